"""Training and held-out sets, and the optional edge set for training perplexity."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import randint
from ..storage import stored
from .graph import directed, shuffled
from .membership import others
from .numbering import number_rows


@dataclass(frozen=True)
class Split:
    n_vertices: int
    n_edges: int
    train: DataFrame
    heldout: DataFrame  # (u, v, y): links, then as many pairs that are no links
    ends: DataFrame | None = None  # (n, m): the training edges in both directions, by vertex

    def by_vertex(self) -> Split:
        """With the training edges of a vertex side by side, so that a few vertices' edges are found without a full scan."""
        lined = directed(self.train).repartitionByRange("n", "m").sortWithinPartitions("n", "m")
        return replace(self, ends=stored(lined, "ends"))

    def incident(self, vertices: list[int]) -> DataFrame:
        """(n, m): the training edges of a few vertices n."""
        here = F.col("n").isin(vertices)
        if self.ends is not None:
            return self.ends.where(here)
        return directed(self.train.where(F.col("u").isin(vertices) | F.col("v").isin(vertices))).where(here)

    @property
    def heldout_links(self) -> DataFrame:
        return self.heldout.where("y = 1").select("u", "v")

    @property
    def heldout_nonlinks(self) -> DataFrame:
        return self.heldout.where("y = 0").select("u", "v")


def heldout_count(n_edges: int, ratio: float) -> int:
    """|E| less ceil((1 - ratio/2) * |E|): the links held out."""
    return n_edges - math.ceil((1 - ratio / 2) * n_edges)


def random_nonlinks(edges: DataFrame, n_vertices: int, count: int, seed: int, salt: str = "non-link") -> DataFrame:
    """`count` distinct oriented pairs that are not in `edges`: hashed draws, no product of the vertices.

    The draws are widened until enough are left; a graph without so many non-links is an error.
    """
    spark = edges.sparkSession
    if count == 0:
        return spark.createDataFrame([], "u long, v long")
    n_edges = edges.count()
    room = n_vertices * (n_vertices - 1) // 2 - n_edges
    if room < count:
        raise ValueError(f"{count} non-links asked for; the graph has {room}")
    free = max(1e-6, room / max(1, n_vertices * (n_vertices - 1) // 2))
    draws = int(count / free * 1.3) + 64
    while True:
        ends = spark.range(draws).select(F.col("id").alias("draw"), randint(n_vertices, salt + "/a", seed, F.col("id")).alias("a"), randint(n_vertices, salt + "/b", seed, F.col("id")).alias("b"))
        pairs = ends.where("a != b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("draw").alias("draw"))
        found = stored(number_rows(others(pairs, edges), ["draw"]).where(F.col("pos") < count).select("u", "v"), "non-links")
        if found.count() == count:
            return found
        draws *= 2


def split_edges(edges: DataFrame, n_vertices: int, ratio: float, seed: int) -> Split:
    """edges(u, v), dense -> the first links in a random order are held out, exactly heldout_count of them."""
    lined = stored(shuffled(edges, seed), "shuffled")
    n_edges = lined.count()
    h = heldout_count(n_edges, ratio)
    links = lined.where(F.col("pos") < h).select("u", "v", F.lit(1).alias("y"))
    train = lined.where(F.col("pos") >= h).select("u", "v")
    nonlinks = random_nonlinks(lined.select("u", "v"), n_vertices, h, seed)
    heldout = stored(links.union(nonlinks.select("u", "v", F.lit(0).alias("y"))), "heldout")
    return Split(n_vertices, n_edges, stored(train, "train"), heldout)


def training_ppx_edges(split: Split, ratio: float, seed: int) -> DataFrame:
    """(u, v, y): the first ratio * |train| training links, and non-links in the graph's proportion."""
    lined = shuffled(split.train, seed + 1)
    links = int(ratio * split.train.count())
    nonlinks = int(links * (split.n_vertices * (split.n_vertices - 1) / 2) / split.n_edges)
    taken = split.train.union(split.heldout.select("u", "v")).distinct()
    room = split.n_vertices * (split.n_vertices - 1) // 2 - taken.count()
    chosen = random_nonlinks(taken, split.n_vertices, min(nonlinks, room), seed, "train-non-link")
    return lined.where(F.col("pos") < links).select("u", "v", F.lit(1).alias("y")).union(chosen.select("u", "v", F.lit(0).alias("y")))
