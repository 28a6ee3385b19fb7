"""Mini-batch samplers and the neighbour sampler.

A sampler is a function (split, config, step) -> Batch. Draws are functions of (seed, step, vertex), so a step can be taken
again after a failure and gives the same batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config, Strategy
from ..functions.rng import randint, uniform, uniform_value
from ..storage import forget, stored
from .membership import others
from .split import Split

#: Draws of a breadth-first non-link step for each vertex taken from the queue.
BF_DRAWS = 32
#: Vertices looked up in one scan, and draws in vain after which the vertices that are left are ranked instead.
DRAWN_AT_ONCE, MISSES = 64, 4096


@dataclass(frozen=True)
class Batch:
    edges: DataFrame  # (u, v), oriented and distinct
    weight: float  # scale of the gradient


def _draws(salt: str, config: Config, t: int, n_vertices: int) -> Iterator[int]:
    """Random vertices, one after another, drawn on the driver: no pass over the vertices."""
    return (int(uniform_value(salt, config.seed, t, j) * n_vertices) for j in count())


def _oriented(ends: DataFrame) -> DataFrame:
    return ends.select(F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v")).distinct()


def _first_ranked(vertices: DataFrame, salt: str, config: Config, t: int, without: set[int]) -> int | None:
    """The vertex (of n) with the smallest random number that is not in `without`."""
    gone = vertices.sparkSession.createDataFrame([(v,) for v in sorted(without)], "n long")
    found = vertices.join(gone, "n", "left_anti").distinct().orderBy(uniform(salt + "-rank", config.seed, t, F.col("n")), "n").first()
    return found["n"] if found else None


def _first_linked(split: Split, salt: str, config: Config, t: int, without: set[int] = frozenset()) -> int | None:
    """The first random vertex with a training edge that is not in `without`; none if there is none."""
    draws = _draws(salt, config, t, split.n_vertices)
    for _ in range(MISSES // DRAWN_AT_ONCE):
        some = [v for v in islice(draws, DRAWN_AT_ONCE) if v not in without]
        linked = {r["n"] for r in split.incident(sorted(set(some))).select("n").distinct().collect()} if some else set()
        if (found := next((v for v in some if v in linked), None)) is not None:
            return found
    return _first_ranked(split.train.select(F.explode(F.array("u", "v")).alias("n")), salt, config, t, without)


def node_link(split: Split, config: Config, t: int) -> Batch:
    """All training edges of a random vertex that has any. Weight: N."""
    u = _first_linked(split, "node-link", config, t)
    edges = _oriented(split.incident([u])) if u is not None else split.train.select("u", "v").limit(0)
    return Batch(edges, float(split.n_vertices))


def node_non_link(split: Split, config: Config, t: int) -> Batch:
    """m random pairs of one random vertex that are neither training edges nor held out. Weight: 2E/m.

    Others are drawn until m are left; a vertex with fewer free others gives what it has.
    """
    spark, m, n = split.train.sparkSession, config.mini_batch, split.n_vertices
    u = next(_draws("node", config, t, n))
    known = _oriented(split.incident([u])).union(split.heldout.select("u", "v").where((F.col("u") == u) | (F.col("v") == u)))
    draws = 4 * m + 64
    while True:
        drawn = spark.range(draws).select(F.col("id").alias("j"), randint(n, "non-link", config.seed, t, F.col("id")).alias("other")).where(F.col("other") != u)
        pairs = drawn.groupBy("other").agg(F.min("j").alias("j")).select(F.least(F.lit(u), "other").alias("u"), F.greatest(F.lit(u), "other").alias("v"), "j")
        chosen = stored(others(pairs, known).orderBy("j").limit(m).select("u", "v"), "non-link-batch")
        if chosen.count() == m:
            break
        forget(chosen)
        if draws > 8 * (n + m):  # nearly every other vertex is taken: the free ones themselves, ranked
            free = spark.range(n).where(F.col("id") != u).select(F.least(F.lit(u), "id").alias("u"), F.greatest(F.lit(u), "id").alias("v"), uniform("non-link-rank", config.seed, t, F.col("id")).alias("j"))
            chosen = stored(others(free, known).orderBy("j", "u", "v").limit(m).select("u", "v"), "non-link-batch")
            break
        draws *= 8
    return Batch(chosen, 2.0 * split.n_edges / m)


def coin(config: Config, t: int) -> bool:
    return uniform_value("coin", config.seed, t) < 0.5


def node(split: Split, config: Config, t: int) -> Batch:
    return (node_link if coin(config, t) else node_non_link)(split, config, t)


def _pairs(split: Split, rows: list[tuple[int, int]]) -> DataFrame:
    return split.train.sparkSession.createDataFrame(rows, "u long, v long")


def _unvisited(split: Split, visited: set[int], salt: str, config: Config, t: int, linked: bool) -> int | None:
    """The next start of a search."""
    if linked:
        return _first_linked(split, salt, config, t, visited)
    found = next((v for v in islice(_draws(salt, config, t, split.n_vertices), MISSES) if v not in visited), None)
    return found if found is not None else _first_ranked(split.train.sparkSession.range(split.n_vertices).withColumnRenamed("id", "n"), salt, config, t, visited)


def bf_link(split: Split, config: Config, t: int) -> Batch:
    """Training edges met by a breadth-first search from random starts, level by level, until m are found. Weight: E/m.

    Within a level, edges are taken in a random order. A level is one join of the training edges with the frontier, cut to
    what is still wanted; so what the driver holds is bounded by m.
    """
    m, visited, taken, frontier = config.mini_batch, set(), {}, []
    while len(taken) < m:
        if not frontier:
            start = _unvisited(split, visited, "bf-link", config, t, True)
            if start is None:
                break
            frontier = [start]
        visited.update(frontier)
        met = _oriented(split.incident(frontier))
        rows = met.orderBy(uniform("bf-edge", config.seed, t, F.col("u"), F.col("v")), "u", "v").limit(m).collect()
        fresh = [(r["u"], r["v"]) for r in rows if (r["u"], r["v"]) not in taken][: m - len(taken)]
        taken.update(dict.fromkeys(fresh))
        frontier = sorted({x for e in fresh for x in e} - visited)
    return Batch(_pairs(split, list(taken)), split.n_edges / m)


def bf_non_link(split: Split, config: Config, t: int) -> Batch:
    """As bf_link over random pairs: each vertex taken draws up to BF_DRAWS others that it is not linked with. Weight: (N(N-1)/2 - E)/m.

    Held-out pairs are left out as well.
    """
    spark, m, n = split.train.sparkSession, config.mini_batch, split.n_vertices
    known = split.train.union(split.heldout.select("u", "v"))
    visited, taken, frontier, idle = set(), {}, [], 0
    while len(taken) < m and idle < 8:
        if not frontier:
            start = _unvisited(split, visited, "bf-non-link", config, t, False)
            if start is None:
                break
            frontier = [start]
        visited.update(frontier)
        ends = spark.createDataFrame([(x,) for x in frontier], "n long")
        draws = ends.select("n", F.explode(F.sequence(F.lit(0), F.lit(BF_DRAWS - 1))).alias("j")).withColumn("m", randint(n, "bf-draw", config.seed, t, F.col("n"), F.col("j"))).where("n != m")
        free = others(draws.select(F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v"), "n", "j", "m"), known)
        rows = free.groupBy("u", "v").agg(F.min(F.struct("n", "j", "m")).alias("d")).orderBy(uniform("bf-order", config.seed, t, F.col("d.n")), "d.j", "u", "v").limit(2 * m).collect()
        fresh = [r for r in rows if (r["u"], r["v"]) not in taken][: m - len(taken)]
        taken.update(dict.fromkeys((r["u"], r["v"]) for r in fresh))
        idle = 0 if fresh else idle + 1
        frontier = sorted({r["d"]["m"] for r in fresh} - visited)[:m]
    return Batch(_pairs(split, list(taken)), (n * (n - 1) / 2 - split.n_edges) / m)


def bf(split: Split, config: Config, t: int) -> Batch:
    return (bf_link if coin(config, t) else bf_non_link)(split, config, t)


SAMPLERS: dict[Strategy, Callable[[Split, Config, int], Batch]] = {
    Strategy.NODE: node, Strategy.NODE_LINK: node_link, Strategy.NODE_NON_LINK: node_non_link,
    Strategy.BF: bf, Strategy.BF_LINK: bf_link, Strategy.BF_NON_LINK: bf_non_link,
}


def neighbors_of_few(nodes: list[int], n_vertices: int, many: int, seed: int, t: int) -> list[tuple[int, int]]:
    """The pairs (n, m) of `neighbor_sample`, drawn on the driver for a small mini-batch."""
    if many >= n_vertices:
        raise ValueError(f"{many} neighbours asked for of {n_vertices} vertices")
    out = []
    for n in nodes:
        draws = (int(uniform_value("neighbor", seed, t, n, j) * n_vertices) for j in count())
        chosen: dict[int, None] = {}
        while len(chosen) < many:
            if (m := next(draws)) != n:
                chosen[m] = None
        out += [(n, m) for m in chosen]
    return out


def neighbor_sample(nodes: DataFrame, n_vertices: int, many: int, seed: int, t: int) -> DataFrame:
    """(n, m): for each node, `many` distinct vertices other than itself, uniform over all.

    Each node draws more than it needs; the draws are widened in the rare case that some node is left with too few.
    """
    if many >= n_vertices:
        raise ValueError(f"{many} neighbours asked for of {n_vertices} vertices")
    draws = 2 * many + 16
    n_nodes = nodes.count()
    per_node = T.ArrayType(T.LongType())
    while True:
        drawn = nodes.select("n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("j")).withColumn("m", randint(n_vertices, "neighbor", seed, t, F.col("n"), F.col("j"))).where("n != m")
        # array_distinct keeps the first of equal draws, in the order of j
        lined = drawn.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("d"))
        chosen = lined.select("n", F.slice(F.array_distinct(F.transform("d", lambda x: x["m"])), 1, many).cast(per_node).alias("ms"))
        found = stored(chosen, "neighbors")
        if found.where(F.size("ms") == many).count() == n_nodes:
            return found.select("n", F.explode("ms").alias("m"))
        draws *= 2
