"""Graph preparation: canonical edges, dense ids, degrees, adjacency, vertex sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from .numbering import number_rows


def canonical(pairs: DataFrame) -> DataFrame:
    """(u, v) with u < v, without self-loops, nulls or repeats."""
    return pairs.where("u is not null and v is not null and u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def vertex_ids(edges: DataFrame) -> DataFrame:
    """(id, n): the vertices' original ids and their dense numbers from 0, in the order of ids."""
    ids = edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct()
    return number_rows(ids, ["id"], "n").select("id", "n")


def dense(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between dense numbers. The pair is oriented again after renaming."""
    a, b = ids.select(F.col("id").alias("u"), F.col("n").alias("a")), ids.select(F.col("id").alias("v"), F.col("n").alias("b"))
    return edges.join(a, "u").join(b, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def shuffled(edges: DataFrame, seed: int) -> DataFrame:
    """Edges with a random position `pos`, the same for one seed."""
    return number_rows(edges.withColumn("h", uniform("edge", seed, F.col("u"), F.col("v"))), ["h", "u", "v"]).drop("h")


def directed(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, as (n, m)."""
    return edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select("v", "u"))


def degree(edges: DataFrame) -> DataFrame:
    return directed(edges).groupBy("n").agg(F.count(F.lit(1)).alias("degree"))


def max_fan_out(edges: DataFrame) -> DataFrame:
    return degree(edges).agg(F.max("degree").alias("max_fan_out"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(n, neighbors): sorted lists, as long as the vertex's degree. Samplers use the edges themselves instead."""
    return directed(edges).groupBy("n").agg(F.sort_array(F.collect_list("m")).alias("neighbors"))


def neighbors_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, m) of the nodes (n) given."""
    return directed(edges).join(nodes.select("n"), "n")


def random_edge(edges: DataFrame, seed: int, draw: int = 0) -> DataFrame:
    """A uniform vertex with edges, then a uniform one of its edges: one row (n, m), not oriented."""
    ends = directed(edges)
    one = ends.select("n").distinct().orderBy(uniform("random-vertex", seed, draw, F.col("n")), "n").limit(1)
    return ends.join(one, "n").orderBy(uniform("random-neighbor", seed, draw, F.col("m")), "m").limit(1)


def ends_of(edges: DataFrame) -> DataFrame:
    """(n): the distinct ends of a mini-batch's edges."""
    return edges.select(F.col("u").alias("n")).union(edges.select("v")).distinct()
