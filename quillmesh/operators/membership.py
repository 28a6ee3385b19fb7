"""Membership of pairs in an edge set. Pairs are oriented before they are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _oriented(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("__u", F.least(a, b)).withColumn("__v", F.greatest(a, b))


def _set(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("__u"), F.col("v").alias("__v"))


def flag(pairs: DataFrame, edges: DataFrame, a: str = "u", b: str = "v", name: str = "y") -> DataFrame:
    """pairs with `name`: 1 if the pair is an edge, else 0. `edges` has no repeats."""
    known = _set(edges).withColumn("__y", F.lit(1))
    return _oriented(pairs, a, b).join(known, ["__u", "__v"], "left").withColumn(name, F.coalesce("__y", F.lit(0))).drop("__u", "__v", "__y")


def members(pairs: DataFrame, edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    return _oriented(pairs, a, b).join(_set(edges), ["__u", "__v"], "left_semi").drop("__u", "__v")


def others(pairs: DataFrame, edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    return _oriented(pairs, a, b).join(_set(edges), ["__u", "__v"], "left_anti").drop("__u", "__v")
