"""Data-parallel primitives: segmented sum, segmented normalisation, sort, global sums, a row-partitioned matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def segment_sum(df: DataFrame, key: str = "n", value: str = "x", name: str = "total") -> DataFrame:
    """Sum of each segment; partial sums are formed before the shuffle."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


def segment_normalize(df: DataFrame, key: str = "n", value: str = "x", total: str | None = None) -> DataFrame:
    """Each value divided by its segment's sum; with `total`, the sum is returned as well."""
    out = df.withColumn("__s", F.sum(value).over(Window.partitionBy(key))).withColumn(value, F.col(value) / F.col("__s"))
    return out.withColumnRenamed("__s", total) if total else out.drop("__s")


def sort_values(df: DataFrame, value: str = "x") -> DataFrame:
    """All values in ascending order, by a range-partitioned sort."""
    return df.orderBy(value)


def sort_segments(df: DataFrame, key: str = "n", value: str = "x", name: str = "sorted") -> DataFrame:
    """Each segment's values as one sorted array."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def reduce_sums(df: DataFrame, *values: str) -> DataFrame:
    """Global sums of several columns in one pass."""
    return df.agg(*[F.sum(v).alias(v) for v in values])


def matrix(spark: SparkSession, rows: int, cols: int, value, blocks: int | None = None) -> DataFrame:
    """(n, row ARRAY<DOUBLE>): a dense matrix, hash-partitioned by row; value(n, j) is a column expression."""
    out = spark.range(rows).select(F.col("id").alias("n"), F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: value(F.col("id"), j).cast("double")).alias("row"))
    return out.repartition(blocks, "n") if blocks else out


def matrix_row(m: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of a matrix by number: an equi-join, the gather of the model's updates."""
    return nodes.join(m, "n")
