"""Global row numbers without a global window.

Rows are range-partitioned and sorted by the key; within a partition the position is the low part of
monotonically_increasing_id(), and the partitions' sizes (one row each) are summed up and joined back. No task holds more
than its range, unlike row_number() over an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

_LOW = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with `name`: 0-based position in the order given, which must be total."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    held = stored(lined.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(_LOW)).drop("__id"), "numbered")
    sizes = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return held.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
