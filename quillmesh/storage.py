"""Durable intermediates in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where none is named, and then only on a single machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str, by: str | None = None, narrow: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps survive a lost executor without recomputing it.

    by: a column of few values; where one of them is asked for, only its files are read.
    narrow: of rows so short that a file for every partition would be mostly overhead: a few files for each core are written.
    """
    spark = ship(df.sparkSession)
    df = df.coalesce(4 * max(1, spark.sparkContext.defaultParallelism)) if narrow else df
    path = f"{shared_dir(spark)}/quillmesh/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if by:
        with settings(spark, spark__sql__maxConcurrentOutputFileWriters="16"):  # instead of a sort by the column
            writer.partitionBy(by).parquet(path)
    else:
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(spark: SparkSession, make: Callable[[int], DataFrame], parts: int, name: str) -> DataFrame:
    """make(0), make(1), ... in one stored table. Each is written, and its shuffle files released, before the next is made."""
    path = f"{shared_dir(ship(spark))}/quillmesh/{name}-{uuid.uuid4().hex}"
    for i in range(parts):
        df = make(i)
        df.write.option("compression", "zstd").mode("append").parquet(path)
        schema = df.schema
        del df
        release(spark)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for a few statements; `__` stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now, not when the driver next happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame | None) -> None:
    """Remove the files of a stored table that is no longer needed."""
    if df is None:
        return
    context = df.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    for file in df.inputFiles():
        if "/quillmesh/" in file:
            base, _, rest = file.rpartition("/quillmesh/")
            folder = hadoop.Path(f"{base}/quillmesh/{rest.split('/', 1)[0]}")
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
            return
