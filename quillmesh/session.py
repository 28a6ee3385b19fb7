"""Sessions, and making this package importable by the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: Session settings that hold unless the application has its own: the bytes that a Python task is handed at a time, and the
#: length of vertex lists that are looked up by the statistics of Parquet row groups and pages.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.pushdown.inFilterThreshold": "4096"}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application; they need not share the driver's folders."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="quillmesh-"), f"{ROOT.name}.zip")
        with zipfile.ZipFile(path, "w") as out:
            for file in sorted(ROOT.rglob("*.py")):
                out.write(file, f"{ROOT.name}/{file.relative_to(ROOT)}")
        context.addPyFile(path)
        for name, value in SETTINGS.items():
            if not context.getConf().contains(name):
                spark.conf.set(name, value)
        _shipped.add(context.applicationId)
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillmesh")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
