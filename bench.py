"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quillmesh import queries as engine  # noqa: E402
from quillmesh.config import Config, Strategy  # noqa: E402
from quillmesh.plans.learner import Learner  # noqa: E402
from quillmesh.session import local_session, ship  # noqa: E402
from quillmesh.sources.edges import customer_supplier  # noqa: E402

HEADLINE = ("edges_dense", "adjacency", "split_counts", "membership_flag", "neighbor_sample", "segment_normalize", "phi_gradient", "theta_gradient", "heldout_perplexity")


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = ship(local_session(cpus, int(cpus), os.environ.get("BENCH_MEMORY", "8g")))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        engine.queries()[name](spark, where).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    config = Config(k=32, mini_batch=32, neighbors=32, strategy=Strategy.NODE)
    began = time.perf_counter()
    learner = Learner.from_edges(customer_supplier(spark, where), config)
    seconds["learner_setup"] = round(time.perf_counter() - began, 3)
    learner.run(1)
    began = time.perf_counter()
    learner.run(5)
    seconds["train_iteration"] = round((time.perf_counter() - began) / 5, 3)
    began = time.perf_counter()
    ppx = learner.heldout_perplexity()
    seconds["evaluation"] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(where).name, "heldout_perplexity": round(ppx, 6)}))


if __name__ == "__main__":
    main()
