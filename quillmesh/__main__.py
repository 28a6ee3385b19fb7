"""Command line: train on an edge list or a stored data set and log held-out perplexity."""

from __future__ import annotations

import argparse
import signal
import threading

from pyspark.sql import SparkSession

from .config import Config, Noise, Strategy
from .operators.graph import canonical, dense, vertex_ids
from .operators.split import split_edges
from .plans.learner import Learner
from .session import ship
from .sources.edges import read_dataset, read_edge_list, write_dataset, write_metrics
from .storage import stored


def parser() -> argparse.ArgumentParser:
    d, p = Config(), argparse.ArgumentParser("quillmesh", description=__doc__)
    p.add_argument("--file", help="edge list: text with white-space separated pairs")
    p.add_argument("--header", type=int, default=4, help="lines to skip at the top of each file")
    p.add_argument("--dump", help="write the canonical data set here and stop")
    p.add_argument("--load", help="read a data set written by --dump")
    p.add_argument("--checkpoint", help="save the model here at the end")
    p.add_argument("--resume", help="go on from this checkpoint")
    p.add_argument("--metrics", help="append evaluations to this JSON folder")
    for name in ("heldout_ratio", "alpha", "a", "b", "c", "epsilon", "eta0", "eta1", "train_ppx_ratio"):
        p.add_argument("--" + name.replace("_", "-"), type=float, default=getattr(d, name))
    for name in ("k", "mini_batch", "neighbors", "ppx_interval", "max_iters", "seed", "compact_every"):
        p.add_argument("--" + name.replace("_", "-"), type=int, default=getattr(d, name))
    p.add_argument("--sample", type=Strategy.parse, default=d.strategy, help=", ".join(s.value for s in Strategy))
    p.add_argument("--noise", type=Noise, default=d.noise, help=", ".join(n.value for n in Noise))
    p.add_argument("--no-prefetch", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = ship(SparkSession.builder.appName("quillmesh").getOrCreate())
    names = ("heldout_ratio", "alpha", "a", "b", "c", "epsilon", "eta0", "eta1", "train_ppx_ratio", "k", "mini_batch", "neighbors", "ppx_interval", "max_iters", "seed", "compact_every", "noise")
    config = Config(**{n: getattr(args, n) for n in names}, strategy=args.sample, prefetch=not args.no_prefetch)
    if args.resume:
        learner = Learner.load(spark, args.resume)
    else:
        if args.load:
            edges, meta = read_dataset(spark, args.load)
            config = config.with_(heldout_ratio=meta["heldout_ratio"])
            learner = Learner(split_edges(edges, meta["n_vertices"], config.heldout_ratio, config.seed), config)
        elif args.file:
            clean = stored(canonical(read_edge_list(spark, args.file, args.header)), "edges")
            if args.dump:
                ids = stored(vertex_ids(clean), "ids")
                write_dataset(dense(clean, ids), args.dump, ids.count(), config.heldout_ratio)
                return 0
            learner = Learner.from_edges(clean, config)
        else:
            parser().error("one of --file, --load, --resume is needed")
    print(learner.config.describe())
    stopped: list[int] = []
    before = signal.signal(signal.SIGINT, lambda *_: stopped.append(1)) if threading.current_thread() is threading.main_thread() else None
    try:
        history = learner.fit(args.max_iters, lambda: bool(stopped))
    finally:
        if before is not None:
            signal.signal(signal.SIGINT, before)
    for row in history:
        print(f"ppx[{row['step']}] = {row['ppx']:.6f} (links {row['n_link']}: {row['ll_link']:.4f}, non-links {row['n_nonlink']}: {row['ll_nonlink']:.4f})")
    for phase, seconds in learner.stats().items():
        print(f"{phase}: {seconds:.2f} s")
    if args.checkpoint:
        learner.save(args.checkpoint)
    if args.metrics:
        write_metrics(spark, learner.history, args.metrics)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
