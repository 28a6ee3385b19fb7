"""The inference loop: sample, update memberships, update strengths, evaluate; checkpoints that resume exactly."""

from __future__ import annotations

import json
import time
from collections import defaultdict
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.beta import theta_gradient_arrays, theta_update_rows
from ..operators.evaluate import likelihood_arrays, perplexity_parts, perplexity_value, running_mean
from ..operators.graph import canonical, dense, ends_of, vertex_ids
from ..operators.initial import beta_of, pi_table, theta_rows
from ..operators.membership import members
from ..operators.phi import arrow_step, overlay
from ..operators.samplers import SAMPLERS, Batch, neighbor_sample, neighbors_of_few
from ..operators.split import Split, split_edges, training_ppx_edges
from ..sources.edges import metrics
from ..storage import forget, stored

#: Rows up to which a mini-batch's side of a join is broadcast, and pairs up to which it is held by the driver; counted, not guessed.
BROADCAST_ROWS, DRIVER_PAIRS = 500_000, 50_000
#: Vertices that are looked up by a list in the filter.
LISTED = 4096


@dataclass(frozen=True)
class Sample:
    """A mini-batch with flagged edges (u, v, y) and flagged pairs (n, m, y) of its nodes and their neighbours."""

    batch: Batch
    pairs: DataFrame
    n_nodes: int
    few: bool
    listed: list[int] | None = None


class PiStore:
    """The membership table: a base and the few rows changed since, merged every `compact_every` steps.

    A mini-batch changes few rows, so a step does not write the whole table again.
    """

    def __init__(self, base: DataFrame, compact_every: int):
        self.base, self.delta, self.changes, self.compact_every, self.held = base, None, 0, compact_every, 0

    def table(self) -> DataFrame:
        return self.base if self.delta is None else overlay(self.base, self.delta, self.held <= BROADCAST_ROWS)

    def rows(self, nodes: DataFrame, few: bool, listed: list[int] | None = None) -> DataFrame:
        """nodes(n, ...), with repeats, and their rows. A short list of the numbers spares reading most of the table, which is in their order."""
        base = self.base if listed is None or len(listed) > LISTED else self.base.where(F.col("n").isin(listed))
        found = base.join(F.broadcast(nodes) if few else nodes, "n")
        return found if self.delta is None else overlay(found, self.delta, self.held <= BROADCAST_ROWS)

    def apply(self, new: DataFrame, n_new: int) -> None:
        """`held` is a bound of the changed rows; while they are few, merging them does not shuffle the table and keeps its order."""
        old, base = self.delta, None
        self.held += n_new
        self.delta = new if old is None else stored(old.join(new, "n", "left_anti").unionByName(new), "pi-delta")
        self.changes += 1
        if self.changes % self.compact_every == 0:
            few = self.held <= BROADCAST_ROWS
            merged = overlay(self.base, self.delta, few)
            base, self.base = self.base, stored(merged if few else merged.repartitionByRange("n").sortWithinPartitions("n"), "pi")
            forget(self.delta)
            self.delta, self.held = None, 0
        for gone in (old, base):
            forget(gone)


class Learner:
    """Overlapping communities of one undirected graph.

    fit() or step() trains; heldout_perplexity() evaluates (each call is one term of the running mean); memberships() and
    strengths() return the model; save() and load() keep it.
    """

    def __init__(self, split: Split, config: Config, ids: DataFrame | None = None, sampler=None):
        if config.neighbors >= split.n_vertices:
            raise ValueError(f"{config.neighbors} neighbours of {split.n_vertices} vertices")
        self.split, self.config, self.ids = split.by_vertex(), config, ids
        self.spark: SparkSession = split.train.sparkSession
        self.sampler = sampler or SAMPLERS[config.strategy]
        self.pi = PiStore(stored(pi_table(self.spark, split.n_vertices, config), "pi"), config.compact_every)
        self.theta = theta_rows(config)
        self.steps, self.evaluations, self.train_evaluations = 0, 0, 0
        self.ppx_state: DataFrame | None = None
        self.train_ppx_state: DataFrame | None = None
        self.train_ppx_set: DataFrame | None = None
        self.history: list[dict] = []
        self.seconds: dict[str, float] = defaultdict(float)
        self._next: tuple[int, Future] | None = None
        self._pool = ThreadPoolExecutor(1) if config.prefetch else None

    @classmethod
    def from_edges(cls, edges: DataFrame, config: Config, sampler=None) -> Learner:
        """edges(u, v) with any ids; self-loops and repeats are dropped."""
        clean = stored(canonical(edges), "edges")
        ids = stored(vertex_ids(clean), "ids")
        return cls(split_edges(dense(clean, ids), ids.count(), config.heldout_ratio, config.seed), config, ids, sampler)

    @contextmanager
    def _timed(self, phase: str):
        began = time.perf_counter()
        yield
        self.seconds[phase] += time.perf_counter() - began

    # sampling

    def _sample(self, t: int) -> Sample:
        batch, c = self.sampler(self.split, self.config, t), self.config
        batch = Batch(stored(batch.edges, "batch"), batch.weight)
        most = DRIVER_PAIRS // (c.neighbors + 1)
        some = batch.edges.limit(most + 1).collect()
        if len(some) <= most:  # a small mini-batch: its pairs are drawn here, and it takes one pass over the training edges to flag them
            edges = sorted((r["u"], r["v"]) for r in some)
            nodes = sorted({x for e in edges for x in e})
            if len(nodes) * (c.neighbors + 1) <= DRIVER_PAIRS:
                pairs = neighbors_of_few(nodes, self.split.n_vertices, c.neighbors, c.seed, t)
                linked = self._linked({(min(p), max(p)) for p in [*pairs, *edges]})
                make = lambda rows, names: self.spark.createDataFrame([(*p, int((min(p), max(p)) in linked)) for p in rows], f"{names[0]} long, {names[1]} long, y int")
                forget(batch.edges)
                return Sample(Batch(make(edges, "uv"), batch.weight), make(pairs, "nm"), len(nodes), True, sorted({*nodes, *(m for _, m in pairs)}))
        nodes = stored(ends_of(batch.edges), "batch-nodes")
        n = nodes.count()
        few = n * (c.neighbors + 1) <= BROADCAST_ROWS
        neighbors = neighbor_sample(nodes, self.split.n_vertices, c.neighbors, c.seed, t)
        flagged = stored(self._flagged(batch.edges, "u", "v", few), "batch-flagged")
        forget(batch.edges), forget(nodes)
        return Sample(Batch(flagged, batch.weight), stored(self._flagged(neighbors, "n", "m", few), "neighbors-flagged"), n, few)

    def _linked(self, pairs: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """Those of a few oriented pairs that are training edges."""
        if not pairs:
            return set()
        asked, firsts = F.broadcast(self.spark.createDataFrame(sorted(pairs), "n long, m long")), sorted({u for u, _ in pairs})
        known = self.split.incident(firsts) if len(firsts) <= LISTED else self.split.ends
        return {(r["n"], r["m"]) for r in known.join(asked, ["n", "m"]).collect()}

    def _taken(self, t: int) -> Sample:
        """The sample of step t; that of step t + 1 begins meanwhile, as samplers do not read the model."""
        if self._pool is None:
            return self._sample(t)
        held = self._next if self._next and self._next[0] == t else (t, self._pool.submit(self._sample, t))
        got = held[1].result()
        self._next = (t + 1, self._pool.submit(self._sample, t + 1))
        return got

    def _flagged(self, pairs: DataFrame, a: str, b: str, few: bool) -> DataFrame:
        """pairs with y; the training edges are the streamed side, so that they are not shuffled for a small batch."""
        sides = pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
        known = self.split.train.join(F.broadcast(sides) if few else sides, ["u", "v"]) if few else members(sides, self.split.train)
        hit = known.select(F.col("u").alias("__u"), F.col("v").alias("__v"), F.lit(1).alias("__y"))
        joined = pairs.withColumn("__u", F.least(a, b)).withColumn("__v", F.greatest(a, b)).join(hit, ["__u", "__v"], "left")
        return joined.withColumn("y", F.coalesce("__y", F.lit(0))).drop("__u", "__v", "__y")

    # one update

    def step(self) -> None:
        t = self.steps + 1
        with self._timed("sample"):
            got = self._taken(t)
        if got.n_nodes:
            with self._timed("phi"):
                # one pass over the memberships gathers the rows of both sides
                pairs = got.pairs.select("n", "m", "y")
                roles = pairs.unionByName(pairs.select("n", F.col("n").alias("m"), F.lit(None).cast("int").alias("y")).distinct())
                rows = self.pi.rows(roles.withColumnRenamed("n", "of").withColumnRenamed("m", "n"), got.few, got.listed)
                both = rows.groupBy(F.col("of").alias("n")).agg(
                    F.first(F.when(F.col("y").isNull(), F.struct("pi", "phi_sum")), True).alias("own"),
                    F.collect_list(F.when(F.col("y").isNotNull(), F.struct(F.col("n").alias("m"), "y", F.col("pi").alias("pb")))).alias("nb"),
                )
                gathered = both.select("n", "own.pi", "own.phi_sum", "nb")
                new = stored(arrow_step(gathered, beta_of(self.theta), self.split.n_vertices, self.config, t), "pi-new")
            with self._timed("theta"):
                # strengths are updated from the new memberships; all ends of the batch's edges have just been updated
                u, v = (new.select(F.col("n").alias(c), F.col("pi").alias(f"p{c}")) for c in ("u", "v"))
                edges = got.batch.edges.join(u, "u").join(v, "v").select("y", "pu", "pv")
                grads = theta_gradient_arrays(edges, self.theta, self.config.epsilon)
                self.theta = theta_update_rows(self.theta, grads, got.batch.weight, self.config, t)
            with self._timed("pi"):
                self.pi.apply(new, got.n_nodes)
            forget(got.pairs), forget(got.batch.edges)
        self.steps = t

    def run(self, steps: int, stop=None) -> int:
        """Up to `steps` updates; stop() is asked before each. Returns how many were made."""
        for i in range(steps):
            if stop and stop():
                return i
            self.step()
        return steps

    def fit(self, max_iters: int | None = None, stop=None) -> list[dict]:
        """Evaluate, then train and evaluate every ppx_interval steps."""
        left = self.config.max_iters if max_iters is None else max_iters
        self.heldout_perplexity()
        while left > 0 and not (stop and stop()):
            made = self.run(min(left, self.config.ppx_interval), stop)
            left -= max(1, made)
            self.heldout_perplexity()
        return self.history

    # evaluation

    def _evaluate(self, edges: DataFrame, state: DataFrame | None, count: int) -> tuple[DataFrame, dict]:
        # only the rows of the edges' ends meet the edges
        ends = ends_of(edges)
        rows = self.pi.rows(ends, 2 * edges.count() <= BROADCAST_ROWS).select("n", "pi")
        likely = likelihood_arrays(edges, rows, beta_of(self.theta), self.config.epsilon)
        new = stored(running_mean(state, likely, count), "ppx")
        forget(state)
        row = perplexity_parts(new).first().asDict()
        row["ppx"] = perplexity_value(row["n_link"] + row["n_nonlink"], row["ll_link"] + row["ll_nonlink"])
        return new, row | {"step": self.steps}

    def heldout_perplexity(self) -> float:
        with self._timed("perplexity"):
            self.evaluations += 1
            self.ppx_state, row = self._evaluate(self.split.heldout, self.ppx_state, self.evaluations)
        self.history.append(row)
        return row["ppx"]

    def training_perplexity(self) -> float:
        with self._timed("training perplexity"):
            if self.train_ppx_set is None:
                self.train_ppx_set = stored(training_ppx_edges(self.split, self.config.train_ppx_ratio, self.config.seed), "train-ppx")
            self.train_evaluations += 1
            self.train_ppx_state, row = self._evaluate(self.train_ppx_set, self.train_ppx_state, self.train_evaluations)
        return row["ppx"]

    # results

    def memberships(self) -> DataFrame:
        """(n, pi, phi_sum), with the original id where it is known."""
        table = self.pi.table()
        return table if self.ids is None else table.join(self.ids, "n").select("id", "n", "pi", "phi_sum")

    def strengths(self) -> DataFrame:
        return self.spark.createDataFrame([(k, a, b, b / (a + b)) for k, (a, b) in enumerate(self.theta)], "k int, t0 double, t1 double, beta double")

    def metrics(self) -> DataFrame:
        return metrics(self.spark, self.history)

    def stats(self) -> dict[str, float]:
        """Seconds spent in each phase."""
        return dict(self.seconds)

    # checkpoints

    def save(self, path: str) -> None:
        """Everything a later run needs; draws are functions of the step, so no generator state is kept."""
        tables = {"pi": self.pi.table(), "train": self.split.train, "heldout": self.split.heldout, "ids": self.ids, "ppx_state": self.ppx_state, "train_ppx_set": self.train_ppx_set, "train_ppx_state": self.train_ppx_state}
        for name, df in tables.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {
            "config": self.config.to_dict(), "theta": self.theta, "steps": self.steps, "evaluations": self.evaluations, "train_evaluations": self.train_evaluations, "history": self.history,
            "n_vertices": self.split.n_vertices, "n_edges": self.split.n_edges, "tables": [n for n, df in tables.items() if df is not None],
        }
        # the metadata is written last: a directory without it is no checkpoint
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, sampler=None) -> Learner:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}
        config = Config.from_dict(meta["config"])
        new = cls.__new__(cls)
        new.spark, new.config, new.ids = spark, config, tables.get("ids")
        new.split = Split(meta["n_vertices"], meta["n_edges"], tables["train"], tables["heldout"]).by_vertex()
        shape = tables["pi"].agg(F.count(F.lit(1)), F.min(F.size("pi")), F.max(F.size("pi"))).first()
        if tuple(shape) != (meta["n_vertices"], config.k, config.k) or len(meta["theta"]) != config.k:
            raise ValueError(f"{path}: memberships are {tuple(shape)}, not {meta['n_vertices']} rows of {config.k}")
        new.sampler = sampler or SAMPLERS[config.strategy]
        # copies in the shared folder: a later save to the same path does not overwrite what is being read
        new.pi = PiStore(stored(tables["pi"].repartitionByRange("n").sortWithinPartitions("n"), "pi"), config.compact_every)
        new.theta = [tuple(x) for x in meta["theta"]]
        new.steps, new.evaluations, new.train_evaluations, new.history = meta["steps"], meta["evaluations"], meta["train_evaluations"], meta["history"]
        new.ppx_state, new.train_ppx_set, new.train_ppx_state = (stored(tables[n], n) if n in tables else None for n in ("ppx_state", "train_ppx_set", "train_ppx_state"))
        new.seconds, new._next = defaultdict(float), None
        new._pool = ThreadPoolExecutor(1) if config.prefetch else None
        return new
