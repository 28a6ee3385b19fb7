"""Update of the memberships (phi and pi) of a mini-batch's vertices.

Two formulations of one operator. The long form, rows (n, m, k), is plain joins and aggregates that Catalyst plans as one;
the Arrow form hands whole ARRAY<DOUBLE> rows to numpy and is quicker in a training loop. All gradients read the old pi; the
new rows are applied together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Noise
from ..functions.rng import normal, normal_value
from .membership import flag

TINY = 1e-24


def noise_column(kind: Noise, salt: str, *keys) -> Column:
    return {Noise.ZERO: lambda: F.lit(0.0), Noise.ONE: lambda: F.lit(1.0), Noise.GAUSSIAN: lambda: normal(salt, *keys)}[kind]()


def noise_value(kind: Noise, salt: str, *keys) -> float:
    return {Noise.ZERO: lambda: 0.0, Noise.ONE: lambda: 1.0, Noise.GAUSSIAN: lambda: normal_value(salt, *keys)}[kind]()


def phi_gradient(pairs: DataFrame, pi_long: DataFrame, beta: DataFrame, train: DataFrame, epsilon: float) -> DataFrame:
    """pairs(n, m) -> (n, k, g): the sum over each node's neighbours.

    pi_long(n, k, p, phi_sum), beta(k, b1).
    """
    seen = flag(pairs, train, "n", "m")
    a = pi_long.select("n", "k", F.col("p").alias("pa"), F.col("phi_sum").alias("s"))
    b = pi_long.select(F.col("n").alias("m"), "k", F.col("p").alias("pb"))
    rows = seen.join(a, "n").join(b, ["m", "k"]).join(F.broadcast(beta.select("k", "b1")), "k")
    link = F.col("y") == 1
    f = F.when(link, F.col("b1") - epsilon).otherwise(epsilon - F.col("b1"))
    e = F.when(link, F.lit(epsilon)).otherwise(F.lit(1 - epsilon))
    p = rows.withColumn("pr", F.col("pa") * (F.col("pb") * f + e))
    share = F.col("pr") / F.sum("pr").over(Window.partitionBy("n", "m"))
    return p.withColumn("g", share / (F.col("pa") * F.col("s")) - 1 / F.col("s")).groupBy("n", "k").agg(F.sum("g").alias("g"))


def phi_update(gradient: DataFrame, pi_long: DataFrame, n_vertices: int, config: Config, t: int) -> DataFrame:
    """(n, k, phi): the staged new phi of the nodes in `gradient`."""
    eps = config.step_size(t)
    rows = gradient.join(pi_long, ["n", "k"]).withColumn("phi", F.col("p") * F.col("phi_sum"))
    drift = eps / 2 * (config.prior - F.col("phi") + (n_vertices / config.neighbors) * F.col("g"))
    noise = F.sqrt(eps * F.col("phi")) * noise_column(config.noise, "phi-noise", config.seed, t, F.col("n"), F.col("k"))
    return rows.select("n", "k", F.greatest(F.abs(F.col("phi") + drift + noise), F.lit(TINY)).alias("phi"))


def pi_update(phi: DataFrame) -> DataFrame:
    """(n, k, p, phi_sum) of the updated nodes."""
    total = F.sum("phi").over(Window.partitionBy("n"))
    return phi.select("n", "k", (F.col("phi") / total).alias("p"), total.alias("phi_sum"))


def overlay(pi: DataFrame, new: DataFrame, few: bool = False) -> DataFrame:
    """pi(n, pi, phi_sum, ...) with the rows of `new` in place of the old ones; a few are broadcast, which keeps pi's order."""
    fresh = new.select("n", F.col("pi").alias("__pi"), F.col("phi_sum").alias("__s"))
    joined = pi.join(F.broadcast(fresh) if few else fresh, "n", "left")
    return joined.withColumns({"pi": F.coalesce("__pi", "pi"), "phi_sum": F.coalesce("__s", "phi_sum")}).drop("__pi", "__s")


def phi_step_rows(pa_: np.ndarray, s: np.ndarray, pb: np.ndarray, y: np.ndarray, first: np.ndarray, beta: np.ndarray, epsilon: float) -> np.ndarray:
    """The gradients of nodes (rows of pa_, with masses s) from their neighbours' rows, those of a node from its `first` on."""
    of = np.repeat(np.arange(len(pa_)), np.diff(np.append(first, len(pb))))
    link = y[:, None] == 1
    p = pa_[of] * (pb * np.where(link, beta - epsilon, epsilon - beta) + np.where(link, epsilon, 1 - epsilon))
    mass = s[of, None]
    return np.add.reduceat(p / p.sum(axis=1, keepdims=True) / (pa_[of] * mass) - 1 / mass, first, axis=0)


def _rows(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def arrow_step(gathered: DataFrame, beta: list[float], n_vertices: int, config: Config, t: int) -> DataFrame:
    """gathered(n, pi, phi_sum, nb array<struct<m, y, pb>>) -> (n, pi, phi_sum): gradient, update and normalisation.

    Each node has a neighbour. They are put in the order of m, so that a rerun adds up the same bits.
    """
    eps, b, k = config.step_size(t), np.array(beta), config.k
    draw = lambda i: noise_column(config.noise, "phi-noise", config.seed, t, F.col("n"), i)
    noisy = gathered.withColumn("nb", F.array_sort("nb")).withColumn("noise", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), draw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nb = batch["nb"]
            at = nb.offsets.to_numpy()
            of = nb.flatten()
            row, s = _rows(batch["pi"], k), batch["phi_sum"].to_numpy()
            g = phi_step_rows(row, s, _rows(of.field("pb"), k), of.field("y").to_numpy(), at[:-1] - at[0], b, config.epsilon)
            phi = row * s[:, None]
            phi = np.maximum(np.abs(phi + eps / 2 * (config.prior - phi + n_vertices / config.neighbors * g) + np.sqrt(eps * phi) * _rows(batch["noise"], k)), TINY)
            mass = phi.sum(axis=1)
            pi = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * k), pa.array((phi / mass[:, None]).ravel()))
            yield pa.RecordBatch.from_arrays([batch["n"], pi, pa.array(mass)], names=["n", "pi", "phi_sum"])

    return noisy.select("n", "pi", "phi_sum", "nb", "noise").mapInArrow(run, "n long, pi array<double>, phi_sum double")
