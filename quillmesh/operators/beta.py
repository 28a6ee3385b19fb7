"""Update of the community strengths (theta and beta) from a mini-batch's edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .membership import flag
from .phi import TINY, noise_column, noise_value

_EXACT = "decimal(38,20)"


def theta_gradient(edges: DataFrame, pi_long: DataFrame, theta: DataFrame, train: DataFrame, epsilon: float) -> DataFrame:
    """edges(u, v) -> (k, g0, g1), summed over the edges. pi_long(n, k, p), theta(k, t0, t1)."""
    u, v = (pi_long.select(F.col("n").alias(c), "k", F.col("p").alias(f"p{c}")) for c in ("u", "v"))
    rows = flag(edges, train).join(u, "u").join(v, ["v", "k"]).join(F.broadcast(theta), "k").withColumn("f", F.col("pu") * F.col("pv"))
    total = F.col("t0") + F.col("t1")
    link, beta = F.col("y") == 1, F.col("t1") / total
    rows = rows.withColumn("p", F.when(link, beta).otherwise(1 - beta) * F.col("f"))
    edge = Window.partitionBy("u", "v")
    z = F.sum("p").over(edge) + F.when(link, F.lit(epsilon)).otherwise(F.lit(1 - epsilon)) * (1 - F.sum("f").over(edge))
    rows = rows.withColumn("w", F.col("p") / z)
    g0 = F.col("w") * ((1 - F.col("y")) / F.col("t0") - 1 / total)
    g1 = F.col("w") * (F.col("y") / F.col("t1") - 1 / total)
    return rows.groupBy("k").agg(F.sum(g0).alias("g0"), F.sum(g1).alias("g1"))


def theta_update(gradient: DataFrame, theta: DataFrame, scale: float, config: Config, t: int) -> DataFrame:
    """(k, t0, t1): the new theta."""
    eps, rows = config.step_size(t), gradient.join(theta, "k")

    def new(i: int, eta: float):
        old = F.col(f"t{i}")
        noise = noise_column(config.noise_of_theta, "theta-noise", config.seed, t, F.col("k"), i)
        return F.greatest(F.abs(old + eps / 2 * (eta - old + scale * F.col(f"g{i}")) + F.sqrt(eps * old) * noise), F.lit(TINY)).alias(f"t{i}")

    return rows.select("k", new(0, config.eta0), new(1, config.eta1))


def theta_gradient_arrays(edges: DataFrame, theta: list[tuple[float, float]], epsilon: float) -> list[tuple[float, float]]:
    """edges(y, pu, pv: ARRAY<DOUBLE>) -> the K summed pairs, on the driver.

    Terms are added as decimals: their sum does not depend on the order in which partitions arrive, so a resumed run
    repeats an unbroken one bit by bit.
    """
    beta = F.array(*[F.lit(t1 / (t0 + t1)) for t0, t1 in theta])
    f = edges.select("y", F.zip_with("pu", "pv", lambda a, b: a * b).alias("f"))
    share = F.zip_with("f", beta, lambda x, b: x * F.when(F.col("y") == 1, b).otherwise(1 - b))
    z = F.aggregate(share, F.lit(0.0), lambda s, x: s + x) + F.when(F.col("y") == 1, F.lit(epsilon)).otherwise(F.lit(1 - epsilon)) * (1 - F.aggregate("f", F.lit(0.0), lambda s, x: s + x))
    rows = f.select("y", F.posexplode(share).alias("k", "p"), z.alias("z"))
    w = F.col("p") / F.col("z")
    sums = rows.groupBy("k", "y").agg(F.sum(w.cast(_EXACT)).alias("w")).collect()
    out = [[0.0, 0.0] for _ in theta]
    for k, y, total in sorted((r["k"], r["y"], float(r["w"])) for r in sums):
        t0, t1 = theta[k]
        out[k][0] += total * ((1 - y) / t0 - 1 / (t0 + t1))
        out[k][1] += total * (y / t1 - 1 / (t0 + t1))
    return [tuple(x) for x in out]


def theta_update_rows(theta: list[tuple[float, float]], gradient: list[tuple[float, float]], scale: float, config: Config, t: int) -> list[tuple[float, float]]:
    eps, out = config.step_size(t), []
    for k, (pair, grads) in enumerate(zip(theta, gradient, strict=True)):
        new = []
        for i, (old, g, eta) in enumerate(zip(pair, grads, (config.eta0, config.eta1), strict=True)):
            noise = noise_value(config.noise_of_theta, "theta-noise", config.seed, t, k, i)
            new.append(max(abs(old + eps / 2 * (eta - old + scale * g) + math.sqrt(eps * old) * noise), TINY))
        out.append(tuple(new))
    return out
