"""Held-out likelihoods, their running mean over evaluations, and perplexity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-30
_EXACT = "decimal(38,20)"


def edge_likelihood(edges: DataFrame, pi_long: DataFrame, beta: DataFrame, epsilon: float) -> DataFrame:
    """edges(u, v, y) -> (u, v, y, l). pi_long(n, k, p), beta(k, b1)."""
    u, v = (pi_long.select(F.col("n").alias(c), "k", F.col("p").alias(f"p{c}")) for c in ("u", "v"))
    rows = edges.join(u, "u").join(v, ["v", "k"]).join(F.broadcast(beta.select("k", "b1")), "k").withColumn("f", F.col("pu") * F.col("pv"))
    sums = rows.groupBy("u", "v", "y").agg(F.sum(F.col("f") * F.col("b1")).alias("fb"), F.sum("f").alias("f"))
    apart = F.col("f") - F.col("fb") + (1 - F.col("f")) * (1 - epsilon)
    return sums.select("u", "v", "y", F.greatest(F.when(F.col("y") == 1, F.col("fb")).otherwise(apart), F.lit(FLOOR)).alias("l"))


def likelihood_arrays(edges: DataFrame, pi: DataFrame, beta: list[float], epsilon: float) -> DataFrame:
    """The same over pi(n, pi ARRAY<DOUBLE>); beta is K numbers."""
    b = F.array(*[F.lit(float(x)) for x in beta])
    u, v = (pi.select(F.col("n").alias(c), F.col("pi").alias(f"p{c}")) for c in ("u", "v"))
    f = edges.join(u, "u").join(v, "v").select("u", "v", "y", F.zip_with("pu", "pv", lambda x, y: x * y).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda s, x: s + x)
    strong = F.aggregate(F.zip_with("f", b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = total - strong + (1 - total) * (1 - epsilon)
    return f.select("u", "v", "y", F.greatest(F.when(F.col("y") == 1, strong).otherwise(apart), F.lit(FLOOR)).alias("l"))


def running_mean(state: DataFrame | None, likelihood: DataFrame, count: int) -> DataFrame:
    """(u, v, y, q): the mean over `count` evaluations, from the mean over the ones before."""
    if state is None or count == 1:
        return likelihood.select("u", "v", "y", F.col("l").alias("q"))
    return state.join(likelihood, ["u", "v", "y"]).select("u", "v", "y", ((F.col("q") * (count - 1) + F.col("l")) / count).alias("q"))


def perplexity_parts(state: DataFrame) -> DataFrame:
    """One row: n_link, n_nonlink, ll_link, ll_nonlink; sums are exact decimals, in any order of partitions."""
    log = F.log("q").cast(_EXACT)
    link = F.col("y") == 1
    return state.agg(
        F.coalesce(F.sum(F.when(link, 1)), F.lit(0)).alias("n_link"), F.coalesce(F.sum(F.when(~link, 1)), F.lit(0)).alias("n_nonlink"),
        F.coalesce(F.sum(F.when(link, log)), F.lit(0)).cast("double").alias("ll_link"), F.coalesce(F.sum(F.when(~link, log)), F.lit(0)).cast("double").alias("ll_nonlink"),
    )


def perplexity(parts: DataFrame) -> DataFrame:
    """The parts and ppx = exp(-mean log-likelihood); 1 without edges."""
    n = F.col("n_link") + F.col("n_nonlink")
    return parts.withColumn("ppx", F.when(n == 0, F.lit(1.0)).otherwise(F.exp(-(F.col("ll_link") + F.col("ll_nonlink")) / F.greatest(n, F.lit(1)))))


def perplexity_value(n: int, log_likelihood: float) -> float:
    return math.exp(-log_likelihood / n) if n else 1.0
