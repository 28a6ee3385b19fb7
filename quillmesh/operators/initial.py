"""Initial state: pi and its row mass, theta and beta, from gamma draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.rng import gamma, gamma_value


def gamma_cells(spark: SparkSession, rows: int, cols: int, shape: float, scale: float, salt: str, seed: int) -> DataFrame:
    """(n, k, x): independent gamma draws."""
    cells = spark.range(rows).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("k"))
    return cells.withColumn("x", gamma(shape, scale, salt, seed, F.col("n"), F.col("k")))


def pi_table(spark: SparkSession, n_vertices: int, config: Config) -> DataFrame:
    """(n, pi ARRAY<DOUBLE>, phi_sum): gamma(eta0, eta1) rows, normalised; their mass is kept. Each row is drawn where it is, without a shuffle."""
    draw = lambda k: gamma(config.eta0, config.eta1, "pi", config.seed, F.col("n"), k)
    rows = spark.range(n_vertices).select(F.col("id").alias("n")).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(config.k - 1)), draw))
    mass = rows.withColumn("phi_sum", F.aggregate("x", F.lit(0.0), lambda a, x: a + x))
    return mass.select("n", F.transform("x", lambda x: x / F.col("phi_sum")).alias("pi"), "phi_sum")


def long_form(pi: DataFrame) -> DataFrame:
    """(n, k, p, phi_sum)."""
    return pi.select("n", F.posexplode("pi").alias("k", "p"), "phi_sum")


def theta_rows(config: Config) -> list[tuple[float, float]]:
    """K pairs of gamma(eta0, eta1) draws: small, kept by the driver."""
    return [tuple(gamma_value(config.eta0, config.eta1, "theta", config.seed, k, i) for i in (0, 1)) for k in range(config.k)]


def beta_of(theta: list[tuple[float, float]]) -> list[float]:
    """Each pair's second share."""
    return [t1 / (t0 + t1) for t0, t1 in theta]


def theta_table(spark: SparkSession, theta: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(theta)], "k int, t0 double, t1 double").coalesce(1)


def beta_normalize(theta: DataFrame) -> DataFrame:
    """(k, b0, b1): both shares; beta is b1."""
    return theta.select("k", (F.col("t0") / (F.col("t0") + F.col("t1"))).alias("b0"), (F.col("t1") / (F.col("t0") + F.col("t1"))).alias("b1"))


def theta_sum(theta: DataFrame) -> DataFrame:
    return theta.select("k", (F.col("t0") + F.col("t1")).alias("total"))
