"""Queries that apply each operator, with production parameters, to its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .common import table
from .cotraining import cotraining
from .decontaminate import decontaminate
from .html_main import extract_main
from .ngram_join import ngram_join
from .packing import pack
from .quality_rules import quality_rules
from .sharding import shard
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .url_filter import url_filter

#: Places by which the terms of a proximity match may be off.
SLOP = 2
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_passages=True).drop("removed")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_js", "word_js")})


def op3_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "n_near")


def near_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_decontaminate, whose SQL has exact phrases only, and n_near."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP).drop("items")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") or name in ("near_decontaminate", "pipeline")}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": oracle.suffix_dedup(),
        "op2_quality_rules": oracle.quality_rules(0.3, 0.31, 200, 100),
        "op6_decontaminate": oracle.decontaminate(),
        "op7_ngram_join": oracle.ngram_join(),
        "op9_url_filter": oracle.url_filter(RULES),
    }
