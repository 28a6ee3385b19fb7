"""The training-data pipeline: quality rules, near-duplicate join, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`.

Rows are dropped by id where a stage rejects them, so rows that share an id share its fate. Rows whose id is null are judged
in the rules stage like all others; later stages cannot name them and keep them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import stored, table
from quillmesh.llm.decontaminate import build_index, search_index
from quillmesh.llm.ngram_join import ngram_join
from quillmesh.llm.packing import pack
from quillmesh.llm.quality_rules import quality_rules
from quillmesh.llm.suffix_dedup import suffix_dedup
from quillmesh.session import ship
from quillmesh.storage import forget

#: No SQL: the packing stage needs a tokenizer and a curve; tested against brute-force versions of the stages instead.
ORACLE_SQL = None

#: Near copies share at least this share of their word shingles.
NEAR_WORDS, NEAR_PERCENT, NEAR_LEVELS = 5, 80, 3
#: Repeated passages of this many bytes are cut; fifty words are rarely shorter.
REPEAT_BYTES = 250
#: Words that a worker process of the packing stage remembers: fewer than in packing alone, as the other stages' data share its memory.
REMEMBERED = 200_000


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """docs without the ids in `dropped`; those are stored first, so that Spark knows their size and picks the join by it."""
    gone = stored(dropped.where("doc_id is not null").select("doc_id").distinct(), name)
    return docs.join(gone, "doc_id", "left_anti")


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., besides text and lang, and the names they had: other columns may be called anything."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.col("text"), F.col("lang")), names


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    ship(spark)
    renamed, names = _renamed(docs)
    return quality_rules(renamed, carry=tuple(names)).where("kept").select(*[F.col(n).alias(c) for n, c in names.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that are linked by similarity, the one with the smallest id stays."""
    ship(spark)
    groups = ngram_join(docs, n=NEAR_WORDS, percent=NEAR_PERCENT, levels=NEAR_LEVELS)
    return _without(docs, groups.where("doc_id != component_id"), "near-copies")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages are cut out of their texts; the first copy stays."""
    ship(spark)
    renamed, names = _renamed(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    # what is made anew is not carried along
    cut = suffix_dedup(renamed, window=REPEAT_BYTES, keep="first", carry=tuple(n for n, c in names.items() if c not in new), with_text=True)
    return cut.select(*[(new[c] if c in new else F.col(n)).alias(c) for n, c in names.items()])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go, however long they are: one window of an item (or a whole shorter item) is enough."""
    index = build_index(docs)
    found = search_index(index, table(spark, sf_dir, "benchmark"))
    clean = _without(docs, found.where("n_hit > 0"), "contaminated")
    forget(index)  # the ids are stored
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
