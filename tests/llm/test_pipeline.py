"""The pipeline's stages on planted documents, each against its plain version."""

import random

import pytest
from pyspark.sql import functions as F

from . import brute
from .conftest import SHAPE, prose

pytest.importorskip("public_tokenizers")
cp = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("planted"))
    passage, item = prose(1, 80), prose(2, 30)
    rows = [(i, prose(10 + i, 150), "en", "s", 0) for i in range(60)]  # clean
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(5)]  # exact copies
    for i in range(5):  # near copies
        words = rows[10 + i][1].split()
        words[random.Random(i).randrange(20, 100)] = "changed"
        rows.append((110 + i, " ".join(words), "en", "s", 0))
    rows += [(120 + i, prose(400 + i, 120) + " " + passage + " " + prose(500 + i, 120), "en", "s", 0) for i in range(6)]  # repeats
    rows += [(130 + i, prose(600 + i, 120) + " " + item + " " + prose(700 + i, 90), "en", "s", 0) for i in range(3)]  # leaks
    rows += [(140, None, None, None, None), (141, "", "en", "s", 0), (142, "too short", "en", "s", 0), (143, "spam " * 200, "en", "s", 0)]
    rows += [(144, " ".join(w + "%%$$" for w in prose(900, 200).split()), "en", "s", 0)]
    spark.createDataFrame(rows, SHAPE).repartition(3).sortWithinPartitions("doc_id").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r[1] for r in rows}, passage


def staged(spark, d, upto):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = docs
    for _, stage in cp.STAGES[:upto]:
        before, docs = docs, cp.stored(stage(spark, docs, d), "stage")
    return {r["doc_id"]: r["text"] for r in before.collect()}, docs


def test_rules_stage(spark, planted):
    d, texts, _ = planted
    _, out = staged(spark, d, 1)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert not {140, 141, 142, 143, 144} & kept.keys()
    assert all(not brute.quality_base(t)[-1] for t in kept.values())
    assert kept == {i: t for i, t in texts.items() if i < 140}


def test_join_stage(spark, planted):
    d, _, _ = planted
    before, out = staged(spark, d, 2)
    groups = brute.jaccard_join(list(before.items()), cp.NEAR_PERCENT, cp.NEAR_WORDS)
    assert {r["doc_id"] for r in out.collect()} == {i for i, _, c in groups if i == c}
    assert not {*range(100, 120)} & {r["doc_id"] for r in out.collect()}


def test_repeats_stage(spark, planted):
    d, _, passage = planted
    before, out = staged(spark, d, 3)
    after = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.keys() == before.keys()
    assert sum(passage in t for t in before.values()) == 6 and sum(passage in t for t in after.values()) == 1
    assert all(after[i] == t for i, t in before.items() if i < 100)
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0


def test_benchmark_stage(spark, planted):
    d, _, _ = planted
    before, out = staged(spark, d, 4)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    hit = {i for (i, t), x in zip(before.items(), brute.decontaminate(list(before.values()), items)) if x[-1]}
    assert {r["doc_id"] for r in out.collect()} == before.keys() - hit and {130} <= hit and not {i for i in hit if i < 100}


def test_run(spark, planted):
    d, _, _ = planted
    before, out = staged(spark, d, 5)
    pieces = out.collect()
    assert {p["doc_id"] for p in pieces} == before.keys()
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows)
    assert key(cp.run(spark, d).collect()) == key(pieces)


def test_stages_of_an_empty_table(spark, planted, tmp_path):
    d, _, _ = planted
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_of_odd_rows(spark, planted, docs, rows, tmp_path):
    """Nulls, repeats and other columns pass through all stages."""
    d, _, _ = planted
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(cp.STAGES):
        out = cp.stored(stage(spark, table, str(tmp_path)), "odd")
        assert i == 4 or out.columns == table.columns
        assert out.count() <= table.count() or i == 4
        table = out


def test_benchmarks_in_long_documents_go(spark, planted):
    d, _, _ = planted
    item = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    part = " ".join(item.split()[:13])
    rows = [(1, prose(801, 2000) + " " + item + " " + prose(802, 2000), "en", "s", 0), (2, prose(803, 4000), "en", "s", 0)]
    rows += [(3, prose(804, 3000) + " " + part, "en", "s", 0), (4, prose(805, 300) + " " + " ".join(item.split()[:12]), "en", "s", 0)]
    out = cp.without_benchmarks(spark, spark.createDataFrame(rows, SHAPE), d)
    assert {r["doc_id"] for r in out.collect()} == {2, 4}


def shuffled(spark, first):
    """Bytes that stages from number `first` on have written to shuffles, and the next stage's number."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() >= first), max([-1, *(s.stageId() for s in stages)]) + 1


def test_repeats_stage_moves_the_texts_with_repeats_only(spark, planted, tmp_path, monkeypatch):
    """Texts in which nothing repeats are stored once, compressed, and are not shuffled; the same at every size, so without broadcasts."""
    from quillmesh.llm import suffix_dedup

    d, _, _ = planted
    passage, wide = prose(1, 80), random.Random(3)
    rows = [(i, "".join(chr(wide.randrange(0x4E00, 0x9000)) for _ in range(6000)), "zh", "s", 6000) for i in range(60)]
    rows += [(100 + i, prose(400 + i, 120) + " " + passage + " " + prose(500 + i, 120), "en", "s", 0) for i in range(6)]
    spark.createDataFrame(rows, SHAPE).repartition(3).sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    docs, made = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}

    def noted(df, name, *args, **kwargs):
        made[name] = df.columns
        return cp.stored(df, name, *args, **kwargs)

    monkeypatch.setattr(suffix_dedup, "stored", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = shuffled(spark, 0)[1]
        out = {r["doc_id"]: r["text"] for r in cp.without_repeats(spark, docs, d).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # what tells segments apart takes 1.2 MB; with the texts, of 1.1 MB, it was 3.9 MB
    assert shuffled(spark, first)[0] < 1.5 * 60 * 18000
    assert [c for c in made["anchors"] if c.startswith("k")] == ["k0", "k1", "k2"]  # doc_id, lang, source
    assert all(out[i] == t for i, t, *_ in rows if i < 100) and sum(passage in t for t in out.values()) == 1 and len(out) == len(rows)


def test_benchmark_stage_leaves_no_index(spark, planted):
    from pathlib import Path

    from quillmesh.storage import shared_dir

    d, texts, _ = planted
    folder = Path(shared_dir(spark).removeprefix("file://"), "quillmesh")
    before = {*folder.glob("postings-*")}
    out = cp.without_benchmarks(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert not {*folder.glob("postings-*")} - before
    assert {r["doc_id"] for r in out.collect()} == texts.keys() - {130, 131, 132}
