"""The operators against plain versions, on whole small tables and on a table of odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import queries as Q
from quillmesh.llm.boosting import Boosted, Isotonic
from quillmesh.llm.common import text_chunks
from quillmesh.llm.cotraining import cotraining
from quillmesh.llm.decontaminate import build_index, decontaminate, search_index
from quillmesh.llm.html_main import extract_main, main_text
from quillmesh.llm.ngram_join import ngram_join
from quillmesh.llm.packing import hilbert, pack
from quillmesh.llm.quality_rules import js_distance, quality_rules
from quillmesh.llm.sharding import cut_rows, shard
from quillmesh.llm.suffix_dedup import factors, merged, suffix_dedup
from quillmesh.llm.toxicity import toxicity
from quillmesh.llm.url_filter import url_filter

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def paired(rows, results):
    return sorted(((r[0], *x) for r, x in zip(rows, results)), key=repr)


def table(spark, tiny, name):
    return [tuple(r) for r in spark.read.parquet(f"{tiny}/{name}.parquet").collect()]


# suffix dedup


def test_factors_mark_earlier_and_later_copies():
    data = np.frombuffer(b"abcXabcYabc", np.uint8)
    earlier, later = factors(data, np.arange(9), 3)
    assert [i for i in range(9) if earlier[i]] == [4, 8]
    assert [i for i in range(9) if later[i]] == [0, 4]


def test_merged_spans():
    assert merged(np.array([[5, 9], [0, 3], [3, 4], [8, 12]])).tolist() == [[0, 4], [5, 12]]
    assert merged(np.zeros((0, 2), int)).tolist() == []


COLUMNS1 = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("window", [400, 60])
def test_suffix_dedup_odd_rows(docs, rows, lister, window):
    got = lister(suffix_dedup(docs, window=window), "doc_id", *COLUMNS1)
    assert got == paired(rows, brute.suffix_dedup([r[1] for r in rows], window))


def test_suffix_dedup_hot_anchors(spark, lister):
    """One passage in more texts than an anchor may gather, each with its own neighbourhood."""
    from .conftest import prose

    passage = prose(7, 120)
    rows = [(i, prose(100 + i, 40) + " " + passage + " " + prose(900 + i, 40)) for i in range(120)]
    got = lister(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", *COLUMNS1)
    assert got == paired(rows, brute.suffix_dedup([r[1] for r in rows]))


def test_suffix_dedup_keeps_the_first(spark, lister):
    from .conftest import prose

    passage = prose(7, 120)
    rows = [(i, prose(100 + i, 40) + " " + passage + " " + prose(900 + i, 40)) for i in range(70)] + [(70, passage + passage), (71, passage)]
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id"), keep="first", with_text=True)
    assert lister(got, "doc_id", *COLUMNS1) == paired(rows, brute.suffix_dedup([r[1] for r in rows], keep="first"))
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert sum(passage in t for t in texts.values()) == 1
    # characters that only partly lie in a removed span stay
    assert all(0 <= len(r["text"].encode()) - (r["n_bytes"] - r["n_removed"]) <= 6 * r["n_spans"] for r in got.collect())


def test_suffix_dedup_leaves_whole_characters(spark):
    rows = [(0, "é" * 500), (1, "a" + "é" * 500)]
    texts = [r["text"] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).orderBy("doc_id").collect()]
    assert texts == ["", "a"]


def test_suffix_dedup_whole_table(spark, tiny, lister):
    rows = table(spark, tiny, "documents")
    texts = [r[1] for r in rows]
    wanted = [(*x, n) for x, n in zip(brute.suffix_dedup(texts), brute.shared_words(texts))]
    assert lister(Q.op1_suffix_dedup(spark, tiny), "doc_id", *COLUMNS1, "n_shared_words") == paired(rows, wanted)


def test_suffix_dedup_row_numbers(spark):
    """Sets of row numbers: any bit of a word, several partitions, none at all."""
    from quillmesh.llm.suffix_dedup import _among, _numbered

    rng = random.Random(4)
    inside = {(p << 33) + i for p in (0, 1, 70) for i in rng.sample(range(300), 90)} | {63, 64, (70 << 33) + 127}
    every = [(p << 33) + i for p in (0, 1, 2, 70) for i in range(300)]
    rows = spark.createDataFrame([(i,) for i in every], "rid long").repartition(3)
    for wanted in (inside, set()):
        numbers = _numbered(rows.where(F.col("rid").isin(*wanted)) if wanted else rows.where("rid < 0"))
        for side in (True, False):
            got = [r["rid"] for r in rows.mapInArrow(_among(numbers, side), "rid long").collect()]
            assert sorted(got) == sorted(i for i in every if (i in wanted) == side)


def test_suffix_dedup_takes_texts_apart_in_portions():
    """What a task holds is bounded by the texts' bytes, not by those of their compressed form."""
    import pyarrow as pa

    from quillmesh.llm.suffix_dedup import _cut, _portions

    texts = [b"", b"a" * 900, b"b" * 300, b"", b"c" * 2500, b"d"]
    none = pa.nulls(len(texts), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([len(t) for t in texts]), pa.array([zlib.compress(t) for t in texts]), none, none], names=["k0", "n_bytes", "packed", "spans", "words"])
    parts = list(_portions(batch, 1000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(sum(p["n_bytes"].to_pylist()) for p in parts) < 1000 + 2500
    big = [b"x" * (3 << 20)] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([len(t) for t in big]), pa.array([zlib.compress(t) for t in big]), none[:5], none[:5]], names=batch.schema.names)
    got = list(_cut(400, ["k0"], True)(iter([batch])))
    assert [t for g in got for t in g["text"].to_pylist()] == [t.decode() for t in big] and max(g.num_rows for g in got) <= 2
    assert not list(_cut(400, ["k0"], True)(iter([batch.slice(0, 0)])))[0].num_rows


def test_suffix_dedup_nothing(nothing):
    assert suffix_dedup(nothing, with_passages=True).count() == 0


def test_shared_words_of_odd_rows(docs, rows, lister):
    got = lister(suffix_dedup(docs, with_passages=True), "doc_id", *COLUMNS1, "n_shared_words")
    texts = [r[1] for r in rows]
    assert got == paired(rows, [(*x, n) for x, n in zip(brute.suffix_dedup(texts), brute.shared_words(texts))])


def test_shared_words_of_short_passages(spark, lister):
    """Passages of 49 to 53 words, of under 400 bytes, in two documents, in one twice, and in very many."""
    from .conftest import prose

    rows, shorts = [], [" ".join(w[:5] for w in prose(50 + k, 49 + k).split()) for k in range(5)]
    for k, x in enumerate(shorts):
        rows += [(10 * k + j, f"{prose(1000 + 10 * k + j, 70)} {x}{' ' * (j + 1)}{prose(2000 + 10 * k + j, 60)}") for j in range(2)]
    rows += [(100, f"{prose(301, 30)} {shorts[4]} {prose(302, 30)} {shorts[4]}"), (101, f"{prose(303, 60)} {(y := prose(99, 52))} z {y}"), (102, shorts[4])]
    rows += [(200 + j, f"{prose(3000 + j, 40)} {shorts[3]} {prose(4000 + j, 30)}") for j in range(90)]
    got = {r["doc_id"]: r["n_shared_words"] for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_passages=True).collect()}
    assert got == dict(zip([i for i, _ in rows], brute.shared_words([t for _, t in rows])))
    assert got[0] == got[10] == got[101] == 0 and got[20] == 51 and got[100] == 106


@pytest.mark.parametrize("window", [5, 7, 40])
def test_factor_ranks_group_equal_beginnings(window):
    from quillmesh.llm.suffix_dedup import factor_ranks

    g = np.random.default_rng(window)
    data = np.concatenate([g.integers(97, 99, 300), np.full(80, 97), g.integers(97, 99, 60).repeat(2)]).astype(np.uint8)
    data[200:260] = data[20:80]
    ranks, keys = factor_ranks(data, window), [bytes(data[i : i + window]) for i in range(len(data))]
    assert all((ranks[i] < ranks[j]) == (keys[i] < keys[j]) for i in range(0, len(data), 7) for j in range(len(data)))
    assert len(set(zip(ranks.tolist(), keys))) == len(set(ranks.tolist())) == len(set(keys))


# quality rules


COLUMNS2 = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_odd_rows(docs, rows, lister):
    out = quality_rules(docs)
    assert lister(out, "doc_id", *COLUMNS2) == paired(rows, [brute.quality_base(r[1]) for r in rows])
    assert out.where("base_failed and kept").count() == 0


def test_quality_whole_table(spark, tiny, lister):
    rows = table(spark, tiny, "documents")
    assert lister(Q.op2_quality_rules(spark, tiny), "doc_id", *COLUMNS2) == paired(rows, [brute.quality_base(r[1]) for r in rows])


def test_quality_rejects_symbols_and_keeps_prose(spark):
    from .conftest import prose

    clean = [(i, prose(i, 200), "en") for i in range(40)]
    junk = [(100 + i, " ".join(w + "%%%$$" for w in prose(300 + i, 200).split()), "en") for i in range(3)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in junk)


def test_js_distance():
    p = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])
    assert js_distance(p, np.array([1.0, 1.0])).tolist() == pytest.approx([0.5579230452841438, 0.0, np.sqrt(0.5)], abs=1e-9)
    assert js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 3.0]))[0] == pytest.approx(1.0)


def test_quality_nothing(nothing):
    assert quality_rules(nothing).count() == 0


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now</div>
<div id="cookie-notice"><p>We use cookies on this site to give you the best of the web and more of it.</p></div>
<article><h1>A  title</h1><p>One &amp; two&nbsp;and<br>three <b>b</b>old.<p>Next <a href="x">link</a> of text, and the rest of the block is not a link at all.</p>
<form><input name="q"> Search</form><div class="comments"><p>First! said a reader.</p></div></article>
<aside><p>Related things</p></aside><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "A title One & two and three bold. Next link of text, and the rest of the block is not a link at all."


def test_main_text_against_a_plain_version(spark):
    """Pages with and without an article element, of good prose, few stop words, link lists and short blocks."""
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    plain = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in rows]
    links = [h.replace("<h1>", "<ul><li><a href='x'>One link</a></li><li><a href='y'>and another link</a></li></ul><h1>", 1) for h in rows[:50]]
    whole = [main_text(h) for h in rows]
    for page in [*rows, *plain, *links]:
        assert main_text(page) == brute.main_text(page)
    assert [main_text(h) for h in links] == whole[:50]  # link lists in an article are no part of it
    assert sum(map(len, map(main_text, plain))) > 0.7 * sum(map(len, whole))  # without the hint most is found


def test_main_text_needs_no_copyright_rule():
    text = "The history of the law of copyright is long, and it is told in this book by one of the best. " * 3
    assert main_text(f"<article><p>{text}</p><p>\xa9 is its sign.</p><p>{text}</p></article>") == " ".join([text.strip(), "\xa9 is its sign.", text.strip()])


def test_main_text_by_blocks_alone():
    good = "The cat is in the house and it is on the mat, as it was in the days of old when the king of the land was not at home for the winter. " * 2
    page = f"<div><p><a href=a>One</a> <a href=b>Two</a></p><p>{good}</p><p>Short one.</p><p>{good}</p><p>Copyright \xa9 2020</p><p>tail</p></div>"
    assert main_text(page) == " ".join([good.strip(), "Short one.", good.strip()])


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), ("<p", ""), ("<article><p>x &lt;b&gt; &#233;&am", "x <b> é&am"), ("<nav><ul><li>menu<article><p>kept", "kept"), ("</div></p><article>a</article></article>", "a"), ("<article><p>cut off <a href='", "cut off"), ("<article>" + "<div>" * 3000 + "deep", "deep"), ("no markup at all", "")],
)
def test_main_text_of_broken_pages(page, text):
    assert main_text(page) == text


def test_extract_main(spark, tiny, lister):
    odd = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    text = main_text(PAGE)
    assert lister(extract_main(odd), "page_id", "url", "text", "n_chars") == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0)], key=repr)
    assert extract_main(odd.limit(0)).count() == 0
    pages = {r["page_id"]: r for r in Q.op3_html_main(spark, tiny).collect()}
    for page_id, url, page in table(spark, tiny, "pages"):
        got = pages[page_id]
        assert got["n_chars"] == len(got["text"]) > 0 and "<" not in got["text"].replace("<", "", page.count("&lt;")) and got["url"] == url


# packing


def whole(rows):
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(VOCABULARY).encode_batch([r[1] or "" for r in rows], add_special_tokens=False)
    return [[*e.ids, 2] for e in encoded]


def check_packing(pieces, rows, size):
    """Each document's ids are cut without a gap, and sequences are filled without one."""
    wanted = Counter((r[0], len(ids), brute.crc_of_ids(ids)) for r, ids in zip(rows, whole(rows)))
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0 and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        documents[p["doc_id"], p["doc_tokens"], p["sequence_id"] * size + p["offset"] - p["start"]].append((p["start"], p["ids"]))
    found = Counter()
    for (doc, n, _), parts in documents.items():
        ids = []
        for start, more in sorted(parts):
            assert start == len(ids)
            ids += more
        assert len(ids) == n
        found[doc, n, brute.crc_of_ids(ids)] += 1
    assert found == wanted
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or k == len(sequences) - 1


@pytest.mark.parametrize("size", [64, 4096])
def test_packing_odd_rows(docs, rows, size):
    check_packing(pack(docs, VOCABULARY, size=size, with_ids=True).collect(), rows, size)


def test_packing_whole_table(spark, tiny):
    rows = table(spark, tiny, "documents")
    pieces = pack(spark.read.parquet(f"{tiny}/documents.parquet"), VOCABULARY, with_ids=True).collect()
    check_packing(pieces, rows, 4096)
    plain = Q.op4_packing(spark, tiny)
    assert plain.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and plain.count() == len(pieces)


def test_packing_nothing(nothing):
    assert pack(nothing, VOCABULARY).count() == 0


def test_words_are_tokenised_as_whole_texts_are(rows):
    from quillmesh.llm.packing import WordTokens

    odd = ["it's you're I'LL don't_x __--.. a1b2² ½ ΣΑΣ Ⅷ x\u200by\x1cz e\u0301 Å İI ß ŒŸ ﬁ", "<|endoftext|> a<|startoftext|>b", "\u00a0no\u00a0break\u2003em", "word,,, (word) [word] 'word' ~word`"]
    texts = odd + [r[1] or "" for r in rows]
    got = [np.frombuffer(b, np.uint16).tolist() for b in WordTokens(VOCABULARY)(texts, 2)]
    assert got == whole([(0, t) for t in texts])


def test_hilbert_is_a_path():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# toxicity and co-training


def test_boosted_and_isotonic():
    g = np.random.default_rng(0)
    x = g.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    margin = Boosted().fit(x[:2000], y[:2000]).margin(x[2000:])
    assert ((margin > 0) == y[2000:]).mean() > 0.95
    to = Isotonic().fit(margin, y[2000:])
    score = to(np.sort(margin))
    assert (np.diff(score) >= 0).all() and 0 <= score.min() and score.max() <= 1


def auc(pairs):
    pos, neg = ([s for y, s in pairs if y == k] for k in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize(("query", "target", "least"), [("op5_toxicity", "toxic", 0.98), ("op8_cotraining", "quality", 0.95)])
def test_held_out_accuracy(spark, query, target, least):
    d = "/root/testdata/sf0.1"
    out = Q.queries()[query](spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", target)
    rows = out.where("held_out").join(labels, "doc_id").select(target, "score", "predicted").collect()
    assert len(rows) > 500 and auc([tuple(r)[:2] for r in rows]) > least
    caught, alarms = (np.mean([r["predicted"] for r in rows if r[target] == y]) for y in (1, 0))
    assert caught > 0.9 and (target != "toxic" or alarms < 0.01)
    assert out.where("held_out").count() == out.where("crc32(cast(doc_id as string)) % 5 = 0").count()
    assert out.count() == spark.read.parquet(f"{d}/documents.parquet").count()


@pytest.mark.parametrize(("operator", "target"), [(toxicity, "toxic"), (cotraining, "quality")])
def test_scores_of_odd_rows(spark, docs, rows, nothing, operator, target):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)] + [(None, 1), (2, None), (3, 0)], f"doc_id long, {target} int")
    out = operator(docs, labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert operator(nothing, labels).count() == 0
    assert {r["score"] for r in operator(docs, labels.limit(0)).collect()} == {0.5}


def test_toxic_words_score_higher(spark):
    from .conftest import prose

    clean = [(i, prose(i, 80)) for i in range(200)]
    toxic = [(1000 + i, prose(500 + i, 40) + " you are a stupid worthless idiot " + prose(800 + i, 40)) for i in range(100)]
    docs = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") >= 1000, 1).otherwise(0).alias("toxic"))
    rows = toxicity(docs, labels).where("held_out").collect()
    assert all(r["predicted"] == int(r["doc_id"] >= 1000) for r in rows) and len(rows) > 30


# decontamination

COLUMNS6 = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontaminate_odd_rows(spark, docs, rows, lister):
    from .conftest import prose

    items = [(1, prose(2, 90)), (1, prose(20, 60)), (2, "WORD"), (10, "two Words"), (None, "a b c d"), (3, None), (4, ""), (5, "a b c"), (6, prose(99, 40)), (7, "tick tock " * 9), (2, "WORD")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(0))
    assert lister(decontaminate(docs, bench), "doc_id", *COLUMNS6) == paired(rows, brute.decontaminate([r[1] for r in rows], items))


def test_decontaminate_in_blocks(spark, docs, rows, lister, monkeypatch):
    from quillmesh.llm import decontaminate as module

    items = [(i, r[1]) for i, r in enumerate(rows) if i % 7 == 1]
    for name, bound in (("SEGMENT", 3000), ("TERMS", 200), ("WINDOWS", 150), ("TOGETHER", 40)):
        monkeypatch.setattr(module, name, bound)
    got = lister(decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")), "doc_id", *COLUMNS6)
    assert got == paired(rows, brute.decontaminate([r[1] for r in rows], items))


def test_decontaminate_whole_table(spark, tiny, lister):
    rows = table(spark, tiny, "documents")
    got = lister(Q.op6_decontaminate(spark, tiny), "doc_id", *COLUMNS6)
    assert got == paired(rows, brute.decontaminate([r[1] for r in rows], table(spark, tiny, "benchmark")))


def test_one_index_serves_many_test_sets(spark, docs, rows, lister):
    """Also proximity matches against a plain version, and windows that several items share."""
    index = build_index(docs)
    texts = [r[1] for r in rows]
    for k, slop in ((3, 0), (5, 2)):
        items = [(i, r[1]) for i, r in enumerate(rows) if i % k == 1] + [(1000, rows[8][1]), (1001, "a c b"), (None, "two words")]
        bench = spark.createDataFrame(items, "item_id long, text string")
        out = search_index(index, bench, slop=slop)
        assert lister(out, "doc_id", *COLUMNS6) == paired(rows, brute.decontaminate(texts, items))
        assert lister(out, "doc_id", "n_near") == paired(rows, [(n,) for n in brute.near_items(texts, items, slop)])


def test_proximity(spark):
    item = " ".join(f"w{i}" for i in range(13))
    gap = item.replace("w6 ", "w6 extra ")
    docs = spark.createDataFrame([(0, f"x {item} y"), (1, f"x {gap} y"), (2, " ".join(reversed(item.split())))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate(docs, spark.createDataFrame([(9, item)], "item_id long, text string"), slop=2).collect()}
    assert [out[i]["n_items"] for i in range(3)] == [1, 0, 0] and [out[i]["n_near"] for i in range(3)] == [1, 1, 0]


def test_decontaminate_nothing(spark, nothing, docs, rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(nothing, empty).count() == 0
    out = decontaminate(docs, empty).collect()
    assert len(out) == len(rows) and {r["items_sha256"] for r in out} == {hashlib.sha256(b"").hexdigest()}


# n-gram join


def expected_join(rows):
    """Rows with equal sets are one node; null ids are not a component's smallest."""
    numbered = [(i, r[1]) for i, r in enumerate(rows)]
    parts = {i: (n, c) for i, n, c in brute.jaccard_join(numbered)}
    least = {}
    for i, r in enumerate(rows):
        c = parts[i][1]
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    return sorted(((r[0], parts[i][0], least[parts[i][1]]) for i, r in enumerate(rows)), key=repr)


def test_ngram_join_odd_rows(docs, rows, lister):
    assert lister(ngram_join(docs), "doc_id", "n_shingles", "component_id") == expected_join(rows)


def test_ngram_join_families(spark, lister):
    """Families whose members are alike in different degrees, chains, and a line that all of them share."""
    import random

    from .conftest import prose

    rows, i = [], 0
    for family in range(6):
        words = prose(1000 + family, 150 + 10 * family).split()
        for member in range(25):
            r = random.Random(family * 100 + member)
            w = list(words)
            for at in r.sample(range(len(w)), r.randint(0, 5)):
                w[at] = f"z{r.random()}"
            if member % 3 == 0:
                words = w  # the family drifts
            rows.append((i, "all of these share one line with each other\n" + " ".join(w)))
            i += 1
    got = lister(ngram_join(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == expected_join(rows) and len({x[2] for x in got}) < 140


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_ngram_join_with_fewer_levels(docs, rows, lister, levels):
    assert lister(ngram_join(docs, levels=levels), "doc_id", "n_shingles", "component_id") == expected_join(rows)


def test_members_that_resemble_neither_the_pivot_nor_each_other_do_not_meet(spark):
    from quillmesh.llm.ngram_join import _next_groups

    own = {m: [1000 * (m + 1) + i for i in range(95)] for m in range(20)}
    own[20] = own[0][:92] + [7, 8, 9]
    lacking = list(range(100, 195))
    rows = [(1, m, 100, 0, [1], x, lacking, x + lacking, 99, 100, False) for m, x in own.items()]
    described = spark.createDataFrame(rows, "ref long, node long, size long, own long, other array<long>, plus array<long>, minus array<long>, tokens array<long>, pivot long, psize long, linked boolean")
    met = defaultdict(set)
    for r in _next_groups(described, 80).collect():
        met[r.g].add(r.node)
    assert set(map(frozenset, met.values())) == {frozenset({0, 20})}


def test_members_that_lack_parts_of_the_pivot_by_chance_do_not_meet(spark):
    """A family of edits of one text, of which a part does not link with it: all pairs of it lack some of the same tokens."""
    from quillmesh.llm.ngram_join import _next_groups

    draw, rows = random.Random(5), []
    for m in range(80):
        n = draw.randint(50, 80) if m % 4 == 0 else draw.randint(5, 40)  # of 396 tokens, replaced by others
        rows.append((1, m, 396, 0, [1], [1000 * (m + 1) + i for i in range(n)], sorted(draw.sample(range(396), n)), 99, 396, (396 - n) * 100 >= 80 * (396 + n)))
    # these two lost nearly the same quarter and have nothing else; the third has as few, but lost others
    rows += [(2, 100 + i, 396 - n, 0, [1], [], list(range(s, s + n)), 99, 396, False) for i, (s, n) in enumerate([(0, 100), (2, 95), (200, 100)])]
    described = spark.createDataFrame(rows, "ref long, node long, size long, own long, other array<long>, plus array<long>, minus array<long>, pivot long, psize long, linked boolean")
    met = defaultdict(set)
    for r in _next_groups(described, 80).collect():
        met[r.g].add(r.node)
    assert {100, 101} in met.values()
    assert len({(a, b) for x in met.values() for a in x for b in x if a < b < 100}) < 50  # of 3160 pairs


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_ngram_join_of_a_family_around_the_limit(spark, lister, levels):
    """Edits of one text by other words, by cuts and by both, similar to it and each other between 0.6 and 1."""
    draw, text = random.Random(11), [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(text))]
    for m in range(1, 70):
        w = list(text)
        for at in draw.sample(range(len(w)), draw.randint(0, 7)):
            w[at] = f"x{draw.randint(0, 9)}"
        if m % 3 == 0:
            lo = draw.randint(0, 20)
            w = w[lo : len(w) - draw.randint(0, 20)]
        if m % 5 == 0:
            w += [f"y{m // 10}z{i}" for i in range(draw.randint(0, 25))]
        rows.append((m, " ".join(w)))
    got = lister(ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), levels=levels), "doc_id", "n_shingles", "component_id")
    assert got == expected_join(rows) and 5 < len({x[2] for x in got}) < 65


def test_ngram_join_counts_every_token_in_one_part(spark):
    from quillmesh.llm.ngram_join import PARTS, _shared

    rows = [(i % 97, hash_ - 2000) for i, hash_ in enumerate(x * 37 % 4001 for x in range(6000))]
    df = Counter(t for _, t in rows)
    parts = [_shared(spark.createDataFrame(rows, "node long, token long"), i).collect() for i in range(PARTS)]
    assert sorted((r.node, r.token, r.df) for p in parts for r in p) == sorted((n, t, df[t]) for n, t in rows if df[t] >= 2)
    assert max(map(len, parts)) < 0.3 * sum(map(len, parts))


def test_ngram_join_nothing(nothing):
    assert ngram_join(nothing).count() == 0


# URL filter

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("", "/never", "block")]
URLS = ["http://a.example.com/en/71?x#y", "https://EXAMPLE.com/en/8", "http://example.com", "ftp://notexample.net/de/9", "x://b.example.net/de/8", "http://org/es/", "http://org/ES/", "no scheme com/en/", None, "", "://com/en/?a://net/de/", "http://a.com?x/en/", "http://.com/en/", "http://com./en/", "http://com:80/en/", "http://café.ÉCOLE.com/en/é", "http://com/en/\nx"]


def expected_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = brute.ascii_lower(rest.split("/")[0].split("?")[0].split("#")[0])
    tail = rest[len(host) :]
    path = tail.split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, "allow")
    return host, path, rule, verdict


def test_url_filter(spark, lister):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    rules = spark.createDataFrame(RULES[:5], "host string, path string, verdict string")
    got = lister(url_filter(pages, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *expected_verdict(u)) for i, u in rows), key=repr)
    assert url_filter(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filter_with_many_rules(spark, lister, monkeypatch):
    from quillmesh.llm import url_filter as module

    monkeypatch.setattr(module, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = lister(url_filter(pages, spark.createDataFrame(RULES[:5], "host string, path string, verdict string")), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *expected_verdict(u)) for i, u in enumerate(URLS)), key=repr)


def test_url_filter_is_native(spark, tiny):
    plan = Q.op9_url_filter(spark, tiny)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ScalaUDF"))


# sharding


def check_shards(out, rows, shards=8):
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def test_sharding_odd_rows(docs, rows, nothing):
    check_shards(shard(docs).collect(), rows)
    assert shard(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 9])
def test_sharding_few_rows(spark, n):
    rows = [(i, f"t{i // 2}") for i in range(n)]
    check_shards(shard(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_sharding_keeps_groups_together(spark):
    """400 single texts, 60 groups of five, and one text in a third of all rows."""
    rows = [(i, f"single {i}") for i in range(400)] + [(1000 + i, f"group {i // 5}") for i in range(300)] + [(5000 + i, "hot") for i in range(350)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(out, rows)
    where = defaultdict(set)
    for r in out:
        where[r["text_crc32"]].add(r["shard"])
    cut = [k for k, s in where.items() if len(s) > 1]
    assert len(cut) <= 8 and len(where[zlib.crc32(b"hot")]) <= 5


def test_propagation_saves_links(spark):
    """Without label propagation nearly all groups are cut; with it none is that a shard can hold."""
    rows = [(i, f"single {i}") for i in range(300)] + [(1000 + i, f"group {i // 6}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = [cut_rows(shard(docs, rounds=k)) for k in (0, 6)]
    assert cut[0] > 300 and cut[1] <= 7


def test_sharding_whole_table(spark, tiny):
    check_shards(Q.op10_sharding(spark, tiny).collect(), table(spark, tiny, "documents"))


# shared parts


def test_text_chunks_cover_whole_texts():
    import pyarrow as pa

    texts = ["a" * 50, "", "b" * 500, "c", ""]
    column = pa.array(["skipped", *texts]).slice(1)
    seen = []
    for lo, hi, data, offsets in text_chunks(column, 100):
        assert hi - lo == len(offsets) - 1
        seen += [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert seen == texts


def test_each_operator_has_one_query():
    names = list(Q.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(Q.oracle_sql()) <= set(names)


# co-training over the whole corpus


def test_cotraining_asks_all_unlabelled(spark):
    from quillmesh.llm import cotraining as module

    n = 26_000  # of which about 20,800 are not held out
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("concat('the word and ', case when id % 2 = 0 then 'of it is fine ' else '## $$ ## %% ' end, id)").alias("text"), F.lit("en").alias("lang"), F.expr("concat('s', id % 2)").alias("source"), F.expr("20 + id % 7").alias("n_chars"))
    labels = docs.where("doc_id < 400").select("doc_id", F.expr("cast(1 - doc_id % 2 as int)").alias("quality"))
    free = docs.where("doc_id >= 400 and crc32(cast(doc_id as string)) % 5 <> 0").count()
    one, two = (module.learn(module.stored_views(docs.repartition(k)), labels) for k in (2, 7))
    assert free > 20_000 and one.n_unlabelled == free
    # equal margins go together, so that no sure row is left to chance
    assert all(c > 3 * int(module.SURE * 20_000) for c in one.handed[-1])
    assert one.handed == two.handed and all(np.array_equal(a[2], b[2]) for k in (0, 1) for a, b in zip(one.models[k].trees, two.models[k].trees, strict=True))


def test_cotraining_sums_and_cuts(spark):
    from quillmesh.llm import cotraining as module

    r = np.random.default_rng(3)
    leaves, values, starts = [r.integers(0, 8, (900, 5), np.uint8) for _ in (0, 1)], [r.normal(size=(5, 8)) for _ in (0, 1)], [0.1, -0.2]
    frame = spark.createDataFrame([(bytes(a), bytes(b)) for a, b in zip(*leaves)], "a binary, b binary").repartition(5)
    rows = module.Unlabelled(frame, starts)
    counts = rows.counts([], values)
    at = [module.on_grid(module.margins(x, s, v)) for x, s, v in zip(leaves, starts, values)]
    assert [dict(c) for c in counts] == [dict(Counter(a.tolist())) for a in at]
    cuts = [module.cut(c, 40, 20) for c in counts]
    assert all(low == np.sort(a)[39] and high == np.sort(a)[-20] for (low, high), a in zip(cuts, at))
    for k, (g, h, n) in enumerate(rows.slopes([(values, cuts)], values)):
        other, (low, high) = at[1 - k], cuts[1 - k]
        taken = (other <= low) | (other >= high)
        want = module.slopes(leaves[k][taken], (other[taken] >= high).astype(int), starts[k], values[k])
        assert n == taken.sum() >= 60 and np.array_equal(g, want[0]) and np.array_equal(h, want[1])


# proximity


def test_proximity_query(spark, tmp_path, lister):
    from .conftest import prose

    item = " ".join(f"w{i}" for i in range(20))
    turned = "w1 w0 " + " ".join(item.split()[2:])  # the windows' rarest terms come before their places
    texts = [turned, "x " + prose(1, 40), turned + " y", item.replace("w9 ", "w9 more "), item, prose(2, 40) + " w1" * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, " ".join(item.split()[:13]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in Q.queries()["near_decontaminate"](spark, str(tmp_path)).collect()}
    assert [out[i]["n_near"] for i in range(6)] == [1, 0, 1, 1, 1, 0] and [out[i]["n_items"] for i in range(6)] == [0, 0, 0, 0, 1, 0]
    exact = lister(Q.op6_decontaminate(spark, str(tmp_path)), "doc_id", *COLUMNS6)
    assert exact == lister(Q.near_decontaminate(spark, str(tmp_path)), "doc_id", *COLUMNS6)


def test_proximity_before_a_document_start(spark):
    """The rarest term is one place early at the very start, so the match would begin in the document before."""
    item = "b a " + " ".join(f"c{i}" for i in range(11))
    start = "a b " + " ".join(f"c{i}" for i in range(11))
    common = " ".join(["b"] * 3 + [f"c{i}" for i in range(11)] * 3)
    docs = spark.createDataFrame([(0, start), (1, "other"), (2, start), (3, common)], "doc_id long, text string").coalesce(1)
    out = {r["doc_id"]: r["n_near"] for r in decontaminate(docs, spark.createDataFrame([(9, item)], "item_id long, text string"), slop=2).collect()}
    assert out == {0: 1, 1: 0, 2: 1, 3: 0}


# hashes


def thue_morse(n=1024):
    """Two strings that clash under any polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_strings_that_clash_modulo_a_power_of_two(spark, lister):
    one, two = thue_morse()
    rows = [(1, one), (2, two), (3, f"{one}\n{two}"), (4, f"{one} x y {two} x y"), (5, f"{one}\n{one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert lister(quality_rules(docs), "doc_id", *COLUMNS2) == paired(rows, [brute.quality_base(t) for _, t in rows])
    assert {tuple(r) for r in ngram_join(docs).collect()} == brute.jaccard_join(rows)
    items = spark.createDataFrame([("i", one)], "item_id string, text string")
    found = {r["doc_id"]: r["n_hit"] for r in decontaminate(docs, items).collect()}
    assert found == {i: x[1] for (i, _), x in zip(rows, brute.decontaminate([t for _, t in rows], [("i", one)]))}


def test_ranges_and_grams():
    from quillmesh.llm.common import BLOCK, Rolling, grams

    g = np.random.default_rng(3)
    data = g.integers(0, 256, 2 * BLOCK + 77).astype(np.uint8)
    data[2 * BLOCK - 10 : 2 * BLOCK + 60] = data[5:75]
    r = Rolling(data)
    a, b = (r.ranges(np.array([s]), np.array([s + 70]))[0] for s in (5, 2 * BLOCK - 10))
    assert a == b == Rolling(data[5:75]).ranges(np.array([0]), np.array([70]))[0]
    assert len({int(r.ranges(np.array([s]), np.array([s + n]))[0]) for s in range(300) for n in range(1, 40)}) == 300 * 39 - sum(len(w) - len(set(w)) for n in range(1, 40) for w in [[bytes(data[s : s + n]) for s in range(300)]])
    h = grams(data, 32)
    assert len(h) == len(data) - 31 and h[5] == h[2 * BLOCK - 10] and len(grams(data[:31], 32)) == 0


# very long texts


def test_very_long_texts(spark, lister):
    """Texts beyond the operators' batches of a megabyte, that share most of their words."""
    from .conftest import prose

    long = prose(77, 190_000)
    rows = [(1, long), (2, long[:900_000] + " " + prose(78, 40_000)), (3, "a short text"), (4, prose(79, 300)), (5, long)]
    assert len(long.encode()) > 1 << 20
    texts = [t for _, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    wanted = [(*x, n) for x, n in zip(brute.suffix_dedup(texts), brute.shared_words(texts))]
    assert lister(suffix_dedup(docs, with_passages=True), "doc_id", *COLUMNS1, "n_shared_words") == paired(rows, wanted)
    assert lister(quality_rules(docs), "doc_id", *COLUMNS2) == paired(rows, [brute.quality_base(t) for t in texts])
    items = [("i", " ".join(long.split()[120_000:120_020])), ("j", "no such words here")]
    assert lister(decontaminate(docs, spark.createDataFrame(items, "item_id string, text string")), "doc_id", *COLUMNS6) == paired(rows, brute.decontaminate(texts, items))
    assert {tuple(r) for r in ngram_join(docs).collect()} == brute.jaccard_join(rows)
    check_packing(pack(docs, VOCABULARY, with_ids=True).collect(), rows, 4096)
    check_shards(shard(docs).collect(), rows)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)], "doc_id long, toxic int, quality int")
    for operator in (toxicity, cotraining):
        assert [0 <= r["score"] <= 1 for r in operator(docs, labels).collect()] == [True] * 5
    page = f"<body><nav><a href=x>Menu</a></nav><article><p>{long}</p></article></body>"
    assert main_text(page) == " ".join(long.split())
    url = "https://a.example.com/en/" + "x" * (1 << 20)
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    out = url_filter(pages, spark.createDataFrame(Q.RULES, "host string, path string, verdict string")).collect()
    assert [(r["rule"], r["verdict"]) for r in out] == [("com/en/", "block")]
