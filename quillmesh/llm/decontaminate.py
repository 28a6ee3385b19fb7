"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents: each segment (about SEGMENT bytes of text) stores the postings of all its words, sorted by term,
with places counted through the segment. Segments are written to the shared folder once; any number of test sets can be
looked up in them with `search_index`, without the texts.

A search makes the test set's windows rows of a table, and counts their terms over all segments. A window with a term that no
segment has cannot match; the terms of the others are put in the order of their counts, rarest first. A window is then looked
up in every segment: its rarest term's places, less the term's offset, are the candidates, and the list of each next rarer
term, offset in the same way, is intersected with them until none are left or all terms agree (an exact phrase), or, with
`slop`, until all terms lie within `slop` places of theirs in the same document (a proximity match). Documents never move;
only narrow rows do. Terms and windows go to the executors in blocks of bounded size (TERMS, WINDOWS), one pass over the
segments each, so the size of the test set is limited neither by the driver's nor by an executor's memory.

Words are runs of the ASCII digits and letters and of characters beyond ASCII, with A-Z lower-cased. A window is `n`
consecutive words of an item; an item of fewer words is one window; one without words has none.

Defined results: a null or empty text has no words and no hits. A very long text is a segment of its own. Items with a null id
are left out; item rows with one id are one item, and windows that several items share count for each. Repeated documents
each get their row, rows without an id as well. An empty table gives no rows, an empty test set no hits. A document's
clashing extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget
from .common import Rolling, lists, signed, stored, text_chunks, text_of, word_spans

#: Bytes of text in a segment; terms and windows that are broadcast at a time; candidates looked at together.
SEGMENT, TERMS, WINDOWS, TOGETHER = 4 << 20, 1_000_000, 100_000, 1 << 20
SPLIT = np.ones(256, bool)
SPLIT[0x30:0x3A] = SPLIT[0x41:0x5B] = SPLIT[0x61:0x7B] = False
SPLIT[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    starts, ends, owner = word_spans(data, offsets, SPLIT)
    return (Rolling(LOWER[data]).ranges(starts, ends) if len(starts) else np.zeros(0, np.uint64)), owner


def segment_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of many texts, hashed a chunk at a time."""
    parts = [(h, owner + lo) for lo, _, data, offsets in text_chunks(texts) for h, owner in (word_hashes(data, offsets),)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def build_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs(key, text) -> segments: seg, ids, n_words (of each document), terms (sorted), counts, places (by term), the last three as numbers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for lo, hi, _, _ in text_chunks(batch["text"], SEGMENT):
                hashes, owner = segment_words(batch["text"].slice(lo, hi - lo))
                place = np.argsort(hashes, kind="stable")
                terms, counts = np.unique(hashes, return_counts=True)
                packed = (pa.array([v.tobytes()], pa.binary()) for v in (terms, counts.astype(np.uint32), place.astype(np.uint32)))
                ids = batch["k"].slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), lists(ids, np.array([hi - lo]), ids.type), lists(np.bincount(owner, minlength=hi - lo), np.array([hi - lo]), pa.int64()), *packed],
                    names=["seg", "ids", "n_words", "terms", "counts", "places"],
                )
                number += 1

    kind = dict(docs.dtypes)[key]
    return stored(docs.select(F.col(f"`{key}`").alias("k"), text_of().alias("text")).mapInArrow(run, f"seg long, ids array<{kind}>, n_words array<long>, terms binary, counts binary, places binary"), "postings")


def test_windows(bench: DataFrame, n: int) -> DataFrame:
    """bench(item_id, text) -> item, wid (a hash of the window), terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                words, owner = word_hashes(data, offsets)
                count = np.bincount(owner, minlength=hi - lo)
                first, size = np.cumsum(count) - count, np.minimum(count, n)
                many = np.where(count > 0, count - size + 1, 0)
                of = np.repeat(np.arange(hi - lo), many)
                at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                width = size[of]
                ids = Rolling(words).ranges(at, at + width) if len(at) else words
                flat = np.repeat(at - np.cumsum(width) + width, width) + np.arange(width.sum())
                yield pa.RecordBatch.from_arrays([batch["item"].slice(lo, hi - lo).take(pa.array(of)), pa.array(signed(ids)), lists(signed(words[flat]), width, pa.int64())], names=["item", "wid", "terms"])

    source = bench.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), text_of().alias("text"))
    return source.mapInArrow(run, "item string, wid long, terms array<long>")


def _numbers(column: pa.Array, row: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """terms(term), distinct -> term, c: those that the index has, and how often."""
    blocks, parts = max(1, -(-terms.count() // TERMS)), None
    for i in range(blocks):
        asked = np.sort(terms.where(F.pmod("term", F.lit(blocks)) == i).toPandas()["term"].to_numpy(np.int64).view(np.uint64))
        shared = index.sparkSession.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            asked, sums = shared.value, np.zeros(len(shared.value), np.int64)
            for batch in batches:
                for row in range(batch.num_rows if len(asked) else 0):
                    own, counts = _numbers(batch["terms"], row, np.uint64), _numbers(batch["counts"], row, np.uint32)
                    at = np.minimum(np.searchsorted(asked, own), len(asked) - 1)
                    same = asked[at] == own
                    sums[at[same]] += counts[same]
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(signed(asked[found])), pa.array(sums[found])], names=["term", "c"])

        part = index.select("terms", "counts").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c"))
        parts = part if parts is None else parts.unionByName(part)
    return stored(parts, "counted")


class Windows:
    """A block of windows: terms and offsets, rarest first, padded to equal length."""

    def __init__(self, rows, n: int):  # noqa: ANN001
        self.ids = rows["wid"].to_numpy(np.int64)
        self.sizes = np.array([len(x) for x in rows["terms"]], np.int64)
        self.terms, self.offs = np.zeros((len(self.ids), n), np.uint64), np.zeros((len(self.ids), n), np.int64)
        inside = np.arange(n) < self.sizes[:, None]
        if len(self.ids):
            self.terms[inside] = np.concatenate(rows["terms"].to_list()).astype(np.int64).view(np.uint64)
            self.offs[inside] = np.concatenate(rows["offs"].to_list())
            self.terms = np.where(inside, self.terms, self.terms[:, :1])


def look_up(windows: Windows, n_words: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(window, document, first word) of the exact matches in a segment, and (window, document) of the proximity matches."""
    if not len(terms) or not len(windows.ids):
        return
    number = np.minimum(np.searchsorted(terms, windows.terms[:, 0]), len(terms) - 1)
    asked = np.flatnonzero(terms[number] == windows.terms[:, 0])
    number = np.minimum(np.searchsorted(terms, windows.terms[asked]), len(terms) - 1)
    whole = (terms[number] == windows.terms[asked]).all(axis=1)
    asked, number = asked[whole], number[whole]
    if not len(asked):
        return
    ends, first = np.cumsum(counts, dtype=np.int64), np.cumsum(n_words) - n_words
    span = len(places)
    postings = np.repeat(np.arange(len(terms)), counts) * span + places  # all lists, one after the other
    many = counts[number[:, 0]].astype(np.int64)
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), TOGETHER)[1:])
    for part in np.split(np.arange(len(asked)), np.unique(cuts)):
        if not len(part):
            continue
        n = many[part]
        w = np.repeat(part, n)
        place = places[np.repeat(ends[number[part, 0]] - np.cumsum(n), n) + np.arange(n.sum())].astype(np.int64)
        doc = np.searchsorted(first, place, side="right") - 1  # documents without words start where the next one does
        lo, hi = first[doc], first[doc] + n_words[doc]
        start = place - windows.offs[asked[w], 0]
        exact = np.flatnonzero((start >= lo) & (start + windows.sizes[asked[w]] <= hi))
        for j in range(1, windows.terms.shape[1]):
            key = number[w[exact], j] * span + start[exact] + windows.offs[asked[w[exact]], j]
            key = np.where(j < windows.sizes[asked[w[exact]]], key, postings[0])
            exact = exact[postings[np.minimum(np.searchsorted(postings, key), len(postings) - 1)] == key]
        loose = np.arange(len(w)) if slop else exact[:0]
        for j in range(1, windows.terms.shape[1] if slop else 0):
            at, base = start[loose] + windows.offs[asked[w[loose]], j], number[w[loose], j] * span
            found = np.searchsorted(postings, base + np.maximum(lo[loose], at - slop))
            near = (found < len(postings)) & (postings[np.minimum(found, len(postings) - 1)] <= base + np.minimum(hi[loose] - 1, at + slop))
            loose = loose[near | (j >= windows.sizes[asked[w[loose]]])]
        yield asked[w[exact]], doc[exact], start[exact], asked[w[loose]], doc[loose]


def _search(index: DataFrame, windows: Windows, slop: int) -> DataFrame:
    """(seg, row, wid, exact) of each window found in a document, and (seg, row, hits) of its words in exact matches."""
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                n_words = batch["n_words"][i].values.to_numpy()
                terms, counts, places = (_numbers(batch[c], i, t) for c, t in (("terms", np.uint64), ("counts", np.uint32), ("places", np.uint32)))
                matches = list(look_up(windows, n_words, terms, counts, places, slop))
                if not matches:
                    continue
                w, doc, start, near, near_doc = map(np.concatenate, zip(*matches, strict=True))
                pairs = [np.unique(np.column_stack([d, x]), axis=0) for d, x in ((doc, w), (near_doc, near))]
                row, wid = np.concatenate(pairs).T
                edge = np.zeros(len(places) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + windows.sizes[w], -1)
                hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                first = np.cumsum(n_words) - n_words
                of = np.searchsorted(first, hit, side="right") - 1
                docs, many = np.unique(of, return_counts=True)
                n, m = len(row), len(docs)
                hits = lists(hit - first[of], np.concatenate([np.zeros(n, np.int64), many]), pa.int64())
                exact = np.arange(n) < len(pairs[0])
                yield pa.RecordBatch.from_arrays([pa.array([batch["seg"][i].as_py()] * (n + m), pa.int64()), pa.array(np.concatenate([row, docs]).astype(np.int32)), pa.array([*windows.ids[wid].tolist(), *[None] * m], pa.int64()), pa.array([*exact.tolist(), *[None] * m], pa.bool_()), hits], names=["seg", "row", "wid", "exact", "hits"])

    return index.select("seg", "n_words", "terms", "counts", "places").mapInArrow(run, "seg long, row int, wid long, exact boolean, hits array<long>")


def search_index(index: DataFrame, bench: DataFrame, n: int = 13, share: int = 20, slop: int = 0, key: str = "doc_id") -> DataFrame:
    """An index of documents, bench(item_id, text) -> the columns of `decontaminate`."""
    found, windows = None, stored(test_windows(bench, n), "windows")
    distinct = windows.groupBy("wid").agg(F.first("terms").alias("terms"))
    terms = stored(windows.select(F.explode("terms").alias("term")).distinct(), "terms")
    counted = term_counts(index, terms)
    spread = distinct.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term"))
    ranked = spread.join(counted, "term").groupBy("wid", "size").agg(F.array_sort(F.collect_list(F.struct("c", "off", "term"))).alias("x")).where(F.size("x") == F.col("size"))
    ranked = stored(ranked.select("wid", F.transform("x", lambda s: s["off"]).alias("offs"), F.transform("x", lambda s: s["term"]).alias("terms")), "ranked")
    blocks = max(1, -(-ranked.count() // WINDOWS))
    for i in range(blocks):
        rows = ranked.where(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == i).toPandas()
        part = _search(index, Windows(rows, n), slop)
        found = part if found is None else found.unionByName(part)
    found = stored(found, "found")
    for table in (terms, counted, ranked):
        forget(table)
    held = windows.select("wid", "item").distinct()
    of_item = found.where("wid is not null").join(held, "wid").groupBy("seg", "row", "item").agg(F.max("exact").alias("exact"), F.max(~F.col("exact")).alias("near"))
    listed = of_item.groupBy("seg", "row").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.sum(F.col("near").cast("long")).alias("n_near"))
    hits = found.where("wid is null").groupBy("seg", "row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"))
    every = index.select("seg", F.posexplode(F.arrays_zip("ids", "n_words")).alias("row", "d")).select("seg", "row", F.col("d.ids").alias(key), F.col("d.n_words").alias("n_words"))
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0))
    return every.join(hits.join(listed, ["seg", "row"], "full"), ["seg", "row"], "left").select(
        key, "n_words", n_hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        items.alias("items"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = 13, share: int = 20, slop: int = 0, key: str = "doc_id") -> DataFrame:
    """docs(doc_id, text), bench(item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items.

    A document is contaminated if at least one word in `share` is inside an exact occurrence of a test window. n_near counts the
    items of which all terms of a window lie within `slop` places of theirs, exact occurrences included; 0 without slop.
    """
    return search_index(build_index(docs, key), bench, n, share, slop, key)
