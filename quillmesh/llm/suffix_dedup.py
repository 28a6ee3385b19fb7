"""Suffix-array deduplication of repeated byte strings, across and within documents.

A string of `window` bytes that starts in two places of the corpus is a repeat. Finding all of them takes four steps.

1. Anchors. Each window is represented by the place of its smallest hashed k-gram, which its bytes alone decide, so equal
   windows agree on it. Consecutive window starts with one anchor form a segment (about 185 starts), described by the
   anchor's hash and a hash of the whole segment.
2. Classes. Segments are counted by (anchor, segment hash), summed before the shuffle. A class that occurs twice is a
   repeat as a whole. An anchor with one class and one segment is not repeated anywhere and is dropped.
3. Suffix order. Where an anchor has several different classes (the borders of repeats), one copy of each class is
   gathered, and the suffix array of those texts is built by prefix doubling up to `window` bytes. In runs of suffixes
   that share `window` bytes, the smaller positions before and after a suffix give its longest previous (and next)
   factor; a factor of `window` bytes marks the suffix as a repeat. An anchor with more than HOT classes is not gathered:
   digests of its single windows are counted in Spark instead, which gives the same marks without a large group.
4. Removal. The marked ranges go back to their documents, which are cut in place.

Texts are shuffled in steps 3 and 4 only if the step has something to do with them: a set of row numbers, one bit a row and
sent to all tasks, tells which; the others are left where they are stored.

keep="none" removes every copy; keep="first" keeps the copy that comes first in row order (input order) and removes the
later ones.

With `with_passages` the same steps 1 and 2 are taken over words, for passages of PASSAGE words, and digests of windows settle
the borders: these are shorter than `window` bytes as a rule and are counted, not removed.

Defined results: null and empty texts, and texts shorter than `window` bytes, lose nothing. Very long texts are read whole; one of 256 MB or more is refused with an error, as places are 28 bits. Ties do not occur: a
smallest gram that occurs twice in a window is taken at its first place. Repeated rows are copies of each other. An empty
table gives no rows. Null or repeated ids are carried along; extra columns are ignored unless asked for with `carry`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, release
from .common import Rolling, doubled, grams, lists, signed, stored, text_chunks, text_of, word_spans

GRAM = 32
#: Words of a passage (more than 50), and of the grams that anchor it.
PASSAGE, WORDS = 51, 16
HOT = 48
#: Bytes gathered for one suffix array.
CHUNK = 1 << 20
PLACE_BITS = 28


def anchored(hashed: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one smallest gram: text number, first and last start, place of the gram. hashed: of each gram."""
    reach = window - gram + 1
    n_windows = len(hashed) - reach + 1
    if n_windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    place = np.arange(len(hashed), dtype=np.int64)
    owner = np.searchsorted(offsets, place, side="right") - 1
    keys = (hashed >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | (place - offsets[owner]).astype(np.uint64)
    least, width = keys, 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    owner = owner[:n_windows]
    valid = place[:n_windows] + window <= offsets[owner + 1]
    anchor = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    change = np.empty(n_windows, bool)
    change[0] = True
    change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(change & valid)
    after = np.empty(n_windows, bool)
    after[-1] = True
    after[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(after & valid)
    text = owner[first]
    return text, first, last, anchor[first] + offsets[text]


def segments(data: np.ndarray, offsets: np.ndarray, window: int, rolling: Rolling, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, first and last window start, anchor place (in the text), anchor hash and segment hash of each segment."""
    hashed = grams(data, gram)
    text, first, last, at = anchored(hashed, offsets, window, gram)
    whole = rolling.ranges(first, last + window) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return text, first - offsets[text], last - offsets[text], at - offsets[text], hashed[at], whole


def worded(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and where each text's words start and end among them."""
    starts, ends, owner = word_spans(data, offsets)
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(owner, minlength=len(offsets) - 1), out=at[1:])
    return rolling.ranges(starts, ends), at


def passages(data: np.ndarray, offsets: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """As `segments`, with words for bytes and PASSAGE words for the window."""
    words, at = worded(data, offsets, rolling)
    hashed = doubled(words, WORDS)[: max(0, len(words) - WORDS + 1)]
    text, first, last, place = anchored(hashed, at, PASSAGE, WORDS)
    whole = Rolling(words).ranges(first, last + PASSAGE) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return text, first - at[text], last - at[text], place - at[text], hashed[place], whole


def factor_ranks(data: np.ndarray, window: int) -> np.ndarray:
    """Rank of each suffix among all, by its first `window` bytes (padded by a byte below all others): equal ranks, equal bytes.

    Ranks are doubled; a suffix whose rank is its own already keeps it, and only the others are sorted again.
    """
    n = len(data)
    wide = np.zeros(n + window, np.uint64)
    wide[:n] = data.astype(np.uint64) + np.uint64(1)
    span = min(7, window)
    packed = np.zeros(n, np.uint64)
    for j in range(span):
        packed = packed * np.uint64(512) + wide[j : n + j]
    # a rank is the place of its first suffix in suffix order, so that ranks of finished suffixes stay valid
    rank, tied = np.zeros(n, np.int64), np.arange(n)
    tied = _ranked(rank, tied, packed, np.zeros(n, np.int64))
    while span < window and len(tied):
        step = min(span, window - span)
        after = tied + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[tied]
        tied = _ranked(rank, tied, first * (n + 2) + second, first)
        span += step
    return rank


def _ranked(rank: np.ndarray, rows: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Set the rank of `rows` by their keys; `first`: the rank they share so far. Returns the rows that still share one."""
    order = np.argsort(keys)
    keys, base = keys[order], first[order]
    new = np.ones(len(rows), bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.arange(len(rows))
    group = np.ones(len(rows), bool)
    group[1:] = base[1:] != base[:-1]
    head = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
    rank[rows[order]] = base + head
    alone = new & np.append(new[1:], True)
    return rows[order[~alone]]


def factors(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at `starts` (ascending places): has an earlier one, has a later one, the same first `window` bytes?

    In suffix order, suffixes with a common prefix of `window` bytes are neighbours. A suffix's longest previous factor
    reaches `window` if a smaller place stands before or after it in that run; that is so unless it is the run's smallest.
    """
    rank = factor_ranks(data, window)[starts]
    order = np.lexsort((starts, rank))
    inverse = rank[order]
    head = np.empty(len(order), bool)
    head[:1] = True
    head[1:] = inverse[1:] != inverse[:-1]
    tail = np.empty(len(order), bool)
    tail[-1:] = True
    tail[:-1] = head[1:]
    earlier, later = np.empty(len(order), bool), np.empty(len(order), bool)
    earlier[order], later[order] = ~head, ~tail
    return earlier, later


def runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end) spans as maximal runs."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(head)
    return np.column_stack([spans[at, 0], np.append(reach[at[1:] - 1], reach[-1])])


def _pack(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (first << 20) | ((last - first) << 10) | (place - first)


NO_PASSAGES = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))


def _anchored(window: int, carry: list[str], with_passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                size = np.diff(offsets)
                if len(size) and size.max() >= 1 << PLACE_BITS:
                    raise ValueError("a text of 256 MB or more is not supported")
                rolling = Rolling(data, 1)
                text, first, last, place, anchor, whole = segments(data, offsets, window, rolling)
                counts = np.bincount(text, minlength=hi - lo)
                of, one, end, at, gram, span = passages(data, offsets, rolling) if with_passages else NO_PASSAGES
                worded = np.bincount(of, minlength=hi - lo)
                raw = data.tobytes()
                packed = [zlib.compress(raw[a:b], 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), *[batch[c].slice(lo, hi - lo) for c in carry], pa.array(size), pa.array(packed, pa.binary()), lists(signed(anchor), counts, pa.int64()), lists(signed(whole), counts, pa.int64()), lists(_pack(first, last, place), counts, pa.int64()), *(lists(v, worded, pa.int64()) for v in (signed(gram), signed(span), _pack(one, end, at)))],
                    names=["rid", *carry, "n_bytes", "packed", "a", "c", "q", "wa", "wc", "wq"],
                )
                row += hi - lo

    return run


#: What a row of contents is: bytes; a block of windows of a hot anchor's segment; the windows of a segment of words.
TEXT, BYTES, PASSAGES = 0, 1, 2
#: Windows of a block.
BLOCK = 16


def _contents(window: int):
    """(rid, packed, wanted segments) -> their places and bytes, or for hot anchors and passages the digests of their windows.

    Windows of hot anchors come in blocks that begin at multiples of BLOCK places from the anchor, so that equal bytes make
    equal blocks. b1, b2: digest of the block's bytes; w1, w2: of its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [[] for _ in CONTENT_NAMES], 0
            for row, packed, wants in zip(*(batch[n].to_pylist() for n in ("rid", "packed", "want")), strict=True):
                data = zlib.decompress(packed)
                rolling = words = None
                for want in wants:
                    what, q = want["what"], want["q"]
                    s, width = q >> 20, (q >> 10) & 1023
                    if what != TEXT and rolling is None:
                        buffer = np.frombuffer(data, np.uint8)
                        rolling = Rolling(buffer, 0), Rolling(buffer, 1)
                    if what == TEXT:
                        parts = [[0], [data[s : s + width + window]], [None], [None], [None], [None]]
                        size += width + window
                    elif what == PASSAGES:
                        if words is None:
                            words = Rolling(worded(buffer, np.array([0, len(buffer)]), rolling[1])[0])
                        at = np.arange(s, s + width + 1)
                        parts = [[0], [None], [None], [None], [words.ranges(at, at + PASSAGE).view(np.int64).tolist()], [None]]
                        size += 8 * width
                    else:
                        at = np.arange(s, s + width + 1)
                        block = (at - s - (q & 1023)) // BLOCK
                        cut = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
                        end = np.append(cut[1:], len(at))
                        b = [r.ranges(at[cut], at[end - 1] + window).view(np.int64).tolist() for r in rolling]
                        w = [r.ranges(at, at + window).view(np.int64).tolist() for r in rolling]
                        parts = [cut.tolist(), [None] * len(cut), *b, *([x[i:j] for i, j in zip(cut.tolist(), end.tolist(), strict=True)] for x in w)]
                        size += 16 * width
                    n = len(parts[0])
                    for o, v in zip(out, ([what] * n, [want["a"]] * n, [want["c"]] * n, [row] * n, [q] * n, [want["all"]] * n, *parts), strict=True):
                        o += v
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, CONTENT_TYPES, strict=True)], names=CONTENT_NAMES)
                    out, size = [[] for _ in CONTENT_NAMES], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, CONTENT_TYPES, strict=True)], names=CONTENT_NAMES)

    return run


CONTENT_NAMES = ["what", "a", "c", "rid", "q", "all", "first", "content", "b1", "b2", "w1", "w2"]
CONTENT_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _hot_marks(blocks: DataFrame, keep: str) -> DataFrame:
    """Blocks of windows (with their places) -> marked ranges (rid, q, lo, hi) of window starts.

    With keep="first", equal blocks after the first are repeats as a whole; only the first of them, and blocks that occur
    once, are taken apart into windows. With keep="none" all are: their windows are counted at once.
    """
    whole, apart = None, blocks
    if keep == "first":
        firsts = stored(blocks.groupBy("b1", "b2").agg(F.min("place").alias("kept")), "blocks")
        known = blocks.join(firsts.hint("merge"), ["b1", "b2"])
        last = F.col("first") + F.size("w1") - 1
        whole, apart = known.where("place > kept").select("place.rid", "place.q", F.col("first").alias("lo"), last.alias("hi")), known.where("place = kept")
    single = apart.select("place", "first", F.posexplode(F.arrays_zip("w1", "w2")).alias("i", "w"))
    single = single.select("place", (F.col("first") + F.col("i")).alias("first"), "w.w1", "w.w2")
    single = stored(single, "single-windows") if keep == "first" else single
    # stored, so that a digest that very many segments share can be split in the join; the join is the same at every size
    windows = stored(single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m"), F.min("place").alias("kept")).where("m >= 2"), "windows")
    again = single.join(windows.hint("merge"), ["w1", "w2"])
    if keep == "first":
        again = again.where("place > kept")
    marks = again.select("place.rid", "place.q", F.col("first").alias("lo"), F.col("first").alias("hi"))
    return marks if whole is None else whole.unionByName(marks)


def _resolve(window: int, keep: str):
    """Rows sorted by anchor -> marked ranges (lo, hi) of window starts, counted from the segment's first."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        # rows of one or more whole anchors, in row order within each anchor
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        size = np.array([len(r[2]) for r in rows])
        at = np.concatenate([[0], np.cumsum(size)])
        count = size - window + 1
        owner = np.repeat(np.arange(len(rows)), count)
        local = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        earlier, later = factors(data, at[owner] + local, window)
        hit = earlier if keep == "first" else earlier | later
        edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (owner[1:] != owner[:-1])]))
        stop = np.flatnonzero(hit & np.concatenate([~hit[1:] | (owner[1:] != owner[:-1]), [True]]))
        of = [rows[i][1] for i in owner[edge]]
        return pa.RecordBatch.from_arrays([pa.array([x["rid"] for x in of], pa.int64()), pa.array([x["q"] for x in of], pa.int64()), pa.array(local[edge].astype(np.int32)), pa.array(local[stop].astype(np.int32))], names=["rid", "q", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, anchor = [], 0, None
        for batch in batches:
            for row in zip(*(batch[n].to_pylist() for n in ("a", "place", "content")), strict=True):
                if row[0] != anchor and held >= CHUNK:
                    yield marks(rows)
                    rows, held = [], 0
                anchor = row[0]
                rows.append(row)
                held += len(row[2])
        if rows:
            yield marks(rows)

    return run


def _numbered(rows: DataFrame) -> Broadcast:
    """rows(rid) -> the set of their numbers, 64 to a word: the words' numbers, ascending, and their bits."""
    bit = F.expr("shiftleft(1L, cast(rid & 63 as int))")
    words = rows.groupBy(F.shiftright("rid", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    at, bits = (words[c].to_numpy() for c in ("at", "bits"))
    order = np.argsort(at)
    return rows.sparkSession.sparkContext.broadcast((at[order], bits[order].view(np.uint64)))


def _among(numbers: Broadcast, inside: bool):
    """The rows whose numbers are in the set, or those whose numbers are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = numbers.value
        for batch in batches:
            rid = batch["rid"].to_numpy()
            has = np.zeros(len(rid), bool)
            if len(at):
                word = np.minimum(np.searchsorted(at, rid >> 6), len(at) - 1)
                has = (at[word] == rid >> 6) & (bits[word] >> (rid & 63).astype(np.uint64) & np.uint64(1) == 1)
            yield batch.filter(pa.array(has == inside))

    return run


def _portions(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about `most` bytes, however well they compress; whole rows only."""
    held = np.cumsum(batch["n_bytes"].to_numpy()) // most
    edges = np.concatenate([[0], np.flatnonzero(np.diff(held)) + 1, [batch.num_rows]])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield batch.slice(lo, hi - lo)


def _cut(window: int, carry: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in _portions(batch)):
            out = [[] for _ in range(5 + with_text)]
            for packed, spans, words in zip(batch["packed"].to_pylist(), batch["spans"], batch["words"], strict=True):
                data = zlib.decompress(packed)
                spans = spans.values
                gone = merged(np.column_stack([spans.field("lo").to_numpy(), spans.field("hi").to_numpy()])) if spans is not None and len(spans) else np.zeros((0, 2), np.int64)
                left, kept = 0, []
                for lo, hi in gone.tolist():
                    kept.append(data[left:lo])
                    left = hi
                kept.append(data[left:])
                rest = b"".join(kept)
                out[0].append(int((gone[:, 1] - gone[:, 0]).sum()))
                out[1].append(len(gone))
                out[2].append(hashlib.sha256(rest).hexdigest())
                out[3].append([{"start": lo, "end": hi} for lo, hi in gone.tolist()])
                words = words.values
                held = merged(np.column_stack([words.field("lo").to_numpy(), words.field("hi").to_numpy()])) if words is not None and len(words) else gone[:0]
                out[4].append(int((held[:, 1] - held[:, 0]).sum()))
                if with_text:
                    out[5].append(_whole_characters(data, gone.tolist()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64(), pa.string()]
            names = ["n_removed", "n_spans", "kept_sha256", "removed", "n_shared_words", "text"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in carry], batch["n_bytes"], *[pa.array(v, t) for v, t in zip(out, kinds, strict=False)]], names=[*carry, "n_bytes", *names[: len(out)]])

    return run


def _whole_characters(data: bytes, gone: list) -> str:
    """What is left of the text if only characters that lie wholly in a span go."""
    left, kept = 0, []
    for lo, hi in gone:
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        kept.append(data[left:lo])
        left = hi
    return b"".join([*kept, data[left:]]).decode("utf-8", "replace")


def _classes(parts: DataFrame) -> DataFrame:
    """parts(rid, a, c, q) -> a, c, n (segments), most (largest rid), rid and q of the first segment."""
    return parts.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.max("rid").alias("most"), F.min(F.struct("rid", "q")).alias("rep")).select("a", "c", "n", "most", "rep.rid", "rep.q")


def _passages(base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments of words; the classes whose anchor two documents have (all: two have the class); what to ask of the contents."""
    parts = base.select("rid", F.inline(F.arrays_zip(F.col("wa").alias("a"), F.col("wc").alias("c"), F.col("wq").alias("q"))))
    classes = _classes(parts)
    anchors = classes.groupBy("a").agg(F.count(F.lit(1)).alias("d"), F.min("rid").alias("lo"), F.max("most").alias("hi")).where("lo < hi").select("a", "d")
    live = stored(classes.join(anchors, "a").select("a", "c", "rid", "q", "d", (F.col("rid") < F.col("most")).alias("all")), "passages")
    release(base.sparkSession)
    return parts, live, live.where("d >= 2").select("rid", "a", "c", "q", F.lit(PASSAGES).alias("what"), "all")


def _shared_words(parts: DataFrame, live: DataFrame, content: DataFrame) -> DataFrame:
    """(rid, lo, hi): spans of words in passages that another document holds too."""
    start, width = F.shiftright("q", 20), F.shiftright("q", 10).bitwiseAND(1023)
    rows = content.where(F.col("what") == PASSAGES).select("a", "c", "rid", "all", F.posexplode("w1").alias("first", "w"))
    windows = stored(rows.groupBy("a", "w").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.max("all").alias("any")).where("lo < hi or any").select("a", "w"), "windows")
    marks = rows.where("not all").join(windows.hint("merge"), ["a", "w"]).select("a", "c", F.col("first").alias("lo"), F.col("first").alias("hi"))
    whole = live.where("all").select("a", "c", F.lit(0).alias("lo"), F.lit(1023).alias("hi"))
    spans = parts.join(whole.unionByName(marks), ["a", "c"])
    found = stored(spans.select("rid", (start + F.col("lo")).alias("lo"), (start + F.least(F.col("hi").cast("long"), width) + PASSAGE).alias("hi")), "shared-words")
    forget(windows)
    return found


def suffix_dedup(docs: DataFrame, window: int = 400, keep: str = "none", carry: tuple[str, ...] = ("doc_id",), with_text: bool = False, with_passages: bool = False) -> DataFrame:
    """docs(text, *carry) -> *carry, n_bytes, n_removed, n_spans, kept_sha256, removed (spans of bytes)[, text as left][, n_shared_words].

    n_shared_words (asked for with `with_passages`) counts the words in passages, PASSAGE words in a row, that another
    document holds as well, however few bytes they have.
    """
    if not GRAM < window <= 1000 or keep not in ("none", "first"):
        raise ValueError(f"window {window} must be in {GRAM + 1}..1000, and keep {keep!r} be none or first")
    names = [f"k{i}" for i in range(len(carry))]
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    typed = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, carry, strict=True))
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], text_of().alias("text"))
    base = stored(source.mapInArrow(_anchored(window, names, with_passages), f"rid long, {typed}, n_bytes long, packed binary, " + ", ".join(f"{x} array<long>" for x in ("a", "c", "q", "wa", "wc", "wq"))), "anchors")
    parts = base.select("rid", F.inline(F.arrays_zip("a", "c", "q")))
    classes = _classes(parts)
    anchors = classes.groupBy("a").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("total")).where("total >= 2").select("a", "d")
    live = stored(classes.join(anchors, "a").select("a", "c", "n", "d", "rid", "q"), "classes")
    release(spark)
    asked = live.where("d >= 2").select("rid", "a", "c", "q", F.when(F.col("d") <= HOT, TEXT).otherwise(BYTES).alias("what"), F.lit(False).alias("all"))
    if with_passages:
        word_parts, word_live, more = _passages(base)
        asked = asked.unionByName(more)
    want = asked.groupBy("rid").agg(F.collect_list(F.struct("a", "c", "q", "what", "all")).alias("want"))
    asked_of = base.select("rid", "packed").mapInArrow(_among(_numbered(asked.select("rid")), True), "rid long, packed binary")
    content = stored(asked_of.join(want.hint("merge"), "rid").select("rid", "packed", "want").mapInArrow(_contents(window), "what int, a long, c long, rid long, q long, all boolean, first int, content binary, b1 long, b2 long, w1 array<long>, w2 array<long>"), "contents", by="what")
    release(spark)
    content = content.withColumn("place", F.struct("rid", "q"))
    texts = content.where(F.col("what") == TEXT)
    hot = _hot_marks(content.where(F.col("what") == BYTES), keep)
    found = texts.select("a", "place", "content").repartition("a").sortWithinPartitions("a", "place").mapInArrow(_resolve(window, keep), "rid long, q long, lo int, hi int")
    whole = live.where("n >= 2").select("a", "c", F.lit(0).alias("lo"), F.lit(1023).alias("hi"), F.struct("rid", "q").alias("rep"))
    some = stored(found.unionByName(hot), "marks")
    words = None
    if with_passages:
        words = _shared_words(word_parts, word_live, content)
        forget(word_live)
    forget(content), release(spark)
    start, width = F.shiftright("q", 20), F.shiftright("q", 10).bitwiseAND(1023)
    columns = ("rid", "q", "lo", "hi")
    everywhere = parts.join(whole, ["a", "c"])
    if keep == "first":
        everywhere = everywhere.where(F.struct("rid", "q") > F.col("rep"))
    marked = everywhere.select(*columns).unionByName(some.select(*columns))
    span, none = F.struct("lo", "hi"), F.lit(None).cast("struct<lo:long,hi:long>")
    spans = marked.select("rid", (start + F.col("lo")).alias("lo"), (start + F.least(F.col("hi").cast("long"), width) + window).alias("hi")).select("rid", span.alias("s"), none.alias("w"))
    if words is not None:
        spans = spans.unionByName(words.select("rid", none.alias("s"), span.alias("w")))
    gone = stored(spans.groupBy("rid").agg(F.collect_list("s").alias("spans"), F.collect_list("w").alias("words")), "spans")
    forget(live), forget(some), forget(words), release(spark)
    # the others keep all that they have, and need not be shuffled
    held, cut, numbers = base.select("rid", *names, "n_bytes", "packed"), _cut(window, names, with_text), _numbered(gone.select("rid"))
    hit = held.mapInArrow(_among(numbers, True), f"rid long, {typed}, n_bytes long, packed binary").join(gone.hint("merge"), "rid").select(*names, "n_bytes", "packed", "spans", "words")
    rest, others = held.withColumns({c: F.lit(None).cast("array<struct<lo:long,hi:long>>") for c in ("spans", "words")}), _among(numbers, False)
    shape = f"{typed}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, n_shared_words long" + ", text string" * with_text
    out = hit.mapInArrow(cut, shape).unionByName(rest.mapInArrow(lambda batches: cut(others(batches)), shape))
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", *(["text"] if with_text else []), *(["n_shared_words"] if with_passages else []))
