"""Packing along a space-filling curve.

Documents are tokenised, their hashed token vectors projected to three dimensions and turned into a key on a Hilbert
curve. The narrow rows (row, key, length) are range-sorted by the key, so that neighbouring documents on the curve follow
each other; running sums within the ranges and the ranges' totals (one number for each partition) give each document its
place in one long stream. The stream is cut every `size` tokens: each sequence is full but the last, and a document that
crosses a cut goes on in the next sequence. The token ids meet their places in a join and are cut there.

Defined results: null and empty texts are one end token. Very long texts are tokenised whole and go on through as many
sequences as they need. Equal keys are ordered by row number. Repeated rows are packed once each. An empty table gives no
rows. Extra columns are ignored, whatever their names, unless asked for with `carry`.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import release
from .common import splitmix, stored, text_of

DIMENSIONS, BITS, BUCKETS = 3, 10, 64
#: Distinct words, and parts of words, whose ids a worker process remembers.
REMEMBERED = 1_000_000
# fixed values: marks that end a word as one token group; not the apostrophe (it starts endings) and the underscore
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Token ids of texts, word by word: this vocabulary's splitting rule never joins characters across white space.

    A worker process keeps what it has seen across tasks. New words of letters and a tail of marks are put together from
    the ids of both parts, so that only new letter runs and unusual words go through the tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer, self.known, self.parts, self.remembered = tokenizer(path), {"": b""}, {"": b""}, remembered
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def _encode_group(self, group: str) -> bytes:
        """Ids of a lower-case string that is one token group, straight from the vocabulary's merges over byte letters."""
        if not group.isascii():
            group = group.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(group)]).tobytes()

    def learn(self, words: set[str]) -> None:
        parts, split, other, fresh = self.parts, [], [], set()
        for w in words:
            letters = w.rstrip(MARKS)
            # Latin letters up to U+00FF are unchanged by normalisation and have one lower case
            if letters.isalpha() and (letters.isascii() or max(letters) <= "\xff"):
                tail, low = w[len(letters) :], letters.lower()
                split.append((w, low, tail))
                if low not in parts:
                    fresh.add(low)
                if tail not in parts:
                    fresh.add(tail)
            else:
                other.append(w)
        for group in fresh:
            parts[group] = self._encode_group(group)
        for w, letters, tail in split:
            self.known[w] = parts[letters] + parts[tail]
        for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False) if other else (), strict=True):
            self.known[w] = np.array(e.ids, np.uint16).tobytes()

    def __call__(self, texts: list[str], end: int) -> Iterator[bytes]:
        if len(self.known) > self.remembered:
            self.known = {"": b""}
        if len(self.parts) > self.remembered:
            self.parts = {"": b""}
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        holes = [[j for j, i in enumerate(ids) if i is None] if None in ids else () for ids in found]
        self.learn({words[j] for words, at in zip(split, holes, strict=True) for j in at})
        for words, ids, at in zip(split, found, holes, strict=True):
            for j in at:
                ids[j] = self.known[words[j]]
            yield b"".join(ids) + end.to_bytes(2, "little")


@cache
def word_tokens(path: str, remembered: int) -> WordTokens:
    return WordTokens(path, remembered)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer points (rows) on the Hilbert curve through a cube of 2**bits to a side (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@cache
def bucket_of_ids() -> np.ndarray:
    return (splitmix(1 << 16, 5) % np.uint64(BUCKETS)).astype(np.int64)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document's hashed, normalised and projected token counts."""
    n = np.array([len(i) for i in ids])
    cell = np.repeat(np.arange(len(ids)) * BUCKETS, n) + bucket_of_ids()[np.concatenate(ids)]
    v = np.log1p(np.bincount(cell, minlength=len(ids) * BUCKETS).reshape(-1, BUCKETS))
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    signs = np.where(splitmix(BUCKETS * DIMENSIONS, 77) >> np.uint64(63), 1.0, -1.0).reshape(BUCKETS, DIMENSIONS)
    y = v @ signs
    side = 1 << BITS
    return hilbert(np.clip(((y + 3) * (side / 6)).astype(np.int64), 0, side - 1))


def _tokens(path: str, end: int, carry: list[str], remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = word_tokens(path, remembered), TaskContext.get().partitionId() << 33
        gc.disable()  # the word tables are large and have no cycles; walking them again and again is wasted time
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    ids = list(encode(part["text"].to_pylist(), end))
                    arrays = [np.frombuffer(i, np.uint16) for i in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ids))), *[part[c] for c in carry], pa.array(curve_keys(arrays)), pa.array([len(a) for a in arrays], pa.int64()), pa.array(ids, pa.binary())], names=["rid", *carry, "key", "n", "ids"])
                    row += len(ids)
        finally:
            gc.enable()

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch["n"].to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch["rid"], pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(ends)], names=["rid", "part", "local", "reach"])
        at = int(ends[-1]) if len(ends) else at


def _pieces(size: int, carry: list[str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, length, crc, total, seq, off, kept = [], [], [], [], [], [], [], []
            for i, (ids, at) in enumerate(zip(batch["ids"].to_pylist(), batch["at"].to_pylist(), strict=True)):
                ids = np.frombuffer(ids, np.uint16).astype("<u4")
                lo = 0
                while lo < len(ids):
                    hi = min(len(ids), lo + size - (at + lo) % size)
                    piece = ids[lo:hi].tobytes()
                    rows.append(i), start.append(lo), length.append(hi - lo), crc.append(zlib.crc32(piece)), total.append(len(ids)), seq.append((at + lo) // size), off.append((at + lo) % size)
                    if with_ids:
                        kept.append(ids[lo:hi])
                    lo = hi
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch[c].take(take) for c in carry], *[pa.array(v, pa.int64()) for v in (start, length, crc, total, seq, off)], *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])], names=[*carry, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end: int = 2, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """docs(text, *carry) -> a row per piece: *carry, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A worker process remembers the ids of `remembered` words, and of as many parts of words.
    """
    names = [f"k{i}" for i in range(len(carry))]
    kinds = dict(docs.dtypes)
    typed = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, carry, strict=True))
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], text_of().alias("text"))
    tokens = stored(source.mapInArrow(_tokens(vocabulary, end, names, remembered), f"rid long, {typed}, key long, n long, ids binary"), "tokens")
    parts = max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    along = tokens.select("key", "rid", "n").repartitionByRange(parts, "key", "rid").sortWithinPartitions("key", "rid")
    placed = stored(along.mapInArrow(_places, "rid long, part long, local long, reach long"), "places")
    release(tokens.sparkSession)
    # one row for each partition
    ranges = placed.groupBy("part").agg(F.max("reach").alias("reach"))
    base = ranges.select("part", (F.sum("reach").over(Window.orderBy("part")) - F.col("reach")).alias("base"))
    located = placed.join(F.broadcast(base), "part").select("rid", (F.col("base") + F.col("local")).alias("at"))
    cut = tokens.select("rid", *names, "ids").join(located.hint("merge"), "rid").select(*names, "ids", "at")
    shape = f"{typed}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return cut.mapInArrow(_pieces(size, names, with_ids), shape).select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
