"""Helpers shared by the training-data operators: durable intermediates and batch-wise text hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import stored as stored

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words by the SplitMix64 rule."""
    z = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


BLOCK = 1 << 15
P31 = np.uint64((1 << 31) - 1)
_31 = np.uint64(31)


def fold(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**62, brought to 0 .. 2**31 - 1 without changing them modulo 2**31 - 1 (the last is another zero)."""
    x = (x & P31) + (x >> _31)
    return (x & P31) + (x >> _31)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = fold(out[:more] * np.uint64(step))
        have, step = have + more, step * step % int(P31)
    return out


class Rolling:
    """Hashes of any ranges of one buffer of bytes (polynomials over random byte codes) or of 64-bit hashes, modulo the prime
    2**31 - 1 at two points. A prime modulus has no strings that clash whatever the point is, as a power of two has; two lanes give 62 bits.
    """

    POINTS = (0x2C5F1B37, 0x5A3D90E1)
    #: Powers that a worker process keeps; longer texts make their own.
    KEPT = 1 << 21
    _powers: list = []

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        kept = self._powers
        if not kept or len(kept[0][0]) < n + 1:
            size = max(n + 1, 1 << 16)
            kept = [(_powers_of(b, size), _powers_of(pow(b, -1, int(P31)), size)) for b in self.POINTS]
            if size <= self.KEPT:
                type(self)._powers = kept
        codes = splitmix(512, 0xA5A5 + which) >> np.uint64(34)
        self.lanes = []
        for k, (up, down) in enumerate(kept):
            own, sums = codes[256 * k : 256 * k + 256], np.zeros(n + 1, np.uint64)
            for lo in range(0, n, BLOCK):  # a block at a time stays in the processor's cache
                part = data[lo : lo + BLOCK]
                terms = own[part] if data.dtype == np.uint8 else part >> np.uint64(33) if k else part & P31
                terms *= up[lo : lo + len(terms)]
                low = terms & P31
                terms >>= _31
                terms += low
                terms[0] += sums[lo]
                np.cumsum(terms, out=sums[lo + 1 : lo + 1 + len(terms)])
            self.lanes.append((sums, down))

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lanes = [fold(fold(sums[ends] - sums[starts]) * down[starts]) for sums, down in self.lanes]
        high, low = (np.where(x == P31, np.uint64(0), x) for x in lanes)
        return mix((high << _31 | low) + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def doubled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k numbers (a power of two) that start at each place, by doubling."""
    width = 1
    while width < k and len(h):
        more = h[width:]
        h = h[: len(more)] * np.uint64(0x9E3779B97F4A7C15)
        h += more
        h ^= h >> np.uint64(29)
        width *= 2
    return mix(h)


def grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes (a power of two) at each place."""
    codes, out = splitmix(256, 0xA5A5), np.zeros(max(0, len(data) - k + 1), np.uint64)
    for lo in range(0, len(out), BLOCK):
        out[lo : lo + BLOCK] = doubled(codes[data[lo : lo + BLOCK + k - 1]], k)
    return out


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string or binary column without nulls, about `most` bytes at a time; whole texts only."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes that lie in one text, and each run's text number."""
    inside = ~space[data]
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64, copy=False).view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and each row's count."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
