"""Quality rules: distribution divergence from language references.

Two passes over the documents. The first adds up, over all documents, each language's histogram of character classes and of
common words (sums are formed in each batch, so a few rows leave each task). The second compares each document's own
histograms with its language's by the Jensen-Shannon distance (base 2, so 0 to 1) and rejects documents that are further off
than `char_limit` or `word_limit`. Short texts have noisy histograms: below `min_chars` characters or `min_words` words the
respective distance is not judged. Languages without a word list share one reference, and only their characters are judged.

Defined results: null and empty texts have no words and fail the base rule. Very long texts are read whole. Null or unknown
languages use the shared reference. A distance that equals its limit is not over it. Repeated rows each get their row, and
count each time in the references. An empty table gives no rows. Extra columns are ignored, whatever their names, unless
asked for with `carry`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, text_chunks, text_of, word_spans

# fixed values: frequent function words of each language
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou",
}
LANGUAGES = sorted(COMMON_WORDS)
SYMBOLS = b"#*$%&|<>"
#: Classes of characters: lower-case, upper-case, digit, space, line end, stop, other mark, symbol, other; beyond ASCII.
CLASSES = 10
_class = np.full(256, 8, np.int8)
_class[0x61:0x7B] = 0
_class[0x41:0x5B] = 1
_class[0x30:0x3A] = 2
_class[[0x20, 0x09]] = 3
_class[[0x0A, 0x0D]] = 4
_class[list(b".,;:")] = 5
_class[list(b"!?'\"()-/_[]{}=+@\\^`~")] = 6
_class[list(SYMBOLS)] = 7
_class[0xC0:] = 9
_class[0x80:0xC0] = -1  # within a character
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[0x41:0x5B] = NOT_LETTER[0x61:0x7B] = False
NOT_LETTER[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
CONTINUES = np.zeros(256, bool)
CONTINUES[0x80:0xC0] = True


def _hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w.encode()) for w in words])]).astype(np.int64)
    return Rolling(data).ranges(at[:-1], at[1:])


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (owner, value) pairs in order: is there an equal pair at all, and is there an earlier one?"""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    again = np.concatenate([[False], same])
    any_other = again | np.concatenate([same, [False]])
    out = np.empty((2, len(order)), bool)
    out[0, order], out[1, order] = any_other, again
    return out[0], out[1]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offsets) - 1
    starts, ends, owner = word_spans(data, offsets)
    out = {"n_words": np.bincount(owner, minlength=n), "n_symbols": per_text(IS_SYMBOL[data], offsets)}
    from .common import WORD_SPACE

    worded = ~WORD_SPACE[data]
    out["word_chars"] = per_text(worded & ~CONTINUES[data], offsets)
    rolling = Rolling(data) if len(data) else None
    # lines
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.union1d(offsets[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_owner = np.searchsorted(offsets, line_start, side="right") - 1
    stop = np.minimum(np.append(line_start[1:], len(data)), offsets[line_owner + 1])
    stop = np.where((stop > line_start) & (data[np.maximum(stop - 1, 0)] == 0x0A), stop - 1, stop) if len(stop) else stop
    total = np.concatenate([[0], np.cumsum(worded, dtype=np.int64)])
    full = total[stop] > total[line_start] if len(stop) else np.zeros(0, bool)
    line_owner, line_start, stop = line_owner[full], line_start[full], stop[full]
    again = repeated(line_owner, rolling.ranges(line_start, stop))[1] if len(stop) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=n)
    # windows of three words
    inside = np.zeros(len(owner), bool)
    if len(owner) >= 3:
        h = rolling.ranges(starts, ends)
        three = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xD1342543DE82EF95) + h[2:]
        at = np.flatnonzero(owner[2:] == owner[:-2])
        twice = at[repeated(owner[at], three[at])[0]]
        for j in range(3):
            inside[twice + j] = True
    out["n_repeat_words"] = np.bincount(owner[inside], minlength=n)
    return out


def histograms(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text's character classes, and of its common words (as numbered in `known`, sorted hashes; last: others)."""
    n = len(offsets) - 1
    kind = _class[data]
    chars = np.column_stack([per_text(kind == k, offsets) for k in range(CLASSES)])
    starts, ends, owner = word_spans(data, offsets, NOT_LETTER)
    words = np.zeros((n, len(known) + 1), np.int64)
    if len(starts):
        h = Rolling(LOWER[data]).ranges(starts, ends)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        cell = np.where(known[at] == h, at, len(known))
        words = np.bincount(owner * (len(known) + 1) + cell, minlength=n * (len(known) + 1)).reshape(n, -1)
    return chars, words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of count rows p from one distribution q."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def _known() -> tuple[np.ndarray, dict[str, np.ndarray]]:
    words = sorted({w for x in COMMON_WORDS.values() for w in x.split()})
    known = np.sort(_hash(words))
    of = {lang: np.searchsorted(known, _hash(x.split())) for lang, x in COMMON_WORDS.items()}
    return known, of


def own_words(words: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A language's own common words, and all others in one."""
    mine = words[:, columns]
    return np.column_stack([mine, words.sum(axis=1) - mine.sum(axis=1)])


def _languages(column: pa.Array) -> np.ndarray:
    number = {x: i for i, x in enumerate(LANGUAGES)}
    return np.array([number.get(x, len(LANGUAGES)) for x in column.to_pylist()], np.int64)


def references(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Character and word counts of each language (the last: of all others), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = _known()
        sums = np.zeros((len(LANGUAGES) + 1, CLASSES + len(known) + 1), np.int64)
        for batch in batches:
            language = _languages(batch["lang"])
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                np.add.at(sums, language[lo:hi], np.column_stack(histograms(data, offsets, known)))
        row, column = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(column), pa.array(sums[row, column])], names=["row", "col", "n"])

    known, _ = _known()
    out = np.zeros((len(LANGUAGES) + 1, CLASSES + len(known) + 1), np.int64)
    for r in docs.select(F.col("lang").cast("string").alias("lang"), text_of().alias("text")).mapInArrow(run, "row long, col long, n long").groupBy("row", "col").agg(F.sum("n").alias("n")).collect():
        out[r[0], r[1]] = r[2]
    return out[:, :CLASSES], out[:, CLASSES:]


def quality_rules(docs: DataFrame, char_limit: float = 0.3, word_limit: float = 0.31, min_chars: int = 200, min_words: int = 100, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, lang, *carry) -> *carry, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_js, word_js."""
    of_chars, of_words = references(docs)
    names = [f"k{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, columns = _known()
        for batch in batches:
            language = _languages(batch["lang"])
            for lo, hi, data, offsets in text_chunks(batch["text"]):
                base = base_counts(data, offsets)
                chars, words = histograms(data, offsets, known)
                char_js, word_js = np.zeros(hi - lo), np.zeros(hi - lo)
                for k in range(len(LANGUAGES) + 1):
                    rows = np.flatnonzero(language[lo:hi] == k)
                    if len(rows):
                        char_js[rows] = js_distance(chars[rows], of_chars[k])
                        if k < len(LANGUAGES):
                            own = columns[LANGUAGES[k]]
                            word_js[rows] = js_distance(own_words(words[rows], own), own_words(of_words[k : k + 1], own)[0])
                n_words, n_repeat = base["n_words"], base["n_repeat_words"]
                failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
                n_chars = chars.sum(axis=1)
                off = ((n_chars >= min_chars) & (char_js > char_limit)) | ((n_words >= min_words) & (word_js > word_limit))
                counts = [pa.array(base[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays([*[batch[c].slice(lo, hi - lo) for c in names], *counts, pa.array(failed), pa.array(~failed & ~off), pa.array(char_js), pa.array(word_js)], names=[*names, *COUNTS, "base_failed", "kept", "char_js", "word_js"])

    kinds = dict(docs.dtypes)
    typed = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, carry, strict=True))
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    shape = f"{typed}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, char_js double, word_js double"
    return source.mapInArrow(run, shape).select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], *COUNTS, "base_failed", "kept", "char_js", "word_js")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
