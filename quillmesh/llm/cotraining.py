"""Quality scores by co-training of two views of a document.

One classifier sees the text only (shares of character classes and common words, repetition, word lengths), the other the
page's metadata only (source, language, stated length). Both start from a bounded sample of labelled rows, which also fixes
the shape of their trees. In each round, each classifier scores every unlabelled document, and those that it is surest of, in
the classes' proportion, are labelled and handed to the other: the cut is found by counts of margins over the whole corpus,
and margins that are equal on the grid go together. The values of all leaves are then fitted again on the labelled rows and
all documents handed over so far, whose gradients and curvatures are summed on the executors. Each view is calibrated
isotonically on labelled rows kept apart, and the calibrated log-odds are combined by weights fitted on the same rows. All
documents are scored.

Views of all documents are stored once; of the unlabelled ones, the leaves they fall into. Sums are of whole numbers, so the
order of rows does not matter. The only bound on what is learned from is `most` labelled ids (and 2 * `most` rows of them,
first by a hash of the id). Rows whose crc32(id) mod 5 is 0 are never learned from.

Defined results: null and empty texts and null metadata are ordinary values; very long texts are read whole. A null id counts
as held out. Of several labels for one id the largest counts; equal margins are handed over together and get equal scores.
Without labels all scores are 0.5. An empty table gives no rows. Repeated rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import lists, stored, text_chunks, text_of
from .quality_rules import CLASSES, LANGUAGES, _known, base_counts, histograms
from .toxicity import held_out, sampled_labels

MOST, ROUNDS, SURE = 20_000, 3, 0.05
META_BUCKETS = 24
DEPTH, STEPS, ANCHOR, WEIGHT = 3, 3, 10.0, 0.3
#: Margins are counted, and compared, in steps of 1 / GRID; whole numbers stand for gradients in steps of 1 / UNIT.
GRID, FAR, UNIT = 1024, 1 << 15, 1 << 20


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    known, columns = _known()
    chars, words = histograms(data, offsets, known)
    base = base_counts(data, offsets)
    n_words = np.maximum(base["n_words"], 1)
    lines = np.maximum(chars[:, 4], 1)
    total = np.maximum(words.sum(axis=1), 1)
    common = np.column_stack([words[:, columns[lang]].sum(axis=1) / total for lang in LANGUAGES])
    return np.column_stack([chars / np.maximum(chars.sum(axis=1, keepdims=True), 1), common.max(axis=1), base["word_chars"] / n_words, base["n_symbols"] / n_words, base["n_dup_lines"] / lines, base["n_repeat_words"] / n_words, np.log1p(base["n_words"])])


TEXT_FEATURES = CLASSES + 6
META_FEATURES = META_BUCKETS + len(LANGUAGES) + 2


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed one-hot source and language, stated length."""
    out = np.zeros((len(source), META_FEATURES))
    for i, (s, x, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32((s or "").encode()) % META_BUCKETS] = 1
        out[i, META_BUCKETS + (LANGUAGES.index(x) if x in LANGUAGES else len(LANGUAGES))] = 1
        out[i, -1] = np.log1p(max(n or 0, 0))
    return out


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch["text"]):
            part = batch.slice(lo, hi - lo)
            both = text_view(data, offsets), meta_view(*(part[c].to_pylist() for c in ("source", "lang", "n_chars")))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], *(lists(v.ravel(), np.full(hi - lo, v.shape[1]), pa.float64()) for v in both)], names=["doc_id", "held_out", "a", "b"])


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c, n in (("a", TEXT_FEATURES), ("b", META_FEATURES)))


def _packed(leaves: np.ndarray) -> pa.Array:
    at = np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(leaves), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(leaves))])


def _unpacked(column: pa.Array) -> np.ndarray:
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(n, -1)


def margins(leaves: np.ndarray, start: float, values: np.ndarray) -> np.ndarray:
    score = np.full(len(leaves), start)
    for t, value in enumerate(values):
        score += value[leaves[:, t]]
    return score


def on_grid(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(margin * GRID), -FAR, FAR).astype(np.int64)


def told(leaves: list[np.ndarray], starts: list[float], history: list) -> list[np.ndarray]:
    """The label that each view was told of each row in the rounds so far, or -1. A round: values and cuts (low, high) of both views."""
    out = [np.full(len(leaves[0]), -1) for _ in (0, 1)]
    for values, cuts in history:
        for k in (0, 1):
            at, free = on_grid(margins(leaves[k], starts[k], values[k])), out[1 - k] < 0
            out[1 - k][free & (at <= cuts[k][0])] = 0
            out[1 - k][free & (at >= cuts[k][1])] = 1
    return out


def cut(counts: list[tuple[int, int]], n_low: int, n_high: int) -> tuple[int, int]:
    """The margins (on the grid) up to and from which rows are handed over: n_low and n_high rows and the equals of the last, if sure."""
    ends = []
    for sign, n in ((1, n_low), (-1, n_high)):
        end, seen = -FAR - 1, 0
        for at, c in sorted((sign * at, c) for at, c in counts):
            if seen >= n or at >= -GRID:  # only what the view is really sure of
                break
            end, seen = at, seen + c
        ends.append(sign * end)
    return ends[0], ends[1]


def slopes(leaves: np.ndarray, y: np.ndarray, start: float, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the logistic loss by the leaves' values, in 1 / UNIT, and how many rows share each pair of leaves."""
    n_leaves = values.shape[1]
    gradient = np.rint(UNIT * (1 / (1 + np.exp(-margins(leaves, start, values))) - y))
    g, h = np.zeros(values.size), np.zeros((values.size, values.size))
    for lo in range(0, len(y), 4096):
        part = leaves[lo : lo + 4096]
        one = np.zeros((len(part), values.size))
        one[np.arange(len(part))[:, None], np.arange(len(values)) * n_leaves + part] = 1
        g += gradient[lo : lo + 4096] @ one
        h += one.T @ one
    return g, h


class Unlabelled:
    """The unlabelled documents on the executors, as the leaves (a, b) they fall into."""

    def __init__(self, leaves: DataFrame, starts: list[float]):
        self.leaves, self.starts = leaves, starts

    def _over(self, run: Callable, shape: str, *given: object) -> DataFrame:
        shared = self.leaves.sparkSession.sparkContext.broadcast((self.starts, *given))
        return self.leaves.mapInArrow(lambda batches: run(([_unpacked(b["a"]), _unpacked(b["b"])] for b in batches if b.num_rows), *shared.value), shape)

    def counts(self, history: list, values: list[np.ndarray]) -> list[list[tuple[int, int]]]:
        """For each view, the margins (on the grid) of the rows that the other was not told of, and their counts."""

        def run(parts, starts, history, values):  # noqa: ANN001, ANN202
            for leaves in parts:
                known = told(leaves, starts, history)
                for k in (0, 1):
                    at, n = np.unique(on_grid(margins(leaves[k], starts[k], values[k]))[known[1 - k] < 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n.astype(np.int64))], names=["k", "at", "n"])

        rows = self._over(run, "k int, at long, n long", history, values).groupBy("k", "at").agg(F.sum("n")).collect()
        return [[(at, n) for k, at, n in rows if k == view] for view in (0, 1)]

    def slopes(self, history: list, values: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each view, the sums of `slopes` over all rows that it was told of, and their number."""
        width = values[0].size + 2  # gradient, counts of pairs of leaves, rows

        def run(parts, starts, history, values):  # noqa: ANN001, ANN202
            sums = [np.zeros((v.size, width)) for v in values]
            for leaves in parts:
                for k, y in enumerate(told(leaves, starts, history)):
                    rows = y >= 0
                    g, h = slopes(leaves[k][rows], y[rows], starts[k], values[k])
                    sums[k] += np.column_stack([g, h, np.full(len(g), rows.sum())])
            for k, s in enumerate(sums):
                if s[0, -1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), lists(s.ravel(), np.full(len(s), width), pa.float64())], names=["k", "i", "s"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for b in batches:
                for k, i, s in zip(b["k"].to_pylist(), b["i"].to_pylist(), b["s"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width), strict=True):
                    total[k, i] = total[k, i] + s if (k, i) in total else s.copy()
            if total:
                keys = np.array(list(total), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(np.concatenate(list(total.values())), np.full(len(total), width), pa.float64())], names=["k", "i", "s"])

        shape, out = "k int, i int, s array<double>", [np.zeros((v.size, width)) for v in values]
        for k, i, s in self._over(run, shape, history, values).repartition("k", "i").mapInArrow(add, shape).collect():
            out[k][i] = s
        return [(s[:, 0], s[:, 1:-1], int(s[0, -1])) for s in out]


class CoTrained:
    """The two fitted and calibrated views and their weights."""

    def start(self, y: np.ndarray, views: tuple[np.ndarray, np.ndarray]) -> CoTrained:
        self.models, self.n_unlabelled, self.handed = None, 0, []
        self.apart = np.arange(len(y)) % 4 == 3
        if len(np.unique(y[~self.apart])) == 2:
            self.models = [Boosted(rounds=50, depth=DEPTH).fit(v[~self.apart], y[~self.apart]) for v in views]
        return self

    def exchange(self, y: np.ndarray, views: tuple[np.ndarray, np.ndarray], unlabelled: Unlabelled, rounds: int = ROUNDS) -> CoTrained:
        y, leaves = y[~self.apart], [m.leaves(v[~self.apart]) for m, v in zip(self.models, views, strict=True)]
        first = [np.array([value for _, _, value in m.trees]) for m in self.models]
        values, history = first, []
        for _ in range(rounds):
            counts = unlabelled.counts(history, values)
            if not history:
                self.n_unlabelled = sum(n for _, n in counts[0])
            n = int(SURE * self.n_unlabelled)
            history = [*history, (values, [cut(c, int(n * (1 - y.mean())), int(n * y.mean())) for c in counts])]
            for _ in range(STEPS if n else 0):
                sums, new = unlabelled.slopes(history, values), []
                for k, (g, h, _) in enumerate(sums):
                    own = slopes(leaves[k], y, unlabelled.starts[k], values[k])
                    # a quarter bounds the curvature of the loss, so that no step overshoots
                    away = (own[0] + WEIGHT * g) / UNIT + ANCHOR * (values[k] - first[k]).ravel()
                    new.append(values[k] - np.linalg.solve((own[1] + WEIGHT * h) / 4 + ANCHOR * np.eye(len(g)), away).reshape(values[k].shape))
                values = new
            self.handed.append([c for _, _, c in sums] if n else [0, 0])
        for m, v in zip(self.models, values, strict=True):
            m.trees = [(feature, at, value) for (feature, at, _), value in zip(m.trees, v, strict=True)]
        return self

    def calibrate(self, y: np.ndarray, views: tuple[np.ndarray, np.ndarray]) -> CoTrained:
        apart, models = self.apart, self.models
        self.maps = [Isotonic().fit(m.margin(v[apart]), y[apart]) for m, v in zip(models, views, strict=True)]
        z = np.column_stack([self._odds(self.maps[k](models[k].margin(views[k][apart]))) for k in (0, 1)] + [np.ones(apart.sum())])
        w = np.array([1.0, 0.0, 0.0])
        for _ in range(25):  # Newton steps of a ridge logistic fit
            p = 1 / (1 + np.exp(-z @ w))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1.0, 1.0, 1e-3])
            w -= np.linalg.solve(h, z.T @ (p - y[apart]) + np.array([w[0] - 1, w[1] - 0.2, 0]))
        self.weights = w
        return self

    @staticmethod
    def _odds(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return np.log(p / (1 - p))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.models is None:
            half = np.full(len(a), 0.5)
            return half, half, half
        one, two = self.maps[0](self.models[0].margin(a)), self.maps[1](self.models[1].margin(b))
        z = np.column_stack([self._odds(one), self._odds(two), np.ones(len(a))])
        return one, two, 1 / (1 + np.exp(-z @ self.weights))


def learn(views: DataFrame, labels: DataFrame, most: int = MOST) -> CoTrained:
    """views(doc_id, held_out, a, b), labels(doc_id, quality) -> the fitted model."""
    known = sampled_labels(labels, "quality", most)
    rows = views.join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "a", "b").select("y", "a", "b").limit(2 * most).collect()
    rows.sort(key=lambda r: (r[1], r[2], r[0]))
    y, both = np.array([r[0] for r in rows], float), tuple(np.array([r[i] for r in rows]).reshape(-1, n) for i, n in ((1, TEXT_FEATURES), (2, META_FEATURES)))
    model = CoTrained().start(y, both)
    if model.models is None:
        return model
    shared = views.sparkSession.sparkContext.broadcast(model.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([_packed(m.leaves(v)) for m, v in zip(shared.value, _matrices(batch), strict=True)], names=["a", "b"])

    asked = labels.where("quality is not null").select("doc_id").distinct()
    free = views.where(F.col("doc_id").isNotNull() & ~F.col("held_out")).join(asked, "doc_id", "left_anti").select("a", "b")
    leaves = stored(free.mapInArrow(run, "a binary, b binary"), "unlabelled")
    return model.exchange(y, both, Unlabelled(leaves, [m.start for m in model.models])).calibrate(y, both)


def stored_views(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, lang, n_chars) -> doc_id, held_out, a, b (both views)."""
    cols = [F.col(c).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    source = docs.select("doc_id", held_out("doc_id").alias("held_out"), *cols, text_of().alias("text"))
    return stored(source.mapInArrow(_views, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, a array<double>, b array<double>"), "views")


def cotraining(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """docs(doc_id, text, source, lang, n_chars), labels(doc_id, quality) -> doc_id, held_out, text_score, meta_score, score, predicted, kept."""
    views = stored_views(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(views, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, both = shared.value(*_matrices(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(one), pa.array(two), pa.array(both), pa.array((both >= 0.5).astype(np.int32)), pa.array(both >= 0.5)], names=["doc_id", "held_out", "text_score", "meta_score", "score", "predicted", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return views.mapInArrow(run, f"doc_id {kind}, held_out boolean, text_score double, meta_score double, score double, predicted int, kept boolean")
