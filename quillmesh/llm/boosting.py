"""Gradient-boosted trees on binned features, and isotonic calibration: small models, fitted on the driver."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Second-order boosting of the logistic loss over quantile bins; trees of a fixed depth stored as arrays."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)]).astype(np.int32) if len(x) else np.zeros((0, len(self.cuts)), np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        w = np.ones(len(y)) if weight is None else weight
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        # rare values above the last quantile still need a cut
        self.cuts = [np.unique(np.append(c, [0.0])) if len(x) and x[:, j].min() <= 0 < x[:, j].max() else c for j, c in enumerate(self.cuts)]
        p = np.clip((w @ y) / max(w.sum(), 1e-9) if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        self.trees = []
        if not len(y):
            return self
        b, score = self._binned(x), np.full(len(y), self.start)
        n_bins, n_features = max(len(c) for c in self.cuts) + 1, x.shape[1]
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            g, h = w * (prob - y), w * prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                cell = (node - first)[:, None] * (n_features * n_bins) + np.arange(n_features) * n_bins + b
                size = many * n_features * n_bins
                total = [np.bincount(cell.ravel(), np.repeat(v, n_features), size).reshape(many, n_features, n_bins) for v in (g, h)]
                gl, hl = (t.cumsum(axis=2) for t in total)
                ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + self.ridge) + (ga - gl) ** 2 / (ha - hl + self.ridge) - ga**2 / (ha + self.ridge)
                gain[(hl < self.least * 0.05) | (ha - hl < self.least * 0.05)] = 0
                flat = gain.reshape(many, -1)
                best = flat.argmax(axis=1)
                ok = flat[np.arange(many), best] > 1e-6
                feature[first : first + many] = np.where(ok, best // n_bins, -1)
                cut[first : first + many] = np.where(ok, best % n_bins, n_bins)
                node = self._down(node, b, feature, cut)
            leaf = node - (2**self.depth - 1)
            gs, hs = (np.bincount(leaf, v, 2**self.depth) for v in (g, h))
            value = -self.rate * gs / (hs + self.ridge)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    @staticmethod
    def _down(node: np.ndarray, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        f = feature[node]
        right = (f >= 0) & (b[np.arange(len(node)), np.maximum(f, 0)] > cut[node])
        return 2 * node + 1 + right

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        b, out = self._binned(x), np.zeros((len(x), len(self.trees)), np.uint8)
        for t, (feature, cut, _) in enumerate(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._down(node, b, feature, cut)
            out[:, t] = node - (2**self.depth - 1)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        leaves, score = self.leaves(x), np.full(len(x), self.start)
        for t, (_, _, value) in enumerate(self.trees):
            score += value[leaves[:, t]]
        return score


class Isotonic:
    """Non-decreasing map from margins to probabilities (pool adjacent violators), straight between the blocks' centres."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, of margins, count
        for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([t, m, 1.0])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        # one label of each kind at the ends keeps the outer probabilities inside (0, 1)
        self.at = np.array([b[1] / b[2] for b in blocks]) if blocks else np.array([0.0])
        self.to = np.array([(b[0] + 0.5) / (b[2] + 1) for b in blocks]) if blocks else np.array([0.5])
        self.to = np.maximum.accumulate(self.to)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        # beyond the outer blocks and inside ties a trace of the margin keeps the order
        return np.clip(np.interp(margin, self.at, self.to) * (1 - 1e-4) + 1e-4 / (1 + np.exp(-np.clip(margin, -30, 30))), 0, 1)
