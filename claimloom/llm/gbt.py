"""Gradient-boosted trees on binned dense features for a 0/1 label, and isotonic calibration; numpy only."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth, fitted level by level on histograms of the logistic loss's gradients."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        n, f = x.shape
        w = np.ones(n) if weight is None else weight
        self.edges = []
        for j in range(f):
            u = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) if n else np.empty(0)
            self.edges.append(u[: self.bins - 1])
        b = self._bin(x)
        rate = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        self.feature = np.zeros((self.trees, (1 << self.depth) - 1), np.int64)
        self.cut = np.full((self.trees, (1 << self.depth) - 1), self.bins, np.int64)  # all go left: no split
        self.leaf = np.zeros((self.trees, 1 << self.depth))
        score, flat = np.full(n, self.base), b + np.arange(f) * self.bins
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (y - p), w * p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                k, first = 1 << level, (1 << level) - 1
                at = (flat + (node * (f * self.bins))[:, None]).ravel()
                hist = [np.bincount(at, np.repeat(v, f), k * f * self.bins).reshape(k, f, self.bins).cumsum(2) for v in (g, h)]
                total = [v[:, :1, -1:] for v in hist]
                gain = sum((a**2) / (c + self.l2) for a, c in ((hist[0], hist[1]), (total[0] - hist[0], total[1] - hist[1]))) - total[0] ** 2 / (total[1] + self.l2)
                gain[(hist[1] < self.least / 4) | (total[1] - hist[1] < self.least / 4)] = 0
                best = gain.reshape(k, -1).argmax(1) if f else np.zeros(k, np.int64)
                good = gain.reshape(k, -1)[np.arange(k), best] > 1e-6 if f else np.zeros(k, bool)
                self.feature[t, first : first + k] = np.where(good, best // self.bins, 0)
                self.cut[t, first : first + k] = np.where(good, best % self.bins, self.bins)
                if f:
                    node = node * 2 + (b[np.arange(n), self.feature[t, first + node]] > self.cut[t, first + node])
                else:
                    node = node * 2
            sums = [np.bincount(node, v, 1 << self.depth) for v in (g, h)]
            self.leaf[t] = self.rate * sums[0] / (sums[1] + self.l2)
            score += self.leaf[t][node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        if not b.shape[1]:
            return out
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = node * 2 + (b[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t][node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


class Isotonic:
    """Weighted least-squares rising fit of y on a score, by pooling adjacent violators; linear between the pools."""

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        by = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # sum of w*y, w, w*score
        for s, v, w in zip(score[by].tolist(), y[by].tolist(), weight[by].tolist(), strict=True):
            pools.append([w * v, w, w * s])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + c for a, c in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.array([p[0] / p[1] for p in pools])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.zeros(len(score))
