"""Gradient-boosted trees for binary targets, on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of fixed depth, at most 32 bins a feature. With no rows or one class, the prediction is constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, least: float = 5.0):
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 32)[1:-1])) if n else np.empty(0) for j in range(m)]
        p = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
        self.base, self.trees, self.depth, self.rate = float(np.log(p / (1 - p))), [], depth, rate
        if not n or y.min() == y.max():
            return
        b = self._bins(x)
        score = np.full(n, self.base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node, tree = np.zeros(n, np.int64), []
            for level in range(depth):
                k = 1 << level
                best, feature, cut = np.full(k, 1e-6), np.zeros(k, np.int64), np.full(k, 99)
                gt, ht = np.bincount(node, g, k), np.bincount(node, h, k)
                parent = gt**2 / (ht + 1)
                for j in range(m):
                    at = node * 32 + b[:, j]
                    gl, hl = (np.cumsum(np.bincount(at, v, k * 32).reshape(k, 32), 1) for v in (g, h))
                    gr, hr = gt[:, None] - gl, ht[:, None] - hl
                    gain = np.where((hl > least / 10) & (hr > least / 10), gl**2 / (hl + 1) + gr**2 / (hr + 1) - parent[:, None], 0)
                    c = gain.argmax(1)
                    v = gain[np.arange(k), c]
                    better = v > best
                    best[better], feature[better], cut[better] = v[better], j, c[better]
                tree.append((feature, cut))
                node = node * 2 + (b[np.arange(n), feature[node]] > cut[node])
            k = 1 << depth
            leaf = np.bincount(node, g, k) / (np.bincount(node, h, k) + 1) * rate
            self.trees.append((tree, leaf))
            score += leaf[node]

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def chance(self, x: np.ndarray) -> np.ndarray:
        """The chance of class 1 of each row."""
        b, rows = self._bins(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            score += leaf[node]
        return 1 / (1 + np.exp(-score))
