"""Gradient-boosted decision trees for a yes/no target, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class BoostedTrees:
    """Full trees of one depth; ``feature``/``cut`` by tree and inner node, ``value`` by tree and leaf."""

    depth: int
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, least: float = 1.0) -> BoostedTrees:
    """Second-order boosting of the logistic loss with histogram splits."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)
    bins = BINS + 1
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    out = BoostedTrees(depth, base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            split = np.zeros((count, 2), np.int64) - 1
            for j in range(width):
                if not len(cuts[j]):
                    continue
                key = (at - first) * bins + binned[:, j]
                gl = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(axis=1)
                hl = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(axis=1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[:, -1:] ** 2 / (hl[:, -1:] + ridge)
                gain[(hl < least) | (hr < least)] = 0
                k = gain[:, : len(cuts[j])].argmax(axis=1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better] = top[better]
                split[better] = np.column_stack([np.full(count, j), k])[better]
            for c in range(count):
                if split[c, 0] >= 0:
                    out.feature[t, first + c] = split[c, 0]
                    out.cut[t, first + c] = cuts[split[c, 0]][split[c, 1]]
            node = at
            at = 2 * node + 1 + (x[np.arange(n), out.feature[t][node]] > out.cut[t][node])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        out.value[t] = -rate * gs / (hs + ridge)
        score += out.value[t][leaf]
    return out
