"""Gradient-boosted regression trees for two classes, on binned features, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Full binary trees of equal depth: ``features`` and ``cuts`` of inner nodes, ``values`` of leaves."""

    depth: int
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = 50, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        scores = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-scores))
            leaf = self._grow(binned, y - p, p * (1 - p), bins, ridge, rate)
            scores += self.values[-1][leaf]
        return self

    def _grow(self, binned: np.ndarray, slope: np.ndarray, bend: np.ndarray, bins: int, ridge: float, rate: float) -> np.ndarray:
        inner = (1 << self.depth) - 1
        features, cuts = np.zeros(inner, np.int64), np.full(inner, bins)
        node = np.zeros(len(slope), np.int64)
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            place = (node - first) * bins
            best = np.full(count, 1e-6)
            for j in range(binned.shape[1]):
                g, h = (np.bincount(place + binned[:, j], v, count * bins).reshape(count, bins).cumsum(axis=1) for v in (slope, bend))
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                at = gain.argmax(axis=1)
                won = gain[np.arange(count), at] > best
                best = np.where(won, gain[np.arange(count), at], best)
                features[first : first + count][won], cuts[first : first + count][won] = j, at[won]
            node = 2 * node + 1 + (binned[np.arange(len(node)), features[node]] > cuts[node])
        leaf = node - inner
        size = 1 << self.depth
        values = rate * np.bincount(leaf, slope, size) / (np.bincount(leaf, bend, size) + ridge)
        self.features.append(features)
        self.cuts.append(cuts)
        self.values.append(values)
        return leaf

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        rows, scores = np.arange(len(x)), np.full(len(x), self.base)
        for features, cuts, values in zip(self.features, self.cuts, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, features[node]] > cuts[node])
            scores += values[node - len(features)]
        return 1 / (1 + np.exp(-scores))
