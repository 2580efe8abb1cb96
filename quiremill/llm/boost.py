"""Gradient-boosted trees over small integer features, fitted on the driver on a bounded sample.

A model of few features can be written as a column, so that rows are scored where they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Boost:
    """Binary classification by logistic loss with trees of a fixed depth; features are integers from 0 to `bins` - 1."""

    def __init__(self, names: list[str], bins: int = 16, rounds: int = 24, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> None:
        self.names, self.bins, self.rounds, self.depth, self.rate, self.least = names, bins, rounds, depth, rate, least
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boost:
        """weight: how many rows each one stands for. Without both classes the model gives the one it saw."""
        if not len(y):
            return self
        w = np.ones(len(y)) if weight is None else weight
        n, ones = w.sum(), (y * w).sum()
        p = (ones + 0.5) / (n + 1)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds if 0 < ones < n else 0):
            q = 1 / (1 + np.exp(-score))
            tree, out = self._tree(x, w * (y - q), w * np.maximum(q * (1 - q), 1e-6))
            self.trees.append(tree)
            score += out
        return self

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Nodes as (feature, bin) by position in a heap, leaves' values, and the rows' values."""
        node = np.zeros(len(g), np.int64)
        splits = []
        for level in range(self.depth):
            width = 1 << level
            best = [(0.0, 0, self.bins)] * width
            parent_g, parent_h = np.bincount(node, weights=g, minlength=width), np.bincount(node, weights=h, minlength=width)
            for f in range(x.shape[1]):
                key = node * self.bins + x[:, f]
                sg = np.bincount(key, weights=g, minlength=width * self.bins).reshape(width, self.bins).cumsum(axis=1)
                sh = np.bincount(key, weights=h, minlength=width * self.bins).reshape(width, self.bins).cumsum(axis=1)
                rg, rh = parent_g[:, None] - sg, parent_h[:, None] - sh
                gain = sg**2 / (sh + 1) + rg**2 / (rh + 1) - (parent_g**2 / (parent_h + 1))[:, None]
                gain = np.where((sh >= self.least) & (rh >= self.least), gain, 0.0)
                cut = gain.argmax(axis=1)
                for k in range(width):
                    if gain[k, cut[k]] > best[k][0] + 1e-9:
                        best[k] = (float(gain[k, cut[k]]), f, int(cut[k]))
            splits.extend((f, b) for _, f, b in best)
            feature, bound = np.array([b[1] for b in best]), np.array([b[2] for b in best])
            node = node * 2 + (x[np.arange(len(g)), feature[node]] > bound[node])
        leaves = self.rate * np.bincount(node, weights=g, minlength=1 << self.depth) / (np.bincount(node, weights=h, minlength=1 << self.depth) + 1)
        return (splits, leaves), leaves[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for splits, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                f, b = np.array([s[0] for s in splits])[at], np.array([s[1] for s in splits])[at]
                node = node * 2 + (x[np.arange(len(x)), f] > b)
            out += leaves[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(x)))

    def lookup(self, sizes: dict[str, int]) -> Column:
        """Whether the score is positive, as a lookup by the columns of the features' names, each below its size."""
        at = F.lit(0)
        for name in self.names:
            at = at * sizes[name] + F.greatest(F.lit(0), F.least(F.col(name), F.lit(sizes[name] - 1)))
        return self.looked_up(at, sizes)

    def looked_up(self, at: Column, sizes: dict[str, int]) -> Column:
        """The same by the number of the combination of features: one byte for every one.

        A nest of conditions for all trees would be too long a method for the JVM to compile.
        """
        grid = np.stack([g.ravel() for g in np.meshgrid(*(np.arange(sizes[n]) for n in self.names), indexing="ij")], axis=1)
        table = (self.score(grid) > 0).astype(np.uint8).tobytes()
        return F.substr(F.lit(bytearray(table)), (at + 1).cast("int"), F.lit(1)) == F.lit(bytearray(b"\x01"))
