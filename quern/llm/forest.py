"""A random forest of shallow trees, fitted on the driver on bounded samples."""

from __future__ import annotations

import numpy as np


class Forest:
    """Bootstrap trees that split on the best of a few features by Gini impurity."""

    def __init__(self, trees: int = 40, depth: int = 8, cuts: int = 16, least: int = 4, seed: int = 7):
        self.trees, self.depth, self.cuts, self.least, self.seed = trees, depth, cuts, least, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        chance = np.random.default_rng(self.seed)
        self.grown = [self._grow(x, y, chance) for _ in range(self.trees)]
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, chance: np.random.Generator) -> np.ndarray:
        """Nodes (feature or -1, threshold, left, right, share of ones) as rows."""
        nodes: list[list[float]] = []
        some = max(1, round(x.shape[1] ** 0.5))
        waiting = [(chance.integers(0, len(x), len(x)), 0, -1, 0)]
        while waiting:
            rows, depth, parent, side = waiting.pop()
            at = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, share])
            if parent >= 0:
                nodes[parent][side] = at
            if depth == self.depth or len(rows) < 2 * self.least or share in (0.0, 1.0):
                continue
            best = (share * (1 - share) - 1e-9, -1, 0.0)
            for f in chance.choice(x.shape[1], some, replace=False):
                v = x[rows, f]
                cuts = np.unique(np.quantile(v, np.linspace(0.03, 0.97, self.cuts)))
                low = v[:, None] <= cuts
                n, k = low.sum(axis=0), (low * y[rows][:, None]).sum(axis=0)
                m, j = len(rows) - n, y[rows].sum() - k
                with np.errstate(divide="ignore", invalid="ignore"):
                    gini = (k * (n - k) / n + j * (m - j) / m) / len(rows)
                gini[(n < self.least) | (m < self.least)] = np.inf
                if gini.min() < best[0]:
                    best = (float(gini.min()), int(f), float(cuts[gini.argmin()]))
            if best[1] < 0:
                continue
            nodes[at][:2] = best[1:]
            low = x[rows, best[1]] <= best[2]
            waiting += [(rows[low], depth + 1, at, 2), (rows[~low], depth + 1, at, 3)]
        return np.asarray(nodes)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of ones over the leaves that each row reaches."""
        total = np.zeros(len(x))
        for nodes in self.grown:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = nodes[at, 0].astype(np.int64)
                inner = f >= 0
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= nodes[at, 1]
                at = np.where(inner, np.where(low, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
            total += nodes[at, 4]
        return total / len(self.grown)
