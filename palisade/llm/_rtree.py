"""An R-tree over vectors of group counts, searched by an overlap bound.

The intersection of two sets is at most the sum of the coordinate-wise minima of
their group counts; a box is bounded the same way by its upper corner.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16


class CountTree:
    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        order = self._order(points, sizes)
        self.order, self.points, self.sizes = order, points[order], sizes[order].astype(np.int64)
        self.levels = []
        upper, low, high = self.points, self.sizes, self.sizes
        while len(upper) > FANOUT:
            at = np.arange(0, len(upper), FANOUT)
            upper, low, high = np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((upper, low, high))

    @staticmethod
    def _order(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: slabs of like size, then the widest coordinates in turn."""
        n = len(sizes)
        if n <= FANOUT:
            return np.arange(n)
        wide = np.argsort(-points.astype(np.float32).var(axis=0), kind="stable")[:4]
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") * max(1, int(np.sqrt(n / FANOUT))) // n
        return np.lexsort([*(points[:, c] for c in wide[::-1]), slab])

    def _may(self, q: np.ndarray, n: int, upper: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Boxes that may hold a set with 100 * intersection >= percent * union."""
        p = self.percent
        fits = (100 * np.minimum(high, n) >= p * n) & (100 * n >= p * low)
        at = np.flatnonzero(fits)
        if not len(at):
            return at
        overlap = np.minimum(upper[at], q).sum(axis=1, dtype=np.int64)
        return at[(100 + p) * overlap >= p * (n + low[at])]

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Places (as given) of all points within the bound of a set of n with counts q."""
        nodes = None
        for upper, low, high in reversed(self.levels):
            if nodes is None:
                nodes = np.arange(len(low))
            nodes = nodes[self._may(q, n, upper[nodes], low[nodes], high[nodes])]
            if not len(nodes):
                return nodes
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            below = len(self.sizes) if upper is self.levels[0][0] else len(self.levels[[x[0] is upper for x in self.levels].index(True) - 1][1])
            nodes = nodes[nodes < below]
        if nodes is None:
            nodes = np.arange(len(self.sizes))
        hit = nodes[self._may(q, n, self.points[nodes], self.sizes[nodes], self.sizes[nodes])]
        return self.order[hit]
