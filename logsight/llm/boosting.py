"""Gradient boosting with logistic loss on a small dense matrix, for models
that are fitted on a bounded sample and applied inside tasks."""
from __future__ import annotations

import numpy as np


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


class BoostedTrees:
    """Depth-limited trees on quantile bins, fitted to the loss's gradient and
    curvature; scores are calibrated on rows held out from the fit."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.max_bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[int, int, int, float]]] = []
        self.edges: list[np.ndarray] = []
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.max_bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = _bins(x, self.edges)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            nodes: list[tuple[int, int, int, float]] = []
            self._grow(b, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), self.depth, nodes)
            self.trees.append(nodes)
            score += self._walk(nodes, b)
        return self

    def _grow(self, b, g, h, rows, depth, nodes) -> int:
        """Adds the subtree of ``rows``: (feature, last bin left, right child, value)."""
        at = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append((-1, 0, 0, float(-self.rate * total_g / (total_h + 1))))
        if not depth or len(rows) < 4:
            return at
        best = (1e-6, -1, 0)
        for j, e in enumerate(self.edges):
            if not len(e):
                continue
            left_g = np.cumsum(np.bincount(b[rows, j], g[rows], len(e) + 1))[:-1]
            left_h = np.cumsum(np.bincount(b[rows, j], h[rows], len(e) + 1))[:-1]
            gain = left_g ** 2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g ** 2 / (total_h + 1)
            gain[(left_h < self.least * 0.1) | (total_h - left_h < self.least * 0.1)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
        if best[1] >= 0:
            goes = b[rows, best[1]] <= best[2]
            self._grow(b, g, h, rows[goes], depth - 1, nodes)
            right = self._grow(b, g, h, rows[~goes], depth - 1, nodes)
            nodes[at] = (best[1], best[2], right, 0.0)
        return at

    def _walk(self, nodes, b) -> np.ndarray:
        out = np.zeros(len(b))
        todo = [(0, np.arange(len(b)))]
        while todo:
            at, rows = todo.pop()
            feature, cut, right, value = nodes[at]
            if feature < 0:
                out[rows] = value
            else:
                goes = b[rows, feature] <= cut
                todo += [(at + 1, rows[goes]), (right, rows[~goes])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        b = _bins(x, self.edges)
        out = np.full(len(x), self.start)
        for nodes in self.trees:
            out += self._walk(nodes, b)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> "BoostedTrees":
        """Platt scaling: slope and shift of the score, fitted to held-out rows."""
        s = self.score(x)
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.slope * s + self.shift, -30, 30)))
            d, w = p - target, np.maximum(p * (1 - p), 1e-6)
            grad = np.array([(d * s).sum() + 1e-3 * (self.slope - 1), d.sum()])
            hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            self.slope, self.shift = self.slope - float(step[0]), self.shift - float(step[1])
            if abs(step).max() < 1e-6:
                break
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.score(x) + self.shift, -30, 30)))
