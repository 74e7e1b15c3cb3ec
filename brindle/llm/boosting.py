"""Gradient-boosted regression trees for a binary label, and isotonic calibration, on dense NumPy features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic-loss boosting with histogram splits: each tree is a perfect one of ``depth`` levels."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.base, self.splits, self.leaves = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        w = np.ones(len(y)) if weight is None else weight / weight.mean()
        rate = np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        score, inner = np.full(len(y), self.base), (1 << self.depth) - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = w * (y - p), w * np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                n, offset = 1 << level, (1 << level) - 1
                best = np.full(n, 1e-6)
                chosen = np.full((n, 2), -1)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = node * self.bins + binned[:, f]
                    g = np.bincount(key, grad, n * self.bins).reshape(n, -1).cumsum(axis=1)
                    h = np.bincount(key, hess, n * self.bins).reshape(n, -1).cumsum(axis=1)
                    gl, hl, gt, ht = g[:, : len(e)], h[:, : len(e)], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least / 4) | (ht - hl < self.least / 4)] = -np.inf
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(n), at]
                    better = top > best
                    best[better] = top[better]
                    chosen[better] = np.stack([np.full(n, f), at], axis=1)[better]
                for k in range(n):
                    if chosen[k, 0] >= 0:
                        feature[offset + k], cut[offset + k] = chosen[k, 0], edges[chosen[k, 0]][chosen[k, 1]]
                node = node * 2 + (x[np.arange(len(y)), feature[offset + node]] > cut[offset + node])
            leaves = 1 << self.depth
            leaf = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + 1)
            score = score + leaf[node]
            self.splits.append((feature, cut))
            self.leaves.append(leaf)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for (feature, cut), leaf in zip(self.splits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            out += leaf[node]
        return out


class Isotonic:
    """Pool-adjacent-violators fit of weighted label rates to scores; interpolates between blocks."""

    def fit(self, score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        order = np.argsort(score, kind="stable")
        w = np.ones(len(y)) if weight is None else weight
        blocks: list[list[float]] = []  # weighted sums of labels, ones and scores
        for s, v, n in zip(score[order].tolist(), y[order].tolist(), w[order].tolist()):
            blocks.append([v * n, n, s * n])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                for k in range(3):
                    blocks[-1][k] += last[k]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])
        return self

    def apply(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
