"""Gradient-boosted trees over binned dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting with histogram splits; leaves take Newton steps."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        b, nb = self._binned(x), self.bins + 1
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4) if len(y) else 0.5
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        self.splits, self.leaves = [], []
        for _ in range(self.trees if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split = np.zeros((2**self.depth - 1, 2), np.int64)
            split[:, 1] = nb  # everything goes left where no split helps
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                best = np.zeros(n)
                for f in range(x.shape[1]):
                    at = node * nb + b[:, f]
                    gl = np.bincount(at, g, n * nb).reshape(n, nb).cumsum(axis=1)
                    hl = np.bincount(at, h, n * nb).reshape(n, nb).cumsum(axis=1)
                    gt, ht = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    k = gain.argmax(axis=1)
                    v = gain[np.arange(n), k]
                    better = v > best + 1e-9
                    best[better] = v[better]
                    split[first : first + n][better] = np.stack((np.full(n, f), k), axis=1)[better]
                s = split[first + node]
                node = 2 * node + (b[np.arange(len(y)), s[:, 0]] > s[:, 1])
            gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
            leaf = self.rate * gs / (hs + self.l2)
            self.splits.append(split)
            self.leaves.append(leaf)
            score += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        at = np.arange(len(x))
        out = np.full(len(x), self.start)
        for split, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                s = split[2**level - 1 + node]
                node = 2 * node + (b[at, s[:, 0]] > s[:, 1])
            out += leaf[node]
        return out


class Isotonic:
    """Least-squares monotone map by pooling adjacent violators, linear between pool centres."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        u, inv = np.unique(x, return_inverse=True)
        wt = np.bincount(inv).astype(float)
        pools: list[list[float]] = []  # mean, weight, first, last
        for v, w, m in zip(np.bincount(inv, weights=y) / wt if len(u) else [], wt, u, strict=True):
            pools.append([v, w, m, m])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                v2, w2, _, last = pools.pop()
                p = pools[-1]
                p[0], p[1], p[3] = (p[0] * p[1] + v2 * w2) / (p[1] + w2), p[1] + w2, last
        self.x = np.array([e for p in pools for e in (p[2], p[3])]) if pools else np.zeros(1)
        self.y = np.array([(p[0] * p[1] + 0.5) / (p[1] + 1) for p in pools for _ in (0, 1)]) if pools else np.full(1, 0.5)
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
