"""Gradient-boosted trees for a binary label, on binned features; small, deterministic, numpy only."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Additive trees of log odds.  ``fit`` takes (rows, features); missing values are -inf."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 48, least: float = 5.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.cuts: list[np.ndarray] = []
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.nan_to_num(np.asarray(x, float), nan=-1e300, neginf=-1e300, posinf=1e300)
        y = np.asarray(y, float)
        n, m = x.shape
        if not n:
            self.cuts = [np.zeros(0)] * m
            return self
        self.cuts = [np.unique(np.quantile(np.unique(x[:, k]), np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for k in range(m)]
        width = max((len(c) for c in self.cuts), default=0) + 1
        b = self._bin(x)
        mean = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        f = np.full(n, self.start)
        for _ in range(self.trees if n else 0):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            nodes = (1 << (self.depth + 1)) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
            at = np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                first, many = (1 << level) - 1, 1 << level
                local = at - first
                live = (local >= 0) & (local < many)
                gs, hs = np.bincount(local[live], g[live], many), np.bincount(local[live], h[live], many)
                value[first : first + many] = self.rate * gs / (hs + self.ridge)
                if level == self.depth:
                    break
                best = np.full(many, 1e-6)
                for k in range(m):
                    cell = local[live] * width + b[live, k]
                    gc = np.bincount(cell, g[live], many * width).reshape(many, width).cumsum(axis=1)[:, :-1]
                    hc = np.bincount(cell, h[live], many * width).reshape(many, width).cumsum(axis=1)[:, :-1]
                    if not gc.shape[1]:
                        continue
                    gr, hr = gs[:, None] - gc, hs[:, None] - hc
                    gain = gc**2 / (hc + self.ridge) + gr**2 / (hr + self.ridge) - (gs**2 / (hs + self.ridge))[:, None]
                    gain[(hc < self.least / 4) | (hr < self.least / 4)] = 0
                    top = gain.argmax(axis=1)
                    won = gain[np.arange(many), top] > best + 1e-12
                    best[won] = gain[np.arange(many), top][won]
                    feature[first : first + many][won], cut[first : first + many][won] = k, top[won]
                split = live & (feature[np.clip(at, 0, nodes - 1)] >= 0)
                go = b[np.flatnonzero(split), feature[at[split]]] > cut[at[split]]
                at[split] = 2 * at[split] + 1 + go
            f += value[at]
            self.model.append((feature, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the label."""
        x = np.nan_to_num(np.asarray(x, float), nan=-1e300, neginf=-1e300, posinf=1e300)
        out = np.full(len(x), self.start)
        if not len(x) or not self.model:
            return out
        b = self._bin(x)
        rows = np.arange(len(x))
        for feature, cut, value in self.model:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = feature[at]
                go = b[rows, np.maximum(k, 0)] > cut[at]
                at = np.where(k >= 0, 2 * at + 1 + go, at)
            out += value[at]
        return out
