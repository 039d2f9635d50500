"""Gradient-boosted trees in numpy: logistic loss, histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf, by tree."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The margin of each row of x."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated if knots are set, else the logistic of the margin."""
        z = self.raw(x)
        if len(self.knots[0]):
            return np.clip(np.interp(z, *self.knots), 0.0, 1.0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: Sequence[int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 2.0, least: float = 2.0, bins: int = 48) -> Trees:
    """Boosted trees for labels 0 and 1. monotone: +1, -1 or 0 by feature; bounds pass down so whole trees keep them."""
    n, m = x.shape
    sign = np.zeros(m) if monotone is None else np.asarray(monotone, float)
    share = np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))), depth, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    if not n or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    margin = np.full(n, model.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        inner, leaves = 2**depth - 1, 2**depth
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        weight = np.zeros(inner + leaves)
        node = np.zeros(n, np.int64)
        weight[0] = g.sum() / (h.sum() + l2)
        for d in range(depth):
            first, count = 2**d - 1, 2**d
            local = node - first
            gain_best = np.full(count, 1e-6)
            pick = [(-1, 0, 0.0, 0.0)] * count
            for j in range(m):
                nb = len(edges[j]) + 1
                if nb < 2:
                    continue
                key = local * nb + binned[j]
                gs = np.cumsum(np.bincount(key, g, count * nb).reshape(count, nb), 1)
                hs = np.cumsum(np.bincount(key, h, count * nb).reshape(count, nb), 1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                lo, hi = low[first : first + count, None], high[first : first + count, None]
                wl, wr = np.clip(gl / (hl + l2), lo, hi), np.clip((gt - gl) / (ht - hl + l2), lo, hi)
                value = lambda w, a, b: a * w - 0.5 * (b + l2) * w * w
                w0 = np.clip(gt / (ht + l2), lo, hi)
                gain = value(wl, gl, hl) + value(wr, gt - gl, ht - hl) - value(w0, gt, ht)
                gain[(hl < least) | (ht - hl < least) | (sign[j] * (wr - wl) < 0)] = -1
                k = gain.argmax(1)
                for a in np.flatnonzero(gain[np.arange(count), k] > gain_best):
                    gain_best[a] = gain[a, k[a]]
                    pick[a] = (j, int(k[a]), float(wl[a, k[a]]), float(wr[a, k[a]]))
            for a, (j, k, wl, wr) in enumerate(pick):
                at = first + a
                left, right = 2 * at + 1, 2 * at + 2
                low[left], high[left], low[right], high[right] = low[at], high[at], low[at], high[at]
                if j < 0:
                    weight[left] = weight[right] = weight[at]
                    continue
                feature[at], threshold[at] = j, edges[j][k]
                weight[left], weight[right] = wl, wr
                if sign[j]:
                    middle = (wl + wr) / 2
                    if sign[j] > 0:
                        high[left], low[right] = min(high[at], middle), max(low[at], middle)
                    else:
                        low[left], high[right] = max(low[at], middle), min(high[at], middle)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        value = rate * weight[inner:]
        margin += value[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    model.feature, model.threshold, model.value = np.stack(features), np.stack(thresholds), np.stack(values)
    return model


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of y on z: equal z are one point, then adjacent violators are pooled.

    Each pool has its mean from its least to its greatest z; between pools the fit is straight.
    """
    place, inverse = np.unique(z, return_inverse=True)
    pools: list[list[float]] = []  # least z, greatest z, sum, weight
    for a, total, weight in zip(place, np.bincount(inverse, y), np.bincount(inverse), strict=True):
        pools.append([a, a, total, float(weight)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, total, weight = pools.pop()
            low = pools[-1]
            pools[-1] = [low[0], high, low[2] + total, low[3] + weight]
    knots = [(at, p[2] / p[3]) for p in pools for at in sorted({p[0], p[1]})]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def fit_calibrated(x: np.ndarray, y: np.ndarray, folds: int = 3, **how: object) -> Trees:
    """fit() on all rows, calibrated by isotonic regression of out-of-fold margins."""
    model = fit(x, y, **how)
    if len(model.feature) and len(y) >= 30 * folds:
        part = np.arange(len(y)) % folds
        z = np.empty(len(y))
        for k in range(folds):
            z[part == k] = fit(x[part != k], y[part != k], **how).raw(x[part == k])
        model.knots = isotonic(z, y)
    return model
