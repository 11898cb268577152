"""Gradient-boosted trees in numpy, flattened for vectorised scoring.

Trees are complete binary trees of one depth, so a forest is four dense
arrays and scoring is ``depth`` gathers over (rows x trees). Training is
histogram based, with logistic loss, L2 regularisation and monotone
constraints kept by bounding the values of both subtrees at each split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """feature, threshold: (trees, 2**depth - 1); value: (trees, 2**depth); a row goes right if x > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of x; no rows give no values."""
        out = np.full(len(x), self.base)
        trees, leaf0 = len(self.feature), self.feature.shape[1]
        if not trees:
            return out
        rows = np.arange(len(x))[:, None]
        step = max(1, (1 << 21) // trees)
        for lo in range(0, len(x), step):
            part, at = x[lo : lo + step], np.zeros((min(step, len(x) - lo), trees), dtype=np.int64)
            which = np.arange(trees)[None, :]
            for _ in range(self.depth):
                f, t = self.feature[which, at], self.threshold[which, at]
                at = 2 * at + 1 + (part[rows[: len(part)], f] > t)
            out[lo : lo + step] += self.value[which, at - leaf0].sum(axis=1)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 2.0, least: float = 1.0, monotone: dict[int, int] | None = None, weight: np.ndarray | None = None) -> Forest:
    """Fit a forest to 0/1 labels.

    monotone maps a feature's index to +1 (score never falls as it grows) or
    -1. Without rows, or with one class only, the forest has no trees.
    """
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    mean = float((y * weight).sum() / weight.sum()) if n else 0.5
    base = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    empty = Forest(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), base)
    if not n or mean in (0.0, 1.0):
        return empty
    edges, code = [], np.empty((width, n), np.int64)
    for j in range(width):
        cut = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        edges.append(cut)
        code[j] = np.searchsorted(cut, x[:, j], side="left")  # x > cut[b] means code > b
    sign = np.zeros(width)
    for j, s in (monotone or {}).items():
        sign[j] = s
    feats, thres, vals, margin = [], [], [], np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        lo, hi = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = [(1e-9, 0, np.inf, 0.0, -1)] * count
            for j in range(width):
                size = bins + 1
                key = local * size + code[j]
                gs = np.bincount(key, g, count * size).reshape(count, size).cumsum(axis=1)
                hs = np.bincount(key, h, count * size).reshape(count, size).cumsum(axis=1)
                cuts = len(edges[j])
                if not cuts:
                    continue
                gl, hl = gs[:, :cuts], hs[:, :cuts]
                gt, ht = gs[:, -1:], hs[:, -1:]
                gr, hr = gt - gl, ht - hl
                low, high = lo[first : first + count, None], hi[first : first + count, None]
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                v0 = np.clip(-gt / (ht + l2), low, high)
                cost = lambda gg, hh, v: gg * v + 0.5 * (hh + l2) * v * v
                gain = cost(gt, ht, v0) - cost(gl, hl, vl) - cost(gr, hr, vr)
                gain = np.where((hl < least * 0.25) | (hr < least * 0.25), -1.0, gain)
                if sign[j]:
                    gain = np.where(sign[j] * (vr - vl) < 0, -1.0, gain)
                at = gain.argmax(axis=1)
                for k in range(count):
                    if gain[k, at[k]] > best[k][0]:
                        best[k] = (gain[k, at[k]], j, edges[j][at[k]], (vl[k, at[k]] + vr[k, at[k]]) / 2, at[k])
            right = np.zeros(n, bool)
            for k, (_, j, cut, mid, at) in enumerate(best):
                i = first + k
                a, b = 2 * i + 1, 2 * i + 2
                lo[a], hi[a], lo[b], hi[b] = lo[i], hi[i], lo[i], hi[i]
                if at < 0:
                    continue
                feature[i], threshold[i] = j, cut
                if sign[j] > 0:
                    hi[a], lo[b] = mid, mid
                elif sign[j] < 0:
                    lo[a], hi[b] = mid, mid
                own = local == k
                right[own] = code[j][own] > at
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = rate * np.clip(-gs / (hs + l2), lo[inner:], hi[inner:])
        margin += value[leaf]
        feats.append(feature)
        thres.append(threshold)
        vals.append(value)
    return Forest(np.array(feats), np.array(thres), np.array(vals), base)


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots of a non-decreasing map from score to probability."""
    order = np.argsort(score, kind="stable")
    weight = np.ones(len(score)) if weight is None else weight
    blocks: list[list[float]] = []
    for s, y, w in zip(score[order], label[order], weight[order]):
        if blocks and s == blocks[-1][3]:  # equal scores share one value
            b = blocks.pop()
            blocks.append([b[0] + y * w, b[1] + w, b[2], s])
        else:
            blocks.append([y * w, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0] + b[0], a[1] + b[1], a[2], b[3]])
    xs, ys = [], []
    for total, w, first, last in blocks:
        xs += [first, last] if last > first else [first]
        ys += [total / w] * (2 if last > first else 1)
    return np.array(xs), np.array(ys)


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Apply isotonic knots by linear interpolation; without knots the logistic of the score."""
    xs, ys = knots
    return np.interp(score, xs, ys) if len(xs) else sigmoid(score)
