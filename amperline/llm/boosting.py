"""Gradient-boosted trees for a yes/no label: a small trainer and flat node arrays for scoring.

The trainer runs on a bounded sample in the driver. A model is five arrays (feature, threshold,
left, right, value) that hold the nodes of all trees, plus each tree's root; leaves point to
themselves, so a batch is scored with `depth` array look-ups per tree.

A feature with sign +1 (-1) can only raise (lower) the score as it grows: splits that break the
order are not taken, and a split's middle value bounds everything below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            out += self.value[node]
        return out


def train(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the log loss over histograms of at most `bins` cuts a feature."""
    rate_of_yes = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_yes / (1 - rate_of_yes)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and y.min() != y.max():
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        # a feature that is mostly one value still gets cuts among its other values
        cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, 17), method="lower")])) if len(v := col[col != np.median(col)]) else c for c, col in zip(cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        width = max(len(c) for c in cuts) + 1
        f = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            grown = _Grower(binned, cuts, width, p - y, p * (1 - p), signs, depth, rate, l2, least, nodes)
            roots.append(grown.grow(np.arange(len(y)), 0, -np.inf, np.inf))
            f += grown.out
    a = np.array(nodes, float).reshape(-1, 5)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots, int), depth, base)


class _Grower:
    def __init__(self, binned, cuts, width, grad, hess, signs, depth, rate, l2, least, nodes):
        self.binned, self.cuts, self.width, self.grad, self.hess = binned, cuts, width, grad, hess
        self.signs, self.depth, self.rate, self.l2, self.least, self.nodes = signs, depth, rate, l2, least, nodes
        self.out = np.zeros(len(grad))

    def grow(self, rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(self.nodes)
        self.nodes.append([0, np.inf, me, me, 0.0])
        best = self._split(rows, low, high) if level < self.depth else None
        if best is None:
            value = np.clip(-self.grad[rows].sum() / (self.hess[rows].sum() + self.l2), low, high) * self.rate
            self.nodes[me][4] = value
            self.out[rows] = value
            return me
        k, cut, left_value, right_value = best
        middle, sign = (left_value + right_value) / 2, self.signs[k]
        goes = self.binned[rows, k] <= cut
        left = self.grow(rows[goes], level + 1, *((low, middle) if sign > 0 else (middle, high) if sign < 0 else (low, high)))
        right = self.grow(rows[~goes], level + 1, *((middle, high) if sign > 0 else (low, middle) if sign < 0 else (low, high)))
        self.nodes[me] = [k, self.cuts[k][cut], left, right, 0.0]
        return me

    def _split(self, rows, low, high):
        best, found = 1e-6, None
        total_g, total_h = self.grad[rows].sum(), self.hess[rows].sum()
        whole = total_g**2 / (total_h + self.l2)
        for k, cuts in enumerate(self.cuts):
            b = self.binned[rows, k]
            g = np.cumsum(np.bincount(b, self.grad[rows], self.width))[: len(cuts)]
            h = np.cumsum(np.bincount(b, self.hess[rows], self.width))[: len(cuts)]
            lv = np.clip(-g / (h + self.l2), low, high)
            rv = np.clip(-(total_g - g) / (total_h - h + self.l2), low, high)
            gain = g**2 / (h + self.l2) + (total_g - g) ** 2 / (total_h - h + self.l2) - whole
            ok = (h >= self.least) & (total_h - h >= self.least) & ((rv - lv) * self.signs[k] >= 0)
            gain = np.where(ok, gain, -1)
            if len(gain) and gain.max() > best:
                i = int(gain.argmax())
                best, found = float(gain[i]), (k, i, float(lv[i]), float(rv[i]))
        return found
