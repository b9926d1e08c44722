"""Gradient-boosted trees for a yes or no, in numpy: histograms of binned features, complete trees of a fixed depth, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosting:
    trees: int = 40
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    penalty: float = 2.0
    least: float = 2.0


@dataclass
class Trees:
    """feature, above: (trees, inner nodes), a value above goes to the right; leaf: (trees, leaves) of log odds."""

    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, above, leaf in zip(self.feature, self.above, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > above[at])
            out += leaf[at - len(feature)]
        return out


def _binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    edges = []
    out = np.empty(x.shape, np.int64)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        if len(values) > bins:
            values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower").astype(x.dtype))
        else:
            values = values[:-1]
        edges.append(values)
        out[:, k] = np.searchsorted(values, x[:, k], "left")
    return out, edges


def fit(x: np.ndarray, y: np.ndarray, plan: Boosting = Boosting()) -> Trees:
    """Trees for rows of x and their answers 0 or 1. The same rows in the same order give the same trees."""
    n, width = x.shape
    binned, edges = _binned(x, plan.bins)
    size = width * plan.bins
    cells = binned + np.arange(width) * plan.bins
    usable = np.zeros((width, plan.bins), bool)
    for k, values in enumerate(edges):
        usable[k, : len(values)] = True
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    score, inner = np.full(n, base), (1 << plan.depth) - 1
    features, aboves, leaves = (np.zeros((plan.trees, inner), np.int64), np.full((plan.trees, inner), np.inf, np.float32), np.zeros((plan.trees, inner + 1)))
    for tree in range(plan.trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(plan.depth):
            count, offset = 1 << level, (1 << level) - 1
            place = ((at - offset)[:, None] * size + cells).ravel()
            g, h = (np.bincount(place, np.repeat(v, width), count * size).reshape(count, width, plan.bins).cumsum(axis=2) for v in (slope, bend))
            gain = np.zeros((count, width, plan.bins))
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            for part_g, part_h in ((g, h), (total_g - g, total_h - h)):
                gain += part_g**2 / (part_h + plan.penalty)
            gain -= total_g**2 / (total_h + plan.penalty)
            gain[~(usable & (h >= plan.least) & (total_h - h >= plan.least))] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for node, cell in enumerate(best.tolist()):
                k, b = divmod(cell, plan.bins)
                if gain[node, k, b] > 1e-6:  # else all go to the left
                    features[tree, offset + node], aboves[tree, offset + node] = k, edges[k][b]
            at = 2 * at + 1 + (x[np.arange(n), features[tree][at]] > aboves[tree][at])
        at -= inner
        g, h = (np.bincount(at, v, inner + 1) for v in (slope, bend))
        leaves[tree] = plan.rate * g / (h + plan.penalty)
        score += leaves[tree][at]
    return Trees(features, aboves, leaves, base)
