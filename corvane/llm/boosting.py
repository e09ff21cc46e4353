"""Histogram gradient-boosted trees on numpy, flattened into arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees in heap order: row t of each array is a tree.

    feature and threshold have 2^depth - 1 columns, leaf 2^depth. A row goes right where its
    feature exceeds the threshold; unsplit nodes have threshold inf and send all left."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))[:, None]
        trees = np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), dtype=np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[trees, node - ((1 << self.depth) - 1)].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            out[at : at + 4096] = 1 / (1 + np.exp(-np.clip(self.margins(x[at : at + 4096]), -40, 40)))
        return out


def _quantile_bins(x: np.ndarray, bins: int) -> tuple[list[np.ndarray], np.ndarray]:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    return edges, np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def _grow(x, binned, edges, grad, hess, depth: int, least_rows: int, l2: float, pick=None):
    """One tree, level by level, from histograms of gradient sums; pick draws features for a level.

    Returns feature and threshold in heap order and the leaf that each row reaches."""
    inner = (1 << depth) - 1
    width = max(len(e) for e in edges) + 1
    node = np.zeros(len(x), dtype=np.int64)
    feature, threshold = np.zeros(inner, dtype=int), np.full(inner, np.inf)
    for level in range(depth):
        first, count = (1 << level) - 1, 1 << level
        at = node - first
        g_all = np.bincount(at, weights=grad, minlength=count)
        h_all = np.bincount(at, weights=hess, minlength=count)
        best = np.full(count, 1e-6)
        for j in range(len(edges)) if pick is None else pick(len(edges)):
            e = edges[j]
            if not len(e):
                continue
            key = at * width + binned[:, j]
            g, h, n = (np.bincount(key, weights=w, minlength=count * width).reshape(count, width).cumsum(axis=1) for w in (grad, hess, None))
            rest = n[:, -1:] - n[:, :-1]
            gain = g[:, :-1] ** 2 / (h[:, :-1] + l2) + (g_all[:, None] - g[:, :-1]) ** 2 / (h_all[:, None] - h[:, :-1] + l2) - (g_all**2 / (h_all + l2))[:, None]
            gain[(n[:, :-1] < least_rows) | (rest < least_rows)] = 0
            gain[:, len(e) :] = 0
            top = gain.argmax(axis=1)
            value = gain[np.arange(count), top]
            better = value > best
            best[better] = value[better]
            feature[first : first + count][better] = j
            threshold[first : first + count][better] = e[np.minimum(top, len(e) - 1)][better]
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
    return feature, threshold, node - inner


def fit_boosted(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least_rows: int = 10, l2: float = 1.0) -> Forest:
    """Boosts logistic loss over quantile histograms. One class or no rows: a constant."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    edges, binned = _quantile_bins(x, bins)
    margin, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, at = _grow(x, binned, edges, grad, hess, depth, least_rows, l2)
        value = -rate * np.bincount(at, weights=grad, minlength=leaves) / (np.bincount(at, weights=hess, minlength=leaves) + l2)
        margin += value[at]
        grown.append((feature, threshold, value))
    return Forest(*(np.array(a) for a in zip(*grown)), base, depth)


def fit_random_forest(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 7, bins: int = 32, least_rows: int = 3, seed: int = 5) -> Forest:
    """Bagged trees on bootstrap weights and a random subset of features for each level.

    A leaf holds its share of label 1 over the number of trees, so the sum of a row's leaves is
    its probability (Forest.margins). One class or no rows: that class's constant."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), float(y[0]) if len(y) else 0.0, depth)
    rng = np.random.default_rng(seed)
    edges, binned = _quantile_bins(x, bins)
    some = max(2, int(np.ceil(np.sqrt(x.shape[1])) + 1))
    grown = []
    for _ in range(trees):
        w = rng.poisson(1.0, len(y)).astype(float)
        use = w > 0
        w = w[use]
        feature, threshold, at = _grow(x[use], binned[use], edges, -w * y[use], w, depth, least_rows, 1e-9, lambda n: rng.choice(n, min(some, n), replace=False))
        hit, all_ = np.bincount(at, weights=w * y[use], minlength=leaves), np.bincount(at, weights=w, minlength=leaves)
        grown.append((feature, threshold, (hit + 0.5 * y.mean()) / (all_ + 0.5) / trees))
    return Forest(*(np.array(a) for a in zip(*grown)), 0.0, depth)
