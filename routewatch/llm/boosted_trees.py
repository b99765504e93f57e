"""Histogram gradient-boosted trees for two classes, in numpy, flattened into arrays.

Training works on a bounded sample that the caller has drawn. Every tree is a complete binary tree in
heap order: arrays of features and thresholds for the inner nodes, and of values for the leaves. A
batch goes through all trees side by side, one vectorised step per level.
"""

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for every row of x."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        trees, inner = self.feature.shape
        if trees:
            node = np.zeros((len(x), trees), np.int64)
            across = np.arange(trees)[None, :]
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, self.feature[across, node]] > self.threshold[across, node])
            total = total + self.value[across, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(column):
    """Upper edges of at most BINS bins of a feature, at sample quantiles halfway between values."""
    values = np.unique(column)
    if len(values) > BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="lower"))
    return (values[1:] + values[:-1]) / 2


def train(x: np.ndarray, y: np.ndarray, trees=80, depth=5, rate=0.15, l2=1.0, least=10) -> Trees:
    """Boost the log loss. Without rows, or with one class only, the model is the smoothed base rate."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [_edges(x[:, f]) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    features, thresholds, values = [], [], []
    raw = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            at = node - first
            best = np.zeros(width)
            cut = np.full(width, BINS)
            for f in range(len(edges)):
                cell = at * BINS + binned[f]
                g, h, n = (np.cumsum(np.bincount(cell, w, width * BINS).reshape(width, BINS), axis=1) for w in (gradient, hessian, None))
                left, right = (g, h, n), (g[:, -1:] - g, h[:, -1:] - h, n[:, -1:] - n)
                gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
                gain[(left[2] < least) | (right[2] < least)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-12
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first:first + width][better], cut[better] = f, top[better]
            for k in range(width):
                if cut[k] < BINS:
                    threshold[first + k] = edges[feature[first + k]][cut[k]]
            goes = binned[feature[node], np.arange(len(y))] > cut[at]
            node = 2 * node + 1 + goes
        leaf = node - inner
        value = -rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + l2)
        raw = raw + value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))
