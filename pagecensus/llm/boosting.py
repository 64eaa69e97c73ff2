"""Histogram gradient-boosted trees for a binary label, flattened for array traversal.

Training bins each feature at quantiles and finds each split from per-bin sums of gradients and
second derivatives.  Trees are complete to one depth, so a forest is three arrays and a batch of
rows walks all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """feature and threshold: (trees, inner nodes); leaf: (trees, leaves); base: log-odds of the start."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        if not self.feature.shape[0]:
            return np.full(len(rows), self.base)
        trees = np.arange(self.feature.shape[0])
        at = np.zeros((len(rows), len(trees)), dtype="int64")
        inner = self.feature.shape[1]
        line = np.arange(len(rows))[:, None]
        for _ in range(inner.bit_length()):
            right = rows[line, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        return self.base + self.leaf[trees, at - inner].sum(axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(rows)))


def fit(
    rows: np.ndarray, label: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
    ridge: float = 2.0, least_rows: float = 10,
) -> Forest:
    """A forest for the probability of label 1; constant where there is nothing to learn from."""
    positive = float(label.sum())
    base = float(np.log((positive + 1) / (len(label) - positive + 1)))
    inner = 2**depth - 1
    if not len(label) or positive in (0, len(label)):
        none = np.zeros((0, inner))
        return Forest(none.astype("int64"), none, np.zeros((0, inner + 1)), base)
    features = rows.shape[1]
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(cuts[f], rows[:, f], side="left") for f in range(features)], axis=1)
    score = np.full(len(label), base)
    found = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = label - p, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype="int64"), np.full(inner, np.inf)
        node = np.zeros(len(label), dtype="int64")
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            here = node - first
            best = np.full(width, 1e-6)
            for f in range(features):
                size = len(cuts[f]) + 1
                if size < 2:
                    continue
                place = here * size + binned[:, f]
                g = np.bincount(place, gradient, width * size).reshape(width, size).cumsum(axis=1)
                h = np.bincount(place, curve, width * size).reshape(width, size).cumsum(axis=1)
                n = np.bincount(place, minlength=width * size).reshape(width, size).cumsum(axis=1)
                gl, hl, nl = g[:, :-1], h[:, :-1], n[:, :-1]
                gr, hr, nr = g[:, -1:] - gl, h[:, -1:] - hl, n[:, -1:] - nl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(nl < least_rows) | (nr < least_rows)] = 0
                cut = gain.argmax(axis=1)
                most = gain[np.arange(width), cut]
                better = most > best
                best[better] = most[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = cuts[f][cut[better]]
            node = 2 * node + 1 + (rows[np.arange(len(label)), feature[node]] > threshold[node])
        leaf_at = node - inner
        g = np.bincount(leaf_at, gradient, inner + 1)
        h = np.bincount(leaf_at, curve, inner + 1)
        leaf = rate * g / (h + ridge)
        score += leaf[leaf_at]
        found.append((feature, threshold, leaf))
    return Forest(*(np.stack(x) for x in zip(*found)), base)
