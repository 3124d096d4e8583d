"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most 64 bins at quantiles; trees of bounded depth are grown level by
level on the logistic loss and kept as flat arrays, so that scoring moves all rows down one level
at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature[t, k]``, ``cut[t, k]`` of node k of tree t (children 2k+1 and 2k+2; right if value > cut), ``leaf[t, j]``."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 2.0, n_bins: int = 64) -> Trees:
    """Trees for labels 0 and 1; with one class or no rows, a constant."""
    y = np.asarray(y, float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base, inner = float(np.log(prior / (1 - prior))), 2**depth - 1
    features, cuts, leaves = [], [], []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, n_bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        margin, offsets = np.full(len(y), base), np.arange(x.shape[1]) * n_bins
        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            bin_cut = np.full(inner, n_bins)
            for level in range(depth):
                first, n = 2**level - 1, 2**level
                flat = (((at - first) * len(offsets) * n_bins)[:, None] + offsets + binned).ravel()
                shape = (n, len(offsets), n_bins)
                G = np.bincount(flat, np.repeat(g, len(offsets)), n * len(offsets) * n_bins).reshape(shape).cumsum(2)
                H = np.bincount(flat, np.repeat(h, len(offsets)), n * len(offsets) * n_bins).reshape(shape).cumsum(2)
                GT, HT = G[:, :, -1:], H[:, :, -1:]
                gain = G**2 / (H + l2) + (GT - G) ** 2 / (HT - H + l2) - GT**2 / (HT + l2)
                gain[(H < least) | (HT - H < least)] = 0
                best = gain.reshape(n, -1).argmax(1)
                for k in range(n):
                    f, b = divmod(int(best[k]), n_bins)
                    if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                        feature[first + k], cut[first + k], bin_cut[first + k] = f, edges[f][b], b
                at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > bin_cut[at])
            at -= inner
            leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
            margin = margin + leaf[at]
            features.append(feature)
            cuts.append(cut)
            leaves.append(leaf)
    return Trees(base, depth, np.array(features, np.int64).reshape(-1, inner), np.array(cuts, float).reshape(-1, inner), np.array(leaves, float).reshape(-1, inner + 1))
