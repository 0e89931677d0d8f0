"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    edges: list[np.ndarray]  # bin edges of each feature
    feature: np.ndarray  # trees, inner nodes
    bin: np.ndarray
    leaf: np.ndarray  # trees, leaves
    start: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        rows = np.arange(len(b))
        out = np.full(len(b), self.start)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, leaf in zip(self.feature, self.bin, self.leaf):
            node = np.zeros(len(b), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1).astype(np.int64)


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 2.0) -> Trees:
    """Fit logistic loss, level by level, with the best split by second-order gain."""
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    b = binned(x, edges)
    n, width = b.shape
    slot = b + np.arange(width) * BINS
    rate0 = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    start = float(np.log(rate0 / (1 - rate0)))
    score = np.full(n, start)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS), np.zeros((trees, inner + 1))
    for k in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p) * weight, p * (1 - p) * weight
        node = np.zeros(n, np.int64)  # within its level
        for level in range(depth):
            many, base = 2**level, 2**level - 1
            where = (node[:, None] * width * BINS + slot).ravel()
            hists = [np.bincount(where, weights=np.repeat(v, width), minlength=many * width * BINS).reshape(many, width, BINS) for v in (g, h)]
            gl, hl = hists[0].cumsum(axis=2), hists[1].cumsum(axis=2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            good = gain.reshape(many, -1)[np.arange(many), best] > 1e-6
            feature[k, base : base + many] = np.where(good, best // BINS, 0)
            cut[k, base : base + many] = np.where(good, best % BINS, BINS)
            node = 2 * node + (b[np.arange(n), feature[k, base + node]] > cut[k, base + node])
        gs, hs = np.bincount(node, weights=g, minlength=inner + 1), np.bincount(node, weights=h, minlength=inner + 1)
        leaf[k] = rate * gs / (hs + ridge)
        score += leaf[k][node]
    return Trees(edges, feature, cut, leaf, start)
