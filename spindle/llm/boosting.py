"""Gradient-boosted trees over a small matrix of features, and isotonic calibration.

Fitting runs on the driver over a bounded sample (or over counts of a bounded
grid), which its callers state; what Spark applies are the fitted numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """base + rate * sum of trees. A tree: (feature, threshold) of 2^depth - 1 nodes in heap order, 2^depth leaves; right if value > threshold."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range((len(leaf)).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> Trees:
    """Logistic loss, second-order splits on quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = np.clip((y * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(mean / (1 - mean))), [])
    margin = np.full(len(y), model.base)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (y - p) * weight, p * (1 - p) * weight
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, k = 2**level - 1, 2**level
            best = np.zeros(k)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                slot = (node - first) * (len(e) + 1) + binned[:, j]
                gs = np.bincount(slot, g, k * (len(e) + 1)).reshape(k, -1)
                hs = np.bincount(slot, h, k * (len(e) + 1)).reshape(k, -1)
                gl, hl, ga, ha = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1], gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < 1e-3) | (ha - hl < 1e-3)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(k), at] > best + 1e-9
                best = np.where(better, gain[np.arange(k), at], best)
                feature[first : first + k] = np.where(better, j, feature[first : first + k])
                threshold[first : first + k] = np.where(better, e[at], threshold[first : first + k])
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_no = node - (2**depth - 1)
        leaf = rate * np.bincount(leaf_no, g, 2**depth) / (np.bincount(leaf_no, h, 2**depth) + l2)
        model.trees.append((feature, threshold, leaf))
        margin += leaf[leaf_no]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the isotonic regression, by pooling adjacent violators."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first and last margin
    for m, v, w in zip(margin[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([v * w, w, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    xs, ys = [], []
    for s, w, lo, hi in blocks:
        xs += [lo, hi]
        ys += [s / w, s / w]
    return np.array(xs), np.array(ys)
