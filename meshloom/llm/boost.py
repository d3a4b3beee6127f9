"""Gradient-boosted symmetric trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostedTrees:
    """Tree t asks depth questions x[feature[t, d]] > threshold[t, d]; the answers number its leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        columns = np.ascontiguousarray(x.T)
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for d in range(self.feature.shape[1]):
                at = 2 * at + (columns[self.feature[t, d]] > self.threshold[t, d])
            out += self.leaf[t][at]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, bins: int = 32) -> BoostedTrees:
    """Logistic loss, second order. All leaves of a level ask the same question, the one that gains most over them.

    Features of two values, which most are, are summed by one matrix product a leaf; the others by bins.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]  # bin > b means x > cuts[b]
    two = [j for j, c in enumerate(cuts) if len(c) == 1]
    above = np.stack([binned[j] > 0 for j in two], 1).astype(np.float64) if two else np.zeros((len(x), 0))
    every = np.arange(len(x))
    base = float(np.log(max((weight * y).sum(), 1e-6) / max((weight * (1 - y)).sum(), 1e-6)))
    score = np.full(len(x), base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        f_row, t_row = [], []
        for d in range(depth):
            best = (-1.0, 0, 0.0, 0)
            if two:
                whole_g, whole_h = (np.bincount(at, v, 1 << d)[:, None] for v in (g, h))
                of_leaf = np.zeros((2 << d, len(x)))
                of_leaf[at, every], of_leaf[at + (1 << d), every] = g, h
                right_g, right_h = np.split(of_leaf @ above, 2)
                gain = ((whole_g - right_g) ** 2 / (whole_h - right_h + ridge) + right_g**2 / (right_h + ridge)).sum(0)
                i = int(np.argmax(gain))
                best = (float(gain[i]), two[i], float(cuts[two[i]][0]), 0)
            for j, c in enumerate(cuts):
                if len(c) < 2:
                    continue
                width = len(c) + 1
                key = at * width + binned[j]
                gs, hs = (np.bincount(key, v, (1 << d) * width).reshape(-1, width).cumsum(1) for v in (g, h))
                right_g, right_h = gs[:, -1:] - gs[:, :-1], hs[:, -1:] - hs[:, :-1]
                gain = (gs[:, :-1] ** 2 / (hs[:, :-1] + ridge) + right_g**2 / (right_h + ridge)).sum(0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-12:
                    best = (float(gain[k]), j, float(c[k]), k)
            _, j, threshold, k = best
            f_row.append(j)
            t_row.append(threshold)
            at = 2 * at + (binned[j] > k)
        leaf = -rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
        score += leaf[at]
        features.append(f_row)
        thresholds.append(t_row)
        leaves.append(leaf)
    return BoostedTrees(np.array(features), np.array(thresholds), np.array(leaves), base)
