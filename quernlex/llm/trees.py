"""Gradient-boosted trees for a 0/1 label, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 64


class Boosted:
    """Trees of one depth on binned features, fitted to the logistic loss by Newton steps.

    Splits are found from histograms of gradients. Without rows, or with one label only, the
    score is the rate of label 1.
    """

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, penalty: float = 1.0, least: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.penalty, self.least = rounds, depth, rate, penalty, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = -20.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, wide = x.shape
        share = y.mean() if n else 0.0
        self.base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        if not 0 < share < 1:
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1], method="lower")) for f in range(wide)]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        at = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-at))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature = np.zeros((1 << self.depth) - 1, np.int64)
            threshold = np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-6)
                chosen = np.full(width, BINS)
                for f in range(wide):
                    key = node * BINS + binned[f]
                    gs = np.cumsum(np.bincount(key, g, width * BINS).reshape(width, BINS), axis=1)
                    hs = np.cumsum(np.bincount(key, h, width * BINS).reshape(width, BINS), axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (ga - gs) ** 2 / (ha - hs + self.penalty) - ga**2 / (ha + self.penalty)
                    gain[(hs < self.least) | (ha - hs < self.least)] = 0
                    gain[:, len(cuts[f]) :] = 0
                    top = gain.argmax(axis=1)
                    more = gain[np.arange(width), top]
                    for k in np.flatnonzero(more > best).tolist():
                        best[k], chosen[k] = more[k], top[k]
                        feature[first + k], threshold[first + k] = f, cuts[f][top[k]]
                node = 2 * node + (x[np.arange(n), feature[first + node]] > threshold[first + node])
            gs, hs = (np.bincount(node, v, 1 << self.depth) for v in (g, h))
            leaf = self.rate * gs / (hs + self.penalty)
            self.trees.append((feature, threshold, leaf))
            at += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                k = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[k]] > threshold[k])
            at += leaf[node]
        return 1 / (1 + np.exp(-at))


class Isotonic:
    """The non-decreasing fit of labels to scores (pool adjacent violators), interpolated.

    A thousandth of the raw score is blended in, so that scores pooled together keep their order.
    """

    def __init__(self, score: np.ndarray, label: np.ndarray) -> None:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
        for s, y in zip(score[order].tolist(), label[order].tolist(), strict=True):
            blocks.append([y, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.value = np.array([b[0] / b[1] for b in blocks])

    def apply(self, score: np.ndarray) -> np.ndarray:
        if not len(self.at):
            return score
        return np.clip(0.999 * np.interp(score, self.at, self.value) + 0.001 * score, 0, 1)
