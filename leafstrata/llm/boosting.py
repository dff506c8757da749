"""Boosted trees on binned features: cyclic additive models with pairs, and depth-wise trees."""

from __future__ import annotations

import numpy as np


def cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    """Up to bins - 1 cuts of a feature, each midway between neighbouring distinct values."""
    values = np.unique(x)
    if len(values) < 2:
        return np.zeros(0)
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < bins:
        return middle
    at = np.searchsorted(values, np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return np.unique(middle[np.clip(at, 0, len(middle) - 1)])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)], 1).astype(np.int16)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gain(g, h, l2):
    return g * g / (h + l2)


def _best_split(g: np.ndarray, h: np.ndarray, lo: int, hi: int, l2: float, least: float) -> tuple[float, int]:
    """Best cut of the bins lo .. hi - 1: its gain, and the first bin on its right."""
    if hi - lo < 2:
        return 0.0, lo
    a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    tg, th = g[lo:hi].sum(), h[lo:hi].sum()
    gain = _gain(a, b, l2) + _gain(tg - a, th - b, l2) - _gain(tg, th, l2)
    gain[(b < least) | (th - b < least)] = 0
    k = int(gain.argmax())
    return float(gain[k]), lo + k + 1


class AdditiveModel:
    """A generalised additive model with pairwise interactions for a 0/1 label.

    Shallow trees of three leaves on one feature at a time, boosted in a cycle with a small
    step, are summed into one lookup table a feature. Pairs that still explain the residual
    best then get tables of their own, by trees that cut both features once. A score is the
    intercept plus one table entry per feature and pair.
    """

    def __init__(self, bins: int = 48, pair_bins: int = 12, rounds: int = 80, pairs: int = 4, step: float = 0.15, l2: float = 2.0, least: float = 1.0):
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.step, self.l2, self.least = bins, pair_bins, rounds, pairs, step, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, d = x.shape
        self.cuts = [cut_points(x[:, i], self.bins) for i in range(d)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pair_cuts, self.pair_tables = {}, {}
        rate = (y.sum() + 0.5) / (n + 1)
        self.intercept = float(np.log(rate / (1 - rate)))
        if not n or y.min() == y.max():
            return self
        b = binned(x, self.cuts)
        z = np.full(n, self.intercept)
        for _ in range(self.rounds):
            for i in range(d):
                p = sigmoid(z)
                size = len(self.tables[i])
                g, h = np.bincount(b[:, i], y - p, size), np.bincount(b[:, i], p * (1 - p), size)
                edges = [0, size]
                for _ in range(2):  # three leaves at most
                    options = [(*_best_split(g, h, lo, hi, self.l2, self.least),) for lo, hi in zip(edges, edges[1:], strict=False)]
                    gain, at = max(options)
                    if gain <= 1e-6:
                        break
                    edges = sorted({*edges, at})
                if len(edges) > 2:
                    move = np.zeros(size)
                    for lo, hi in zip(edges, edges[1:], strict=False):
                        move[lo:hi] = self.step * g[lo:hi].sum() / (h[lo:hi].sum() + self.l2)
                    self.tables[i] += move
                    z += move[b[:, i]]
        self._fit_pairs(x, y, z)
        return self

    def _pair_split(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
        """Best pair of cuts of a grid of gradients: gain over no cut, and the cuts."""
        quad = lambda m: (m.cumsum(0).cumsum(1), m.sum(0).cumsum(), m.sum(1).cumsum(), m.sum())
        (gg, gc, gr, gt), (hh, hc, hr, ht) = quad(g), quad(h)
        total = np.zeros_like(gg)
        for a, b in ((gg, hh), (gr[:, None] - gg, hr[:, None] - hh), (gc[None] - gg, hc[None] - hh), (gt - gr[:, None] - gc[None] + gg, ht - hr[:, None] - hc[None] + hh)):
            total += _gain(a, np.maximum(b, 0), self.l2)
        total = total[:-1, :-1] - _gain(gt, ht, self.l2)
        if not total.size:
            return 0.0, 0, 0
        i, j = np.unravel_index(total.argmax(), total.shape)
        return float(total[i, j]), int(i) + 1, int(j) + 1

    def _fit_pairs(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
        d = x.shape[1]
        cuts = [cut_points(x[:, i], self.pair_bins) for i in range(d)]
        b = binned(x, cuts)
        size = [len(c) + 1 for c in cuts]

        def grids(i, j, p):
            cell = b[:, i].astype(np.int64) * size[j] + b[:, j]
            shape = (size[i], size[j])
            return np.bincount(cell, y - p, size[i] * size[j]).reshape(shape), np.bincount(cell, p * (1 - p), size[i] * size[j]).reshape(shape)

        p = sigmoid(z)
        ranked = sorted(((self._pair_split(*grids(i, j, p))[0], i, j) for i in range(d) for j in range(i)), reverse=True)
        chosen = [(i, j) for gain, i, j in ranked[: self.n_pairs] if gain > 1e-6]
        for i, j in chosen:
            self.pair_cuts[i, j], self.pair_tables[i, j] = (cuts[i], cuts[j]), np.zeros((size[i], size[j]))
        for _ in range(self.rounds // 2):
            for i, j in chosen:
                g, h = grids(i, j, sigmoid(z))
                gain, r, c = self._pair_split(g, h)
                if gain <= 1e-6:
                    continue
                move = np.zeros_like(g)
                for rows in (slice(0, r), slice(r, None)):
                    for cols in (slice(0, c), slice(c, None)):
                        move[rows, cols] = self.step * g[rows, cols].sum() / (h[rows, cols].sum() + self.l2)
                self.pair_tables[i, j] += move
                z += move[b[:, i], b[:, j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, by additions of table entries."""
        b = binned(x, self.cuts)
        z = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for (i, j), t in self.pair_tables.items():
            ci, cj = self.pair_cuts[i, j]
            z += t[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return sigmoid(z)


class BoostedTrees:
    """Gradient-boosted trees of fixed depth for a 0/1 label; margins, not probabilities."""

    def __init__(self, bins: int = 32, trees: int = 80, depth: int = 3, step: float = 0.15, l2: float = 2.0, least: float = 1.0):
        self.bins, self.n_trees, self.depth, self.step, self.l2, self.least = bins, trees, depth, step, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        self.cuts = [cut_points(x[:, i], self.bins) for i in range(d)]
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rate = (y.sum() + 0.5) / (n + 1)
        self.intercept = float(np.log(rate / (1 - rate)))
        if not n or y.min() == y.max():
            return self
        b = binned(x, self.cuts)
        wide = max(2, *(len(c) + 1 for c in self.cuts))
        z = np.full(n, self.intercept)
        inner = (1 << self.depth) - 1
        for _ in range(self.n_trees):
            p = sigmoid(z)
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int16), np.full(inner, wide, np.int16)  # a cut beyond all bins: all rows go left
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                here = node - first
                best = np.zeros(count)
                for i in range(d):
                    cell = here * wide + b[:, i]
                    gs, hs = (np.bincount(cell, v, count * wide).reshape(count, wide) for v in (g, h))
                    a, c = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    tg, th = gs.sum(1)[:, None], hs.sum(1)[:, None]
                    gain = _gain(a, c, self.l2) + _gain(tg - a, th - c, self.l2) - _gain(tg, th, self.l2)
                    gain[(c < self.least) | (th - c < self.least)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    better = top > best + 1e-9
                    best[better] = top[better]
                    feature[first : first + count][better], cut[first : first + count][better] = i, at[better] + 1
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] >= cut[node])
            leaf = node - inner
            leaves = self.step * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
            self.trees.append((feature, cut, leaves))
            z += leaves[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        z, rows = np.full(len(x), self.intercept), np.arange(len(x))
        for feature, cut, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] >= cut[node])
            z += leaves[node - len(feature)]
        return z


class Isotonic:
    """A monotone step-wise linear map from margins to rates, by pooling adjacent violators."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        if not len(margin):
            self.x, self.p = np.zeros(1), np.full(1, 0.5)
            return self
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, weight, sum of margins
        for m, t in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([t, 1.0, m])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.p = np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks])
        self.p = np.maximum.accumulate(self.p)
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.p)
