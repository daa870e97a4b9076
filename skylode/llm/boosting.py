"""Gradient-boosted trees for two classes, and isotonic calibration, in numpy; trees can be turned into Columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Boosted:
    """Trees over dense features. A node is (feature, cut, left, right), taken left where value <= cut, or a leaf value."""

    trees: list[list] = field(default_factory=list)
    start: float = 0.0
    knots: tuple[np.ndarray, np.ndarray] | None = None  # of the isotonic calibration: margins and probabilities

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            is_leaf = np.array([not isinstance(n, tuple) for n in nodes])
            f, c, l, r = (np.array([n[i] if isinstance(n, tuple) else 0 for n in nodes]) for i in range(4))
            while not is_leaf[at].all():
                go = ~is_leaf[at]
                a = at[go]
                at[go] = np.where(x[go, f[a]] <= c[a], l[a], r[a])
            out += np.array([0.0 if isinstance(n, tuple) else n for n in nodes])[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = self.margin(x)
        return sigmoid(m) if self.knots is None else np.interp(m, *self.knots)

    def column(self, features: list[Column]) -> Column:
        """The margin as a Column over the features' Columns."""

        def node(nodes: list, i: int) -> Column:
            n = nodes[i]
            return F.when(features[n[0]] <= F.lit(float(n[1])), node(nodes, n[2])).otherwise(node(nodes, n[3])) if isinstance(n, tuple) else F.lit(float(n))

        out = F.lit(float(self.start))
        for nodes in self.trees:
            out = out + node(nodes, 0)
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Newton steps on the logistic loss; splits at quantiles, found from histograms. Same rows, same model."""
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(start=float(np.log(p / (1 - p))))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    # Rare features have their whole weight at one value: give the smallest value above it a cut of its own.
    cuts = [np.unique(np.append(c, x[:, j].min())) for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        q = sigmoid(margin)
        g, h = q - y, q * (1 - q)
        nodes: list = []

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes)
            G, H = g[rows].sum(), h[rows].sum()
            nodes.append(float(-rate * G / (H + ridge)))
            if level == depth or len(rows) < 4:
                return me
            best = (1e-6, -1, -1)
            for j, c in enumerate(cuts):
                b = binned[rows, j]
                gl, hl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                ok = (hl >= least) & (H - hl >= least)
                gain = np.where(ok, gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge), 0)
                if len(gain) and gain.max() > best[0] + 1e-12:
                    best = (gain.max(), j, int(np.argmax(gain)))
            if best[1] < 0:
                return me
            _, j, k = best
            left = binned[rows, j] <= k
            a, b = grow(rows[left], level + 1), grow(rows[~left], level + 1)
            nodes[me] = (j, float(cuts[j][k]), a, b)
            return me

        grow(np.arange(len(y)), 0)
        model.trees.append(nodes)
        one = Boosted([nodes])
        margin = margin + one.margin(x)
    return model


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray) -> None:
    """Isotonic regression (pool adjacent violators) of y on the margins, with a weak pull to 0 and 1 apart."""
    m = model.margin(x)
    order = np.argsort(m, kind="stable")
    m, y = m[order], y[order].astype(float)
    keep, start = np.unique(m, return_index=True)
    n = np.diff(np.append(start, len(m))).astype(float)
    total = np.add.reduceat(y, start) if len(y) else np.zeros(0)
    blocks: list[list[float]] = []  # sum, count, first, last
    for s, c, at in zip(total, n, keep, strict=True):
        blocks.append([s, c, at, at])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s2, c2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2], last]
    xs, ys = [], []
    for s, c, a, b in blocks:
        value = (s + 0.01) / (c + 0.02)
        xs += [a] if a == b else [a, b]
        ys += [value] if a == b else [value, value]
    model.knots = (np.array(xs), np.maximum.accumulate(np.array(ys))) if xs else None
