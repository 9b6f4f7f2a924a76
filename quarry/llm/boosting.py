"""Gradient-boosted trees for a yes/no target, on a few thousand rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A full binary tree: per inner node a feature and a limit (rows above it
    go right), per leaf a value."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        inner = len(self.feature)
        rows = np.arange(len(x))
        while inner and node[0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.limit[node])
        return self.value[node - inner]


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int) -> Tree:
    inner = (1 << depth) - 1
    feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(x), np.int64)
    for at in range(inner):
        own = np.flatnonzero(node == at)
        best = (1e-6, None)
        g, h = grad[own].sum(), hess[own].sum()
        for f, cuts in enumerate(edges):
            if not len(cuts) or not len(own):
                continue
            sg = np.bincount(bins[own, f], grad[own], len(cuts) + 1)[:-1].cumsum()
            sh = np.bincount(bins[own, f], hess[own], len(cuts) + 1)[:-1].cumsum()
            gain = sg**2 / (sh + 1) + (g - sg) ** 2 / (h - sh + 1) - g**2 / (h + 1)
            gain[(sh < 1) | (h - sh < 1)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, cuts[k]))
        if best[1] is not None:
            feature[at], limit[at] = best[1]
        node[own] = 2 * at + 1 + (x[own, feature[at]] > limit[at])
    leaf = node - inner
    value = np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
    return Tree(feature, limit, value)


@dataclass
class Boosted:
    """Trees, and the steps of a monotone calibration of their sum."""

    start: float
    rate: float
    trees: list[Tree]
    steps: np.ndarray
    chance: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self.rate * tree.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        if not len(x):
            return np.zeros(0)
        return self.chance[np.searchsorted(self.steps, self.raw(x), "right")]


def _monotone(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising chances over rising scores."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([s, float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, v2, n2 = blocks.pop()
            blocks[-1][1] += v2
            blocks[-1][2] += n2
    chance = [(v + 0.5) / (n + 1) for _, v, n in blocks]
    return np.array([b[0] for b in blocks[1:]]), np.maximum.accumulate(chance)


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2) -> Boosted:
    """Trees on the rows not ``held``, calibration on those that are."""
    a, b = x[~held], y[~held].astype(float)
    edges = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in a.T]
    edges = [e[:-1] if len(e) > 1 and e[-1] >= c.max() else e for e, c in zip(edges, a.T, strict=True)]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, a.T, strict=True)], 1)
    p = min(0.99, max(0.01, b.mean()))
    model = Boosted(float(np.log(p / (1 - p))), rate, [], np.zeros(0), np.zeros(1))
    total = np.full(len(a), model.start)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-total))
        tree = _grow(a, bins, edges, b - chance, chance * (1 - chance), depth)
        model.trees.append(tree)
        total += rate * tree.predict(a)
    model.steps, model.chance = _monotone(model.raw(x[held]), y[held])
    return model
