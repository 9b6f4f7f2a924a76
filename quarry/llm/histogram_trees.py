"""Gradient-boosted trees on histograms, flattened into arrays.

Values are binned once; a tree grows level by level, each node at the cut with the
largest gain over its histograms of gradients and Hessians.  All trees end as one
set of arrays (feature, limit, children, value) with a list of roots, and scoring
walks every row through every tree at once, a level a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Cuts of a feature at most, levels of a tree, trees at most, step, L2 weight, and the least Hessian of a leaf.
CUTS, DEPTH, ROUNDS, RATE, RIDGE, LEAST = 63, 4, 200, 0.1, 1.0, 2.0
#: Rounds without a better loss on rows set aside, after which trees end.
PATIENCE = 20
#: Rows and trees walked at a time, as a product.
WALK = 1 << 20


@dataclass
class Flat:
    """Trees one after another: a node's feature, limit (greater goes right),
    children (itself at a leaf) and value, and where each tree begins."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.start)
        if not len(self.roots):
            return out
        step = max(1, WALK // len(self.roots))
        for at in range(0, len(x), step):
            rows = x[at : at + step]
            node = np.tile(self.roots, (len(rows), 1))
            own = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                node = np.where(rows[own, self.feature[node]] > self.limit[node], self.right[node], self.left[node])
            out[at : at + step] += self.value[node].sum(axis=1)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def cuts_of(column: np.ndarray) -> np.ndarray:
    """Limits between bins: quantiles of the distinct values, midway to the next."""
    known = np.unique(column)
    if len(known) < 2:
        return np.zeros(0)
    between = (known[:-1] + known[1:]) / 2
    if len(between) <= CUTS:
        return between
    return np.unique(between[np.linspace(0, len(between) - 1, CUTS).round().astype(int)])


def _grow(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[list[list[float]], np.ndarray]:
    """Nodes [feature, limit, left, right, value] of one tree, and each row's leaf."""
    nodes, leaf = [[0, np.inf, 0, 0, 0.0]], np.zeros(len(bins), np.int64)
    level, size = [0], CUTS + 1
    for _ in range(DEPTH):
        place = np.full(len(nodes), -1)
        place[level] = np.arange(len(level))
        own = place[leaf]
        there = np.flatnonzero(own >= 0)
        own, g, h, n = own[there], grad[there], hess[there], len(level)
        total_g, total_h = np.bincount(own, g, n), np.bincount(own, h, n)
        gain, choice = np.full(n, 1e-6), np.full((n, 2), -1)
        for f in range(len(cuts)):
            if not len(cuts[f]):
                continue
            key = own * size + bins[there, f]
            sg = np.bincount(key, g, n * size).reshape(n, size)[:, :-1].cumsum(axis=1)
            sh = np.bincount(key, h, n * size).reshape(n, size)[:, :-1].cumsum(axis=1)
            rg, rh = total_g[:, None] - sg, total_h[:, None] - sh
            found = sg**2 / (sh + RIDGE) + rg**2 / (rh + RIDGE) - (total_g**2 / (total_h + RIDGE))[:, None]
            found[(sh < LEAST) | (rh < LEAST)] = 0
            best = found.argmax(axis=1)
            better = np.flatnonzero(found[np.arange(n), best] > gain)
            gain[better] = found[better, best[better]]
            choice[better, 0], choice[better, 1] = f, best[better]
        following = []
        for i, node in enumerate(level):
            f, b = choice[i].tolist()
            if f < 0:
                continue
            nodes[node][:4] = [f, float(cuts[f][b]), len(nodes), len(nodes) + 1]
            for child in (len(nodes), len(nodes) + 1):
                nodes.append([0, np.inf, child, child, 0.0])
                following.append(child)
            rows = there[own == i]
            leaf[rows] = np.where(bins[rows, f] > b, nodes[node][3], nodes[node][2])
        if not (level := following):
            break
    g, h = np.bincount(leaf, grad, len(nodes)), np.bincount(leaf, hess, len(nodes))
    for i, value in enumerate((RATE * g / (h + RIDGE)).tolist()):
        nodes[i][4] = value
    return nodes, leaf


def _loss(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * np.logaddexp(0, np.where(y > 0, -raw, raw))).sum() / weight.sum())


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, aside: np.ndarray) -> Flat:
    """Trees on the rows that are not ``aside``; those that are say how many trees."""
    use = ~aside
    p = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9) if len(y) else 0.5, 0.001, 0.999))
    start = float(np.log(p / (1 - p)))
    flat: list[list[float]] = []
    roots: list[int] = []
    a, b, w = x[use], y[use].astype(float), weight[use]
    if len(a) and 0 < b.sum() < len(b):
        cuts = [cuts_of(c) for c in a.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(cuts, a.T, strict=True)], 1)
        away = np.stack([np.searchsorted(e, c, "left") for e, c in zip(cuts, x[aside].T, strict=True)], 1)
        total, other = np.full(len(a), start), np.full(int(aside.sum()), start)
        best, since, ends = np.inf, 0, [0]
        for _ in range(ROUNDS):
            chance = 1 / (1 + np.exp(-total))
            nodes, leaf = _grow(bins, cuts, w * (b - chance), w * chance * (1 - chance))
            value = np.array([n[4] for n in nodes])
            total += value[leaf]
            roots.append(len(flat))
            base = len(flat)
            flat += [[f, limit, left + base, right + base, v] for f, limit, left, right, v in nodes]
            ends.append(len(flat))
            if len(other):
                other += value[_leaves(nodes, cuts, away)]
                loss = _loss(other, y[aside], weight[aside])
                if loss < best - 1e-6:
                    best, since = loss, 0
                elif (since := since + 1) >= PATIENCE:
                    break
        if since:
            roots, flat = roots[:-since], flat[: ends[-1 - since]]
    table = np.array(flat, float).reshape(-1, 5)
    feature, left, right = (table[:, i].astype(np.int64) for i in (0, 2, 3))
    return Flat(start, feature, table[:, 1], left, right, table[:, 4], np.array(roots, np.int64), DEPTH)


def _leaves(nodes: list[list[float]], cuts: list[np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The leaves of binned rows."""
    table = np.array(nodes, float)
    feature, left, right = (table[:, i].astype(np.int64) for i in (0, 2, 3))
    # The bin whose upper limit a node's is; a leaf's rows stay where they are.
    limit = np.array([np.searchsorted(cuts[f], v) if np.isfinite(v) else CUTS + 1 for f, v in zip(feature, table[:, 1], strict=True)])
    node = np.zeros(len(bins), np.int64)
    for _ in range(DEPTH):
        node = np.where(bins[np.arange(len(bins)), feature[node]] > limit[node], right[node], left[node])
    return node
