"""Boosted trees on binned features: split choice, leaf values and scores, in numpy.

A cell is a distinct row of bins; it carries the number of its rows and the sums of the targets
(or the counts of the classes), which is all that the squared and the multinomial loss need.
Bin 0 is a missing value. Trees are perfect: a node that is not split sends all rows to the left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TIE = 1e-9  # gains this close count as equal, so the order of a sum decides nothing


@dataclass(frozen=True)
class BoostSpec:
    """``gamma`` is the least gain of a split, ``l2`` the penalty of leaf values, ``columns`` the
    share of features that a tree may use, ``min_rows`` the least rows of a leaf."""

    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    bins: int = 64
    loss: str = "squared"
    l2: float = 0.0
    gamma: float = 0.0
    columns: float = 1.0
    min_rows: int = 1
    seed: int = 42


@dataclass
class Trees:
    """One tree per output: the splits by node in level order, and the leaves' values."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    leaf: np.ndarray

    def leaves(self, bins: np.ndarray, output: int) -> np.ndarray:
        node = np.zeros(len(bins), "int64")
        for level in range(int(np.log2(self.leaf.shape[1]))):
            node = descend(bins, node, level, self.feature[output], self.cut[output],
                           self.missing_left[output])
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.stack([self.leaf[k][self.leaves(bins, k)] for k in range(len(self.leaf))], axis=1)


def descend(bins, node, level: int, feature, cut, missing_left) -> np.ndarray:
    """Places of the rows on the next level, numbered from its left."""
    at = (1 << level) - 1 + node
    value = bins[np.arange(len(bins)), feature[at]]
    right = np.where(value == 0, ~missing_left[at], value > cut[at])
    return node * 2 + right


def allowed_features(spec: BoostSpec, width: int, turn: int, output: int) -> np.ndarray:
    """The features that one tree may use, from the seed alone."""
    ok = np.ones(width, bool)
    if spec.columns < 1:
        keep = max(1, round(spec.columns * width))
        rng = np.random.default_rng([spec.seed, turn, output])
        ok[rng.permutation(width)[keep:]] = False
    return ok


def histogram(bins: np.ndarray, node: np.ndarray, sums: np.ndarray, nodes: int, width: int):
    """Sums per (statistic, node, feature, bin) of the rows' ``sums`` (rows, statistics)."""
    p = bins.shape[1]
    flat = ((node[:, None] * p + np.arange(p)) * width + bins).ravel()
    return np.stack([
        np.bincount(flat, np.repeat(x, p), nodes * p * width).reshape(nodes, p, width)
        for x in sums.T])


def choose(hist: np.ndarray, spec: BoostSpec, allowed: np.ndarray):
    """Per node the best split (feature, cut, missing go left) and the children's (G, H) sums.

    ``hist`` is (G, H, rows) per node, feature and bin. Of splits of equal gain the first feature,
    then the lowest cut counts, missing values to the left first. Without a split that gains more
    than ``gamma`` all rows go left. ``allowed`` tells the features, for all nodes or for each.
    """
    g, h, n = hist
    nodes, p, width = g.shape
    total = [x[:, :1].sum(2)[:, :, None, None] for x in (g, h, n)]
    below = [np.cumsum(x[:, :, 1:], axis=2)[..., None] + np.stack(
        [x[:, :, 0], np.zeros((nodes, p))], axis=-1)[:, :, None, :] for x in (g, h, n)]
    (gl, hl, nl), (gr, hr, nr) = below, [t - x for t, x in zip(total, below, strict=True)]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (gl ** 2 / (hl + spec.l2) + gr ** 2 / (hr + spec.l2)
                      - total[0] ** 2 / (total[1] + spec.l2))
    ok = (nl >= max(spec.min_rows, 0.5)) & (nr >= max(spec.min_rows, 0.5)) & np.isfinite(gain)
    open_ = np.broadcast_to(allowed, (nodes, p))[:, :, None, None]
    gain = np.where(ok & open_, gain, -np.inf).reshape(nodes, -1)
    best = gain.max(1)
    at = np.argmax(gain >= (best - TIE * np.maximum(np.abs(best), 1e-300))[:, None], axis=1)
    split = best > spec.gamma
    feature, cut, side = np.unravel_index(at, (p, width - 1, 2))
    rows = np.arange(nodes)

    def children(left, whole):
        a = np.where(split, left[rows, feature, cut, side], whole[:, 0, 0, 0])
        return np.stack([a, whole[:, 0, 0, 0] - a], axis=1).ravel()

    return (np.where(split, feature, 0), np.where(split, cut + 1, width),
            np.where(split, side == 0, True), children(gl, total[0]), children(hl, total[1]))


def leaf_values(g: np.ndarray, h: np.ndarray, spec: BoostSpec) -> np.ndarray:
    room = h + spec.l2
    return np.where(room > 1e-12, -spec.rate * g / np.where(room > 1e-12, room, 1), 0.0)


def start(sums: np.ndarray, rows: float, spec: BoostSpec) -> np.ndarray:
    """Scores before the first tree: means, or logarithms of the classes' shares."""
    if spec.loss == "squared":
        return sums / max(rows, 1)
    return np.log(np.maximum(sums, 1e-12) / max(rows, 1e-12))


def gradients(scores: np.ndarray, n: np.ndarray, sums: np.ndarray, spec: BoostSpec):
    """(G, H) per cell and output at the current scores."""
    if spec.loss == "squared":
        return n[:, None] * scores - sums, np.repeat(n[:, None], sums.shape[1], axis=1)
    p = softmax(scores)
    return n[:, None] * p - sums, n[:, None] * p * (1 - p)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def boost(bins: np.ndarray, n: np.ndarray, sums: np.ndarray, width: int, spec: BoostSpec):
    """(scores of all cells, start, trees by round) of one model; cells of no rows are scored too."""
    bins = bins.astype("int64")
    base = start(sums.sum(0), n.sum(), spec)
    scores = np.tile(base, (len(bins), 1))
    used, out = n > 0, []
    own = bins[used]
    for turn in range(spec.rounds):
        g, h = gradients(scores[used], n[used], sums[used], spec)
        made = [_grow(own, np.stack([g[:, k], h[:, k], n[used]], axis=1), width, spec,
                      allowed_features(spec, bins.shape[1], turn, k)) for k in range(g.shape[1])]
        trees = Trees(*(np.stack(x) for x in zip(*made, strict=True)))
        scores += trees.scores(bins)
        out.append(trees)
    return scores, base, out


def _grow(bins, stats, width: int, spec: BoostSpec, allowed):
    inner, node = (1 << spec.depth) - 1, np.zeros(len(bins), "int64")
    feature, cut = np.zeros(inner, "int64"), np.full(inner, width)
    missing_left = np.ones(inner, bool)
    for level in range(spec.depth):
        own = slice((1 << level) - 1, (1 << (level + 1)) - 1)
        hist = histogram(bins, node, stats, 1 << level, width)
        feature[own], cut[own], missing_left[own], g, h = choose(hist, spec, allowed)
        if level + 1 < spec.depth:
            node = descend(bins, node, level, feature, cut, missing_left)
    return feature, cut, missing_left, leaf_values(g, h, spec)


def boost_many(bins: np.ndarray, n: np.ndarray, sums: np.ndarray, width: int, spec: BoostSpec):
    """Scores of all cells by one model of squared loss per column of ``sums``, grown side by side.

    The same scores as of ``boost`` column by column: a node of a model is a node of one wide level.
    """
    if spec.loss != "squared":
        raise ValueError("only models of squared loss are grown side by side")
    bins = bins.astype("int64")
    (cells, p), models = bins.shape, sums.shape[1]
    row, model = np.arange(cells)[:, None], np.arange(models)
    spots = (np.arange(p) * width + bins)[:, None, :]
    rows = np.repeat(np.repeat(n, models), p)
    scores = np.tile(sums.sum(0) / max(n.sum(), 1), (cells, 1))
    for turn in range(spec.rounds):
        g = np.repeat((n[:, None] * scores - sums).ravel(), p)
        allowed = np.stack([allowed_features(spec, p, turn, 0)] * models)
        node = np.zeros((cells, models), "int64")
        for level in range(spec.depth):
            k = 1 << level
            wide = model * k + node
            flat = (wide[:, :, None] * (p * width) + spots).ravel()
            hist = np.stack([np.bincount(flat, x, models * k * p * width).reshape(-1, p, width)
                             for x in (g, rows)])
            feature, cut, left, gs, hs = choose(
                hist[[0, 1, 1]], spec, np.repeat(allowed, k, axis=0))
            value = bins[row, feature[wide]]
            node = node * 2 + np.where(value == 0, ~left[wide], value > cut[wide])
        leaf = leaf_values(gs, hs, spec)
        scores += leaf[model * (1 << spec.depth) + node]
    return scores
