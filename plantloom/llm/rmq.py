"""Postings with range-maximum sparse tables, searched by intervals of documents, best first."""

from __future__ import annotations

import numpy as np

BATCH = 128  # intervals that are split at a time


def _levels(values: np.ndarray, longest: int, better) -> np.ndarray:
    """Row j, place i: where the best of values[i : i + 2^j] stands; of equal ones the first."""
    rows = max(1, int(longest).bit_length())
    out = np.zeros((rows, len(values)), "int32")
    out[0] = np.arange(len(values))
    for j in range(1, rows):
        half = 1 << (j - 1)
        a, b = out[j - 1][:-half], out[j - 1][half:]
        out[j] = out[j - 1]
        out[j][: len(b)] = np.where(better(values[b], values[a]), b, a)
    return out


def _best(levels: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray, better):
    """Place of the best value in each non-empty range a : b."""
    j = np.frexp((b - a).astype("float64"))[1] - 1
    x, y = levels[j, a], levels[j, b - (np.int64(1) << j)]
    return np.where(better(values[y], values[x]), y, x)


class Postings:
    """Documents 0 … ``docs`` - 1 of a shard: per term the documents that hold it and the impacts.

    ``rank`` orders documents of equal score. All posting lists stand in one array, term by term,
    under one sparse table of as many levels as the longest list needs; no query reaches over a
    list's ends.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, rank: np.ndarray,
                 terms: int):
        order = np.lexsort((doc, term))
        self.docs, self.rank = len(rank), rank
        self.key = term[order].astype("int64") * self.docs + doc[order]
        self.doc, self.impact = doc[order].astype("int64"), impact[order]
        self.edge = np.searchsorted(self.key, np.arange(terms + 1) * np.int64(self.docs))
        self.top = _levels(self.impact, np.diff(self.edge).max(initial=1), np.greater)
        self.least = _levels(rank, self.docs, np.less)

    def first_rank(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.rank[_best(self.least, self.rank, lo, hi, np.less)]

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best: larger scores first, then smaller ranks.

        An interval of documents is bounded by the sum over the terms of the largest impact among
        its postings. The intervals of the highest bounds are split at the document of their
        largest single impact, whose score is exact; both sides come back unless their bound is
        below the k-th score, or equal to it where every rank in them comes later.
        """
        terms = terms[self.edge[terms + 1] > self.edge[terms]]
        best, scores = np.zeros(0, "int64"), np.zeros(0, "int64")
        if not len(terms):
            return best, scores
        base = terms.astype("int64") * self.docs
        pool = self._bounded(np.array([0]), np.array([self.docs]), self.edge[terms][None],
                             self.edge[terms + 1][None])
        while len(pool[0]):
            bound = pool[0]
            if len(bound) > BATCH:
                at = np.argpartition(bound, len(bound) - BATCH)
                now, later = at[-BATCH:], at[:-BATCH]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, "int64")
            _, lo, hi, a, b, split = (x[now] for x in pool)
            place = np.searchsorted(self.key, base + split[:, None])
            inside = place < b
            inside[inside] &= self.doc[place[inside]] == np.broadcast_to(
                split[:, None], place.shape)[inside]
            value = np.where(inside, self.impact[np.minimum(place, len(self.impact) - 1)], 0)
            best = np.concatenate([best, split])
            scores = np.concatenate([scores, value.sum(1)])
            if len(best) > k:
                keep = np.lexsort((self.rank[best], -scores))[:k]
                best, scores = best[keep], scores[keep]
            sides = self._bounded(
                np.concatenate([lo, split + 1]), np.concatenate([split, hi]),
                np.concatenate([a, place + inside]), np.concatenate([place, b]))
            pool = [np.concatenate([x[later], y]) for x, y in zip(pool, sides, strict=True)]
            if len(best) == k:
                least, last = scores.min(), self.rank[best[np.lexsort((self.rank[best], -scores))[-1]]]
                open_ = pool[0] > least
                even = np.flatnonzero(pool[0] == least)
                open_[even] = self.first_rank(pool[1][even], pool[2][even]) < last
                pool = [x[open_] for x in pool]
        keep = np.lexsort((self.rank[best], -scores))
        return best[keep], scores[keep]

    def _bounded(self, lo, hi, a, b):
        """Intervals with any posting: [bound, lo, hi, a, b, document of the largest impact]."""
        own = b > a
        live = own.any(1)
        lo, hi, a, b, own = lo[live], hi[live], a[live], b[live], own[live]
        value, at = np.zeros(a.shape, "int64"), np.zeros(a.shape, "int64")
        at[own] = _best(self.top, self.impact, a[own], b[own], np.greater)
        value[own] = self.impact[at[own]]
        split = self.doc[at[np.arange(len(at)), value.argmax(1)]]
        return [value.sum(1), lo, hi, a, b, split]
