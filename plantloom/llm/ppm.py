"""Prediction by partial matching over bytes: trie, escapes, symbol exclusion."""

from __future__ import annotations

import numpy as np

ORDER = 6  # bytes of context
GAP, END = 0x20, 0x0A  # word border and end of text; neither occurs in a word
ALPHABET = 256
CODE_BITS = 8 * (ORDER + 1)  # of a key; its depth stands above them


def windows(words: list[bytes]):
    """All (context, symbol) places of words: (codes of the last ORDER + 1 bytes, known bytes, word).

    A word is preceded by one border and followed by one; contexts do not reach further back.
    ``code`` packs the bytes up to and including the symbol; ``depth`` is the longest context.
    """
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), "uint8").astype("int64")
    sizes = np.fromiter(map(len, words), "int64", len(words)) + 1  # symbols, border included
    owner = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = first[owner] + 1 + inside
    depth = np.minimum(inside + 1, ORDER)
    code = data[at].copy()
    for k in range(1, ORDER + 1):
        code |= np.where(k <= depth, data[np.maximum(at - k, 0)], 0) << (8 * k)
    return code, depth, owner


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and, for each, the sum of its rows of ``weights``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.add.reduceat(weights[order], first, axis=0) if len(first) else weights[:0]


def tally_places(code: np.ndarray, depth: np.ndarray, weight: np.ndarray, orders=range(ORDER + 1)):
    """Per order: (order, distinct codes, summed weights) of places; weights may be rows of a matrix."""
    for k in orders:
        here = depth >= k
        yield k, *summed(code[here] & ((1 << 8 * (k + 1)) - 1), weight[here])


def tally(words: list[bytes], counts: np.ndarray):
    """Per order: (order, distinct codes, summed counts) of the words' places."""
    code, depth, owner = windows(words)
    yield from tally_places(code, depth, np.asarray(counts, "int64")[owner])


def running(texts: list[bytes]):
    """Places of running texts: (bytes, key of each byte, first byte of each text).

    A text is a border, its words with a border after each, and END; contexts reach back to its
    first border. A key is the code with the depth above it; -1 at the first border.
    """
    raw = [b" " + b" ".join([*t.split(), b"\n"]) for t in texts]
    data = np.frombuffer(b"".join(raw), "uint8")
    sizes = np.fromiter(map(len, raw), "int64", len(raw))
    first = np.cumsum(sizes) - sizes
    wide = data.astype("int64")
    key, two = wide | (ORDER << CODE_BITS), wide.copy()
    two[1:] |= wide[:-1] << 8
    for k, back in ((0, two), (2, two), (4, two), (6, wide)):  # runs of up to two bytes, k back
        key[k:] |= back[: max(0, len(wide) - k)] << (8 * k)
    for k in range(1, ORDER):
        at = first[sizes > k] + k
        key[at] = key[at] & ((1 << 8 * (k + 1)) - 1) | (k << CODE_BITS)
    key[first] = -1
    return data, key, first


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, -1 where it is missing."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class Trie:
    """Contexts of 0 … ORDER bytes with the counts of the symbols that follow.

    A symbol is coded in the longest context that was seen; each escape to the next shorter one
    costs distinct / (total + distinct), and the symbols of the longer context are excluded there,
    from the total as from the distinct ones. Symbols never seen share what is left evenly.
    """

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        """``parts``: for each order the sorted codes (context, symbol) and their counts."""
        self.edges, self.counts, self.contexts = [], [], []
        self.total, self.distinct, self.excluded = [], [], []
        for k, (codes, n) in enumerate(parts):
            first = np.flatnonzero(np.diff(codes >> 8, prepend=-1))
            contexts, q = codes[first] >> 8, np.diff(np.append(first, len(codes)))
            self.edges.append(codes)
            self.counts.append(n.astype("float64"))
            self.contexts.append(contexts)
            self.total.append(np.add.reduceat(n, first) if len(n) else n)
            self.distinct.append(q)
            if k == 0 or not len(n):
                self.excluded.append(np.zeros(len(contexts), "int64"))
                continue
            shorter = codes & ((1 << 8 * k) - 1)
            below = parts[k - 1][1][_find(parts[k - 1][0], shorter)]
            self.excluded.append(np.add.reduceat(below, first))

    def log10(self, code: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each code in its context."""
        out = np.zeros(len(code))
        open_ = np.arange(len(code))
        gone, gone_q = np.zeros(len(code), "int64"), np.zeros(len(code), "int64")
        for k in range(ORDER, -1, -1):
            own = code[open_] & ((1 << 8 * (k + 1)) - 1)
            ctx = np.where(depth[open_] >= k, _find(self.contexts[k], own >> 8), -1)
            use = ctx >= 0
            i, c = open_[use], ctx[use]
            if not len(i):
                continue
            total = self.total[k][c] - gone[i] + self.distinct[k][c] - gone_q[i]
            left = self.distinct[k][c] - gone_q[i]
            e = _find(self.edges[k], own[use])
            hit = e >= 0
            out[i[hit]] += np.log10(self.counts[k][e[hit]] / total[hit])
            miss = ~hit & (left > 0)
            out[i[miss]] += np.log10(left[miss] / total[miss])
            gone[i], gone_q[i] = self.excluded[k][c], self.distinct[k][c]
            done = np.zeros(len(open_), bool)
            done[np.flatnonzero(use)[hit]] = True
            open_ = open_[~done]
            if not len(open_):
                return out
        seen = len(self.edges[0])
        out[open_] -= np.log10(max(1, ALPHABET - seen))
        return out

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word with its border."""
        if not words:
            return np.zeros(0)
        code, depth, owner = windows(words)
        return np.bincount(owner, weights=self.log10(code, depth), minlength=len(words))


class Held:
    """Keys → places in a list: hash tables of one key per slot, then a sorted rest."""

    def __init__(self, keys: np.ndarray):
        """``keys`` come most frequent first, so these are found in the first table."""
        self.levels, at = [], np.arange(len(keys), dtype="int32")
        for factor in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9):
            shift = 64 - max(4, len(keys).bit_length())
            used, first = np.unique(self._slot(keys, factor, shift), return_index=True)
            table, value = np.full(1 << (64 - shift), -2), np.zeros(1 << (64 - shift), "int32")
            table[used], value[used] = keys[first], at[first]
            self.levels.append((factor, shift, table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, at = keys[rest], at[rest]
        order = np.argsort(keys)
        self.keys, self.at = keys[order], at[order]

    @staticmethod
    def _slot(keys, factor: int, shift: int):
        return ((keys.view("uint64") * np.uint64(factor)) >> np.uint64(shift)).view("int64")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the list, -1 where it is missing or negative."""
        factor, shift, table, value = self.levels[0]  # most keys are here: no lists of places
        slot = self._slot(keys, factor, shift)
        hit = table.take(slot) == keys
        out = np.where(hit, value.take(slot), -1)
        open_ = np.flatnonzero(~hit & (keys >= 0))
        for factor, shift, table, value in self.levels[1:]:
            own = keys[open_]
            slot = self._slot(own, factor, shift)
            hit = table[slot] == own
            out[open_[hit]] = value[slot[hit]]
            open_ = open_[~hit]
        at = _find(self.keys, keys[open_])
        out[open_[at >= 0]] = self.at[at[at >= 0]]
        return out
