"""Phrase counts in a HAT-trie: containers of rows that burst under a shallow trie of word ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EDGES = 2  # a path has the ids of the first two words at most
BURST = 8192  # phrases at which a container bursts
HOLD = 600_000  # phrases that a trie holds before subtrees are spilled
WIDTH = EDGES + 4  # columns of an entry: path, left, right, key, count
KEY, COUNT = WIDTH - 2, WIDTH - 1


def first_of_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a stable order of 64-bit hashes, where in it each distinct one begins)"""
    # Values are sorted much faster than places, so places stand in the low bits of the values;
    # where two hashes differ in these alone and stand wrong, they are sorted as they are.
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype="uint64")) & low).view("int64")
    own = keys[order]
    if (own[1:] < own[:-1]).any():
        order = np.argsort(keys, kind="stable")
        own = keys[order]
    return order, np.flatnonzero(np.append(True, own[1:] != own[:-1]))


class Container:
    """Blocks of rows (path, left, right, key, count); a key may stand in several until they are summed."""

    __slots__ = ("blocks", "size")

    def __init__(self):
        self.blocks: list[np.ndarray] = []
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def add(self, rows: np.ndarray) -> None:
        self.blocks.append(rows)
        self.size += len(rows)

    def matrix(self) -> np.ndarray:
        """Its rows by path and key, one of each."""
        if len(self.blocks) > 1:
            self.blocks = [_summed(self.blocks)]
            self.size = len(self.blocks[0])
        return self.blocks[0]


class HatTrie:
    """Counts of phrases. It starts as one container; ``spilled`` gives whole subtrees back.

    A container that grows over ``burst`` phrases becomes a node with one container for each id of
    its next word; under ``EDGES`` words containers only grow. When over ``hold`` rows are held,
    those of equal phrases are summed; the largest subtrees under the root then leave as one run
    sorted by path and key, until half remain.
    """

    def __init__(self, hold: int = HOLD, burst: int = BURST):
        self.hold, self.burst = hold, burst
        self.root: Container | dict = Container()
        self.size = 0

    def add(self, path: list[np.ndarray], left: np.ndarray, right: np.ndarray, key: np.ndarray):
        """Count one occurrence of each phrase; ``key`` tells phrases apart."""
        if not len(key):
            return
        order, first = first_of_equal(key.view("uint64"))
        n, one = np.diff(np.append(first, len(key))), order[first]
        rows = np.stack([*(p[one] for p in path), left[one], right[one], key[one], n], axis=1)
        self.root = self._put(self.root, rows, 0)

    def _put(self, at: Container | dict, rows: np.ndarray, depth: int) -> Container | dict:
        if isinstance(at, Container):
            at.add(rows)
            self.size += len(rows)
            if at.size <= self.burst or depth == EDGES:
                return at
            self.size -= at.size
            rows, at = at.matrix(), Container()
            if len(rows) <= self.burst // 2:  # many were equal
                return self._put(at, rows, depth)
            at = {}
        for word, own in _runs(rows, depth):
            at[word] = self._put(at.get(word) or Container(), own, depth + 1)
        return at

    def spilled(self, rest: bool = False) -> Iterator[np.ndarray]:
        """A sorted run of the largest subtrees if too much is held; with ``rest``, of all."""
        if not self.size or not rest and self.size <= self.hold:
            return
        held, self.root, self.size = _summed(_blocks(self.root)), {}, 0
        if rest:
            yield held
        elif len(held) <= self.hold // 2:
            self._put(self.root, held, 0)
        else:
            _, at, n = np.unique(held[:, 0], return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            remain = len(held) - np.cumsum(n[order])
            leave = np.zeros(len(n), bool)
            leave[order[: int(np.argmax(remain <= self.hold // 2)) + 1]] = True
            if not leave.all():
                self._put(self.root, held[~leave[at]], 0)
            yield held[leave[at]]


def _blocks(at: Container | dict) -> list[np.ndarray]:
    return at.blocks if isinstance(at, Container) else [b for x in at.values() for b in _blocks(x)]


def _runs(rows: np.ndarray, column: int):
    """(value, its rows) for each value of a column."""
    rows = rows[np.argsort(rows[:, column], kind="stable")]
    first = np.flatnonzero(np.diff(rows[:, column], prepend=rows[0, column] - 1))
    for word, a, b in zip(rows[first, column].tolist(), first.tolist(),
                          [*first[1:].tolist(), len(rows)], strict=True):
        yield word, rows[a:b]


def _summed(blocks: list[np.ndarray]) -> np.ndarray:
    """All rows by path and key, those of one key as one row."""
    rows = np.concatenate(blocks)
    rows = rows[np.lexsort([rows[:, KEY], *(rows[:, j] for j in reversed(range(EDGES)))])]
    first = np.flatnonzero(np.append(True, rows[1:, KEY] != rows[:-1, KEY]))
    n = np.add.reduceat(rows[:, COUNT], first)
    rows = rows[first]
    rows[:, COUNT] = n
    return rows
