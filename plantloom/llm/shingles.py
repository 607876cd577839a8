"""Word shingles of many texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import functools

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype="uint64")
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
CHUNK_BYTES = 1 << 20  # text that is hashed at a time


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(x):
        out = np.full(n, x, "uint64")
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(_BASE), row(pow(_BASE, -1, 1 << 64))


def word_hashes(data: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of every word of a byte buffer that starts and ends with a gap."""
    gap = gaps[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = _powers(max(1 << 21, 1 << len(data).bit_length()))
    total = np.zeros(len(data) + 1, "uint64")
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return starts, mixed((total[ends] - total[starts]) * down[starts])


def _chunks(texts):
    part, size = [], 0
    for t in texts:
        raw = (t or "").encode()
        if part and size + len(raw) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield part


def shingle_sets(texts, words: int = 5):
    """For runs of texts: (sorted distinct shingle hashes of all, first index of each text + end).

    A text of fewer words has one shingle, of all its words; a text without words has none.
    """
    for part in _chunks(texts):
        data = np.frombuffer(b" " + b" ".join(part) + b" ", "uint8")
        lengths = np.fromiter(map(len, part), "int64", len(part))
        begin = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
        starts, h = word_hashes(data)
        edge = np.searchsorted(starts, begin)
        n = np.diff(edge)
        count = np.where(n >= words, n - words + 1, (n > 0).astype("int64"))
        ends = np.cumsum(count)
        sums = np.zeros(len(h), "uint64")
        factor = np.uint64(1)
        for j in range(words):
            sums[: max(0, len(h) - j)] += h[j:] * factor
            factor = factor * _STEP
        first = np.repeat(edge[:-1] - (ends - count), count) + np.arange(ends[-1])
        out = sums[first]
        for i in np.flatnonzero((n > 0) & (n < words)):
            x = np.uint64(n[i])
            for v in h[edge[i]: edge[i + 1]]:
                x = x * _STEP + v
            out[ends[i] - 1] = x
        out = mixed(out)
        bounds = np.concatenate([[0], ends])
        keep = np.ones(len(out), bool)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            out[a:b].sort()
        if len(out):
            keep[1:] = out[1:] != out[:-1]
            keep[bounds[:-1][count > 0]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        yield out[keep], kept[bounds]


def hashed(part: list[bytes]):
    """Words of some texts: (joined bytes, first byte and hash of each, index of each text's first + end)."""
    data = np.frombuffer(b" " + b" ".join(part) + b" ", "uint8")
    lengths = np.fromiter(map(len, part), "int64", len(part))
    begin = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
    starts, h = word_hashes(data)
    return data, starts, h, np.searchsorted(starts, begin)


def sentence_hashes(part: list[bytes], most: int = 16):
    """Sentences of some texts: (hash, number of words, index of each text's first + end).

    A sentence ends with a word whose last byte is one of ``.!?``, after ``most`` words, or with
    the text.
    """
    return hashed_sentences(*hashed(part), most)


def hashed_sentences(data, starts, h, edge, most: int = 16):
    """``sentence_hashes`` of texts whose words are ``hashed``."""
    gap = SPACES[data]
    last = data[np.flatnonzero(~gap[:-1] & gap[1:])]
    if not len(h):
        return h, edge[:0], edge
    new = np.zeros(len(h), bool)
    new[1:] = np.isin(last[:-1], np.frombuffer(b".!?", "uint8"))
    new[edge[:-1][np.diff(edge) > 0]] = True
    run = np.flatnonzero(new)
    inside = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    first = np.flatnonzero(inside % most == 0)
    n = np.diff(np.append(first, len(h)))
    at = np.arange(len(h)) - np.repeat(first, n)
    power = np.multiply.accumulate(np.concatenate([[1], np.full(most, _STEP)]).astype("uint64"))
    sums = mixed(np.add.reduceat(h * power[at], first) + n.astype("uint64"))
    return sums, n, np.searchsorted(first, edge)


def in_parts(texts, size: int = CHUNK_BYTES):
    """(index of the first, lower-cased bytes) of runs of texts of about ``size`` bytes."""
    part, held, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = (t or "").encode().lower()
        if part and held + len(raw) > size:
            yield first, part
            part, held, first = [], 0, i
        part.append(raw)
        held += len(raw) + 1
    if part:
        yield first, part
