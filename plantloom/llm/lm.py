"""Language-model scores of documents: byte-context trie (PPM) and a word unigram base."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.llm.common import held_out, q, stored, table
from plantloom.llm.ppm import (
    CODE_BITS, END, GAP, ORDER, Held, Trie, _find, running, summed, tally_places,
)
from plantloom.llm.shingles import hashed, hashed_sentences, in_parts

HELD = 1 << 22  # words that are sorted at a time and handed on
COMMON = 400_000  # most frequent words that every task holds; the others are joined
CHUNK = 1 << 17  # bytes of text whose arrays are made at a time
PLACES = 1 << 23  # places of bytes that are sorted at a time and handed on
WINDOWS = 1_500_000  # places of most frequent contexts that every task holds; the others are joined
SENTENCES = 2_000_000  # most frequent repeated sentences that every task holds; the others are joined
MANY = 10_000  # times from which on all are held alike
PARTS = 4  # of the training rows; each is scored by the bytes of the others
NEAR = 3  # last bytes of a context that decide the group of its places
ASKED = 1_000_000  # places that a task collects before it asks for their scores
GROUP = 5_000_000  # words of training texts to one more group of places


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the times of each; sorts ``keys`` in place."""
    keys.sort()
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return keys[first], np.diff(np.append(first, len(keys)))


def _by_tag(keys: np.ndarray, times: np.ndarray, bits: int, tags: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys without the tag in their last ``bits``, and a matrix of times by tag."""
    tag = keys & ((1 << bits) - 1)
    keys = keys >> bits
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    out = np.zeros((np.count_nonzero(new), tags), "int64")
    out[np.cumsum(new) - 1, tag] = times
    return keys[new], out


class _Buffer:
    """Numbers of many arrays in one, up to ``size``; more come out in several turns."""

    def __init__(self, size: int):
        self.size, self.raw, self.used = size, np.empty(size, "int64"), 0

    def full(self, keys: np.ndarray):
        """Takes ``keys``; yields the numbers whenever no more fit."""
        at = 0
        while at < len(keys):
            n = min(len(keys) - at, self.size - self.used)
            self.raw[self.used: self.used + n] = keys[at: at + n]
            self.used, at = self.used + n, at + n
            if self.used == self.size:
                yield self.rest()

    def rest(self) -> np.ndarray:
        """The numbers taken since the last turn; they may be sorted in place."""
        used, self.used = self.used, 0
        return self.raw[:used]


def _hash_counts(batches):
    """(sentence or word, hash, times in training rows, n), summed in the task as far as it holds.

    ``n`` is for words the times in all rows, for sentences the rows that hold them. A word's hash
    is sorted with a last bit that tells whether its row trains.
    """
    names = ["sentence", "h", "c", "n"]
    words, found, size = _Buffer(HELD), [], 0

    def rows(sentence, h, c, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h), sentence)), pa.array(h), pa.array(c), pa.array(n)], names=names)

    def of_words(keys):
        h, times = _by_tag(*_distinct(keys), 1, 2)
        return rows(False, h & ((1 << 63) - 1), times[:, 1].copy(), sum(times.T))

    def of_sentences():
        h, n = summed(*map(np.concatenate, zip(*found, strict=True)))
        found.clear()
        return rows(True, h, n[:, 0].copy(), n[:, 1].copy())

    for batch in batches:
        learn = batch.column(1).to_numpy(zero_copy_only=False)
        for first, part in in_parts(batch.column(0).to_pylist(), CHUNK):
            known = hashed(part)
            own = learn[first: first + len(part)]
            keys = (known[2] & ~np.uint64(1)).view("int64") | np.repeat(own, np.diff(known[3]))
            yield from map(of_words, words.full(keys))
            text, h, times, *_ = _of_texts(known)
            found.append((h, np.column_stack([times * own[text], np.ones(len(h), "int64")])))
            size += len(h)
            if size > HELD // 4:
                yield of_sentences()
                size = 0
    yield of_words(words.rest())
    if found:
        yield of_sentences()


def packed(x: np.ndarray) -> bytes:
    """An array of numbers, or a matrix of such rows, in little room if it is sorted or small.

    The first byte is the size of a number; whole ones take the least that holds the largest.
    """
    x = np.ascontiguousarray(x)
    if x.size and x.dtype == "int64" and x.min() >= 0:
        x = x.astype(np.min_scalar_type(x.max()))
    flat = x.view("uint8").reshape(len(x), -1 if len(x) else 8)
    return bytes([x.itemsize]) + pa.compress(
        np.ascontiguousarray(flat.T).tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int, width: int | None = None, kind: str = "int64") -> np.ndarray:
    """The array of length ``n``, or the matrix of ``width`` columns, that was packed."""
    if not n:
        return np.zeros(0 if width is None else (0, width), kind)
    item = raw[0]
    size = item * (width or 1)
    flat = np.frombuffer(pa.decompress(pa.py_buffer(raw).slice(1), n * size, codec="zstd"), "uint8")
    out = np.ascontiguousarray(flat.reshape(size, n).T)
    out = out.view(kind if item == 8 else f"uint{8 * item}").astype(kind, copy=False)
    return out[:, 0] if width is None else out


PACKED = "grp int, q long, keys binary, counts binary"


def _packed_rows(grp: list[int], tallies: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of ``PACKED``: keys of a group and a matrix with their counts by part."""
    return pa.RecordBatch.from_arrays(
        [pa.array(grp, pa.int32()), pa.array([len(k) for k, _ in tallies], pa.int64()),
         pa.array([packed(k) for k, _ in tallies], pa.binary()),
         pa.array([packed(n) for _, n in tallies], pa.binary())],
        names=["grp", "q", "keys", "counts"])


def _tallies(rows: pa.RecordBatch | pa.Table):
    """(group, keys, counts by part) of rows of ``PACKED``."""
    for g, q, keys, counts in zip(*(rows[x].to_pylist() for x in ("grp", "q", "keys", "counts")),
                                  strict=True):
        yield g, unpacked(keys, q), unpacked(counts, q, PARTS + 1)


def _group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """Group of each place by the last ``NEAR`` bytes of its context."""
    near = ((keys >> 8) & ((1 << 8 * NEAR) - 1)).astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
    return ((near >> np.uint64(32)) % np.uint64(groups)).astype("uint16")


def _place_counts(batches, groups: int):
    """Rows of ``PACKED``: distinct places with their counts by part, summed in the task."""
    held = _Buffer(PLACES)

    def rows(places):
        places, times = _distinct(places)
        order = np.argsort(_group_of(places >> 3, groups), kind="stable")
        keys, counts = _by_tag(places[order], times[order], 3, PARTS + 1)
        found, at = np.unique(_group_of(keys, groups), return_index=True)
        cut = np.append(at, len(keys))
        for a in range(0, len(found), 64):
            yield _packed_rows(found[a: a + 64].tolist(), [
                (keys[i:j], counts[i:j]) for i, j in zip(cut[a: a + 64], cut[a + 1: a + 65], strict=False)])

    for batch in batches:
        parts = batch.column(1).to_numpy().astype("int64")
        for first, part in in_parts(batch.column(0).to_pylist(), CHUNK):
            _, key, start = running(part)
            sizes = np.diff(np.append(start, len(key)))
            key = (key << 3 | np.repeat(parts[first: first + len(part)], sizes))[key >= 0]
            for places in held.full(key):
                yield from rows(places)
    yield from rows(held.rest())


def _learned(counts: np.ndarray, part: int) -> np.ndarray:
    """Times that the rows of ``part`` may learn from: those of all training parts but their own."""
    return sum(counts[:, p] for p in range(1, PARTS + 1) if p != part)


def _without(tally, part: int):
    """Codes and counts of one order of the trie that scores the rows of ``part``."""
    codes, counts = tally
    n = _learned(counts, part)
    return codes[n > 0], n[n > 0]


def _contexts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted places: (first place of each longest context, number of its places, all their times)."""
    first = np.flatnonzero(np.diff(keys >> 8, prepend=-1))
    total = np.add.reduceat(sum(counts.T), first) if len(first) else first
    return first, np.diff(np.append(first, len(keys))), total


def _sizes(batches):
    """(order, code, counts by part) of the lowest orders; order -1: places of contexts by their times."""
    names = ["k", "code", *[f"n{p}" for p in range(PARTS + 1)]]
    for batch in batches:
        for _, keys, counts in _tallies(batch):
            _, q, total = _contexts(keys, counts)
            found = [(-1, *summed(np.minimum(total, MANY), q[:, None] * np.eye(1, PARTS + 1, dtype="int64"))),
                     *tally_places(keys & ((1 << CODE_BITS) - 1), keys >> CODE_BITS, counts, range(NEAR))]
            for k, codes, sums in found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), k, "int32")), pa.array(codes),
                     *[pa.array(np.ascontiguousarray(c)) for c in sums.T]], names=names)


def _is_held(keys: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Places whose longest context was seen often enough for every task to hold it."""
    _, q, total = _contexts(keys, counts)
    return np.repeat(np.minimum(total, MANY) >= least, q)


def _tries(keys: np.ndarray, counts: np.ndarray, short):
    """(part, the trie that scores its rows) of the places of a group."""
    code, depth = keys & ((1 << CODE_BITS) - 1), keys >> CODE_BITS
    long = [t for _, *t in tally_places(code, depth, counts, range(NEAR, ORDER + 1))]
    for p in range(PARTS + 1):
        yield p, Trie([_without(t, p) for t in [*short, *long]])


def _scores(trie: Trie, keys: np.ndarray) -> np.ndarray:
    return trie.log10(keys & ((1 << CODE_BITS) - 1), keys >> CODE_BITS)


def _held_scores(batches, short, least: int):
    """(key, part, score) of the held places that cannot be scored from their context alone.

    Their context of ``ORDER`` bytes does not foretell them, or they stand in a shorter one.
    """
    for batch in batches:
        for _, keys, counts in _tallies(batch):
            held = _is_held(keys, counts, least)
            if not held.any():
                continue
            for p, trie in _tries(keys, counts, short.value):
                own = keys[held & (counts[:, p] > 0) & ~(
                    (keys >> CODE_BITS == ORDER) & (_learned(counts, p) > 0))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(np.full(len(own), p, "int32")),
                     pa.array(_scores(trie, own))], names=["key", "part", "score"])


ASKS = "grp int, slice long, q long, keys binary, spots binary"


def _asks(slice_: int, keys: np.ndarray, spots: np.ndarray, groups: int) -> list[dict]:
    """By group the places whose scores a task asks for; a spot is a unit of the slice and a part."""
    group = _group_of(keys, groups)
    order = np.argsort(keys)
    order = order[np.argsort(group[order], kind="stable")]
    found, at = np.unique(group[order], return_index=True)
    cut = np.append(at, len(order))
    return [{"grp": int(g), "slice": slice_, "q": j - i, "keys": packed(keys[order[i:j]]),
             "spots": packed(spots[order[i:j]])}
            for g, i, j in zip(found, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


ANSWERS = "slice long, q long, units binary, scores binary"


def _answered(asks: pa.Table, places: pa.Table, short) -> pa.Table:
    """Rows of ``ANSWERS``: the sums of the scores that were asked for in a group, by unit."""
    slices, q, keys, spots = (asks[x].to_pylist() for x in ("slice", "q", "keys", "spots"))
    edges = np.cumsum([0, *q])
    out = []
    if slices:
        key = np.concatenate([unpacked(x, n) for x, n in zip(keys, q, strict=True)])
        spot = np.concatenate([unpacked(x, n) for x, n in zip(spots, q, strict=True)])
        score = np.zeros(len(key))
        (_, *tally), = _tallies(places)
        for p, trie in _tries(*tally, short.value):
            own = np.flatnonzero(spot & 7 == p)
            score[own] = _scores(trie, key[own])
        out = [summed(spot[a:b] >> 3, score[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({
        "slice": pa.array(slices, pa.int64()), "q": pa.array([len(u) for u, _ in out], pa.int64()),
        "units": pa.array([packed(u) for u, _ in out], pa.binary()),
        "scores": pa.array([packed(x) for _, x in out], pa.binary())})


def _joined(answers: pa.Table) -> pa.Table:
    """(unit, score) of a slice from the answers of all groups."""
    q, units, scores = (answers[x].to_pylist() for x in ("q", "units", "scores"))
    unit, score = summed(
        np.concatenate([unpacked(u, n) for u, n in zip(units, q, strict=True)]),
        np.concatenate([unpacked(x, n, kind="float64") for x, n in zip(scores, q, strict=True)]))
    return pa.table({"unit": unit + answers["slice"][0].as_py(), "joined": score})


def _merged(t: pa.Table) -> pa.Table:
    """The rows of ``PACKED`` of one group as one row."""
    tallies = [(k, n) for _, k, n in _tallies(t)]
    whole = summed(*(np.concatenate(x) for x in zip(*tallies, strict=True)))
    return pa.Table.from_batches([_packed_rows([t["grp"][0].as_py()], [whole])])


class HeldPlaces:
    """Places of frequent contexts, whole contexts at a time, and their scores by part.

    It travels as counts; a worker makes the scores of them when it first needs them.
    """

    def __init__(self, rows: pa.Table, others: pa.Table):
        """``rows`` of ``PACKED``; ``others`` (key, part, score): scores not made from the counts."""
        tallies = [(k, n) for _, k, n in _tallies(rows)]
        keys = np.concatenate([np.zeros(0, "int64"), *[k for k, _ in tallies]])
        counts = np.concatenate([np.zeros((0, PARTS + 1), "int64"), *[n for _, n in tallies]])
        order = np.argsort(keys)
        counts = counts[order]
        self.q, self.keys = len(keys), packed(keys[order])
        self.counts = [packed(np.ascontiguousarray(n)) for n in counts.T]
        key, part, score = (others[x].to_numpy() for x in ("key", "part", "score"))
        order = np.lexsort((key, part))
        spot = part.astype("int64") * len(keys) + np.searchsorted(np.sort(keys), key)
        self.more, self.spots, self.scores = len(key), packed(spot[order]), packed(score[order])
        self.made = None

    def tables(self) -> tuple[Held, np.ndarray]:
        """(places of keys, matrix of scores by place and part); its last row is of place -1."""
        if self.made is None:
            keys, times = unpacked(self.keys, self.q), [unpacked(n, self.q) for n in self.counts]
            learned = sum(times[1:])
            order = np.argsort(-(learned + times[0]), kind="stable")
            scores = np.zeros((self.q + 1, PARTS + 1))
            first = np.flatnonzero(np.diff(keys >> 8, prepend=-1))
            q = np.diff(np.append(first, self.q))
            for p in range(PARTS + 1) if self.q else ():
                n = learned - times[p] if p else learned
                room = np.add.reduceat(n, first) + np.add.reduceat((n > 0).astype("int64"), first)
                own = np.log10(np.maximum(n, 1) / np.maximum(np.repeat(room, q), 1))
                scores[:-1, p] = own[order]
            del times, learned
            if self.more:
                to = np.empty(self.q, "int64")
                to[order] = np.arange(self.q)
                spot = unpacked(self.spots, self.more)
                scores[to[spot % self.q], spot // self.q] = unpacked(self.scores, self.more, kind="float64")
            self.made = Held(keys[order]), scores
        return self.made


def held_places(places: DataFrame, most: int):
    """(places that tasks hold, edges of short contexts for all tasks) of rows of ``PACKED``.

    A place's score is log10 of its last byte in its context. Part 0, the held-out rows, is scored
    by the trie of all other parts; each other part by that of all but part 0 and itself. Places
    that share the last ``NEAR`` bytes of their context stand in one group, which so holds all
    edges of longer contexts; the edges of shorter ones go to all groups.
    """
    names = [f"n{p}" for p in range(PARTS + 1)]
    low = places.mapInArrow(_sizes, "k int, code long, " + ", ".join(f"{n} long" for n in names)) \
        .groupBy("k", "code").agg(*[F.sum(n).alias(n) for n in names]).orderBy("k", "code").toArrow()
    k, code = low["k"].to_numpy(), low["code"].to_numpy()
    sums = np.column_stack([low[n].to_numpy() for n in names]).astype("int64")
    least = _least({int(t): int(n) for t, n in zip(code[k < 0], sums[k < 0, 0], strict=True)}, most)
    short = places.sparkSession.sparkContext.broadcast([(code[k == i], sums[k == i]) for i in range(NEAR)])

    def frequent(batches):
        for batch in batches:
            for g, keys, counts in _tallies(batch):
                own = _is_held(keys, counts, least)
                yield _packed_rows([g], [(keys[own], counts[own])])

    return HeldPlaces(
        places.mapInArrow(frequent, PACKED).toArrow(),
        places.mapInArrow(lambda it: _held_scores(it, short, least),
                          "key long, part int, score double").toArrow()), short


class HeldSentences:
    """Hashes of sentences of two or more texts and their times in training rows."""

    def __init__(self, rows: pa.Table, every: bool):
        """``every``: no such sentence is missing."""
        h, times = (rows[x].to_numpy().astype("int64") for x in ("h", "times"))
        order = np.argsort(h)
        self.q, self.h, self.times, self.every = len(h), packed(h[order]), packed(times[order]), every
        self.made = None

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it held, its times in training rows) of each hash."""
        if self.made is None:
            self.made = unpacked(self.h, self.q), np.append(unpacked(self.times, self.q), 0)
        at = _find(self.made[0], h)
        return at >= 0, self.made[1][at]


def _least(sizes: dict[int, int], most: int) -> int:
    """The least number of times such that at most ``most`` were seen as often or more often."""
    least, held = MANY + 1, 0
    for t in sorted(sizes, reverse=True):
        if held + sizes[t] > most:
            break
        least, held = t, held + sizes[t]
    return least


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """The rows of the largest ``n``, at most ``most``; rows of equal ``n`` stay or go together."""
    times = F.least("n", F.lit(MANY))
    sizes = {r.t: r["count"] for r in counted.groupBy(times.alias("t")).count().collect()}
    return counted.where(times >= _least(sizes, most))


def pruned(edges: DataFrame, most: int) -> DataFrame:
    """The edges (k, code, n) of a trie of at most ``most`` edges, or else of order 1.

    No query uses it: ``held_places`` keeps all edges.

    Contexts of 2 or more bytes go if they were seen less often than a power of two, the smallest
    that suffices; a context's suffixes were seen at least as often, so they stay with it.
    """
    edges = edges.withColumn("ctx", F.shiftright("code", 8))
    contexts = edges.groupBy("k", "ctx").agg(F.sum("n").alias("seen"), F.count("*").alias("q"))
    sizes = contexts.groupBy(
        (F.col("k") >= 2).alias("long"), F.floor(F.log2("seen")).cast("int").alias("bits")
    ).agg(F.sum("q").alias("q")).collect()
    room = most - sum(r.q for r in sizes if not r.long)
    least = 0
    while sum(r.q for r in sizes if r.long and r.bits >= least) > max(0, room):
        least += 1
    if not least:
        return edges.drop("ctx")
    kept = contexts.where((F.col("k") < 2) | (F.col("seen") >= F.lit(1 << least)))
    return edges.join(kept.select("k", "ctx"), ["k", "ctx"], "left_semi").drop("ctx")


def _of_texts(known):
    """Of hashed texts the distinct sentences of each: (text, hash, times); place of each sentence, words, edges."""
    hashes, count, edge = hashed_sentences(*known)
    hashes = (hashes >> np.uint64(1)).view("int64")
    text = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    order = np.lexsort((hashes, text))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(hashes[order]) != 0)
    first = np.flatnonzero(new)
    place = np.empty(len(order), "int64")
    place[order] = np.cumsum(new) - 1
    own = np.diff(np.append(first, len(order)))
    return text[order][first], hashes[order][first], own, place, count, edge


def _sentences(part: list[bytes], known, owner: np.ndarray, places, seen: HeldSentences):
    """Of some texts: (sums by text, sentences to be joined, places to be asked for, their units).

    ``known`` are their hashed words, ``owner`` is the part of each text. A sentence of other
    training texts is coded by its count, any other spelled by its places. Sums: log10 without the
    places asked for, sentences coded, spelled and learned, and distinct ones that only this text
    taught. A sentence that is to be joined stands once per text: (text, hash, times there, score
    without the places asked for). Units are the texts, then the sentences to be joined.
    """
    held, scores = places
    text, h, own, place, count, edge = _of_texts(known)
    data, key, start = running(part)
    end = np.append(start[1:], len(data)) - 1
    begin = np.zeros(len(count), "int64")
    if len(count):
        border = np.flatnonzero((data == GAP) & (key >= 0))
        begin[1:] = border[np.cumsum(count)[:-1] - 1] + 1
        begin[edge[:-1][np.diff(edge) > 0]] = start[np.diff(edge) > 0] + 1

    seen_before, times = seen.find(h)
    learn = owner[text] > 0
    others = times - np.where(learn, own, 0)
    open_ = ~seen_before & (not seen.every)
    whole = ~open_ & (others > 0)
    spelled = ~open_ & ~whole
    if len(count):  # the places of a coded sentence are not needed
        coded = np.repeat(whole[place], np.diff(np.append(begin, len(data))))
        key[begin[0]:][coded & (data[begin[0]:] != END)] = -1

    at = held.find(key)
    score = scores.ravel().take(  # place -1 is the last row
        at * (PARTS + 1) + np.repeat(owner, np.diff(np.append(start, len(data)))))
    bounds = np.sort(np.concatenate([begin, end]))
    sums = np.add.reduceat(score, bounds)[np.searchsorted(bounds, begin)]
    total = np.bincount(place, weights=sums, minlength=len(h))
    value = np.where(whole, own * np.log10(np.maximum(others, 1)), np.where(spelled, total, 0))

    def by_text(x):
        return np.bincount(text, weights=x, minlength=len(part))

    numbers = [by_text(value) + score[end], *[by_text(x).astype("int64") for x in (
        own * whole, own * spelled, own * learn, spelled & learn)]]
    unit = np.where(open_, len(part) + np.cumsum(open_) - 1, np.where(whole, -1, text))
    miss = np.flatnonzero((at < 0) & (key >= 0))
    to = np.searchsorted(start, miss, "right") - 1
    inside = data[miss] != END
    to[inside] = unit[place[np.searchsorted(begin, miss[inside], "right") - 1]]
    return (numbers, [x[open_] for x in (text, h, own, total)], key[miss[to >= 0]], to[to >= 0])


def _word_sums(known, words: Held, learned: np.ndarray, base: np.ndarray):
    """Of hashed texts: (words, learned words, summed base, hashes of other words, their edges).

    The last of ``learned`` and ``base`` are those of words that ``words`` does not hold.
    """
    *_, h, edge = known
    h = (h >> np.uint64(1)).view("int64")
    at = words.find(h)
    n = np.diff(edge)
    text = np.repeat(np.arange(len(n)), n)
    sums = [np.bincount(text, weights=x[at], minlength=len(n)) for x in (learned, base)]
    miss = np.flatnonzero(at < 0)
    return n, sums[0].astype("int64"), sums[1], h[miss], np.searchsorted(miss, edge)


ROWS = ("held_out boolean, part int, row long, n_tokens long, known long, base double,"
        " rare array<long>, coded double, whole long, spelled long, mine long,"
        " alone long, sentences array<struct<h: long, own: long, score: double, unit: long>>,"
        f" asks array<struct<{ASKS.replace(' ', ': ').replace(',:', ',')}>>")


def _score_rows(batches, common, held, sentences, base_end: float, end_known: int, groups: int):
    """One row per document: sums over its common words, its other words, and its sentences.

    Between them rows with ``asks`` alone: the places whose scores the documents before still need.
    """
    places, seen = held.value.tables(), sentences.value
    hashes, learned, base = common.value
    words = Held(hashes)
    row = first_row = TaskContext.get().partitionId() << 40
    schema, kind = None, None
    keys, spots, size = [], [], 0

    def asked():
        asks = _asks(first_row, np.concatenate(keys), np.concatenate(spots), groups)
        keys.clear()
        spots.clear()
        return pa.RecordBatch.from_pylist([{"asks": asks}], schema)

    for batch in batches:
        owner = batch.column(3).to_numpy()
        if schema is None:
            kind = pa.list_(pa.struct([
                ("grp", pa.int32()), ("slice", pa.int64()), ("q", pa.int64()),
                ("keys", pa.binary()), ("spots", pa.binary())]))
            schema = pa.schema([
                ("_id", batch.schema.field(0).type), ("held_out", pa.bool_()), ("part", pa.int32()),
                *[(x, pa.int64()) for x in ("row", "n_tokens", "known")], ("base", pa.float64()),
                ("rare", pa.list_(pa.int64())),
                ("coded", pa.float64()),
                *[(x, pa.int64()) for x in ("whole", "spelled", "mine", "alone")],
                ("sentences", pa.list_(pa.struct([
                    ("h", pa.int64()), ("own", pa.int64()), ("score", pa.float64()),
                    ("unit", pa.int64())]))), ("asks", kind)])
        for first, part in in_parts(batch.column(2).to_pylist(), 2 * CHUNK):
            known = hashed(part)
            n, hits, sums, rare, cut = _word_sums(known, words, learned, base)
            own = batch.slice(first, len(part))
            part_of = owner[first: first + len(part)]
            numbers, (text, *each), key, unit = _sentences(part, known, part_of, places, seen)
            unit_of = row + len(part) + np.arange(len(text))
            each = pa.StructArray.from_arrays(
                [*map(pa.array, each), pa.array(unit_of)], names=["h", "own", "score", "unit"])
            edges = np.searchsorted(text, np.arange(len(part) + 1)).astype("int32")
            keys.append(key)
            spots.append((row - first_row + unit) << 3 | np.append(part_of, part_of[text])[unit])
            size += len(key)
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), own.column(3), pa.array(row + np.arange(len(part))),
                 pa.array(n + 1), pa.array(hits + end_known), pa.array(sums + base_end),
                 pa.ListArray.from_arrays(pa.array(cut.astype("int32")), pa.array(rare)),
                 *map(pa.array, numbers),
                 pa.ListArray.from_arrays(pa.array(edges), each), pa.nulls(len(part), kind)],
                names=schema.names)
            row += len(part) + len(text)
            if size > ASKED:
                yield asked()
                size, first_row = 0, row
    if size:
        yield asked()


def ppm_scores(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10,
) -> DataFrame:
    """One row per input row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose crc32(id as text) is divisible by ``folds`` are held out; the others train. A text,
    A-Z lower-cased, is its words and one end. ``base_score`` is its log10 probability under
    add-0.1 word counts. ``score`` is that under prediction by partial matching. A sentence that
    other training texts hold is one symbol of the longest level (its count over total plus
    distinct; a training text's own sentences do not count for it). Any other escapes to its bytes,
    each word with the border after it, in contexts of up to 6 bytes that reach back over words
    and sentences to the start of the text, with escapes and symbol exclusion. The end is the last
    byte. For a held-out text the trie holds the bytes of all training texts. These are dealt to 4
    parts by their id; for one of them it holds those of the 3 other parts, so that a text never
    foretells its own bytes.

    All sentences, words and distinct places (a byte in its longest context) of the corpus are
    counted as tables. Places travel as packed arrays, one with counts by part for each group of
    contexts. Tasks hold the up to 400,000 most frequent words, 2 million most frequent sentences
    of two or more texts, and 1.5 million places of the most frequent contexts; other words and
    sentences are joined, and other places are asked for, in slices, of the groups that hold their
    part of the trie. NULL and empty texts are the end alone; NULL ids train; rows may repeat; an
    empty table gives an empty result. Other columns are not read. Words, sentences and contexts
    of equal counts are held together or not at all, which changes no score. Words and sentences
    are counted and known by 63-bit hashes. A text is scored whole in one task, in arrays of several times its size.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = held_out(q(id_col), folds)
    docs = df.select(q(id_col).alias("_id"), out.alias("held_out"),
                     q(text_col).cast("string").alias("_text"),
                     F.when(out, 0).otherwise(F.coalesce(F.floor(F.crc32(
                         q(id_col).cast("string").cast("binary")) / folds) % PARTS, F.lit(0)) + 1)
                     .cast("int").alias("_part"))
    counts = stored(
        docs.select("_text", ~F.col("held_out")).mapInArrow(
            _hash_counts, "sentence boolean, h long, c long, n long")
        .repartition("h")  # a task hands on each hash about once: summing before the shuffle gains nothing
        .groupBy("sentence", "h").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-counts")
    vocab = counts.where("NOT sentence").drop("sentence")
    counted = counts.where("sentence").select("h", F.col("c").alias("times"), "n")
    learned = docs.where(~F.col("held_out")).select("_id").count()
    sums = vocab.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    total = (sums.c or 0) + learned
    types = (sums.v or 0) + (learned > 0)
    below = total + 0.1 * (types + 1)

    base_end = float(np.log10((learned + 0.1) / below))
    groups = 100 + total // GROUP
    places = stored(
        docs.select("_text", "_part").mapInArrow(lambda it: _place_counts(it, groups), PACKED)
        .groupBy("grp").applyInArrow(_merged, PACKED), "lm-places")
    held, short = held_places(places, WINDOWS)
    held = df.sparkSession.sparkContext.broadcast(held)

    # Only a sentence of two or more texts can be one of other texts.
    size = counted.agg(F.sum("times").alias("n"), F.count_if(F.col("times") > 0).alias("types"),
                       F.count_if(F.col("n") > 1).alias("seen")).first()
    seen = counted.where("n > 1")
    top = most_frequent(seen, SENTENCES).toArrow()
    every = len(top) == size.seen
    sentences = df.sparkSession.sparkContext.broadcast(HeldSentences(top, every))

    vocab = vocab.withColumn("base", F.log10((F.col("c") + 0.1) / below))
    top = most_frequent(vocab, COMMON).toArrow().sort_by([("n", "descending")])
    common = df.sparkSession.sparkContext.broadcast((
        top["h"].to_numpy(), np.append(top["c"].to_numpy() > 0, False), np.append(top["base"].to_numpy(), 0)))
    out = stored(docs.mapInArrow(
        lambda it: _score_rows(it, common, held, sentences, base_end, int(learned > 0), groups),
        f"_id {kind}, {ROWS}"), "lm-rows")

    asks = out.where("asks IS NOT NULL").select(F.explode("asks").alias("a")).select("a.*")
    answers = asks.groupBy("grp").cogroup(places.groupBy("grp")).applyInArrow(
        lambda a, b: _answered(a, b, short), ANSWERS)
    joined = answers.groupBy("slice").applyInArrow(_joined, "unit long, joined double")
    if not every:
        joined = stored(joined, "lm-joined")
    rows = out.where("asks IS NULL")
    sums = rows.drop("rare", "sentences", "asks").join(
        joined.withColumnRenamed("unit", "row"), "row", "left").withColumn(
        "coded", F.col("coded") + F.coalesce("joined", F.lit(0))).drop("joined")
    if not every:
        each = rows.select("row", "part", F.explode("sentences").alias("s")).select(
            "row", "part", "s.*").join(seen.select("h", "times"), "h", "left").join(
            joined, "unit", "left").withColumn(
            "others", F.coalesce("times", F.lit(0)) - F.when(F.col("part") > 0, F.col("own")).otherwise(0))
        whole, own = F.col("others") > 0, F.col("own")
        spelled = F.col("score") + F.coalesce("joined", F.lit(0))
        more = each.groupBy("row").agg(
            F.sum(F.when(whole, own * F.log10("others")).otherwise(spelled)).alias("_coded"),
            F.sum(F.when(whole, own).otherwise(0)).alias("_whole"),
            F.sum(F.when(whole, 0).otherwise(own)).alias("_spelled"),
            F.count_if((F.col("part") > 0) & ~whole).alias("_alone"))
        sums = sums.join(more, "row", "left").withColumns(
            {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("coded", "whole", "spelled", "alone")})
    types = F.lit(size.types) - F.col("alone")
    room = F.log10(F.greatest(F.lit(size.n or 0) - F.col("mine") + types, F.lit(1)))
    coded = F.col("coded") - F.col("whole") * room + F.col("spelled") * (
        F.log10(F.greatest(types, F.lit(1))) - room)
    more = rows.select("row", F.explode("rare").alias("h")).join(
        vocab.select("h", "c", "base"), "h").groupBy("row").agg(
        F.count_if(F.col("c") > 0).alias("_known"), F.sum("base").alias("_base"))
    none = F.lit(0)
    return (
        sums.join(more, "row", "left").select(
            F.col("_id").alias(id_col), "held_out", "n_tokens",
            (F.col("known") + F.coalesce("_known", none)).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("_base", none)).alias("base_score"),
            coded.alias("score")))


def op4_ppm_scores(spark, sf: str) -> DataFrame:
    """All documents scored by a model learned from nine tenths of them."""
    return ppm_scores(table(spark, sf, "documents"))
