import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plantloom.llm import ppm
from plantloom.llm.lm import op4_ppm_scores, ppm_scores, pruned
from plantloom.llm.shingles import sentence_hashes

from .brute import ODD_SCHEMA, odd_rows


def words(text):
    return (text or "").encode().lower().split()


def base_of(docs):
    """(n_tokens, n_known, train_tokens, base) per document by the contract's formula."""
    end = b"\n"
    tokens = {i: [*words(t), end] for i, t in docs}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    return {i: (len(ws), sum(train[w] > 0 for w in ws), n,
                sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
            for i, ws in tokens.items()}


class PlainTrie:
    """The same model, symbol by symbol, over dictionaries."""

    def __init__(self, counts):
        self.next = defaultdict(Counter)
        for w, c in counts.items():
            s = b" " + w + b" "
            for i in range(1, len(s)):
                for k in range(min(i, ppm.ORDER) + 1):
                    self.next[s[i - k: i]][s[i]] += c

    def log10(self, context, symbol):
        out, gone = 0.0, set()
        for k in range(min(len(context), ppm.ORDER), -1, -1):
            seen = self.next.get(context[len(context) - k:])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in gone}
            room = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / room)
            if left:
                out += math.log10(len(left) / room)
            gone |= set(seen)
        return out - math.log10(max(1, ppm.ALPHABET - len(gone)))

    def word(self, w):
        s = b" " + w + b" "
        return sum(self.log10(s[max(0, i - ppm.ORDER): i], s[i]) for i in range(1, len(s)))


def build(counts):
    words, n = list(counts), np.array(list(counts.values()))
    parts = [(c, s) for _, c, s in ppm.tally(words, n)]
    return ppm.Trie(parts)


def test_trie_against_dictionaries():
    counts = Counter({b"the": 40, b"then": 7, b"there": 5, b"other": 9, b"banana": 3, b"bandana": 2,
                      "été".encode(): 4, b"a": 30, b"x": 1})
    trie, plain = build(counts), PlainTrie(counts)
    asked = [*counts, b"theory", b"bananas", b"zzz", b"qa", b"other.", "étés".encode()]
    got = trie.words(asked)
    assert got == pytest.approx([plain.word(w) for w in asked])


def test_probabilities_sum_to_one():
    counts = Counter({b"abc": 5, b"abd": 3, b"b": 2, b"cab": 1})
    plain = PlainTrie(counts)
    for context in (b" ", b" a", b" ab", b" ca", b" zz", b"bc"):
        total = sum(10 ** plain.log10(context, s) for s in range(256))
        assert total == pytest.approx(1)


def test_pruning_keeps_low_orders(spark):
    counts = Counter({f"w{i}".encode(): 1 + i % 3 for i in range(3000)})
    rows = [(k, int(c), int(n)) for k, codes, sums in ppm.tally(
        list(counts), np.array(list(counts.values()))) for c, n in zip(codes, sums, strict=True)]
    df = spark.createDataFrame(rows, "k int, code long, n long")
    assert pruned(df, len(rows)).count() == len(rows)
    kept = sorted(map(tuple, pruned(df, 500).select("k", "code", "n").collect()))
    assert len(kept) <= 500 and {r for r in rows if r[0] < 2} <= set(kept)
    parts = [(np.array([c for x, c, _ in kept if x == k], "int64"),
              np.array([n for x, _, n in kept if x == k], "int64")) for k in range(ppm.ORDER + 1)]
    assert np.isfinite(ppm.Trie(parts).words([b"w1", b"never"])).all()


def test_sentences():
    h, n, edge = sentence_hashes([b"a b. c d", b"", b"a b.", b"x " * 40])
    assert n.tolist() == [2, 2, 2, 16, 16, 8] and edge.tolist() == [0, 2, 2, 3, 6]
    assert h[0] == h[2] and h[3] == h[4] != h[5]


def test_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = base_of(docs)
    got = op4_ppm_scores(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        tokens, known, n, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.score <= 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA)
    got = ppm_scores(df).collect()
    assert len(got) == len(odd_rows())
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert all(math.isfinite(r.score) for r in got)
    assert ppm_scores(df.limit(0)).count() == 0
    one = spark.createDataFrame([(0, "some words")], "doc_id long, text string")
    assert ppm_scores(one).count() == 1


def test_rare_words_are_joined(spark, sf, monkeypatch):
    """The same scores whether words are held by tasks or joined."""
    from plantloom.llm import lm

    df = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: r for r in ppm_scores(df).collect()}
    monkeypatch.setattr(lm, "COMMON", 50)
    b = {r.doc_id: r for r in ppm_scores(df).collect()}
    for i, r in a.items():
        assert b[i].n_known == r.n_known
        assert b[i].base_score == pytest.approx(r.base_score)
        assert b[i].score == pytest.approx(r.score)


def plain_scores(docs):
    """Scores of (id, text) rows symbol by symbol: other texts' sentences, else running bytes."""
    def cut(text):
        out, now = [], []
        for w in words(text):
            now.append(w)
            if w[-1:] in (b".", b"!", b"?") or len(now) == 16:
                out.append(tuple(now))
                now = []
        return [*out, tuple(now)] if now else out

    parts_of = [1 + zlib.crc32(str(i).encode()) // 10 % 4 for i, _ in docs]
    tries = [PlainTrie({}) for _ in range(5)]
    learn = [zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in docs]
    for (_, t), on, part in zip(docs, learn, parts_of, strict=True):
        s = b" " + b"".join(w + b" " for w in words(t)) + b"\n"
        for i in range(1, len(s)) if on else ():
            for k in range(min(i, ppm.ORDER) + 1):
                for p in range(5):
                    if p != part:
                        tries[p].next[s[i - k: i]][s[i]] += 1
    seen = Counter(x for (_, t), on in zip(docs, learn, strict=True) if on for x in cut(t))
    out = []
    for (_, t), on, part in zip(docs, learn, parts_of, strict=True):
        trie = tries[part if on else 0]
        others = seen - Counter(cut(t)) if on else seen
        types = len(others)
        room = max(1, sum(others.values()) + types)
        s, at, score = b" ", 1, 0.0
        parts = [(x, b"".join(w + b" " for w in x)) for x in cut(t)] + [(None, b"\n")]
        for x, raw in parts:
            s += raw
            if others[x]:
                score += math.log10(others[x] / room)
            else:
                score += math.log10(max(1, types) / room) if x else 0
                score += sum(trie.log10(s[max(0, i - ppm.ORDER): i], s[i]) for i in range(at, len(s)))
            at = len(s)
        out.append(score)
    return out


RUNNING = ["one two three. four five six.", "one two three. seven eight", "four five six. nine",
           "a b. a b. c", None, "", "zq\0xv jjkw", "été là. one two three.", "b a. c d e f g",
           "three two one. six five four.", "one two four. five six seven", "eight nine. zero"] * 2


@pytest.mark.parametrize("places", [2_000_000, 5, 0])
def test_running_bytes_against_dictionaries(spark, monkeypatch, places):
    """Every text, whether trained on or not, wherever its places are looked up."""
    from plantloom.llm import lm

    monkeypatch.setattr(lm, "WINDOWS", places)
    docs = list(enumerate(RUNNING[:-1]))
    got = {r.doc_id: r.score for r in ppm_scores(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in docs] == pytest.approx(plain_scores(docs))


def test_training_noise_and_word_order_show(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids = [i for i in range(10**6, 10**6 + 99) if zlib.crc32(str(i).encode()) % 10]
    text = next(t for _, t in rows if t and len(t.split()) > 60).lower().replace(".", "").split()[:16]
    noise = " ".join("".join(chr(97 + (i * i * 7 + j * j * 13 + i * j) % 26) for j in range(len(w)))
                     for i, w in enumerate(text))
    more = [(ids[0], " ".join(text)), (ids[1], noise), (ids[2], " ".join(sorted(text)))]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm_scores(df).collect()}
    assert got[ids[1]] < got[ids[0]] and got[ids[2]] != pytest.approx(got[ids[0]], rel=1e-3)


def test_places_travel_packed():
    """A task hands on each place once, with its counts by part, in fewer bytes than its key has."""
    from plantloom.llm import lm

    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcde"), 5)) for _ in range(400)) for _ in range(60)]
    parts = rng.integers(0, 5, len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(parts.astype("int32"))], names=["t", "p"])
    rows = list(lm._place_counts(iter([batch, batch]), 7))
    got = {int(k): n.tolist() for r in rows for _, keys, counts in lm._tallies(r)
           for k, n in zip(keys, counts, strict=True)}
    want = defaultdict(lambda: [0] * 5)
    for text, p in zip(texts, parts, strict=True):
        _, key, _ = ppm.running([text.encode()])
        for k in key[key >= 0].tolist():
            want[k][p] += 2
    assert got == want
    assert sum(r.num_rows for r in rows) <= 7
    assert sum(len(x) for r in rows for c in ("keys", "counts") for x in r[c].to_pylist()) < 7 * len(want)


@pytest.mark.parametrize("sentences", [0, 2])
def test_sentences_and_places_are_joined(spark, monkeypatch, sentences):
    """The same scores if tasks hold few sentences and places and ask for the others in many slices."""
    from plantloom.llm import lm

    monkeypatch.setattr(lm, "SENTENCES", sentences)
    monkeypatch.setattr(lm, "WINDOWS", 30)
    monkeypatch.setattr(lm, "ASKED", 3)
    docs = list(enumerate(RUNNING[:-1]))
    got = {r.doc_id: r.score for r in ppm_scores(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in docs] == pytest.approx(plain_scores(docs))


@pytest.mark.parametrize("held, places", [(1 << 22, 1 << 23), (7, 50)])
def test_counts_are_sorted_hashes(monkeypatch, held, places):
    """One reading of a text gives its words and sentences, each once in a turn, whatever a turn holds."""
    from plantloom.llm import lm, shingles

    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "PLACES", places)
    calls, plain = [], shingles.word_hashes
    monkeypatch.setattr(shingles, "word_hashes", lambda *a: calls.append(1) or plain(*a))
    texts = ["a b a. c", None, "", "c c. \x0bA\tb a. d", "été \0x"]
    learn = [True, True, False, False, True]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(learn)], names=["t", "l"])
    rows = [r for b in lm._hash_counts(iter([batch, batch])) for r in b.to_pylist()]
    assert len(calls) == 2
    got, want = Counter(), Counter()
    for r in rows:
        got[r["sentence"], r["h"], "c"] += r["c"]
        got[r["sentence"], r["h"], "n"] += r["n"]
    for t, on in zip(texts, learn, strict=True):
        for w in words(t):
            h = int(plain(np.frombuffer(b" " + w + b" ", "uint8"))[1][0]) >> 1
            want[False, h, "n"] += 2
            want[False, h, "c"] += 2 * on
        found = Counter((sentence_hashes([b" ".join(words(t))])[0] >> np.uint64(1)).tolist())
        for h, n in found.items():
            want[True, h, "n"] += 2
            want[True, h, "c"] += 2 * on * n
    assert +got == +want
    if held > 7:
        assert len(rows) == len({(r["sentence"], r["h"]) for r in rows})
    parts = pa.array(np.arange(5, dtype="int32"))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), parts], names=["t", "p"])
    got = Counter()
    for r in lm._place_counts(iter([batch, batch]), 3):
        for _, keys, counts in lm._tallies(r):
            for k, n in zip(keys.tolist(), counts, strict=True):
                got.update({(k, p): int(x) for p, x in enumerate(n)})
    want = Counter()
    for p, t in enumerate(texts):
        key = ppm.running([(t or "").encode().lower()])[1]
        want.update({(k, p): 2 * n for k, n in Counter(key[key >= 0].tolist()).items()})
    assert +got == +want


def test_packed_numbers_take_the_least_room():
    from plantloom.llm.lm import packed, unpacked

    rng = np.random.default_rng(5)
    for most, item in ((200, 1), (60_000, 2), (1 << 31, 4), (1 << 60, 8)):
        x = rng.integers(0, most, 999)
        x[0] = most - 1
        assert packed(x)[0] == item
        assert (unpacked(packed(x), 999) == x).all()
        assert (unpacked(packed(x.reshape(333, 3)), 333, 3) == x.reshape(333, 3)).all()
    assert (unpacked(packed(-x), 999) == -x).all()
    assert (unpacked(packed(x / 7), 999, kind="float64") == x / 7).all()
    assert len(unpacked(packed(x[:0]), 0)) == 0


def test_found_places_of_held_keys():
    rng = np.random.default_rng(6)
    keys = rng.permutation(np.unique(rng.integers(0, 1 << 60, 5000)))
    asked = np.concatenate([keys, [-1, -1], rng.integers(0, 1 << 60, 500), keys[::-1]])
    at = {int(k): i for i, k in enumerate(keys)}
    assert ppm.Held(keys).find(asked).tolist() == [at.get(int(k), -1) for k in asked]
    assert ppm.Held(keys[:0]).find(asked[:9]).tolist() == [-1] * 9
