import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plantloom.llm import phrases
from plantloom.llm.hattrie import COUNT, KEY, HatTrie, first_of_equal
from plantloom.llm.phrases import collocations

from .brute import ODD_SCHEMA, odd_rows

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "text string, lang string"


def plain(rows, least, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(
                    tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i: i + k]] = max(inside[p[i: i + k]], a)
        found = []
        for p, a in cand.items():
            if inside[p] >= a:
                continue
            score, _, left, right = min(
                (1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]],
                 counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df, **args):
    return sorted(map(tuple, collocations(df, **args).collect()))


def test_random_texts(spark):
    rnd = random.Random(3)
    words = ["a", "B", "çé", "d'e", "\x00f", "G-h", "日本"]
    rows = [("".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";"])
                     for _ in range(rnd.randrange(60))), rnd.choice(["x", "y", None, "und"]))
            for _ in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for least in (2, 9):
        want = plain(rows, least)
        assert len(want) > 20 and got(df, least=least) == want
    assert got(df, least=4, longest=3, top=7) == plain(rows, 4, 3, 7)
    assert got(df, least=10 ** 6) == [] == got(df, least=3, longest=1)


def test_ties_and_absorbed_phrases(spark):
    rows = [("one two three. one two three. two three four", "x"), ("b a. a b", "x"),
            ("one two three", None)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, least=3) == plain(rows, 3)
    found = {r[2] for r in got(df, least=3) if r[0] == "x"}
    assert "one two three" in found and "one two" not in found and "two three" in found


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA).selectExpr("*", "size AS key", "node AS n")
    rows = [(r[1], r[2]) for r in odd_rows()]
    assert got(df, least=2) == plain(rows, 2) and got(df.limit(0)) == []


def test_long_text_goes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 200)
    text = "the cat sat. on the mat, the cat! " * 200 + "word " * 500 + "the cat sat" * 30
    raw = [b"".join(x for x, _ in part) for part in phrases._segments(
        [type("S", (), {"as_py": lambda self: text})()], ["x"])]
    assert b"".join(raw).decode() == text and len(raw) > 20
    long = "alpha beta gamma, " * 300_000
    df = spark.createDataFrame([(long, "x"), ("alpha beta", "x")], SCHEMA)
    assert [r[2:5] for r in got(df)] == [
        ("alpha beta", 300_001, 300_001), ("alpha beta gamma", 300_000, 300_001)]


def test_bitmap_full_of_false_marks_changes_nothing(spark, monkeypatch):
    rows = [("a b c d e f. a b c", "x"), ("b c d. x y", "y")] * 4
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(phrases, "_bitmap", lambda spark, frequent: b"\xff" * ((1 << 26) // 8))
    assert got(df, least=4) == plain(rows, 4)


def test_trie_bursts_and_spills_all_it_counts():
    rng = np.random.default_rng(5)
    trie, total, runs = HatTrie(hold=500, burst=40), Counter(), []
    for _ in range(30):
        first, second, last = rng.zipf(1.4, (3, 400)).clip(max=60).astype("int64")
        key = (first * 100 + second) * 100 + last
        total.update(key.tolist())
        trie.add([first, second], first * 100 + second, second * 100 + last, key)
        runs += trie.spilled()
        assert trie.size <= 500
    runs += trie.spilled(rest=True)
    assert trie.size == 0 and len(runs) > 5 and isinstance(trie.root, dict)
    seen = Counter()
    for run in runs:
        keys = run[:, KEY].tolist()
        assert keys == sorted(keys) and len(set(keys)) == len(keys)
        for row in run.tolist():
            seen[row[KEY]] += row[COUNT]
            assert row[KEY] == row[2] * 100 + row[3] % 100
    assert seen == total


def test_texts_are_read_twice_whatever_the_length_of_phrases(spark):
    rows = [("a b c d e f. a b c d e", "x")] * 30
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.udf(read, "string")("text"))
    assert got(df, least=20) == plain(rows, 20)
    assert seen.value == 2 * len(rows)


def test_words_are_summed_over_runs_of_any_size(monkeypatch):
    rnd = random.Random(4)
    rows = [(" ".join(rnd.choice("abcdefghijklmnop") * rnd.randrange(1, 3) for _ in range(40)),
             rnd.choice(["x", "und", None])) for _ in range(60)] + [("", "y"), (None, None), (" .", "z")]
    want = Counter((lang or "und", w) for text, lang in rows for w in (text or "").replace(".", "").split())
    batches = [pa.RecordBatch.from_pylist([dict(text=t, lang=x) for t, x in rows[i: i + 20]],
                                          pa.schema([("text", pa.string()), ("lang", pa.string())]))
               for i in range(0, len(rows), 20)]
    monkeypatch.setattr(phrases, "CHUNK", 300)
    for held in (1, 50, 10 ** 6):
        monkeypatch.setattr(phrases, "WORDS_HELD", held)
        runs = pa.Table.from_batches(list(phrases._word_runs(iter(batches))))
        part = np.array(runs["part"])
        found, sums = [], Counter()
        for i in np.unique(part):
            for r in phrases._merged_words(runs.filter(pa.array(part == i)), 40).to_pylist():
                if r["w"] is None:
                    sums[r["lang"]] += r["n"]
                else:
                    found.append((r["lang"], r["w"], r["n"]))
        assert sorted(found) == sorted((*k, n) for k, n in want.items() if n >= 40) and len(found) > 9
        assert sums == {x: sum(n for (y, _), n in want.items() if x == y) for x in ("x", "und")}


def test_hashes_alike_in_their_high_bits_are_told_apart():
    keys = np.array([5, 2, 5, 1 << 63, 2, 1 << 63, 3], "uint64")
    order, first = first_of_equal(keys)
    assert order.tolist() == [1, 4, 6, 0, 2, 3, 5] and first.tolist() == [0, 2, 3, 5]
