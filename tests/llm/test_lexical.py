import math
import random
import re
from collections import Counter

import numpy as np

from plantloom.llm import lexical
from plantloom.llm.lexical import impacts, lexical_search
from plantloom.llm.rmq import Postings

from .brute import ODD_SCHEMA, odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=10):
    """(item, rank, doc, score) by the formula, over all pairs."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total, count = sum(c.total() for _, c in held), len(held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 90 + 90 * c.total() * count // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s)
                for rank, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(docs, items, **args):
    return sorted(map(tuple, lexical_search(docs, items, **args).collect()), key=str)


def texts(rnd, n, words, most=40):
    return [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))],
                                 k=rnd.randrange(most))) for _ in range(n)]


def test_random_texts_over_many_shards(spark, monkeypatch):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(80)] + ["é", "Z9", "a-b", "日本"]
    docs = list(enumerate(texts(rnd, 700, words) + ["w1 w2 w3"] * 60 + ["w70 w71"] * 3))
    docs += [(None, "w5 w70 w80"), (3, "w5 w70 w80"), (3, "w5 w70 w80"), (9999, None)]
    items = list(enumerate(texts(rnd, 25, words, 12))) + [(900, "w1 w2 w3"), (901, "none such")]
    df, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = plain(docs, items)
    assert got(df, asked) == want
    monkeypatch.setattr(lexical, "POSTINGS", 900)
    monkeypatch.setattr(lexical, "TERMS", 40)
    assert got(df.repartition(7), asked) == want
    assert got(df, asked, k=3) == plain(docs, items, 3)


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA).selectExpr("*", "size AS n", "node AS rank")
    docs = [(r[0], r[1]) for r in odd_rows()]
    items = [(1, "plain words WORD5 no"), (2, ""), (3, None), (None, "âge 1234")]
    asked = spark.createDataFrame([(*x, 1) for x in items], ITEMS + ", score int")
    assert got(df, asked) == plain(docs, items)
    assert got(df.limit(0), asked) == [] == got(df, asked.limit(0))
    twice = asked.unionByName(spark.createDataFrame([(1, "zzz", 2)], asked.schema))
    assert got(df, twice) == plain(docs, items)


def test_long_text_is_split_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 64)
    text = "alpha beta-gamma " * 500 + "x" * 300 + " omega"
    assert [t.decode() for part in lexical._terms(text) for t in part] == terms(text)
    docs, items = [(1, text), (2, "alpha omega")], [(1, "omega"), (2, "x" * 300 + " beta")]
    assert got(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)) == plain(
        docs, items)


def test_intervals_against_all_documents():
    rng = np.random.default_rng(2)
    for docs in (1, 2, 50, 3000):
        held = rng.random((docs, 12)) < rng.random(12) ** 2
        doc, term = np.nonzero(held)
        impact = rng.integers(1, 9 if docs == 50 else 10 ** 6, len(doc))
        rank = rng.permutation(docs)
        index = Postings(term, doc, impact, rank, 12)
        for own in (np.arange(12), np.array([3]), np.array([0, 7, 11])):
            total = np.zeros(docs, "int64")
            use = np.isin(term, own)
            np.add.at(total, doc[use], impact[use])
            best = np.lexsort((rank, -total))
            best = best[total[best] > 0][:10]
            at, scores = index.search(own, 10)
            at, scores = at[scores > 0], scores[scores > 0]
            assert at.tolist() == best.tolist() and scores.tolist() == total[best].tolist()


def test_equal_documents_are_not_all_looked_at():
    docs, looked = 20_000, []
    index = Postings(np.repeat([0, 1], docs), np.tile(np.arange(docs), 2),
                     np.full(2 * docs, 5), np.arange(docs), 2)
    plain_bound = index._bounded
    index._bounded = lambda lo, *x: looked.append(len(lo)) or plain_bound(lo, *x)
    at, scores = index.search(np.array([0, 1]), 10)
    assert at.tolist() == list(range(10)) and set(scores) == {10} and sum(looked) < 200


def test_lengths_past_64_bits():
    n, tf, w = np.array([10 ** 9, 3]), np.array([7, 1]), np.array([900, 800])
    got = impacts(w, tf, n, 10 ** 12, 5 * 10 ** 14)
    assert got.tolist() == [
        int(w[i]) * (10 ** 9 * int(tf[i]) // (1000 * int(tf[i]) + 8 * (
            10 + 90 * int(n[i]) * 10 ** 12 // (5 * 10 ** 14)))) for i in range(2)]
