import math
from collections import defaultdict

import numpy as np
import pytest

from plantloom.llm import vectors
from plantloom.llm.graph import nearest, op6_robust_graph
from plantloom.llm.topk import exact_topk, op5_ball_tree_topk

SCHEMA = "vec_id long, embedding array<float>, rank int, shard string"


def usable(v, zero):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and (
        zero or any(v))


def plain(rows, key, zero, k=10):
    rows = [(i, v) for i, v in rows if i is not None and usable(v, zero)]
    out = {}
    for i in sorted({i for i, _ in rows if i % 100 == 0}):
        v = min(v for j, v in rows if j == i)
        found = sorted((key(v, w), j) for j, w in rows if j != i and len(w) == len(v))
        out[i] = found[:k]
    return out


def dot(v, w):
    return -sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(v, w, strict=True))


def gap(v, w):
    return math.dist(v, w)


def ranked(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.score, r.vec_id))
    return out


@pytest.fixture(scope="module")
def table(spark, sf):
    return [(r.vec_id, r.embedding) for r in
            spark.read.parquet(f"{sf}/embeddings.parquet").collect()]


def test_exact_documents(spark, sf, table):
    want = plain(table, dot, True)
    got = ranked(op5_ball_tree_topk(spark, sf))
    assert {q: [(-s, i) for s, i in v] for q, v in got.items()} == want


def test_graph_documents(spark, sf, table):
    want = plain(table, gap, False)
    got = ranked(op6_robust_graph(spark, sf))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vec = dict(table)
    for q, found in got.items():
        assert all(s == pytest.approx(math.dist(vec[q], vec[i]), abs=1e-12) for s, i in found)
        assert found == sorted(found)


def odd():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(150)]
    rows += [(i, [1.0, 1.0, 0.0, 0.0]) for i in range(200, 260)]
    rows += [(100, rows[100][1]), (300, None), (301, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4),
             (400, [math.nan, 0.0, 0.0, 0.0]), (500, [math.inf, 0.0, 0.0, 0.0]),
             (600, [0.0] * 4), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (800, [])]
    return rows


@pytest.mark.parametrize("shard_rows", [8192, 20])
def test_odd_rows(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vectors, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vectors, "LANE_SHARDS", 3)
    rows = odd()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = ranked(exact_topk(df))
    assert {q: [(-s, i) for s, i in v] for q, v in got.items()} == plain(rows, dot, True)
    got, want = ranked(nearest(df)), plain(rows, gap, False)
    assert set(got) == set(want)
    hits = sum(len({round(s, 9) for s, _ in got[q]} & {round(s, 9) for s, _ in want[q]}) > 0
               for q in want)
    assert hits == len(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert exact_topk(df.limit(0)).count() == 0 and nearest(df.limit(0)).count() == 0
