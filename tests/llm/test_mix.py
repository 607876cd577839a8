import random
from collections import Counter, defaultdict

import pytest

from plantloom.llm.flow import Network
from plantloom.llm.mix import mix_sources, op2_mix_sources, targets

from .brute import ODD_SCHEMA, WORD, odd_rows


def plain_min_cost(n, arcs, s, t):
    """Shortest augmenting paths by Bellman-Ford, one unit at a time."""
    room = [list(a) for a in arcs]
    flow = cost = 0
    used = [0] * len(arcs)
    while True:
        far, via = [10**9] * n, [None] * n
        far[s] = 0
        for _ in range(n):
            for i, (a, b, r, c) in enumerate(room):
                if used[i] < r and far[a] + c < far[b]:
                    far[b], via[b] = far[a] + c, (i, 1)
                if used[i] and far[b] - c < far[a]:
                    far[a], via[a] = far[b] - c, (i, -1)
        if far[t] >= 10**9:
            return flow, cost
        x = t
        while x != s:
            i, d = via[x]
            used[i] += d
            cost += d * room[i][3]
            x = room[i][0] if d > 0 else room[i][1]
        flow += 1


@pytest.mark.parametrize("seed", range(12))
def test_network(seed):
    r = random.Random(seed)
    n = 7
    arcs = [(a, b, r.randint(1, 5), r.randint(0, 4)) for a in range(n) for b in range(n)
            if a != b and r.random() < 0.45]
    net = Network(n)
    ids = [net.arc(*a) for a in arcs]
    sent = net.solve(0, n - 1)
    cost = sum(net.flow(e) * a[3] for e, a in zip(ids, arcs, strict=True))
    assert (sent, cost) == plain_min_cost(n, arcs, 0, n - 1)


def test_targets():
    assert targets([10, 10, 10]) == [pytest.approx(18.75), pytest.approx(7.5), pytest.approx(3.75)]
    got = targets([1, 100, 100, 2])
    assert got[0] == 3 and got[3] == 6 and sum(got) == pytest.approx(203)
    assert targets([]) == [] and targets([0, 0]) == [0, 0]


def check(rows, got):
    text = {r[0]: r[1] for r in rows}
    size = {i: len(WORD.findall(t or "")) for i, t in text.items()}
    taken, goal, largest = Counter(), {}, Counter()
    for r in got:
        assert r._size == size[r.doc_id] and 0 <= r._repeats <= 3
        taken[r.source] += r._size * r._repeats
        goal[r.source] = r._target
        largest[r.source] = max(largest[r.source], r._size)
    for s, g in goal.items():
        assert abs(taken[s] - g) <= largest[s]


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = mix_sources(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], a)
    b = mix_sources(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r._repeats) for r in a) == Counter((r.doc_id, r._repeats) for r in b)
    got = op2_mix_sources(spark, sf).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter(
        (r.doc_id, r._repeats * r._size) for r in a)


def test_shared_texts_are_not_repeated_first(spark):
    """With unused single-source texts at hand, a text in both sources is not shown twice."""
    rows = [(i, f"own a {i} x", "a") for i in range(40)] + [(100 + i, f"own b {i} x", "b")
            for i in range(400)] + [(1000 + i, f"both {i} y z", "a") for i in range(40)] + [
            (2000 + i, f"both {i} y z", "b") for i in range(40)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    seen = defaultdict(int)
    for r in got:
        if r.text.startswith("both"):
            seen[r.text] += r._repeats
    own = [r._repeats for r in got if r.text.startswith("own a")]
    assert min(own) >= 1
    assert sum(seen.values()) / 40 <= 1 + max(own)


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA)
    got = mix_sources(df).collect()
    assert len(got) == len(odd_rows()) and all(r._repeats == 0 for r in got if not r._size)
    assert {r._source_size for r in got if r.source is None} == {4}
    assert mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 2, 4096])
def test_rare_patterns_are_routed_with_their_shared_words(spark, most):
    """However few patterns are kept, targets are met and shared texts are not shown more often."""
    r, rows = random.Random(9), []
    for i in range(400):
        text = " ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(1, 9))) + f" t{i}"
        for s in r.sample("abcdef", r.choice([1, 1, 2, 3])):
            rows.append((len(rows), text, s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df, max_patterns=most).collect()
    check([(i, t) for i, t, _ in rows], got)
    assert len(got) == len(rows)
    shown = Counter()
    for x in got:
        shown[x.text] += x._repeats
    assert max(shown.values()) <= 9
