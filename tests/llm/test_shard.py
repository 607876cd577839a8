import zlib
from collections import Counter, defaultdict

import pytest

from plantloom.llm.cuts import weighted_cuts
from plantloom.llm.shard import kd_shards, op1_kd_shards

from .brute import ODD_SCHEMA, odd_rows


def test_documents(spark, sf):
    got = op1_kd_shards(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    weight, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[raw].add(r.shard)
    assert set(weight) == set(range(16))
    assert max(weight.values()) - min(weight.values()) <= 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hot_group_is_divided(spark):
    rows = [(i, "same text" if i % 3 else f"text {i} x", "s", 9) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    sizes = Counter()
    for r in kd_shards(df, ["n_chars", "source"], shards=5).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 5 and max(sizes.values()) < 1.02 * min(sizes.values())


def test_small_groups_stay_together(spark):
    rows = [(i, f"copy {i % 500} of a text", f"s{i % 7}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    homes = defaultdict(set)
    got = kd_shards(df, ["n_chars", "source"], shards=4, slack=0.02)
    for r in got.join(df, "doc_id").collect():
        homes[r.text].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_odd_rows_and_targets(spark):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA)
    got = kd_shards(df, ["n_chars", "lang"], shards=3).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows())
    assert kd_shards(df.limit(0), ["n_chars"], shards=4).count() == 0
    assert kd_shards(df, [], target_bytes=1 << 30).select("shard").distinct().count() == 1


@pytest.mark.parametrize("slack", [0, 50])
def test_weighted_cuts_against_sorting(spark, slack):
    rows = [(i % 3, (i * 7919) % 97 << 40 | i % 5, 1 + i % 11) for i in range(2000)]
    needs = [1234, None, 3000]
    cuts = weighted_cuts(spark.createDataFrame(rows, "node int, key long, weight long"), needs, slack)
    for n in (0, 2):
        left = sum(w for a, k, w in rows if a == n and k <= cuts[n])
        heaviest = max(Counter({k: sum(w for a, x, w in rows if a == n and x == k)
                                for _, k, _ in rows}).values())
        assert abs(left - needs[n]) <= max(heaviest, slack)
    assert cuts[1] == (1 << 60) - 1


def test_text_dimension_counts_by_its_whole_value(spark):
    """Values that share a long head are as far apart as their places among the distinct ones."""
    rows = [(i, f"text {i}", f"https://example.com/common/{i % 40:03d}", 5) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = kd_shards(df, ["source", "n_chars"], shards=4).join(df, "doc_id").collect()
    spans = {s: sorted({r.source for r in got if r.shard == s}) for s in range(4)}
    for a, b in zip(range(3), range(1, 4), strict=True):
        assert spans[a][-1] <= spans[b][0]  # a cut may fall into one value
    assert all(len(v) in (10, 11, 12) for v in spans.values())
