"""Cuts by position: any number and type of keys, ties, and the same rows on either path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantloom.operators import order, position, split

KEYS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [(i % 3, f"s{i % 7:02d}", None if i % 11 == 0 else dt.datetime(2024, 1, 1 + i % 5), i)
            for i in range(3000)]
    return spark.createDataFrame(rows, "a int, b string, c timestamp, id long").cache()


def plain(keyed, n):
    rows = sorted(keyed.collect(), key=lambda r: (r.a, r.b, r.c is not None, r.c or 0, r.id))
    return [r.id for r in rows[len(rows) - n:]]


@pytest.mark.parametrize("n", [1, 10, 999, 2999])
@pytest.mark.parametrize("top", [0, 10_000])
@pytest.mark.parametrize("sorted_rows", [50, 200_000])
def test_last_rows_of_four_keys(keyed, monkeypatch, n, top, sorted_rows):
    monkeypatch.setattr(position, "TOP_ROWS", top)
    monkeypatch.setattr(position, "SORTED_ROWS", sorted_rows)
    got = position.last_rows(keyed, n, [*KEYS, "id"])
    assert sorted(r.id for r in got.collect()) == sorted(plain(keyed, n))


@pytest.mark.parametrize("sorted_rows", [50, 200_000])
def test_ties_are_cut_at_the_exact_count(keyed, monkeypatch, sorted_rows):
    monkeypatch.setattr(position, "SORTED_ROWS", sorted_rows)
    for order_by in (["a"], KEYS):
        both = []
        for top in (0, 10_000):
            monkeypatch.setattr(position, "TOP_ROWS", top)
            both.append(sorted(r.id for r in position.last_rows(keyed, 777, order_by).collect()))
        assert both[0] == both[1] and len(both[0]) == 777
    flags = split.chronological_split(keyed, ["a"])
    assert flags.filter("is_train").count() == 2400


def test_equal_rows_cannot_be_cut(spark):
    df = spark.range(10).selectExpr("1 AS a", "2 AS b")
    with pytest.raises(ValueError, match="equal rows"):
        split.chronological_split(df, ["a", "b"])


def test_cells_follow_the_whole_key(keyed, monkeypatch):
    monkeypatch.setattr(order, "TARGET_ROWS", 100)
    for keys, series in (([*KEYS, "id"], ()), (["b", "c", "id"], ("a",)), (["id"], ("a", "b"))):
        layout = order.plan_layout(keyed, keys, series)
        assert layout.is_cut
        got = order.with_ordinal(keyed, keys, series, "o", layout=layout).collect()
        groups = {}
        for r in sorted(got, key=lambda r: tuple(
                (r[k] is not None, r[k] if r[k] is not None else 0) for k in keys)):
            groups.setdefault(tuple(r[s] for s in series), []).append(r.o)
        assert all(o == list(range(len(o))) for o in groups.values())


def test_long_keys_above_doubles(spark):
    df = spark.range(1000).selectExpr("id + 9007199254740992 AS k")
    cut = position.cuts_at(df, ["k"], [501])[0]
    assert df.filter(cut.before()).count() == 501


@pytest.mark.parametrize("top", [10, 1000])
def test_equal_rows_at_the_border_on_both_sides_of_the_switch(spark, monkeypatch, top):
    monkeypatch.setattr(position, "TOP_ROWS", top)
    df = spark.createDataFrame([(1, "a")] * 30 + [(2, "b")] * 30 + [(3, "c")] * 5, "t int, v string")
    for n in (3, 5, 20, 35, 36, 50, 65, 80):
        got = [r.v for r in position.last_rows(df, n, ["t"]).collect()]
        assert got == (["a"] * 30 + ["b"] * 30 + ["c"] * 5)[-n:]


def test_cuts_share_their_passes(spark, monkeypatch):
    """Three positions cost about as many jobs as one."""
    monkeypatch.setattr(position, "SORTED_ROWS", 2000)
    df = spark.range(20_000).select("id", (20_000 - F.col("id")).alias("k"))
    sc = spark.sparkContext

    def jobs(positions):
        group = f"cuts-{len(positions)}"
        sc.setJobGroup(group, group)
        cuts = position.cuts_at(df, ["k"], positions)
        sc.setJobGroup("rest", "rest")
        assert [df.filter(c.before()).count() for c in cuts] == positions
        return len(sc.statusTracker().getJobIdsForGroup(group))

    assert jobs([2000, 10_000, 17_000]) <= jobs([10_000]) + 3
