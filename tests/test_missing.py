"""NULL, NaN and ±infinity in every operator that counts, ranks, checks or correlates."""

import math

import pytest

from plantloom.functions.names import PhysicalRules  # noqa: F401
from plantloom.operators import clean, prune, scale, split, stats, validate
from plantloom.operators.encode import one_hot

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def dirty(spark):
    x = [1.0, 2.0, NAN, 4.0, None, 6.0, NAN, 8.0]
    y = [2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, INF]
    rows = [(i, a, b, b, 3.0 * i % 5) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, pulp_ph double, y double, copy double, z double")


def test_describe_and_profile_skip_nan(dirty):
    got = {r["column"]: r for r in stats.describe(dirty, ["pulp_ph"]).collect()}
    assert (got["pulp_ph"]["n"], got["pulp_ph"]["p50"], got["pulp_ph"]["max"]) == (5, 4.0, 8.0)
    rows = stats.column_profile(dirty, ["pulp_ph"]).collect()
    assert len(rows) == 1


def test_quantile_users_do_not_stop(dirty):
    assert scale.fit_robust(dirty, ["pulp_ph"]).apply(dirty).count() == 8
    assert clean.mask_outliers(dirty, ["pulp_ph"], "iqr").count() == 8
    filled = clean.clean(dirty.select("id", "pulp_ph"), "median", ["id"], columns=["pulp_ph"])
    assert sorted(r.pulp_ph for r in filled.collect()) == [1, 2, 4, 4, 4, 4, 6, 8]


def test_nan_is_not_out_of_range(dirty):
    assert validate.validate_rows(dirty.select("id", "pulp_ph"), skip=["id"]).count() == 8


@pytest.mark.parametrize("extra", [[], ["z", "pulp_ph"]])
def test_copy_of_the_target_is_found_whatever_the_width(dirty, extra):
    kept, gone = prune.prune_features(dirty, ["copy", *extra], "y")
    assert "copy" in gone and "copy" not in kept
    assert prune.leakage_report(dirty, ["copy"], "y").first().leak


def test_one_correlation_for_all_widths(spark):
    rows = [(1e9 + i, 1e9 + (i * 7 % 11), float(i), float(i % 3), 5.0) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")

    def pairs(*names):
        return {(r.a, r.b): r.r for r in stats.correlations(df, list(names)).collect()}

    wide = pairs("a", "b", "c", "d", "e")
    for p in (("a", "b"), ("a", "c"), ("b", "d"), ("a", "e")):
        assert pairs(*p)[p] == (pytest.approx(wide[p], abs=1e-12) if wide[p] is not None else None)
    assert wide["a", "c"] == pytest.approx(1) and wide["a", "e"] is None
    across = {(r.a, r.b): r.r for r in stats.correlations(df, ["a", "b"], ["c"]).collect()}
    assert across == {p: pytest.approx(wide[p]) for p in (("a", "c"), ("b", "c"))}


def test_null_groups_are_in_a_side_and_a_fold(spark):
    rows = [(i, None if i % 4 == 0 else f"g{i % 4}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g string")
    assert split.group_folds(df, "g").filter("fold IS NULL").count() == 0
    assert split.unit_split(df, "g").filter("is_train IS NULL").count() == 0
    got = split.stratified_split(df, "g", 0.2, keys=["id"])
    assert got.filter("is_train IS NULL").count() == 0
    assert got.filter("is_train AND g IS NULL").count() == 8


def test_one_hot_has_no_limit_of_its_own(spark):
    df = spark.range(1200).selectExpr("id", "concat('v', id) AS c")
    assert len(one_hot(df, ["c"]).columns) == 1 + 1199
    with pytest.raises(ValueError):
        one_hot(df, ["c"], max_levels=1000)
