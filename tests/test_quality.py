import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from plantloom.functions.names import PhysicalRules, col
from plantloom.functions.scalars import class_band, confidence
from plantloom.operators import clean, metrics, prune, quantiles, stats, timeseries, validate

INF = float("inf")
PB, GRADE, SUMP, AIR = "line2.tails_pb", "bank.grade", "sump.7.nivel", "blower_airflow"


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [
        (0, 11.0, 20.0, 30.0, 900.0), (1, -0.5, 21.0, 31.0, 901.0), (2, 12.0, 100.5, 32.0, 902.0),
        (3, None, 22.0, None, 903.0), (4, 13.0, 23.0, 1500.5, 904.0), (5, 14.0, 24.0, 33.0, -1.0),
        (6, 15.0, 25.0, -500.0, 0.0), (7, 250.0, -3.0, -501.0, INF), (8, 0.0, 100.0, 1500.0, 905.0),
        (9, 16.0, 26.0, 34.0, 50_000.0), (10, 17.0, None, 35.0, 906.0), (11, 18.0, 27.0, 36.0, 907.0),
    ]
    return spark.createDataFrame(
        rows, f"t int, `{PB}` double, `{GRADE}` double, `{SUMP}` double, `{AIR}` double")


def test_validate_rows(dirty):
    seen = Observation("v")
    kept = validate.validate_rows(dirty, skip=["t"], observation=seen)
    assert sorted(r["t"] for r in kept.collect()) == [0, 3, 6, 8, 9, 10, 11]
    assert seen.get["rows_in"] == 12 and seen.get["rows_out"] == 7
    s = validate.validation_stats(dirty, skip=["t"]).first()
    assert s["invalid_by_column"] == {PB: 2, GRADE: 2, SUMP: 2, AIR: 2}
    assert (s["reject_pct"], s["severity"]) == (pytest.approx(500 / 12, abs=0.01), "high")
    assert s["categories"][PB] == "PERCENTAGE"


def test_validate_small_frame_and_dates(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (TIMESTAMP '2024-05-01', 12.5D, 9.1D, 70D), (TIMESTAMP '2024-05-02', NULL, 8.8D, 71D),
      (TIMESTAMP '2024-05-03', 13.0D, 14.5D, 72D), (TIMESTAMP '2024-05-04', 101D, 9.0D, -2D),
      (TIMESTAMP '2024-05-05', 14.0D, 9.2D, 0D), (NULL, 15D, 9.3D, 73D) AS t(ts, tails_pb, cell_ph, amina_dose)""")
    kept = validate.validate_rows(df, "ts")
    assert sorted(r["ts"].day for r in kept.collect()) == [1, 2, 5]
    assert validate.validation_stats(df, "ts").first()["rows_without_timestamp"] == 1


def test_strict_and_unknown(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "xyz double, ore_ph double")
    with pytest.raises(ValueError):
        validate.validate_rows(df, strict=True)
    assert validate.validate_rows(df, drop_unknown=True).columns == ["ore_ph"]
    ruled = PhysicalRules().with_rule("xyz", 5, 6)
    assert validate.validate_rows(df, rules=ruled).count() == 0


def test_summary_lists_only_problems(dirty):
    rows = validate.invalid_summary(dirty, skip=["t"]).collect()
    assert len(rows) == 4 and all(r["n_invalid"] > 0 or r["pct_null"] > 10 for r in rows)


@pytest.mark.parametrize(
    ("strategy", "a", "b"),
    [
        ("ffill", [3, 3, 3, 9, 9, 12, 12], [7, 7, 5, 5, 5, 5, 1]),
        ("bfill", [3, 9, 9, 9, 12, 12, 0], [7, 5, 5, 1, 1, 1, 1]),
        ("interpolate", [3, 5, 7, 9, 10.5, 12, 12], [7, 6, 5, 4, 3, 2, 1]),
        ("mean", [3, 8, 8, 9, 8, 12, 8], [7, 13 / 3, 5, 13 / 3, 13 / 3, 13 / 3, 1]),
        ("median", [3, 9, 9, 9, 9, 12, 9], [7, 5, 5, 5, 5, 5, 1]),
    ],
)
@pytest.mark.parametrize("target_rows", [2, 100])
def test_clean(spark, strategy, a, b, target_rows):
    df = spark.createDataFrame(
        list(zip(range(7), [3.0, None, INF, 9.0, None, 12.0, -INF],
                 [7.0, None, 5.0, None, INF, None, 1.0], "abcdefg")),
        "t int, p double, q double, text string")
    sizing = {"target_rows": target_rows} if strategy in ("ffill", "bfill", "interpolate") else {}
    out = clean.clean(df, strategy, ["t"], **sizing).orderBy("t").collect()
    assert [r["p"] for r in out] == pytest.approx(a)
    assert [r["q"] for r in out] == pytest.approx(b)
    assert "".join(r["text"] for r in out) == "abcdefg"
    if strategy == "ffill":
        s = clean.cleaning_stats(df, strategy, ["t"]).first()
        assert (s["rows"], s["inf_replaced"], s["nulls_imputed"]) == (7, 3, 8)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        clean.clean(spark.range(3).toDF("t"), "magic", ["t"])


def test_constant_column_correlations(spark):
    df = spark.createDataFrame([(float(i), 7.0, float(-i)) for i in range(9)], "a double, b double, c double")
    for names in (["a", "b", "c"], ["a", "b", "c", "d"]):
        src = df.withColumn("d", F.col("a") * 2)
        got = {(r["a"], r["b"]): r["r"] for r in stats.correlations(src, names).collect()}
        assert got["a", "b"] is None and got["a", "c"] == pytest.approx(-1)
    assert prune.constant_columns(df, ["a", "b"]) == ["b"]
    assert prune.collinear_columns(df, ["a", "b", "c"], 0.98) == ["a"]
    assert prune.redundant_columns(df, ["a", "b", "c"]) == ["c"]


def test_leak(spark):
    df = spark.range(200).select(
        F.rand(1).alias("temp_a"), F.rand(2).alias("yq")).withColumn("leak_copy", F.col("yq"))
    kept, gone = prune.drop_leakage(df, ["temp_a", "leak_copy"], "yq")
    assert gone == ["leak_copy"] and "leak_copy" not in kept.columns
    with pytest.raises(ValueError):
        prune.drop_leakage(df, ["leak_copy"], "yq", strict=True)


def test_undefined_metrics_are_null(spark):
    flat = spark.createDataFrame([(7.0, 7.0)] * 50, "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] is None
    zero = spark.createDataFrame([(0.0, 1.0)] * 5, "y double, p double")
    assert metrics.regression_metrics(zero, "y", "p").first()["mape"] is None


@pytest.mark.parametrize(
    ("values", "word"),
    [
        (["a", "b", "c", "d"] * 5, "numeric"),
        (["1", "2", "3", "4"], "needed"),
        (["1"] * 12 + ["inf"], "infinite"),
        (["3"] * 20, "constant"),
    ],
)
def test_target_guards(spark, values, word):
    df = spark.createDataFrame([(v,) for v in values], "y string")
    if word != "numeric":
        df = df.select(F.col("y").cast("double"))
    with pytest.raises(ValueError, match=word):
        validate.check_target(df, "y")
    with pytest.raises(ValueError, match="not found"):
        validate.check_target(df, "nope")


def test_confidence_and_bands(spark):
    df = spark.createDataFrame(
        [(0.0, 85.0), (1.0, 85.0), (50.0, 85.0), (1.0, 0.0)], "s double, p double")
    got = [r[0] for r in df.select(confidence(F.col("s"), F.col("p"))).collect()]
    assert got == pytest.approx([85.0, 100 * math.exp(-3 / 85), 100 * math.exp(-150 / 85), 50.0])
    k = spark.createDataFrame([(v,) for v in (68, 69, 70, 137, 138)], "k int")
    assert [r[0] for r in k.select(class_band(col("k"))).collect()] == [1, 3, 2, 2, 3]


def test_rul(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)], "u int, c int")
    out = timeseries.rul_label(df, ["u"], "c").orderBy("u", "c").collect()
    assert [r["RUL"] for r in out] == [2, 1, 0, 1, 0]


def test_ranks_with_ties_and_infinities(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 50 == 1, INF)
        .when(F.col("id") % 50 == 2, -INF).otherwise(F.col("id") * 0.1).alias("v"))
    values = sorted(r[0] for r in df.collect())
    ranks = [0, 1, 59, 60, 1000, 1500, 2939, 2940, 2999]
    got = quantiles.values_at_ranks(
        df, {"v": ranks}, {"v": 3000}, exact_values=40, pivot_sample=100)
    assert [got["v", r] for r in ranks] == [values[r] for r in ranks]


def test_ranks_of_whole_numbers_in_a_table_far_larger_than_the_sample(spark):
    # Batches of whole numbers once shared one sequence of draws, in which no number was small enough.
    df = spark.range(1_200_000).select((F.col("id") % 50).cast("double").alias("v"))
    got = quantiles.column_quantiles(df, ["v"], [0, 0.5, 1], exact_values=1000, pivot_sample=50)
    assert got["v"] == [0.0, 24.5, 49.0]


def test_grouped_quantiles_hot_group(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 4 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        (F.col("id") * 37 % 997).cast("double").alias("v"))
    cut = quantiles.grouped_quantiles(df, ["g"], "v", {"q": 0.3}, target_rows=200)
    want = df.groupBy("g").agg(F.percentile("v", F.lit(0.3)).alias("q"))
    a, b = ({r["g"]: r["q"] for r in x.collect()} for x in (cut, want))
    assert a == pytest.approx(b)
