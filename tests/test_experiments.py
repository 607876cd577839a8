import pytest
from pyspark.sql import functions as F

from plantloom.models.boosting import BoostSpec
from plantloom.plans import experiments, score
from plantloom.plans.train import train

QUICK = BoostSpec(rounds=20, depth=2, rate=0.3)


def test_signal_report(spark):
    df = spark.range(600).selectExpr(
        "id", "id % 40 AS hole", "CAST(xxhash64(id) % 5 AS DOUBLE) AS a", "CAST(xxhash64(id, 1) % 5 AS DOUBLE) AS b")
    df = df.withColumn("y", 3 * (F.col("a") > 0).cast("int") + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100)) / 100)
    got = {(r.features, r.target): r for r in experiments.signal_report(
        df, {"a": ["a"], "b": ["b"]}, ["y"], "hole", ["id"], n=24, spec=QUICK).collect()}
    assert got["a", "y"].verdict == "real" and got["a", "y"].p_value == pytest.approx(0.04)
    assert got["b", "y"].verdict == "none" and got["b", "y"].n_groups == 40


def test_few_rows_are_left_out(spark):
    df = spark.range(15).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id AS DOUBLE) AS y")
    assert experiments.compare_models(df, ["x"], ["y"], ["id"]).count() == 0


def test_training_with_diagnosis_and_step(spark):
    df = spark.range(3000).selectExpr("id", "sin(id / 50D) * 10 AS y", "sin(id / 50D) * 10 + pmod(xxhash64(id), 700) / 50D AS x")
    model, _ = train(df, "y", ["x"], ["id"], lags=(), trials=1, width=16, step="auto", force="kernel")
    assert model.diagnosis["severity"] == "critical" and model.diagnosis["step"] > 1
    assert model.diagnosis["step"] == model.diagnosis["recommended_step"]
    plain, _ = train(df, "y", ["x"], ["id"], lags=(), trials=1, width=16, step=3, force="kernel")
    assert plain.diagnosis == {"step": 3}


def test_a_series_without_a_name_is_scored(spark):
    df = spark.range(240).selectExpr(
        "id", "IF(id % 2 = 0, 'a', NULL) AS s", "CAST(id % 10 AS DOUBLE) AS x",
        "2D * (id % 10) + pmod(xxhash64(id), 9) AS y")
    model, _ = train(df, "y", ["x"], ["id"], ["s"], lags=(), trials=1, width=16, force="kernel")
    got = score.score_series(df, model, ["id"], ["s"], n_points=5, min_history=50)
    assert {r.s for r in got.collect()} == {"a", None} and got.count() == 10
