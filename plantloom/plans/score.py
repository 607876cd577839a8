"""Scoring flows: latest point and last points per series, what-if sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.operators.encode import scenario_sweep
from plantloom.operators.split import join_flags
from plantloom.operators.timeseries import lag_features
from plantloom.plans.train import SensorModel

_BACK = "__from_end"


def recent_rows(df: DataFrame, n: int, order: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows of each series with ``__from_end`` = 1 for the newest.

    Spark keeps only ``n`` rows per series and task before the shuffle, so a hot series
    does not travel.
    """
    by = [col(c) for c in series] or [F.lit(0)]
    w = Window.partitionBy(*by).orderBy(*[col(c).desc() for c in order])
    return df.withColumn(_BACK, F.row_number().over(w)).filter(col(_BACK) <= n)


def _result(scored: DataFrame, model: SensorModel, order, series) -> DataFrame:
    return scored.select(
        *[col(c) for c in dict.fromkeys([*series, *order])],
        col(model.target).alias("real"),
        col("prediction").alias("predicted"),
        F.lit(model.kind).alias("model_used"),
        col("std").alias("confidence_std"),
        col("confidence").alias("confidence_pct"),
    )


def _features(rows: DataFrame, model: SensorModel, order, series) -> DataFrame:
    if not model.lags:
        return rows
    return lag_features(rows, model.target, order, series, model.lags)


def score_latest(
    df: DataFrame, model: SensorModel, order: Sequence[str], series: Sequence[str] = ()
) -> DataFrame:
    """One scored row per series: its newest point, features from its recent history."""
    need = max([10, *model.lags]) + 1
    rows = _features(recent_rows(df, need, order, series), model, order, series)
    newest = rows.filter(col(_BACK) == 1).na.fill(0.0, subset=[f"`{c}`" for c in model.features])
    return _result(model.predict(newest), model, order, series)


def score_series(
    df: DataFrame,
    model: SensorModel,
    order: Sequence[str],
    series: Sequence[str] = (),
    n_points: int = 100,
    min_history: int = 50,
) -> DataFrame:
    """The last ``n_points`` of each series that have ``min_history`` rows before them."""
    need = n_points + max([10, *model.lags]) + 1
    rows = _features(recent_rows(df, need, order, series), model, order, series)
    by = list(series)
    sizes = df.groupBy(*[col(c) for c in by]).agg(F.count(F.lit(1)).alias("__n"))
    if by:
        rows = join_flags(rows, sizes, by)
    else:
        rows = rows.withColumn("__n", F.lit(sizes.first()["__n"]))
    wanted = rows.filter(
        (col(_BACK) <= n_points) & (col("__n") - col(_BACK) >= min_history)
    ).drop("__n")
    return _result(model.predict(wanted.na.drop(subset=[f"`{c}`" for c in model.features])), model, order, series)


def score_scenarios(
    df: DataFrame, model: SensorModel, factors: Sequence[float], order: Sequence[str],
    noise: float = 0.0, seed: int = 42,
) -> DataFrame:
    """Average prediction per what-if factor on the air and flow columns."""
    scored = model.predict(scenario_sweep(df, factors, noise, seed))
    return scored.groupBy("factor").agg(
        F.avg("prediction").alias("predicted_avg"),
        F.avg("confidence").alias("confidence_avg"),
        F.count(F.lit(1)).alias("n"),
    )
