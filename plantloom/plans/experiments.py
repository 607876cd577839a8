"""Experiments: forecast horizons, hourly soft sensor, model comparison, signal or chance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.functions.scalars import model_verdict, signal_verdict
from plantloom.models import learners, linear
from plantloom.models.boosting import BoostSpec, fit_boosting, permutation_test_boosted
from plantloom.operators.metrics import mean_baseline, regression_metrics
from plantloom.operators.split import chronological_split, kfold
from plantloom.operators.timeseries import HORIZONS, horizon_targets, input_lags, persistence
from plantloom.plans.train import written

# The boosted trees of the horizon and hourly experiments, and of those on samples.
BOOSTED = BoostSpec(rounds=300, depth=4, rate=0.05)
SHALLOW = BoostSpec(rounds=200, depth=2, rate=0.05)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def evaluate_horizons(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    order: Sequence[str],
    horizons: Sequence[int] = HORIZONS,
    spec: BoostSpec = BOOSTED,
    **options,
) -> DataFrame:
    """Rows (target, horizon, model_r2, persistence_r2, verdict) on a chronological split."""
    slim = df.select(*[col(c) for c in dict.fromkeys([*order, *features, *targets])])
    parts = []
    for y in targets:
        future = written(
            horizon_targets(slim, y, order, horizons=horizons, **options).na.drop(), "horizons"
        )
        for h in horizons:
            rows = chronological_split(future.filter(col("horizon") == h), order)
            model = fit_boosting(rows.filter("is_train"), features, "target", spec)
            test = model.predict(rows.filter("NOT is_train"))
            key = F.lit(0).alias("__k")
            a = regression_metrics(test, "target", "prediction").select(
                F.col("r2").alias("model_r2"), "n", key)
            b = regression_metrics(test, "target", y).select(
                F.col("r2").alias("persistence_r2"), key)
            parts.append(
                a.join(b, "__k").select(
                    F.lit(y).alias("target"), F.lit(h).alias("horizon"), "n", "model_r2",
                    "persistence_r2",
                    model_verdict(F.col("model_r2"), F.col("persistence_r2")).alias("verdict"),
                )
            )
    return _union(parts)


def hourly_experiment(
    hours: DataFrame, features: Sequence[str], target: str, order: Sequence[str],
    lags: Sequence[int] = (1, 2, 3), spec: BoostSpec = BOOSTED, margin: float = 0.02,
) -> DataFrame:
    """Rows (model, n, r2, mae, beats_persistence): does a soft sensor beat the hour before?

    ``mean`` and ``persistence`` are the baselines, ``nowcast`` sees the readings of the hour,
    ``input_lags`` also those of the hours before. The last fifth in time is the test.
    """
    needed = [*dict.fromkeys([*order, *features, target])]
    rows = hours.select(*[col(c) for c in needed]).na.drop()
    rows = input_lags(persistence(rows, target, order), features, order, lags=lags)
    rows = written(chronological_split(rows, order), "hourly")
    train, test = rows.filter("is_train"), rows.filter("NOT is_train")
    lagged = [*features, *[f"{c}_t-{k}" for k in lags for c in features]]
    reports = {"mean": mean_baseline(train, test, target),
               "persistence": regression_metrics(test, target, "persistence")}
    for name, columns in (("nowcast", list(features)), ("input_lags", lagged)):
        scored = fit_boosting(train, columns, target, spec).predict(test)
        reports[name] = regression_metrics(scored, target, "prediction")
    out = written(_union([r.select(F.lit(name).alias("model"), "n", "r2", "mae")
                          for name, r in reports.items()]), "hourly-report")
    bar = out.filter("model = 'persistence'").first()["r2"]
    beats = F.when(~col("model").isin("mean", "persistence"), col("r2") > F.lit(bar) + margin)
    return out.withColumn("beats_persistence", beats)


def compare_models(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str],
    folds: int = 5, least: int = 20, spec: BoostSpec = SHALLOW, forest: Mapping | None = None,
) -> DataFrame:
    """Rows (target, model, n, mean, std, r2, mae) of shuffled K-fold predictions, per target.

    ``linear``, ``boosted`` and ``forest`` see the same folds of the complete rows; a target with
    fewer than ``least`` of them has no rows.
    """
    parts = []
    for y in targets:
        known = df.na.drop(subset=[f"`{c}`" for c in [*features, y]])
        rows = written(kfold(known.select(*[
            col(c) for c in dict.fromkeys([*keys, *features, y])]), keys, folds), "compare")
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(col(y)).alias("mean"),
                        F.stddev_pop(col(y)).alias("std")).first()
        if size["n"] < least:
            continue
        scored = {
            "linear": linear.oof_linear(rows, features, y, "fold"),
            "boosted": fit_boosting(rows, features, y, spec, fold="fold").predict(rows, "fold"),
            "forest": learners.out_of_fold(
                rows, features, y, "fold", "forest", range(folds), **(forest or {})),
        }
        parts += [
            regression_metrics(s, y, "prediction").select(
                F.lit(y).alias("target"), F.lit(name).alias("model"), "n",
                F.lit(size["mean"]).cast("double").alias("mean"),
                F.lit(size["std"]).cast("double").alias("std"), "r2", "mae")
            for name, s in scored.items()]
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "target string, model string, n long, mean double, std double, r2 double, mae double")
    return _union(parts)


def signal_report(
    df: DataFrame, feature_sets: Mapping[str, Sequence[str]], targets: Sequence[str], group: str,
    keys: Sequence[str], n: int = 200, spec: BoostSpec = SHALLOW, **options,
) -> DataFrame:
    """Per feature set and target: grouped out-of-fold R², permutation p-value and a verdict.

    ``real`` needs R² above 0.3 and p below 0.05, ``weak`` R² above 0.1; else ``none``.
    """
    parts = []
    for name, features in feature_sets.items():
        for y in targets:
            r = permutation_test_boosted(df, features, y, group, keys, n, spec=spec, **options)
            parts.append(r.select(F.lit(name).alias("features"), F.lit(y).alias("target"), "r2",
                                  "p_value", "n_rows", "n_groups",
                                  signal_verdict(col("r2"), col("p_value")).alias("verdict")))
    return _union(parts)


def best_horizon(report: DataFrame) -> DataFrame:
    """The largest gap over persistence with a usable model, or no row."""
    gap = F.col("model_r2") - F.col("persistence_r2")
    return (
        report.withColumn("gap", gap)
        .filter((F.col("model_r2") > 0.1) & (F.col("gap") > 0.02))
        .orderBy(F.desc("gap"), "target", "horizon")
        .limit(1)
    )
