"""End-to-end batch flows: validate → clean → (resample → baselines)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import PhysicalRules, col
from plantloom.operators.clean import clean
from plantloom.operators.metrics import mean_baseline, regression_metrics
from plantloom.operators.split import chronological_split
from plantloom.operators.timeseries import persistence
from plantloom.operators.validate import RULES, validate_rows
from plantloom.session import written


def run_etl(
    df: DataFrame,
    ts: str,
    order: Sequence[str],
    series: Sequence[str] = (),
    rules: PhysicalRules = RULES,
    strategy: str = "ffill",
    columns: Sequence[str] | None = None,
    skip: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Validated and cleaned rows as one lazy plan; errors surface, nothing is swallowed."""
    kept = validate_rows(df, ts, rules, skip=[*skip, *order, *series])
    return clean(kept, strategy, order, series, columns, **options)


def baseline_report(
    df: DataFrame, ts: str, seq: str, sensor: str, target: str, unit: str = "hour",
    skip: Sequence[str] = (), **options,
) -> DataFrame:
    """Metrics of the mean and the persistence forecast on time-unit averages.

    The averages are few (one per time unit) and feed several passes, so they are written once.
    """
    rows = run_etl(df, ts, [ts, seq], columns=[sensor, target], skip=skip, **options)
    slots = written(
        rows.groupBy(F.date_trunc(unit, col(ts)).alias("slot"))
        .agg(F.avg(col(sensor)).alias("x"), F.avg(col(target)).alias("y")),
        "slots",
    )
    ordered = persistence(slots, "y", ["slot"])
    parts = chronological_split(ordered, ["slot"])
    train, test = parts.filter("is_train"), parts.filter("NOT is_train")
    mean = mean_baseline(train, test, "y").withColumn("model", F.lit("mean"))
    last = regression_metrics(test, "y", "persistence").withColumn("model", F.lit("persistence"))
    return mean.unionByName(last)
