"""Causal time-series features, labels, baselines and diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.functions.safe import safe_corr
from plantloom.operators.order import Layout, add_ordinal, apply_windows, plan_layout

LAGS = (1, 5, 10, 20)
HORIZONS = (1, 3, 6, 12, 24)
# Lags probed for a recommended subsample step, and the limit.
PROBE_LAGS = (10, 20, 30, 40, 50, 75, 100, 150, 200)
PROBE_LIMIT = 0.85


def _target_features(y: str, w, lags: Sequence[int], diffs: bool) -> dict[str, Column]:
    value = col(y).cast("double")
    out = {f"{y}_lag_{k}": F.lag(value, k).over(w) for k in lags}
    if diffs:
        past = w.rowsBetween(-10, -1)
        out[f"{y}_diff_1"] = F.lag(value, 1).over(w) - F.lag(value, 2).over(w)
        out[f"{y}_diff_5"] = F.lag(value, 1).over(w) - F.lag(value, 6).over(w)
        out[f"{y}_rolling_mean_10"] = F.avg(value).over(past)
        out[f"{y}_rolling_std_10"] = F.stddev_samp(value).over(past)
    return out


def feature_names(y: str, lags: Sequence[int] = LAGS, diffs: bool = True) -> list[str]:
    extra = ["diff_1", "diff_5", "rolling_mean_10", "rolling_std_10"] if diffs else []
    return [*[f"{y}_lag_{k}" for k in lags], *[f"{y}_{e}" for e in extra]]


def lag_features(
    df: DataFrame,
    y: str,
    order: Sequence[str],
    series: Sequence[str] = (),
    lags: Sequence[int] = LAGS,
    diffs: bool = True,
    **options,
) -> DataFrame:
    """Target lags, causal differences and rolling statistics; only rows before t are read."""
    back = max([*lags, 10 if diffs else 0])
    return apply_windows(
        df, lambda w: _target_features(y, w, lags, diffs), order, series, [y], back=back, **options
    )


def input_lags(
    df: DataFrame,
    sensors: Sequence[str],
    order: Sequence[str],
    series: Sequence[str] = (),
    lags: Sequence[int] = (1, 2, 3),
    fill: float = 0.0,
    **options,
) -> DataFrame:
    """Every sensor at t-1, t-2, t-3; missing history is filled with a constant."""

    def build(w):
        return {
            f"{c}_t-{k}": F.coalesce(F.lag(col(c), k).over(w), F.lit(fill))
            for k in lags
            for c in sensors
        }

    return apply_windows(df, build, order, series, sensors, back=max(lags), **options)


def unit_rolling_mean(
    df: DataFrame,
    sensors: Sequence[str],
    unit: Sequence[str],
    order: Sequence[str],
    width: int = 10,
    **sizing,
) -> DataFrame:
    """``<sensor>_rm``: mean over the last ``width`` rows; the first rows keep their value."""

    def build(w):
        last = w.rowsBetween(-(width - 1), 0)
        full = F.count(F.lit(1)).over(w.rowsBetween(-width, 0)) > width
        return {
            f"{c}_rm": F.when(full, F.avg(col(c)).over(last)).otherwise(col(c)) for c in sensors
        }

    return apply_windows(df, build, order, unit, sensors, back=width, **sizing)


def rul_label(df: DataFrame, unit: Sequence[str], cycle: str, name: str = "RUL") -> DataFrame:
    """Remaining cycles: the unit's last cycle minus the current one.

    The maximum is aggregated before the shuffle and joined back, so a unit with very many
    rows is never gathered in one task.
    """
    peak = df.groupBy(*[col(c) for c in unit]).agg(F.max(col(cycle)).alias("__peak"))
    return (
        df.join(peak, list(unit), "left")
        .withColumn(name, col("__peak") - col(cycle))
        .drop("__peak")
    )


def horizon_targets(
    df: DataFrame,
    y: str,
    order: Sequence[str],
    series: Sequence[str] = (),
    horizons: Sequence[int] = HORIZONS,
    **options,
) -> DataFrame:
    """One row per (t, horizon) with ``target`` = y[t+h]; rows without a future are dropped."""

    def build(w):
        leads = [
            F.struct(F.lit(h).alias("h"), F.lead(F.struct(col(y).alias("v")), h).over(w).alias("f"))
            for h in horizons
        ]
        return {"__leads": F.array(*leads)}

    wide = apply_windows(df, build, order, series, [y], ahead=max(horizons), **options)
    long = wide.withColumn("__l", F.explode("__leads"))
    return (
        long.filter(col("__l")["f"].isNotNull())
        .withColumn("horizon", col("__l")["h"])
        .withColumn("target", col("__l")["f"]["v"])
        .drop("__l", "__leads")
    )


def persistence(
    df: DataFrame, y: str, order: Sequence[str], series: Sequence[str] = (), **options
) -> DataFrame:
    """``persistence`` = y[t-1]; the first row has no forecast."""
    return apply_windows(
        df, lambda w: {"persistence": F.lag(col(y), 1).over(w)}, order, series, [y], back=1, **options
    )


def autocorr_diagnosis(
    df: DataFrame,
    y: str,
    order: Sequence[str],
    layout: Layout | None = None,
    **sizing,
) -> DataFrame:
    """One row: moments, CV %, autocorrelations, severity and the recommended step."""
    lags = sorted({1, 10, 50, *PROBE_LAGS})
    value = col(y).cast("double")
    slim = df.select(*[col(c) for c in order], value.alias("y"))
    wide = apply_windows(
        slim,
        lambda w: {f"l{k}": F.lag("y", k).over(w) for k in lags},
        order,
        inputs=["y"],
        back=max(lags),
        layout=layout,
        **sizing,
    )
    stats = wide.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"),
        *[safe_corr(F.col("y"), F.col(f"l{k}")).alias(f"ac{k}") for k in lags],
    )
    step = F.coalesce(
        *[F.when(col(f"ac{k}") < PROBE_LIMIT, F.lit(k)) for k in PROBE_LAGS], F.lit(200)
    )
    cv = F.when(col("mean") != 0, col("std") / col("mean") * 100).otherwise(0.0)
    ac1 = col("ac1")
    severity = (
        F.when(ac1 > 0.98, "critical").when(ac1 > 0.95, "high").when(ac1 > 0.90, "moderate")
    )
    return stats.select(
        "n_samples",
        "mean",
        "std",
        cv.alias("cv"),
        ac1.alias("autocorr_1"),
        F.when(col("n_samples") > 10, col("ac10")).otherwise(0.0).alias("autocorr_10"),
        F.when(col("n_samples") > 50, col("ac50")).otherwise(0.0).alias("autocorr_50"),
        step.cast("int").alias("recommended_step"),
        severity.otherwise("ok").alias("severity"),
    )


def gap_frequency(df: DataFrame, ts: str, order: Sequence[str], **options) -> DataFrame:
    """Time range and the most common gap between consecutive rows, in seconds."""
    slim = df.select(*[col(c) for c in dict.fromkeys([ts, *order])])
    gaps = apply_windows(
        slim,
        lambda w: {"__prev": F.lag(col(ts), 1).over(w)},
        order,
        inputs=[ts],
        back=1,
        **options,
    )
    micros = F.unix_micros(col(ts).cast("timestamp")) - F.unix_micros(
        col("__prev").cast("timestamp")
    )
    counted = (
        gaps.filter(col("__prev").isNotNull())
        .groupBy(micros.alias("gap"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = counted.orderBy(F.desc("n"), "gap").limit(1)
    span = df.agg(F.min(col(ts)).alias("first_ts"), F.max(col(ts)).alias("last_ts"))
    return span.withColumn("__k", F.lit(0)).join(
        top.select(
            (F.col("gap") / F.lit(1e6)).alias("gap_seconds"),
            F.col("n").alias("gap_count"),
            F.lit(0).alias("__k"),
        ),
        "__k",
        "left",
    ).drop("__k")

