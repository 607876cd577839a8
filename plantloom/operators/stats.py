"""Descriptive statistics: describe, resample, histograms, correlations, profiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.functions.safe import finite, known, numeric_columns, rows_from
from plantloom.models.gram import SUMS, added, batches_of
from plantloom.operators.quantiles import column_quantiles, grouped_quantiles, interpolate_at

QUARTILES = (0.25, 0.5, 0.75)
_COLUMNS_PER_AGG = 60


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles, max; one row per numeric column."""
    names = list(columns or numeric_columns(df))
    quarts = column_quantiles(df, names, QUARTILES)
    parts = []
    for start in range(0, len(names), _COLUMNS_PER_AGG):
        part = names[start:start + _COLUMNS_PER_AGG]
        aggs, structs = [], []
        for i, c in enumerate(part):
            v = known(col(c))
            aggs += [
                F.count(v).alias(f"n{i}"),
                F.avg(v).alias(f"m{i}"),
                F.stddev_samp(v).alias(f"s{i}"),
                F.min(v).alias(f"lo{i}"),
                F.max(v).alias(f"hi{i}"),
            ]
            q1, q2, q3 = (F.lit(q).cast("double") for q in quarts[c])
            structs.append(
                F.struct(
                    F.lit(c).alias("column"),
                    col(f"n{i}").alias("n"),
                    col(f"m{i}").alias("mean"),
                    col(f"s{i}").alias("std"),
                    col(f"lo{i}").alias("min"),
                    q1.alias("p25"),
                    q2.alias("p50"),
                    q3.alias("p75"),
                    col(f"hi{i}").alias("max"),
                )
            )
        parts.append(rows_from(df.agg(*aggs), structs))
    return reduce(lambda a, b: a.unionByName(b), parts)


def box_stats(df: DataFrame, value: str, by: Sequence[str] = (), **sizing) -> DataFrame:
    """Five-number summary, whole table or per group."""
    points = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    if by:
        return grouped_quantiles(df, by, value, points, **sizing)
    got = column_quantiles(df, [value], list(points.values()))[value]
    return df.sparkSession.createDataFrame(
        [tuple(got)], ", ".join(f"{name} double" for name in points)
    )


def resample(
    df: DataFrame,
    ts: str,
    sensors: Sequence[str],
    targets: Sequence[str] = (),
    seq: str | None = None,
    unit: str = "hour",
    series: Sequence[str] = (),
) -> DataFrame:
    """Per time unit: mean, std, min, max and last of each sensor, first of each target.

    Partial aggregation runs before the shuffle, so a hot hour costs one row per task.
    """
    place = F.struct(col(ts), col(seq)) if seq else col(ts)
    aggs = []
    for c in sensors:
        v = col(c)
        aggs += [
            F.avg(v).alias(f"{c}__mean"),
            F.stddev_samp(v).alias(f"{c}__std"),
            F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"),
            F.max_by(v, F.when(v.isNotNull(), place)).alias(f"{c}__last"),
        ]
    for c in targets:
        aggs.append(F.min_by(col(c), F.when(col(c).isNotNull(), place)).alias(c))
    slot = F.date_trunc(unit, col(ts)).alias("slot")
    return df.groupBy(*[col(c) for c in series], slot).agg(*aggs)


def group_stats(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Per group: rows, and for each column max, last known value and distinct count."""
    place = F.struct(*[col(c) for c in order])
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [
            F.max(col(c)).alias(f"{c}__max"),
            F.max_by(col(c), F.when(col(c).isNotNull(), place)).alias(f"{c}__last"),
            F.countDistinct(col(c)).alias(f"{c}__distinct"),
        ]
    return df.groupBy(*[col(c) for c in by]).agg(*aggs)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table (column, value, n), one scan for all columns."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value"))
                for c in columns
            ]
        )
    )
    return (
        df.select(pairs.alias("__p"))
        .select("__p.*")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)],
    )
    return rows_from(
        agg,
        [
            F.struct(
                F.lit(c).alias("column"),
                col(f"n{i}").alias("n_null"),
                F.try_divide(col(f"n{i}") * F.lit(100.0), col("n")).alias("pct_null"),
            )
            for i, c in enumerate(names)
        ],
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are listed."""
    v = col(value).cast("double")
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = (
        df.filter(v.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def equal_frequency(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Edges at fractional rank k·n/bins (clipped to the maximum) and the count per bin."""
    known = df.select(col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = known.count()
    spots = [min(k * n / bins, n - 1) for k in range(bins + 1)]
    edges = interpolate_at(known, {"v": spots}, {"v": n})["v"]
    v = F.col("v")
    counts = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        upper = v <= b if i == bins - 1 else v < b
        counts.append(F.count_if((v >= a) & upper).alias(f"n{i}"))
    structs = [
        F.struct(
            F.lit(i).alias("bin"),
            F.lit(edges[i]).alias("lower"),
            F.lit(edges[i + 1]).alias("upper"),
            col(f"n{i}").alias("n"),
        )
        for i in range(bins)
    ]
    return rows_from(known.agg(*counts), structs)


def correlations(
    df: DataFrame, columns: Sequence[str], against: Sequence[str] | None = None
) -> DataFrame:
    """Long (a, b, r): upper-triangle pairs in column order, or ``columns`` × ``against``."""
    names = list(dict.fromkeys([*columns, *(against or ())]))
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    pair = _pair_sums(df, names)
    if against is None:
        return pair.filter("i < j").drop("i", "j")
    return pair.filter(F.col("a").isin(list(columns)) & F.col("b").isin(list(against))
                       & (F.col("i") != F.col("j"))).drop("i", "j")


def _pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations (i, j, a, b, r) of all columns from one pass of matrix products.

    A pair counts the rows where both values are finite; sums are centred on the means. Tasks send
    whole matrices, which a few tasks add up; the driver holds one entry per pair of columns.
    """
    p = len(columns)
    means = [F.avg(finite(col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]
    centre = df.agg(*means).first()
    shift = np.array([m or 0.0 for m in centre])
    narrow = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, p, p))
        for batch in batches:
            x = np.column_stack(
                [batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)]
            ).astype(float)
            seen = np.isfinite(x)
            x = np.where(seen, x - shift, 0.0)
            m = seen.astype(float)
            sq = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        yield from batches_of({(0, k): t for k, t in enumerate(total)})

    got = added(narrow.mapInArrow(sums, SUMS))
    n, sx, sy, sxx, syy, sxy = (got.get((0, k), np.zeros((p, p))) for k in range(6))
    with np.errstate(divide="ignore", invalid="ignore"):
        cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
        r = np.where((vx > sxx * 1e-13) & (vy > syy * 1e-13), cov / np.sqrt(vx * vy), np.nan)
    i, j = (x.ravel().astype("int32") for x in np.indices((p, p)))
    names = np.array(columns, dtype=object)
    return df.sparkSession.createDataFrame(pa.table({
        "i": pa.array(i), "j": pa.array(j), "a": pa.array(names[i], pa.string()),
        "b": pa.array(names[j], pa.string()), "r": pa.array(r.ravel(), mask=np.isnan(r.ravel()))}))


def strong_correlations(df, columns, threshold: float = 0.8) -> DataFrame:
    return correlations(df, columns).filter(F.abs("r") >= threshold)


def tallies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, value, n``: how often each value, as text, stands in column number ``i``.

    All columns are grouped in one job; tasks sum up before anything travels.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("value"))
        for i, c in enumerate(columns)])).alias("c")
    return df.select(cells).select("c.*").groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, rows, missing, distinct, zeros, moments and quartiles if numeric."""
    names = list(columns or df.columns)
    numbers = [c for c in names if c in numeric_columns(df)]
    kinds = dict(df.dtypes)
    quarts = column_quantiles(df, numbers, QUARTILES)
    none = F.lit(None).cast("double")
    plain = df.select(*[(known(col(c)) if c in numbers else col(c)).alias(c) for c in names])
    # 0.0 and -0.0 are one value.
    plain = plain.withColumns({c: F.when(col(c) == 0, F.lit(0).cast(kinds[c])).otherwise(col(c))
                               for c in numbers if kinds[c] in ("float", "double")})
    distinct = {r["i"]: r["d"] for r in tallies(plain, names).groupBy("i").agg(
        F.count("value").alias("d")).collect()}
    aggs, structs = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(names):
        v = known(col(c)) if c in numbers else col(c)
        aggs.append(F.count(v).alias(f"k{i}"))
        if c in numbers:
            aggs += [
                F.count_if(v == 0).alias(f"z{i}"),
                F.avg(v).alias(f"m{i}"),
                F.stddev_samp(v).alias(f"s{i}"),
                F.skewness(v).alias(f"g{i}"),
                F.kurtosis(v).alias(f"h{i}"),
                F.min(v).alias(f"lo{i}"),
                F.max(v).alias(f"hi{i}"),
            ]
        num = (lambda e, c=c: e) if c in numbers else (lambda e: none)
        k = col(f"k{i}").cast("double")
        # Sample-adjusted skewness and excess kurtosis from the population moments.
        skew = num(col(f"g{i}")) * F.try_divide(F.sqrt(k * (k - 1)), k - 2)
        kurt = F.try_divide((k - 1) * ((k + 1) * num(col(f"h{i}")) + 6), (k - 2) * (k - 3))
        q = quarts.get(c, [None] * 3)
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("type"),
                col("n").alias("n_rows"),
                (col("n") - col(f"k{i}")).alias("n_missing"),
                F.lit(distinct.get(i, 0)).cast("long").alias("n_distinct"),
                (col(f"z{i}") if c in numbers else F.lit(None).cast("long")).alias("n_zero"),
                num(col(f"m{i}")).alias("mean"),
                num(col(f"s{i}")).alias("std"),
                skew.alias("skewness"),
                kurt.alias("kurtosis"),
                num(col(f"lo{i}")).alias("min"),
                *[F.lit(x).cast("double").alias(f"p{w}") for x, w in zip(q, (25, 50, 75))],
                num(col(f"hi{i}")).alias("max"),
            )
        )
    return rows_from(df.agg(*aggs), structs)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values per column (ties: smaller value first)."""
    first = Window.partitionBy("i").orderBy(F.desc("n"), F.asc("value"))
    names = F.array(*[F.lit(c) for c in columns])
    return (
        tallies(df, columns).withColumn("__rn", F.row_number().over(first))
        .filter(F.col("__rn") <= k)
        .select(F.element_at(names, F.col("i") + 1).alias("column"), "value", "n"))


def cycle_features(
    df: DataFrame,
    cycle: Sequence[str],
    sensor: str,
    value: str,
    position: str,
    sensors: Sequence[str],
    **sizing,
) -> DataFrame:
    """Per cycle and sensor: mean, std, min, max, quartiles and slope, one row per cycle."""
    keys = [*cycle, sensor]
    v, x = col(value).cast("double"), col(position).cast("double")
    known = df.filter(v.isNotNull())
    moments = known.groupBy(*[col(k) for k in keys]).agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.try_divide(F.covar_pop(v, x), F.var_pop(x)).alias("slope"),
    )
    quarts = grouped_quantiles(
        known, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, **sizing
    )
    long = moments.join(quarts, keys)
    stats = ["mean", "std", "min", "max", "p25", "p50", "p75", "slope"]
    wide = (
        long.groupBy(*[col(c) for c in cycle])
        .pivot(sensor, list(sensors))
        .agg(*[F.first(s, ignorenulls=True).alias(s) for s in stats])
    )
    return wide


def shift_rollup(
    df: DataFrame,
    ts: str,
    prediction: str,
    confidence: str,
    health: Mapping[str, Column] | None = None,
    shift: str = "8 hours",
    target: float = 80.0,
    value_per_point: float = 1250.0,
    model: str = "model",
) -> DataFrame:
    """Shift report rows: average prediction, money impact, status, sensor health.

    ``health`` maps a sensor to the condition that flags a bad reading.
    """
    health = health or {}
    rolled = df.groupBy(F.window(col(ts), shift).alias("__w")).agg(
        F.avg(col(prediction)).alias("recovery_avg"),
        F.avg(col(confidence)).alias("confidence_avg"),
        *[
            F.avg(F.coalesce(bad, F.lit(True)).cast("double")).alias(f"__h{i}")
            for i, bad in enumerate(health.values())
        ],
    )
    state = [
        F.when(col(f"__h{i}") == 0, "ok").when(col(f"__h{i}") <= 0.1, "warn").otherwise("fault")
        for i in range(len(health))
    ]
    out = rolled.select(
        col("__w")["start"].alias("shift_start"),
        "recovery_avg",
        F.lit(target).alias("recovery_target"),
        ((F.col("recovery_avg") - target) * value_per_point).alias("financial_impact"),
        "confidence_avg",
        F.when(F.col("confidence_avg") > 85, "stable").otherwise("noisy").alias("status"),
        F.when(F.col("recovery_avg") >= target, "hold").otherwise("adjust air").alias(
            "recommendation"
        ),
        F.lit(model).alias("model_name"),
        *([F.create_map(*[e for k, s in zip(health, state) for e in (F.lit(k), s)])
           .alias("sensor_health")] if health else []),
    )
    return out
