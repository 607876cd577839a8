"""Physical-range validation: row filter, statistics, diagnosis, value checks, guards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plantloom.functions.names import UNKNOWN, PhysicalRules, col
from plantloom.functions.safe import is_infinite, numeric_columns, rows_from

RULES = PhysicalRules()


def _bad(name: str, rules: PhysicalRules) -> Column | None:
    """True for a present value outside its range; None for a column without one."""
    limits = rules.limits(name)
    if limits is None:
        return None
    value = col(name)
    outside = ~value.between(F.lit(limits[0]), F.lit(limits[1]))
    return value.isNotNull() & ~F.isnan(value) & outside


def _checked(df: DataFrame, rules: PhysicalRules, skip: Sequence[str]) -> dict[str, Column]:
    tests = {c: _bad(c, rules) for c in numeric_columns(df, skip)}
    return {c: t for c, t in tests.items() if t is not None}


def drop_unknown_columns(
    df: DataFrame, rules: PhysicalRules = RULES, skip: Sequence[str] = ()
) -> DataFrame:
    """Drop numeric columns that match neither a pattern nor an override."""
    doomed = [c for c in numeric_columns(df, skip) if rules.limits(c) is None]
    return df.drop(*doomed)


def keep_predicate(
    df: DataFrame,
    timestamp: str | None = None,
    rules: PhysicalRules = RULES,
    skip: Sequence[str] = (),
) -> Column:
    """One conjunctive predicate for the whole row, usable on streams too."""
    tests = [~bad for bad in _checked(df, rules, skip).values()]
    if timestamp:
        tests.insert(0, col(timestamp).isNotNull())
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def validate_rows(
    df: DataFrame,
    timestamp: str | None = None,
    rules: PhysicalRules = RULES,
    strict: bool = False,
    drop_unknown: bool = False,
    skip: Sequence[str] = (),
    observation: Observation | None = None,
) -> DataFrame:
    """Keep rows whose categorised sensor values are all missing or within range.

    ``strict`` refuses a frame that has numeric columns without a rule.  With an
    ``observation`` the validation counters ride on the same pass.
    """
    if drop_unknown:
        df = drop_unknown_columns(df, rules, skip)
    elif strict:
        unruled = [c for c in numeric_columns(df, skip) if rules.limits(c) is None]
        if unruled:
            raise ValueError(f"columns without a physical category: {unruled}")
    keep = keep_predicate(df, timestamp, rules, skip)
    if observation is not None:
        df = df.observe(observation, *_counters(df, timestamp, rules, skip, keep))
    return df.filter(keep)


def _counters(df, timestamp, rules, skip, keep) -> list[Column]:
    no_ts = col(timestamp).isNull() if timestamp else F.lit(False)
    parts = [
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(keep).alias("rows_out"),
        F.count_if(no_ts).alias("rows_without_timestamp"),
    ]
    for c, bad in _checked(df, rules, skip).items():
        parts.append(F.count_if(bad & ~no_ts).alias(f"invalid::{c}"))
    return parts


def reject_band(rate: Column) -> Column:
    return F.when(rate > 10, "high").when(rate > 5, "moderate").otherwise("ok")


def validation_stats(
    df: DataFrame,
    timestamp: str | None = None,
    rules: PhysicalRules = RULES,
    skip: Sequence[str] = (),
) -> DataFrame:
    """One row: rows in/out, reject rate and band, invalid counts and categories by column."""
    keep = keep_predicate(df, timestamp, rules, skip)
    names = list(_checked(df, rules, skip))
    totals = df.agg(*_counters(df, timestamp, rules, skip, keep))
    rejected = col("rows_in") - col("rows_out")
    rate = F.coalesce(F.try_divide(rejected * F.lit(100.0), col("rows_in")), F.lit(0.0))
    invalid = F.create_map(
        *[e for c in names for e in (F.lit(c), col(f"invalid::{c}"))]
    ) if names else F.create_map().cast("map<string,bigint>")
    cats = {c: rules.category(c) for c in numeric_columns(df, skip)}
    detected = F.create_map(*[F.lit(e) for pair in cats.items() for e in pair])
    return totals.select(
        "rows_in",
        "rows_out",
        rejected.alias("rows_rejected"),
        "rows_without_timestamp",
        F.round(rate, 2).alias("reject_pct"),
        reject_band(rate).alias("severity"),
        F.map_filter(invalid, lambda _, n: n > 0).alias("invalid_by_column"),
        detected.alias("categories"),
    )


def diagnose(
    df: DataFrame, rules: PhysicalRules = RULES, skip: Sequence[str] = ()
) -> DataFrame:
    """Quality report, one row per numeric column, worst first; nothing is filtered."""
    names = numeric_columns(df, skip)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        value = col(c).cast("double")
        bad = _bad(c, rules)
        bad = F.lit(False) if bad is None else bad
        aggs += [
            F.count_if(value.isNull()).alias(f"null{i}"),
            F.count_if(bad).alias(f"bad{i}"),
            F.min(F.when(bad, value)).alias(f"ex{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
            F.avg(value).alias(f"avg{i}"),
        ]
    structs = []
    for i, c in enumerate(names):
        lo, hi = rules.limits(c) or (float("-inf"), float("inf"))
        share = lambda part: F.round(F.try_divide(col(part) * F.lit(100.0), col("n")), 2)
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(rules.category(c)).alias("category"),
                F.lit(lo).alias("min_allowed"),
                F.lit(hi).alias("max_allowed"),
                col("n").alias("n_total"),
                col(f"null{i}").alias("n_null"),
                share(f"null{i}").alias("pct_null"),
                col(f"bad{i}").alias("n_invalid"),
                share(f"bad{i}").alias("pct_invalid"),
                col(f"ex{i}").alias("example_invalid"),
                col(f"min{i}").alias("min_real"),
                col(f"max{i}").alias("max_real"),
                col(f"avg{i}").alias("mean"),
            )
        )
    return rows_from(df.agg(*aggs), structs).orderBy(F.desc("pct_invalid"), "column")


def invalid_summary(
    df: DataFrame, rules: PhysicalRules = RULES, skip: Sequence[str] = ()
) -> DataFrame:
    """The problem columns of :func:`diagnose`: any invalid value, or over 10 % missing."""
    return diagnose(df, rules, skip).filter((F.col("n_invalid") > 0) | (F.col("pct_null") > 10))


def check_values(
    df: DataFrame, name: str, value: str, rules: PhysicalRules = RULES, strict: bool = False
) -> DataFrame:
    """Add ``valid`` and ``reason`` to long data of (sensor name, value) rows."""
    v = col(value)
    reason = F.when(v.isNull() | F.isnan(v), "not a number").when(is_infinite(v), "infinite")
    if strict:
        reason = reason.when(F.coalesce(col("category"), F.lit(UNKNOWN)) == UNKNOWN, "no category")
    reason = reason.when(v < col("min_allowed"), "below minimum").when(
        v > col("max_allowed"), "above maximum"
    )
    ruled = rules.classify(df, name).withColumn("reason", reason)
    return ruled.withColumn("valid", col("reason").isNull()).drop(
        "category", "min_allowed", "max_allowed"
    )


def check_target(df: DataFrame, target: str, min_rows: int = 10) -> None:
    """Raise a clear ValueError unless the target can be regressed on."""
    if target not in df.columns:
        raise ValueError(f"target {target!r} not found; columns start {df.columns[:10]}")
    value = F.expr(f"try_cast(`{target}` AS double)")
    value = F.nanvl(value, F.lit(None).cast("double"))
    stats = df.agg(
        F.count(value).alias("n"),
        F.count(col(target)).alias("given"),
        F.count_if(is_infinite(value)).alias("inf"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    ).first()
    if stats["n"] == 0 and stats["given"] > 0:
        raise ValueError(f"target {target!r} is not numeric")
    if stats["n"] < min_rows:
        raise ValueError(f"only {stats['n']} rows with a valid target, {min_rows} needed")
    if stats["inf"]:
        raise ValueError(f"target {target!r} holds infinite values")
    if stats["lo"] == stats["hi"]:
        raise ValueError(f"target {target!r} is constant")


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in any (or the named) columns."""
    return df.na.drop(subset=[f"`{c}`" for c in (subset or df.columns)])
