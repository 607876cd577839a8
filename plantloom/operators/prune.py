"""Feature pruning: leakage, constants, collinearity, redundancy, low variation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.functions.safe import finite, rows_from, safe_corr
from plantloom.operators.stats import correlations


CONSTANT_BELOW = 1e-8


def leakage_report(
    df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.999
) -> DataFrame:
    """Per feature: correlation with the target and whether it is a near copy."""
    y = col(target).cast("double")
    aggs, structs = [], []
    for i, c in enumerate(features):
        x = col(c).cast("double")
        aggs += [safe_corr(x, y).alias(f"r{i}"), F.count(finite(x)).alias(f"n{i}")]
        leaks = F.coalesce((F.abs(col(f"r{i}")) >= threshold) & (col(f"n{i}") >= 3), F.lit(False))
        structs.append(
            F.struct(F.lit(c).alias("feature"), col(f"r{i}").alias("r"), leaks.alias("leak"))
        )
    return rows_from(df.agg(*aggs), structs)


def drop_leakage(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    threshold: float = 0.999,
    strict: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Drop near copies of the target; ``strict`` raises instead."""
    found = leakage_report(df, features, target, threshold).filter("leak").collect()
    leaked = [r["feature"] for r in found]
    if leaked and strict:
        raise ValueError(f"features copy the target {target!r}: {leaked}")
    return df.drop(*leaked), leaked


def constant_columns(
    df: DataFrame, features: Sequence[str], tolerance: float = CONSTANT_BELOW
) -> list[str]:
    row = df.agg(*[
        F.stddev_samp(finite(col(c))).alias(f"s{i}") for i, c in enumerate(features)
    ]).first()
    return [c for i, c in enumerate(features) if row[i] is not None and row[i] < tolerance]


def drop_constant(df, features, tolerance: float = CONSTANT_BELOW) -> tuple[DataFrame, list[str]]:
    gone = constant_columns(df, features, tolerance)
    return df.drop(*gone), gone


def collinear_columns(
    df: DataFrame, features: Sequence[str], threshold: float = 0.98, side: str = "a"
) -> list[str]:
    """The earlier (``a``) or later (``b``) column of each pair above the threshold."""
    if len(features) < 2:
        return []
    pairs = correlations(df, features).filter(F.abs("r") > threshold)
    hit = {r[side] for r in pairs.select(side).distinct().collect()}
    return [c for c in features if c in hit]


def drop_collinear(df, features, threshold: float = 0.98) -> tuple[DataFrame, list[str]]:
    gone = collinear_columns(df, features, threshold)
    return df.drop(*gone), gone


def redundant_columns(df, features, threshold: float = 0.95) -> list[str]:
    return collinear_columns(df, features, threshold, side="b")


def prune_features(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    leak: float = 0.999,
    collinear: float = 0.98,
    strict: bool = False,
) -> tuple[list[str], dict[str, str]]:
    """Surviving features and the reason each other one was removed.

    Two scans whatever the number of rules: spreads, then all correlations at once.
    """
    names = list(features)
    row = df.agg(
        *[F.stddev_samp(finite(col(c))).alias(f"s{i}") for i, c in enumerate(names)],
        *[F.count(finite(col(c))).alias(f"n{i}") for i, c in enumerate(names)],
    ).first()
    spread = {c: row[f"s{i}"] for i, c in enumerate(names)}
    known = {c: row[f"n{i}"] for i, c in enumerate(names)}
    pairs = [r for r in correlations(df, [*names, target]).collect() if r["r"] is not None]
    reasons = {
        r["a"]: "leak"
        for r in pairs
        if r["b"] == target and abs(r["r"]) >= leak and known[r["a"]] >= 3
    }
    if reasons and strict:
        raise ValueError(f"features copy the target {target!r}: {sorted(reasons)}")
    for c in names:
        if c not in reasons and spread[c] is not None and spread[c] < CONSTANT_BELOW:
            reasons[c] = "constant"
    kept = [c for c in names if c not in reasons]
    for r in pairs:
        if r["a"] in kept and r["b"] in kept and abs(r["r"]) > collinear:
            reasons[r["a"]] = "collinear"
    return [c for c in names if c not in reasons], reasons


def low_variation(df: DataFrame, columns: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Coefficient of variation in percent per column, flagged below the limit."""
    aggs = [F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(columns)]
    structs = []
    for i, c in enumerate(columns):
        cv = F.coalesce(F.try_divide(col(f"s{i}"), col(f"m{i}")) * 100, F.lit(0.0))
        structs.append(
            F.struct(F.lit(c).alias("column"), cv.alias("cv"), (cv < limit).alias("flat"))
        )
    return rows_from(df.agg(*aggs), structs)


def top_correlations(
    df: DataFrame, features: Sequence[str], target: str, k: int = 10
) -> DataFrame:
    """The k features with the largest absolute correlation with the target."""
    return (
        correlations(df, features, [target])
        .select(F.col("a").alias("feature"), F.abs("r").alias("abs_r"))
        .filter("abs_r is not null")
        .orderBy(F.desc("abs_r"), "feature")
        .limit(k)
    )


def tautology(df: DataFrame, prefix: str, targets: Sequence[str]) -> DataFrame:
    """Correlation of each column whose name starts with ``prefix`` with each target."""
    names = [c for c in df.columns if c.strip().lower().startswith(prefix.lower())]
    return correlations(df, names, targets)
