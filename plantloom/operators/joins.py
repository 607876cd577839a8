"""Joins with suffixes, join-integrity report, row and column concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.operators.order import with_ordinal


def join_suffix(
    left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str = "_r", how: str = "inner"
) -> DataFrame:
    """Equi-join; right columns whose name is taken get the suffix."""
    taken = set(left.columns) - set(on)
    renamed = right.select(
        *[col(c).alias(f"{c}{suffix}" if c in taken else c) for c in right.columns]
    )
    return left.join(renamed, list(on), how)


def join_integrity(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows and keys on each side, rows per key, and the size of the inner join.

    Both sides are counted per key first, so the join itself is never materialised.
    """

    def per_key(df: DataFrame, name: str) -> DataFrame:
        keys = [col(k) for k in on]
        known = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
        return df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    both = per_key(left, "nl").join(per_key(right, "nr"), list(on), "full")
    return both.agg(
        F.coalesce(F.sum("nl"), F.lit(0)).alias("left_rows"),
        F.count("nl").alias("left_keys"),
        F.coalesce(F.sum("nr"), F.lit(0)).alias("right_rows"),
        F.count("nr").alias("right_keys"),
        F.min("nr").alias("right_min_per_key"),
        F.max("nr").alias("right_max_per_key"),
        F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0)).alias("joined_rows"),
    ).withColumn("multiplies", F.col("joined_rows") > F.col("left_rows"))


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def concat_columns(
    left: DataFrame,
    right: DataFrame,
    left_order: Sequence[str],
    right_order: Sequence[str],
    **sizing,
) -> DataFrame:
    """Pair rows by position (two frames in their own order)."""
    a = with_ordinal(left, left_order, name="__pos", **sizing)
    b = with_ordinal(right, right_order, name="__pos", **sizing)
    clash = (set(left.columns) & set(right.columns)) - {"__pos"}
    if clash:
        raise ValueError(f"column names clash: {sorted(clash)}")
    return a.join(b, "__pos", "full").drop("__pos")
