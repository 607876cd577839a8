"""NULL / NaN / infinity handling and ANSI-safe statistics as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantloom.functions.names import col

INF = float("inf")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Numeric columns in source order; booleans are not sensors."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN marks a missing value in files; in the engine only NULL does."""
    names = [c for c in (columns or df.columns) if fractional(df, c)]
    return df.withColumns({c: F.nanvl(col(c), F.lit(None).cast("double")) for c in names})


def is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(INF)


def finite(c: Column) -> Column:
    """The value, or NULL where it is ±infinity or NaN."""
    return F.when(~is_infinite(c) & ~F.isnan(c), c)


def known(c: Column) -> Column:
    """A number as a double, NULL where it is NaN: both mark a missing value."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both sides are finite; NULL where one is constant."""
    xs, ys = finite(x.cast("double")), finite(y.cast("double"))
    both = xs.isNotNull() & ys.isNotNull()
    xs, ys = F.when(both, xs), F.when(both, ys)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def rows_from(agg: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct (lazy, no collect)."""
    return agg.select(F.explode(F.array(*structs)).alias("__r")).select("__r.*")
