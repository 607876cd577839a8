"""Typing and encoding: safe casts, sentinels, one-hot, clipping, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantloom.functions.names import col
from plantloom.functions.scalars import perturb


def to_number(c: Column) -> Column:
    """Trimmed text with a decimal comma or point as a double, else NULL."""
    text = F.regexp_replace(F.trim(c), ",", ".")
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def numeric_coerce(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns (names with ``date`` excepted) to double; failures become NULL."""
    names = columns or [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and "date" not in f.name.lower()
    ]
    return df.withColumns({c: to_number(col(c)) for c in names})


def cast_where_possible(df: DataFrame) -> DataFrame:
    """Cast a text column to double only if every value parses."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    row = df.agg(
        *[
            F.count_if(col(c).isNotNull() & col(c).try_cast("double").isNull()).alias(f"f{i}")
            for i, c in enumerate(texts)
        ]
    ).first()
    return df.withColumns(
        {c: col(c).try_cast("double") for i, c in enumerate(texts) if row[i] == 0}
    )


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: str = "?") -> DataFrame:
    return df.withColumns({c: F.nullif(col(c), F.lit(sentinel)) for c in columns})


def levels_of(df: DataFrame, column: str, max_levels: int | None = None) -> list:
    levels = df.select(col(column).alias("v")).filter(F.col("v").isNotNull()).distinct()
    ordered = levels.orderBy("v")
    found = (ordered if max_levels is None else ordered.limit(max_levels + 1)).collect()
    if max_levels is not None and len(found) > max_levels:
        raise ValueError(f"{column!r} has more than {max_levels} levels")
    return [r["v"] for r in found]


def one_hot(
    df: DataFrame, columns: Sequence[str], drop_first: bool = True, levels: dict | None = None,
    max_levels: int | None = None,
) -> DataFrame:
    """0/1 columns ``<column>_<level>`` in level order, replacing the text column.

    ``max_levels`` makes a column with more levels an error; by default there is no limit.
    """
    out = df
    for c in columns:
        names = (levels or {}).get(c) or levels_of(df, c, max_levels)
        kept = names[1:] if drop_first else names
        flags = {f"{c}_{v}": F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)) for v in kept}
        out = out.withColumns(flags).drop(c)
    return out


def clip_upper(df: DataFrame, column: str, limit: float) -> DataFrame:
    value = col(column)
    return df.withColumn(column, F.when(value > limit, F.lit(limit)).otherwise(value))


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Model features in model order; a missing one is 0.0."""
    present = set(df.columns)
    cols = [
        col(f).cast("double").alias(f) if f in present else F.lit(0.0).alias(f) for f in features
    ]
    return df.select(*[col(k) for k in keep], *cols)


def scenario_sweep(
    df: DataFrame, factors: Sequence[float], noise: float = 0.0, seed: int = 42
) -> DataFrame:
    """Every row under each what-if factor; ``factor`` names the scenario."""
    swept = df.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    return swept.withColumns(perturb(df.columns, F.col("factor"), noise, seed))
