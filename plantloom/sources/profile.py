"""What a source holds: ingestion statistics and a schema report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.functions.safe import numeric_columns, rows_from


def ingestion_stats(df: DataFrame, source: str) -> DataFrame:
    """One row: rows, columns, source name and the mean null share in percent (2 dp)."""
    names = df.columns
    missing = sum((F.count_if(col(c).isNull()) for c in names), F.lit(0))
    share = F.try_divide(missing * F.lit(100.0), F.lit(len(names)) * F.count(F.lit(1)))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(names)).alias("n_columns"),
        F.lit(source).alias("source"),
        F.round(F.coalesce(share, F.lit(0.0)), 2).alias("null_pct"),
    )


def schema_report(df: DataFrame) -> DataFrame:
    """Per column: type, null count and share, numeric range and moments."""
    kinds, numbers = dict(df.dtypes), set(numeric_columns(df))
    aggs, structs = [F.count(F.lit(1)).alias("n")], []
    none = F.lit(None).cast("double")
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(col(c).isNull()).alias(f"u{i}"))
        if c in numbers:
            v = col(c).cast("double")
            aggs += [
                F.min(v).alias(f"a{i}"),
                F.max(v).alias(f"b{i}"),
                F.avg(v).alias(f"m{i}"),
                F.stddev_samp(v).alias(f"s{i}"),
            ]
        stat = lambda tag, c=c, i=i: col(f"{tag}{i}") if c in numbers else none
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("type"),
                col(f"u{i}").alias("n_null"),
                F.try_divide(col(f"u{i}") * F.lit(100.0), col("n")).alias("pct_null"),
                stat("a").alias("min"),
                stat("b").alias("max"),
                stat("m").alias("mean"),
                stat("s").alias("std"),
            )
        )
    return rows_from(df.agg(*aggs), structs)
