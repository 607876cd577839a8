"""Robust and min-max scaling, fitted on the training side only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.operators.quantiles import column_quantiles


@dataclass(frozen=True)
class Scaler:
    """Per column (centre, scale): ``(x - centre) / scale``."""

    params: Mapping[str, tuple[float, float]]

    def expr(self, name: str) -> Column:
        centre, scale = self.params[name]
        return (col(name).cast("double") - F.lit(centre)) / F.lit(scale)

    def inverse_expr(self, name: str, value: Column) -> Column:
        centre, scale = self.params[name]
        return value * F.lit(scale) + F.lit(centre)

    def only(self, names: Sequence[str]) -> Scaler:
        return Scaler({c: self.params[c] for c in names})

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": self.expr(c) for c in self.params})

    def invert(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.inverse_expr(c, col(c)) for c in self.params})


def fit_robust(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Median and exact interquartile range; a zero range scales by 1."""
    quarts = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    params = {}
    for c, (a, m, b) in quarts.items():
        if m is not None:
            params[c] = (m, (b - a) if b != a else 1.0)
    return Scaler(params)


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> Scaler:
    row = df.agg(
        *[F.min(col(c)).cast("double").alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(col(c)).cast("double").alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    params = {}
    for i, c in enumerate(columns):
        a, b = row[f"a{i}"], row[f"b{i}"]
        if a is not None:
            params[c] = (a, (b - a) if b != a else 1.0)
    return Scaler(params)
