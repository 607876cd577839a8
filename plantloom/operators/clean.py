"""Cleaning: infinities, outliers, ordered and statistical imputation, quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.functions.safe import finite, is_infinite, numeric_columns, rows_from
from plantloom.operators.order import (
    LONG,
    Layout,
    add_ordinal,
    join_cells,
    plan_layout,
)
from plantloom.operators.quantiles import column_quantiles
from plantloom.operators.stats import tallies

STRATEGIES = ("ffill", "bfill", "interpolate", "mean", "median")


def inf_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or numeric_columns(df)
    return df.withColumns({c: finite(col(c)) for c in names})


def outlier_bounds(
    df: DataFrame, columns: Sequence[str], method: str = "zscore", threshold: float = 3.0
) -> dict[str, tuple[float, float]]:
    """Allowed interval per column; columns without spread are left out."""
    if method == "zscore":
        stats = df.agg(
            *[F.avg(finite(col(c))).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_samp(finite(col(c))).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        spread = {c: (stats[f"m{i}"], stats[f"s{i}"]) for i, c in enumerate(columns)}
        return {c: (m - threshold * s, m + threshold * s) for c, (m, s) in spread.items() if s}
    if method == "iqr":
        quarts = column_quantiles(df, columns, [0.25, 0.75])
        return {
            c: (a - threshold * (b - a), b + threshold * (b - a))
            for c, (a, b) in quarts.items()
            if a is not None and a != b
        }
    raise ValueError(f"unknown outlier method {method!r}")


def mask_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "zscore", threshold: float = 3.0
) -> DataFrame:
    """Outliers become NULL; bounds come from the whole frame."""
    bounds = outlier_bounds(df, columns, method, threshold)
    return df.withColumns(
        {c: F.when(col(c).between(F.lit(a), F.lit(b)), col(c)) for c, (a, b) in bounds.items()}
    )


def _carries(
    cells: DataFrame, layout: Layout, values: dict[str, Column], forward: bool, backward: bool
) -> DataFrame:
    """Join to each cell what it receives over its borders: the last known value before it
    (``<name>@p``) and the next known one after it (``<name>@n``)."""
    place = F.struct(*[col(c) for c in layout.order])
    sides = [(F.max_by, "p")] * forward + [(F.min_by, "n")] * backward
    edge = (
        cells.filter(col(LONG))
        .groupBy(*[col(k) for k in layout.keys])
        .agg(
            *[
                best(v, F.when(v.isNotNull(), place)).alias(f"{name}@{tag}")
                for name, v in values.items()
                for best, tag in sides
            ]
        )
    )
    outs = []
    for name in values:
        for _, tag in sides:
            walk = layout.across_cells(descending=tag == "n")
            before = walk.rowsBetween(Window.unboundedPreceding, -1)
            known = F.last(col(f"{name}@{tag}"), ignorenulls=True).over(before)
            outs.append(known.alias(f"{name}@{tag}"))
    return join_cells(cells, edge.select(*[col(k) for k in layout.keys], *outs), layout)


def _known(layout: Layout, name: str, value: Column, forward: bool) -> Column:
    """Last (or next) known value inside the cell, else what came over its border."""
    # Looking ahead is looking back in reverse order: a frame that ends at UNBOUNDED FOLLOWING
    # is evaluated anew for every row.
    w = layout.window(descending=not forward)
    inside = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not layout.is_cut:
        return inside
    return F.coalesce(inside, col(f"{name}@{'p' if forward else 'n'}"))


def _drop_carries(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[f"{n}@{t}" for n in names for t in "pn"])


def fill_ordered(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    series: Sequence[str] = (),
    forward: bool = True,
    layout: Layout | None = None,
    **sizing,
) -> DataFrame:
    """Last (or next) known value within the series."""
    layout = layout or plan_layout(df, order, series, **sizing)
    cells = layout.attach(df)
    names = {f"__c{i}": c for i, c in enumerate(columns)}
    if layout.is_cut:
        values = {n: col(c) for n, c in names.items()}
        cells = _carries(cells, layout, values, forward, not forward)
    filled = {c: _known(layout, n, col(c), forward) for n, c in names.items()}
    return layout.strip(_drop_carries(cells.withColumns(filled), list(names)))


def ffill(df, columns, order, series=(), **options) -> DataFrame:
    return fill_ordered(df, columns, order, series, True, **options)


def bfill(df, columns, order, series=(), **options) -> DataFrame:
    return fill_ordered(df, columns, order, series, False, **options)


def interpolate(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    series: Sequence[str] = (),
    layout: Layout | None = None,
    **sizing,
) -> DataFrame:
    """Linear by row position; before the first and after the last value the nearest one."""
    layout = layout or plan_layout(df, order, series, **sizing)
    cells = add_ordinal(layout.attach(df), layout, "__ord")
    names = {f"__c{i}": c for i, c in enumerate(columns)}
    points = {
        n: F.when(col(c).isNotNull(), F.struct(col(c).alias("v"), col("__ord").alias("o")))
        for n, c in names.items()
    }
    if layout.is_cut:
        cells = _carries(cells, layout, points, True, True)
    sides = {}
    for n, p in points.items():
        sides[f"{n}@a"] = _known(layout, n, p, True)
        sides[f"{n}@b"] = _known(layout, n, p, False)
    cells = cells.withColumns(sides)
    out = {}
    for n, c in names.items():
        a, b = col(f"{n}@a"), col(f"{n}@b")
        share = F.try_divide(col("__ord") - a["o"], b["o"] - a["o"])
        out[c] = F.coalesce(col(c), a["v"] + (b["v"] - a["v"]) * share, a["v"], b["v"])
    cells = cells.withColumns(out).drop(*sides, "__ord")
    return layout.strip(_drop_carries(cells, list(names)))


def fill_statistic(df: DataFrame, columns: Sequence[str], statistic: str) -> DataFrame:
    """Fill with the column mean or exact median over the frame."""
    if statistic == "median":
        values = {c: q[0] for c, q in column_quantiles(df, columns, [0.5]).items()}
    else:
        row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        values = {c: row[i] for i, c in enumerate(columns)}
    return df.withColumns(
        {c: F.coalesce(col(c), F.lit(v)) for c, v in values.items() if v is not None}
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column (ties: the smaller one); one job for all columns."""
    if not columns:
        return {}
    kinds = dict(df.dtypes)
    known_numbers = set(numeric_columns(df))
    numbers = [i for i, c in enumerate(columns) if c in known_numbers]
    counted = tallies(df, columns).filter(F.col("value").isNotNull()).withColumn(
        "size", F.when(F.col("i").isin(numbers), F.col("value").try_cast("double")))
    first = Window.partitionBy("i").orderBy(F.desc("n"), "size", "value")
    top = counted.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1")
    mode = [F.max(F.when(F.col("i") == i, F.col("value"))).cast(kinds[c]).alias(f"m{i}")
            for i, c in enumerate(columns)]
    row = top.agg(*mode).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = column_modes(df, columns)
    return df.withColumns(
        {c: F.coalesce(col(c), F.lit(v)) for c, v in modes.items() if v is not None}
    )


def fill_constant(
    df: DataFrame, value: float = 0.0, columns: Sequence[str] | None = None
) -> DataFrame:
    return df.withColumns(
        {c: F.coalesce(col(c), F.lit(value)) for c in columns or numeric_columns(df)}
    )


def impute(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str,
    order: Sequence[str] = (),
    series: Sequence[str] = (),
    **options,
) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is not one of {STRATEGIES}")
    if strategy in ("mean", "median"):
        return fill_statistic(df, columns, strategy)
    if not order:
        raise ValueError(f"strategy {strategy!r} needs an order")
    step = {"ffill": ffill, "bfill": bfill, "interpolate": interpolate}[strategy]
    return step(df, columns, order, series, **options)


def clean(
    df: DataFrame,
    strategy: str = "ffill",
    order: Sequence[str] = (),
    series: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    fill_value: float = 0.0,
    outliers: str | None = None,
    threshold: float = 3.0,
    **options,
) -> DataFrame:
    """Infinities → (outliers) → imputation → constant for whatever is still missing."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is not one of {STRATEGIES}")
    names = list(columns or numeric_columns(df, skip=[*order, *series]))
    if not names:
        return df
    out = inf_to_null(df, names)
    if outliers:
        out = mask_outliers(out, names, outliers, threshold)
    out = impute(out, names, strategy, order, series, **options)
    return fill_constant(out, fill_value, names)


def cleaning_stats(
    df: DataFrame,
    strategy: str = "ffill",
    order: Sequence[str] = (),
    series: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    outliers: str | None = None,
    threshold: float = 3.0,
    **options,
) -> DataFrame:
    """One row: rows, infinities replaced, outliers masked, nulls imputed by the strategy."""
    names = list(columns or numeric_columns(df, skip=[*order, *series]))

    def missing(frame: DataFrame, alias: str) -> DataFrame:
        holes = sum((F.count_if(col(c).isNull()) for c in names), F.lit(0))
        return frame.agg(holes.cast("long").alias(alias), F.lit(0).alias("__k"))

    infs = sum((F.count_if(is_infinite(col(c))) for c in names), F.lit(0))
    first = df.agg(
        F.count(F.lit(1)).alias("rows"),
        infs.cast("long").alias("inf_replaced"),
        F.lit(0).alias("__k"),
    )
    step = inf_to_null(df, names)
    before = missing(step, "before")
    masked = mask_outliers(step, names, outliers, threshold) if outliers else step
    after_mask = missing(masked, "masked")
    filled = missing(impute(masked, names, strategy, order, series, **options), "left")
    # Four one-row frames side by side.
    row = first
    for part in (before, after_mask, filled):
        row = row.join(F.broadcast(part), "__k")
    return row.select(
        "rows",
        "inf_replaced",
        (F.col("masked") - F.col("before")).alias("outliers_masked"),
        (F.col("masked") - F.col("left")).alias("nulls_imputed"),
    )


def quality_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls, infinities and moments per numeric column; the frame is not changed."""
    names = columns or numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        v = col(c).cast("double")
        aggs += [
            F.count_if(v.isNull()).alias(f"null{i}"),
            F.count_if(is_infinite(v)).alias(f"inf{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.avg(v).alias(f"avg{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
        ]
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            col(f"null{i}").alias("n_null"),
            F.try_divide(col(f"null{i}") * F.lit(100.0), col("n")).alias("pct_null"),
            col(f"inf{i}").alias("n_inf"),
            col(f"min{i}").alias("min"),
            col(f"max{i}").alias("max"),
            col(f"avg{i}").alias("mean"),
            F.nanvl(col(f"std{i}"), F.lit(None).cast("double")).alias("std"),
        )
        for i, c in enumerate(names)
    ]
    return rows_from(df.agg(*aggs), structs)
