"""Row order at scale: bounded cells, ordinals, and look-back windows over long series.

``Window.orderBy(ts)`` without a key, or with a key that owns a third of the rows, sends
an unbounded group to one task.  A :class:`Layout` cuts only such long series into cells of
consecutive rows (equal-frequency bounds of the whole order key, of any types, measured on
the data), so every window runs over ``(series, cell)``; the number of cells grows with the
table.  What crosses a cell border is small and is shipped
explicitly: the few rows a bounded window reaches back (:func:`apply_windows`), or one carry
value per cell for unbounded fills (``operators.clean``).

Short series are never cut, and a table below ``target_rows`` is one cell per series: the
plan then is the plain ``partitionBy(series)`` window with a single shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantloom.functions.names import col
from plantloom.session import written

CELL = "__cell"
LONG = "__long_series"
HALO = "__halo"
_KEY = "__order_key"
_BOUNDS = "__bounds"
# Bounds of the first level of cells, which the driver holds; each further level cuts every cell
# into so many at most, by bounds that stay in a table.
FIRST, FAN = 1024, 64

TARGET_ROWS = 1_000_000
# Key tuples drawn per cell, and at least, to choose bounds.  Bounds only balance the cells;
# every row gets a cell.
DRAWN_PER_CELL, DRAWN = 8, 20_000
# Long series that are named in a filter; more of them are joined.
_NAMED = 100


def sort_key(df: DataFrame, order: Sequence[str]) -> Column:
    """The order keys as one comparable struct; NULL comes first, NaN last, as in a sort.

    Timestamps are counted in microseconds, so that a key read by the driver compares equal.
    """
    kinds = dict(df.dtypes)
    parts = []
    for i, c in enumerate(order):
        value = col(c)
        if kinds[c] in ("timestamp", "timestamp_ntz"):
            value = F.unix_micros(value.cast("timestamp"))
        parts.append(value.alias(f"k{i}"))
    return F.struct(*parts)


@dataclass(frozen=True)
class Layout:
    """How rows of ``series`` ordered by ``order`` are grouped into cells."""

    order: tuple[str, ...]
    series: tuple[str, ...] = ()
    bounds: tuple[tuple, ...] = ()
    long_series: tuple[tuple, ...] = ()
    finer: tuple[DataFrame, ...] = ()

    @property
    def is_cut(self) -> bool:
        return bool(self.bounds)

    @property
    def keys(self) -> list[str]:
        return [*self.series, CELL]

    def order_cols(self, descending: bool = False) -> list[Column]:
        return [col(c).desc() if descending else col(c).asc() for c in self.order]

    def window(self, descending: bool = False) -> WindowSpec:
        return Window.partitionBy(*[col(k) for k in self.keys]).orderBy(
            *self.order_cols(descending)
        )

    def across_cells(self, descending: bool = False) -> WindowSpec:
        """Cells of one series in order; a series has a bounded number of them."""
        by = [col(c) for c in self.series] or [F.lit(0)]
        return Window.partitionBy(*by).orderBy(col(CELL).desc() if descending else col(CELL))

    def attach(self, df: DataFrame) -> DataFrame:
        """Add the cell number (and the long-series flag where the layout is cut)."""
        if not self.is_cut:
            return df.withColumn(CELL, F.lit(0).cast("long"))
        df = _flag_long(df, self).withColumn(_KEY, sort_key(df, self.order))
        return self._routed(df).withColumn(
            CELL, F.when(col(LONG), col(CELL)).otherwise(0).cast("long")).drop(_KEY)

    def _routed(self, df: DataFrame) -> DataFrame:
        """Add the cell of the key: by the first bounds, a literal, then level by level."""
        kind = T.ArrayType(df.schema[_KEY].dataType)
        one = df.sparkSession.createDataFrame(
            [(list(self.bounds),)], T.StructType([T.StructField(_BOUNDS, kind)]))
        # Spark puts the one array into the expression below; no join, nothing travels with rows.
        df = df.withColumn(_BOUNDS, one.scalar())
        df = df.withColumn(CELL, _place(col(_BOUNDS), len(self.bounds)).cast("long")).drop(_BOUNDS)
        for level in self.finer:
            here = level.withColumnRenamed(CELL, "__up")
            df = df.join(here, col(CELL) == col("__up"), "left").withColumn(
                CELL, col(CELL) * FAN + F.coalesce(_place(col(_BOUNDS), FAN), F.lit(0))
            ).drop("__up", _BOUNDS)
        return df

    def strip(self, df: DataFrame) -> DataFrame:
        return df.drop(CELL, LONG, HALO)


def _place(bounds: Column, most: int) -> Column:
    """Number of sorted ``bounds`` at or below the key, by halving; ``most`` are there at most."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]
    # The bounds are a part of the running value: a lambda that names a column is given a copy.
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.struct(F.lit(0).alias("at"), bounds.alias("b"), col(_KEY).alias("k")),
        lambda x, step: F.struct(
            F.when(F.get(x["b"], x["at"] + step - 1) <= x["k"], x["at"] + step)
            .otherwise(x["at"]).alias("at"), x["b"].alias("b"), x["k"].alias("k")),
        lambda x: x["at"],
    )


def plan_layout(
    df: DataFrame,
    order: Sequence[str],
    series: Sequence[str] = (),
    target_rows: int | None = None,
) -> Layout:
    """Measure the table (key columns only) and decide which series to cut, and where.

    There is one cell per ``target_rows`` (by default a million) rows. The driver holds the long
    series, at most one per cell, and ``FIRST`` bounds; those of further levels are a table.
    """
    order, series = tuple(order), tuple(series)
    target_rows = target_rows or TARGET_ROWS
    total = df.count()
    cells = math.ceil(total / target_rows)
    if cells <= 1:
        return Layout(order, series)
    longs: list[tuple] = []
    if series:
        heavy = (
            df.groupBy(*[col(c) for c in series])
            .agg(F.count(F.lit(1)).alias("__n"))
            .filter(F.col("__n") > target_rows)
            .drop("__n")
        )
        longs = [tuple(r) for r in heavy.collect()]
        if not longs:
            return Layout(order, series)
    keyed = _flag_long(df, Layout(order, series, long_series=tuple(longs))).filter(col(LONG))
    first = min(cells, FIRST)
    keys = keyed.select(sort_key(df, order).alias(_KEY))

    def drawn(per_cell: int, seed: int) -> DataFrame:
        share = min(1.0, max(DRAWN, DRAWN_PER_CELL * per_cell) / total)
        return keys.sample(share, seed=seed) if share < 1 else keys

    found = [tuple(r[_KEY]) for r in drawn(first, 42).orderBy(_KEY).collect()]
    picks = [found[len(found) * i // first] for i in range(1, first)] if found else []
    layout = Layout(order, series, tuple(dict.fromkeys(picks)), tuple(longs))
    made = first
    while made < cells and layout.is_cut:
        cuts = min(FAN, -(-cells // made))
        inside = layout._routed(drawn(made * cuts, 43 + len(layout.finer)))
        spots = [F.get(col("__all"), F.floor(F.size("__all") * F.lit(i / cuts)).cast("int"))
                 for i in range(1, cuts)]
        level = inside.groupBy(CELL).agg(F.sort_array(F.collect_list(_KEY)).alias("__all")).select(
            CELL, F.array_distinct(F.array(*spots)).alias(_BOUNDS))
        layout = replace(layout, finer=(*layout.finer, written(level, "cell-bounds")))
        made *= cuts
    return layout


def _flag_long(df: DataFrame, layout: Layout) -> DataFrame:
    if not layout.series:
        return df.withColumn(LONG, F.lit(True))
    if len(layout.series) == 1 and len(layout.long_series) <= _NAMED:
        values = [v[0] for v in layout.long_series]
        named = [v for v in values if v is not None]
        hit = col(layout.series[0]).isin(named) if named else F.lit(False)
        hit = F.coalesce(hit, F.lit(None in values))
        return df.withColumn(LONG, hit)
    # At most one row per cell, see plan_layout.
    alias = {c: f"__l_{i}" for i, c in enumerate(layout.series)}
    schema = T.StructType(
        [T.StructField(alias[c], df.schema[c].dataType, True) for c in layout.series]
    )
    named = df.sparkSession.createDataFrame(list(layout.long_series), schema)
    cond = reduce(
        lambda a, b: a & b, [col(c).eqNullSafe(col(alias[c])) for c in layout.series]
    )
    flagged = df.join(F.broadcast(named.withColumn(LONG, F.lit(True))), cond, "left")
    return flagged.withColumn(LONG, F.coalesce(col(LONG), F.lit(False))).drop(*alias.values())


def cell_spans(df: DataFrame, layout: Layout) -> DataFrame:
    """Per cell of the cut series: first ordinal, end ordinal (exclusive), series total."""
    counts = (
        df.filter(col(LONG))
        .groupBy(*[col(k) for k in layout.keys])
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    walk = layout.across_cells()
    before = F.sum("__n").over(walk.rowsBetween(Window.unboundedPreceding, -1))
    every = walk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        counts.withColumn("__start", F.coalesce(before, F.lit(0)).cast("long"))
        .withColumn("__end", col("__start") + col("__n"))
        .withColumn("__total", F.sum("__n").over(every))
        .drop("__n")
    )


def join_cells(df: DataFrame, per_cell: DataFrame, layout: Layout) -> DataFrame:
    """Left join a per-cell table; without a series it has at most one row per cell."""
    if not layout.series:
        return df.join(F.broadcast(per_cell), CELL, "left")
    renamed = per_cell.select(
        *[col(k).alias(f"__r_{i}") for i, k in enumerate(layout.keys)],
        *[col(c) for c in per_cell.columns if c not in layout.keys],
    )
    cond = reduce(
        lambda a, b: a & b,
        [col(k).eqNullSafe(col(f"__r_{i}")) for i, k in enumerate(layout.keys)],
    )
    return df.join(renamed, cond, "left").drop(
        *[f"__r_{i}" for i in range(len(layout.keys))]
    )


def add_ordinal(cells: DataFrame, layout: Layout, name: str = "ord") -> DataFrame:
    """0-based position within the series on a frame that already carries cells."""
    if layout.is_cut:
        spans = cell_spans(cells, layout).drop("__end", "__total")
        cells = join_cells(cells, spans, layout)
        offset = F.coalesce(col("__start"), F.lit(0))
    else:
        offset = F.lit(0)
    place = F.row_number().over(layout.window()) - 1
    return cells.withColumn(name, (place + offset).cast("long")).drop("__start")


def with_ordinal(
    df: DataFrame,
    order: Sequence[str],
    series: Sequence[str] = (),
    name: str = "ord",
    layout: Layout | None = None,
    **sizing,
) -> DataFrame:
    """Add the 0-based position of each row within its series."""
    layout = layout or plan_layout(df, order, series, **sizing)
    return layout.strip(add_ordinal(layout.attach(df), layout, name))


def _border_rows(cells: DataFrame, layout: Layout, reach: int, forward: bool) -> DataFrame:
    """Copies of the rows near a cell border, re-labelled with each cell that needs them.

    ``forward`` copies the last rows of a cell into the following cells (look-back);
    otherwise the first rows go into the preceding ones (look-ahead).  A cell may be
    smaller than ``reach``, so a row can serve several cells, at most ``reach`` of them.
    """
    long_rows = cells.filter(col(LONG))
    spans = cell_spans(cells, layout)
    walk = layout.across_cells()
    near = walk.rowsBetween(1, reach) if forward else walk.rowsBetween(-reach, -1)
    edge = "__start" if forward else "__end"
    spans = spans.withColumn(
        "__near", F.collect_list(F.struct(col(CELL).alias("c"), col(edge).alias("e"))).over(near)
    )
    ranked = long_rows.withColumn(
        "__rn", F.row_number().over(layout.window(descending=forward))
    ).filter(col("__rn") <= reach)
    ranked = join_cells(ranked, spans, layout)
    if forward:
        place = col("__end") - col("__rn")
        wanted = F.filter(col("__near"), lambda x: x["e"] <= place + reach)
    else:
        place = col("__start") + col("__rn") - 1
        wanted = F.filter(col("__near"), lambda x: x["e"] > place - reach)
    return (
        ranked.withColumn("__to", F.explode(wanted))
        .withColumn(CELL, col("__to")["c"])
        .drop("__to", "__near", "__rn", "__start", "__end", "__total")
    )


def apply_windows(
    df: DataFrame,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    order: Sequence[str],
    series: Sequence[str] = (),
    inputs: Sequence[str] = (),
    back: int = 0,
    ahead: int = 0,
    layout: Layout | None = None,
    **sizing,
) -> DataFrame:
    """Add window columns that reach at most ``back`` rows behind and ``ahead`` in front.

    ``build(window)`` returns the new columns over the given window; ``inputs`` are the
    columns they read.  The table is shuffled once; only border rows travel twice.
    """
    layout = layout or plan_layout(df, order, series, **sizing)
    cells = layout.attach(df)
    if layout.is_cut and (back or ahead):
        needed = dict.fromkeys([*layout.keys, *layout.order, *inputs, LONG])
        narrow = cells.select(*[col(c) for c in needed])
        borders = []
        if back:
            borders.append(_border_rows(narrow, layout, back, forward=True))
        if ahead:
            borders.append(_border_rows(narrow, layout, ahead, forward=False))
        halo = reduce(lambda a, b: a.unionByName(b), borders).withColumn(HALO, F.lit(True))
        cells = cells.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)
    else:
        cells = cells.withColumn(HALO, F.lit(False))
    out = cells.withColumns(dict(build(layout.window())))
    return layout.strip(out.filter(~col(HALO)))


def row_sorted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Total sort by the order keys (range-partitioned by Spark)."""
    return df.orderBy(*[col(c) for c in order])


def subsample(df, every: int, order, series=(), start: int = 0, **sizing) -> DataFrame:
    """Every ``every``-th row of each series, by position."""
    rows = with_ordinal(df, order, series, "__ord", **sizing)
    return rows.filter(F.pmod(col("__ord") - start, F.lit(every)) == 0).drop("__ord")
