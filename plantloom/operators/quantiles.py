"""Exact order statistics without a global sort.

Whole-table ranks are found by narrowing: a bounded sample proposes two pivots around each
rank, one counting pass over all rows keeps the interval that holds it, and once few enough
values are left inside they are read exactly.  Every pass is a map-only scan of the needed
columns (Arrow batches, NumPy inside) with a small result, so no data is shuffled.  The
counts decide: an inaccurate pivot only costs another pass, never a wrong value.

Grouped quantiles of a few groups are searched the same way, all groups in one pass; those of many
groups run over cells (``operators.order``) of value counts instead, so a group
that owns a third of the table is still spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantloom.functions.names import col
from plantloom.functions.safe import known
from plantloom.operators.order import (
    LONG,
    Layout,
    cell_spans,
    join_cells,
    plan_layout,
)

# Values that one pass may read to the driver (16 MB of doubles over all its intervals), and
# rows drawn to choose pivots.
EXACT_VALUES = 2_000_000
PIVOT_SAMPLE = 20_000
_COLUMNS_PER_PASS = 32
# Groups whose ranks are searched by counting passes.
FEW_GROUPS = 64


@dataclass
class _Interval:
    """Open interval of one column that still holds the values of some ranks."""

    column: int
    lo: float | None
    hi: float | None
    below: int
    inside: int
    ranks: list[int]

    def inner(self, x: np.ndarray) -> np.ndarray:
        keep = ~np.isnan(x)
        if self.lo is not None:
            keep &= x > self.lo
        if self.hi is not None:
            keep &= x < self.hi
        return x[keep]


def _scan(
    df: DataFrame,
    columns: Sequence[str],
    step: Callable[[int, np.ndarray, np.random.Generator], Iterator[tuple[int, np.ndarray]]],
) -> DataFrame:
    """Map-only pass: ``step(column number, values, random numbers)`` yields (interval, array) per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One sequence a task, whatever its values: batches of equal values draw apart, and a
        # re-run task draws the same rows.
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            ids, arrays = [], []
            for j in range(batch.num_columns):
                x = batch.column(j).to_numpy(zero_copy_only=False).astype(float)
                for i, values in step(j, x, rng):
                    ids.append(i)
                    arrays.append(values)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int32()), pa.array(arrays, pa.list_(pa.float64()))],
                    names=["i", "v"],
                )

    doubles = [col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)]
    return df.select(*doubles).mapInArrow(run, "i int, v array<double>")


def _gather(found: DataFrame, n: int) -> list[np.ndarray]:
    """Sorted values per interval number; the callers bound how many there are."""
    got = found.toArrow()
    parts: list[list[np.ndarray]] = [[] for _ in range(n)]
    values = got.column("v").combine_chunks()
    for i, start, end in zip(
        got.column("i").to_pylist(), values.offsets.to_pylist(), values.offsets.to_pylist()[1:]
    ):
        parts[i].append(values.values.slice(start, end - start).to_numpy(zero_copy_only=False))
    return [np.sort(np.concatenate(p)) if p else np.empty(0) for p in parts]


def _draw(df, columns, intervals: list[_Interval], size: int) -> list[np.ndarray]:
    by_column: dict[int, list[tuple[int, _Interval]]] = {}
    for i, iv in enumerate(intervals):
        by_column.setdefault(iv.column, []).append((i, iv))

    def step(j: int, x: np.ndarray, rng: np.random.Generator):
        for i, iv in by_column.get(j, ()):
            inner = iv.inner(x)
            share = size / iv.inside
            if share < 1 and len(inner):
                inner = inner[rng.random(len(inner)) < share]
            if len(inner):
                yield i, inner

    return _gather(_scan(df, columns, step), len(intervals))


def _pivots(iv: _Interval, drawn: np.ndarray) -> np.ndarray:
    if not len(drawn):
        raise ArithmeticError("no pivot drawn; the counts do not match the frame")
    # Four standard errors of a sampled percentile on either side of the rank.
    slack = 2 / math.sqrt(len(drawn))
    spots = []
    for r in iv.ranks:
        p = (r - iv.below + 0.5) / iv.inside
        spots += [p - slack, p + slack]
    at = np.clip(np.array(spots) * len(drawn), 0, len(drawn) - 1).astype(int)
    return np.unique(drawn[at])


def _counts(df, columns, intervals: list[_Interval], pivots: list[np.ndarray]):
    """Per interval: counts of (below p0, = p0, between, = p1, …, above)."""
    by_column: dict[int, list[tuple[int, _Interval, np.ndarray]]] = {}
    for i, (iv, p) in enumerate(zip(intervals, pivots)):
        by_column.setdefault(iv.column, []).append((i, iv, p))

    def step(j: int, x: np.ndarray, _: np.random.Generator):
        for i, iv, p in by_column.get(j, ()):
            inner = iv.inner(x)
            slot = np.searchsorted(p, inner, "left") + np.searchsorted(p, inner, "right")
            yield i, np.bincount(slot, minlength=2 * len(p) + 1).astype(float)

    sums = (
        _scan(df, columns, step)
        .select("i", F.posexplode("v").alias("slot", "n"))
        .groupBy("i", "slot")
        .agg(F.sum("n").cast("long").alias("n"))
    )
    out = [np.zeros(2 * len(p) + 1, dtype=np.int64) for p in pivots]
    for r in sums.collect():
        out[r["i"]][r["slot"]] = r["n"]
    return out


def _narrowed(iv: _Interval, p: np.ndarray, n: np.ndarray, found: dict) -> list[_Interval]:
    """Settle the ranks that fall on a pivot; keep a smaller interval for the others."""
    edges = np.concatenate([[iv.below], iv.below + np.cumsum(n)])
    left: dict[int, list[int]] = {}
    for r in iv.ranks:
        slot = int(np.searchsorted(edges, r, "right")) - 1
        if slot % 2:
            found[iv.column, r] = float(p[slot // 2])
        else:
            left.setdefault(slot, []).append(r)
    fences = [iv.lo, *p.tolist(), iv.hi]
    return [
        _Interval(iv.column, fences[s // 2], fences[s // 2 + 1], int(edges[s]), int(n[s]), ranks)
        for s, ranks in left.items()
    ]


def _search(df, columns, intervals, exact_values: int, pivot_sample: int) -> dict:
    found: dict[tuple[int, int], float] = {}
    while intervals:
        exact_rows = max(1, exact_values // len(intervals))
        small = [iv for iv in intervals if iv.inside <= exact_rows]
        wide = [iv for iv in intervals if iv.inside > exact_rows]
        if small:
            every = _draw(df, columns, small, exact_rows + 1)
            for iv, values in zip(small, every):
                if len(values) != iv.inside:
                    raise ArithmeticError("the frame changed between two passes")
                for r in iv.ranks:
                    found[iv.column, r] = float(values[r - iv.below])
        intervals = []
        if wide:
            pivots = [_pivots(iv, d) for iv, d in zip(wide, _draw(df, columns, wide, pivot_sample))]
            for iv, p, n in zip(wide, pivots, _counts(df, columns, wide, pivots)):
                intervals += _narrowed(iv, p, n, found)
    return found


def values_at_ranks(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    sizes: Mapping[str, int],
    exact_values: int = EXACT_VALUES,
    pivot_sample: int = PIVOT_SAMPLE,
) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank of each column; ``sizes`` are the non-null counts."""
    out: dict[tuple[str, int], float] = {}
    names = list(ranks)
    for start in range(0, len(names), _COLUMNS_PER_PASS):
        part = names[start:start + _COLUMNS_PER_PASS]
        todo = [
            _Interval(j, None, None, 0, sizes[c], sorted(set(ranks[c])))
            for j, c in enumerate(part)
            if len(ranks[c])
        ]
        got = _search(df, part, todo, exact_values, pivot_sample)
        out.update({(part[j], r): v for (j, r), v in got.items()})
    return out


def _positions(n: int, probs: Sequence[float]) -> list[float]:
    return [p * (n - 1) for p in probs]


def interpolate_at(
    df: DataFrame, positions: Mapping[str, Sequence[float]], sizes: Mapping[str, int], **options
) -> dict[str, list[float | None]]:
    """Linear interpolation between neighbouring order statistics at fractional ranks."""
    ranks = {
        c: {r for h in hs for r in (math.floor(h), math.ceil(h))}
        for c, hs in positions.items()
        if sizes[c]
    }
    at = values_at_ranks(df, {c: sorted(r) for c, r in ranks.items()}, sizes, **options)
    out: dict[str, list[float | None]] = {}
    for c, hs in positions.items():
        if not sizes[c]:
            out[c] = [None] * len(hs)
            continue
        row = []
        for h in hs:
            lo, hi = at[c, math.floor(h)], at[c, math.ceil(h)]
            row.append(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)))
        out[c] = row
    return out


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], **options
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles per column, over its values that are neither NULL nor NaN."""
    if not columns:
        return {}
    row = df.agg(*[F.count(known(col(c))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: row[i] for i, c in enumerate(columns)}
    positions = {c: _positions(sizes[c], probs) for c in columns}
    return interpolate_at(df, positions, sizes, **options)


def _quantiles_of_few(values: DataFrame, by, groups, probs: Mapping[str, float]) -> DataFrame:
    """Each group as a column of its own, that is NULL in the rows of the others."""
    kinds = {c: values.schema[c].dataType for c in by}
    own = [
        reduce(lambda a, b: a & b, [
            col(c).eqNullSafe(F.lit(g[c]).cast(kinds[c])) for c in by])
        for g in groups
    ]
    names = [f"g{i}" for i in range(len(groups))]
    wide = values.select(*[
        F.when(mine, col("__v")).cast("double").alias(n) for n, mine in zip(names, own)])
    found = column_quantiles(wide, names, list(probs.values()))
    schema = T.StructType([
        *[T.StructField(c, kinds[c]) for c in by],
        *[T.StructField(n, T.DoubleType()) for n in probs],
    ])
    rows = [(*[g[c] for c in by], *found[n]) for g, n in zip(groups, names)]
    return values.sparkSession.createDataFrame(rows, schema)


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    layout: Layout | None = None,
    **sizing,
) -> DataFrame:
    """One row per group with the named exact quantiles of ``value``.

    The ranks of up to ``FEW_GROUPS`` groups are searched together by counting passes, so no value
    is shuffled; the values of more groups are counted per group and value, in cells.
    """
    values = df.select(
        *[col(c) for c in by], known(col(value)).alias("__v")
    ).filter(col("__v").isNotNull())
    if layout is None and not sizing:
        groups = values.select(*[col(c) for c in by]).distinct().limit(FEW_GROUPS + 1).collect()
        if len(groups) <= FEW_GROUPS:
            return _quantiles_of_few(values, by, groups, probs)
    layout = layout or plan_layout(values, ["__v"], by, **sizing)
    tally = values.groupBy(*[col(c) for c in by], "__v").agg(F.count(F.lit(1)).alias("__c"))
    cells = layout.attach(tally)
    upto = F.sum("__c").over(layout.window().rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("__c").over(Window.partitionBy(*[col(k) for k in layout.keys]))
    if layout.is_cut:
        spans = cell_spans(layout.attach(values), layout).drop("__end")
        cells = join_cells(cells, spans, layout)
        upto = upto + F.coalesce(col("__start"), F.lit(0))
        whole = F.when(col(LONG), col("__total")).otherwise(whole)
    ranked = cells.withColumn("__upto", upto).withColumn("__all", whole)
    picks = []
    for i, p in enumerate(probs.values()):
        spot = F.lit(float(p)) * (col("__all") - 1)
        for tag, rank in (("f", F.floor(spot)), ("c", F.ceil(spot))):
            hit = (rank >= col("__upto") - col("__c")) & (rank < col("__upto"))
            picks.append(F.max(F.when(hit, col("__v"))).alias(f"__{tag}{i}"))
    found = ranked.groupBy(*[col(c) for c in by]).agg(F.max("__all").alias("__n"), *picks)
    outs = []
    for i, (name, p) in enumerate(probs.items()):
        spot = F.lit(float(p)) * (col("__n") - 1)
        part = spot - F.floor(spot)
        lo, hi = col(f"__f{i}"), col(f"__c{i}")
        outs.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * part).alias(name))
    return found.select(*[col(c) for c in by], *outs)

