"""Cuts by row position without sorting or shuffling the table.

"The first 80 % of the rows" needs only the order key found at one rank.  The key is the whole
tuple of order columns, of any types, compared by Spark; counting passes between pivots drawn
from the rows narrow the interval that holds the rank, and the split is then a plain filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantloom.functions.names import col
from plantloom.operators.order import sort_key

# Rows of an interval that are sorted, and rows drawn from an interval to choose pivots.
SORTED_ROWS = 200_000
PIVOT_SAMPLE = 2_000
# Rows up to which the end of a table is a top-k; it gives the rows that a cut gives.
TOP_ROWS = 10_000


@dataclass(frozen=True)
class Cut:
    """Rows strictly before a point of the order; without a key, all rows or none."""

    key: Column | None = None
    value: Column | None = None
    tie: Column | None = None
    tie_value: int | None = None
    none: bool = False

    def before(self) -> Column:
        if self.key is None:
            return F.lit(not self.none)
        out = self.key < self.value
        if self.tie is not None:
            out = out | ((self.key == self.value) & (self.tie < F.lit(self.tie_value)))
        return out


@dataclass
class _Search:
    """Rows strictly between two keys that still hold a rank."""

    rank: int
    inside: int
    below: int = 0
    low: tuple | None = None
    high: tuple | None = None
    found: tuple | None = None

    def within(self, k: Column, kind: T.StructType) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out &= k > _literal(self.low, kind)
        if self.high is not None:
            out &= k < _literal(self.high, kind)
        return out

    def narrow(self, counted: Sequence[tuple[tuple, int, int]]) -> None:
        """Use (key, rows below it, rows equal to it) of some pivots."""
        end = self.below + self.inside
        for key, start, same in counted:
            if start <= self.rank < start + same:
                self.found = key
            elif start + same <= self.rank and start + same > self.below:
                self.below, self.low = start + same, key
            elif start > self.rank and start < end:
                end, self.high = start, key
        self.inside = end - self.below


def _literal(value: tuple, kind: T.StructType) -> Column:
    """A key tuple as a struct of exactly the key's types."""
    return F.struct(*[
        F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)
    ])


def _keys_at(keys: DataFrame, ranks: Sequence[int], total: int) -> dict[int, tuple]:
    """rank → (key, rows below the key) of the struct column ``k``, by Spark's own order."""
    kind, k = keys.schema["k"].dataType, F.col("k")
    searches, seed = {r: _Search(r, total) for r in ranks}, 42

    def count(pivots: Sequence[tuple]) -> list[tuple[tuple, int, int]]:
        sizes = keys.agg(*[
            F.count_if(op) for p in pivots
            for op in (k < _literal(p, kind), k == _literal(p, kind))
        ]).first()
        return [(p, sizes[2 * i], sizes[2 * i + 1]) for i, p in enumerate(pivots)]

    while wide := [s for s in searches.values() if s.found is None and s.inside > SORTED_ROWS]:
        pivots: dict[tuple, None] = {}
        drawn = keys.withColumn("u", F.rand(seed)).select("k", *[
            (s.within(k, kind) & (F.col("u") < PIVOT_SAMPLE / s.inside)).alias(f"w{i}")
            for i, s in enumerate(wide)])
        drawn = drawn.filter(F.greatest(F.lit(False), *[f"w{i}" for i in range(len(wide))]))
        drawn = drawn.orderBy("k").collect()
        for i, s in enumerate(wide):
            got = [tuple(r.k) for r in drawn if r[f"w{i}"]]
            spot = (s.rank - s.below) / s.inside * len(got)
            reach = 2 * len(got) ** 0.5
            for x in (spot - reach, spot, spot + reach) if got else ():
                pivots[got[min(len(got) - 1, max(0, int(x)))]] = None
        seed += 1
        if pivots:
            counted = count(list(pivots))
            for s in wide:
                s.narrow(counted)
    if left := [s for s in searches.values() if s.found is None]:
        at = F.filter(F.array(*[F.when(s.within(k, kind), i) for i, s in enumerate(left)]), F.isnotnull)
        place = F.row_number().over(Window.partitionBy("i").orderBy("k"))
        ranks = F.array(*[F.lit(s.rank - s.below) for s in left])
        rows = keys.select("k", F.explode(at).alias("i")).withColumn("n", place).filter(
            F.col("n") == F.get(ranks, F.col("i")) + 1).collect()
        for r in rows:
            left[r.i].found = tuple(r.k)
    starts = {p: start for p, start, _ in count(list({s.found: None for s in searches.values()}))}
    return {r: (s.found, starts[s.found]) for r, s in searches.items()}


class TiedRows(ValueError):
    """Equal rows stand on both sides of a position: ``skip`` of those at ``cut`` come before it."""

    def __init__(self, position: int, order: Sequence[str], cut: Cut, equal: Column, skip: int):
        super().__init__(
            f"equal rows on both sides of position {position} in the order {list(order)}")
        self.cut, self.equal, self.skip = cut, equal, skip


def cuts_at(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> list[Cut]:
    """A cut before each position (0-based) of the table in the order of all keys.

    Rows that tie in every key are ordered by a hash of the whole row; a position between equal
    rows has no cut and raises.
    """
    key = sort_key(df, order)
    keys = df.select(key.alias("k"))
    total = keys.count()
    inside = sorted({p for p in positions if 0 < p < total})
    at = _keys_at(keys, inside, total) if inside else {}
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    row_hash = F.xxhash64(*[col(c) for c in plain])
    cuts = {}
    for p in inside:
        value, start = at[p]
        bound = _literal(value, keys.schema["k"].dataType)
        if p == start:
            cuts[p] = Cut(key, bound)
            continue
        ties = df.filter(key == bound).select(F.struct(row_hash.alias("h")).alias("k"))
        (found,), below = _keys_at(ties, [p - start], ties.count())[p - start]
        if below != p - start:
            raise TiedRows(p, order, Cut(key, bound, row_hash, found),
                           (key == bound) & (row_hash == F.lit(found)), p - start - below)
        cuts[p] = Cut(key, bound, row_hash, found)
    return [cuts.get(p, Cut(none=p <= 0)) for p in positions]


def last_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The last ``n`` rows by the order keys, ascending; ties as in :func:`cuts_at`.

    Of equal rows at the border as many are given as are missing.
    """
    ascending = [col(c) for c in order]
    if n <= TOP_ROWS:
        plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        keys = [*[c.desc() for c in ascending], F.xxhash64(*[col(c) for c in plain]).desc()]
        return df.orderBy(*keys).limit(n).orderBy(*ascending)
    try:
        cut = cuts_at(df, order, [df.count() - n])[0]
    except TiedRows as tie:
        later = df.filter(~tie.cut.before() & ~tie.equal)
        times = F.explode(F.sequence(F.lit(1), F.lit(df.filter(tie.equal).count() - tie.skip)))
        one = df.filter(tie.equal).limit(1).withColumn("__time", times).drop("__time")
        return later.unionByName(one).orderBy(*ascending)
    return df.filter(~cut.before()).orderBy(*ascending)


def trailing_slice(
    df: DataFrame, n: int, end: int | None, order: Sequence[str]
) -> DataFrame:
    """``n`` rows that end before position ``end`` (None: the end of the table)."""
    if end is None:
        return last_rows(df, n, order)
    start, stop = cuts_at(df, order, [max(0, end - n), end])
    return df.filter(~start.before() & stop.before()).orderBy(*[col(c) for c in order])
