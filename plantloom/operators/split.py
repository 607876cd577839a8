"""Train/test splits and folds: chronological, stratified, grouped, unit-wise, shuffled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.operators.order import with_ordinal
from plantloom.operators.position import cuts_at


def join_flags(df: DataFrame, flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the per-key columns of ``flags``; NULL is a key like any other."""
    renamed = flags
    for i, c in enumerate(keys):
        renamed = renamed.withColumnRenamed(c, f"__f{i}")
    same = reduce(
        lambda a, b: a & b, [col(c).eqNullSafe(col(f"__f{i}")) for i, c in enumerate(keys)]
    )
    return df.join(renamed, same, "left").drop(*[f"__f{i}" for i in range(len(keys))])


def hash_key(keys: Sequence[str], seed: int = 42) -> Column:
    """Seeded md5 of the row keys: a random order that survives recomputation, in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
                 .cast("binary"))


def chronological_split(
    df: DataFrame,
    order: Sequence[str],
    test_size: float = 0.2,
    name: str = "is_train",
) -> DataFrame:
    """Flag the first int(n·(1-test_size)) rows; a filter predicate, no sort or shuffle."""
    cut = int(df.count() * (1 - test_size))
    return df.withColumn(name, cuts_at(df, order, [cut])[0].before())


def forward_folds(
    df: DataFrame, order: Sequence[str], k: int | None = None, name: str = "block"
) -> DataFrame:
    """Forward-chaining blocks: 0 is only ever trained on, block i is tested after blocks < i."""
    n = df.count()
    k = k or min(3, max(2, n - 1))
    size = n // (k + 1)
    starts = [n - size * (k - i) for i in range(k)]
    block = F.lit(0)
    for cut in cuts_at(df, order, starts):
        block = block + (~cut.before()).cast("int")
    return df.withColumn(name, block)


def random_split(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.3, seed: int = 42,
    name: str = "is_train", **sizing,
) -> DataFrame:
    """Seeded split by rank of the key hash: ceil(n·test_size) test rows."""
    n = df.count()
    n_test = -int(-n * test_size // 1)
    keyed = df.withColumn("__h", hash_key(keys, seed))
    cut = cuts_at(keyed, ["__h", *keys], [n_test])[0]
    return keyed.withColumn(name, ~cut.before()).drop("__h")


def _class_ranked(df, label, order, seed, keys, sizing) -> DataFrame:
    if order:
        return with_ordinal(df, order, [label], "__ord", **sizing)
    keyed = df.withColumn("__h", hash_key(keys, seed))
    return with_ordinal(keyed, ["__h", *keys], [label], "__ord", **sizing).drop("__h")


def stratified_split(
    df: DataFrame,
    label: str,
    test_size: float = 0.2,
    keys: Sequence[str] = (),
    order: Sequence[str] = (),
    seed: int = 42,
    name: str = "is_train",
    **sizing,
) -> DataFrame:
    """Per class the first floor(n·(1-test_size)) rows train: by time order, or by key hash."""
    ranked = _class_ranked(df, label, order, seed, keys, sizing)
    sizes = df.groupBy(col(label)).agg(F.count(F.lit(1)).alias("__n"))
    joined = join_flags(ranked, sizes, [label])
    return joined.withColumn(
        name, F.col("__ord") < F.floor(F.col("__n") * F.lit(1 - test_size))
    ).drop("__ord", "__n")


def unit_split(
    df: DataFrame, unit: str, test_size: float = 0.2, seed: int = 42, name: str = "is_train"
) -> DataFrame:
    """No unit on both sides: a seeded rank over the distinct units decides."""
    units = df.select(col(unit)).distinct().withColumn("__h", hash_key([unit], seed))
    total = units.count()
    ranked = with_ordinal(units, ["__h"], name="__ord")
    flags = ranked.select(unit, (F.col("__ord") >= int(total * test_size)).alias(name))
    return join_flags(df, flags, [unit])


def kfold(
    df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42, name: str = "fold", **sizing
) -> DataFrame:
    """Shuffled folds whose sizes differ by at most one."""
    keyed = df.withColumn("__h", hash_key(keys, seed))
    ranked = with_ordinal(keyed, ["__h", *keys], name="__ord", **sizing)
    return ranked.withColumn(name, (F.col("__ord") % k).cast("int")).drop("__h", "__ord")


def group_folds(
    df: DataFrame, group: str, k: int | None = None, name: str = "fold", **sizing
) -> DataFrame:
    """No group in two folds; groups are dealt out by size, there and back again."""
    sizes = df.groupBy(col(group)).agg(F.count(F.lit(1)).alias("__n"))
    k = min(k or 5, sizes.count())
    keyed = sizes.select(
        group, (-F.col("__n")).alias("__neg"), hash_key([group]).alias("__h")
    )
    ranked = with_ordinal(keyed, ["__neg", "__h"], name="__ord", **sizing)
    lap, seat = F.floor(F.col("__ord") / k), F.col("__ord") % k
    fold = F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")
    return join_flags(df, ranked.select(group, fold.alias(name)), [group])


def sample_cap(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], seed: int = 42
) -> DataFrame:
    """A seeded sample of n rows without replacement, back in row order: a cut in hash order."""
    keyed = df.withColumn("__h", hash_key(keys, seed))
    picked = keyed.filter(cuts_at(keyed, ["__h", *keys], [n])[0].before()).drop("__h")
    return picked.orderBy(*[col(c) for c in order])


def random_row(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return df.orderBy(hash_key(keys, seed)).limit(1)
