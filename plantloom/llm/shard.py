"""K-d tree sharding with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantloom.llm.common import q, stored, table
from plantloom.llm.cuts import longs, weighted_cuts
from plantloom.operators.order import with_ordinal

CELL = (1 << 24) - 1  # grid of a dimension
ROWS_PER_RUN = 65_536  # rows that one task numbers


def _coordinate(df: DataFrame, name: str):
    """A number or time as a double, NaN as NULL; of any other column the text, to be ranked."""
    c, kind = q(name), df.schema[name].dataType
    if isinstance(kind, T.NumericType | T.BooleanType):
        x = c.cast("double")
    elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        x = c.cast("timestamp").cast("double")
    else:
        return c.cast("string")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _ranked(base: DataFrame, name: str) -> DataFrame:
    """A text column replaced by its value's place among the sorted distinct values."""
    values = base.where(F.col(name).isNotNull()).select(name).distinct()
    places = stored(with_ordinal(stored(values, "kd-values"), [name], name="_place"), "kd-places")
    return base.join(places, name, "left").withColumn(name, F.col("_place").cast("double")).drop("_place")


def kd_shards(
    df: DataFrame, dims: list[str], *, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None, target_bytes: int | None = None, slack: float = 0.002,
) -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, shard, slot``.

    A node of the tree that holds k leaves is cut along its widest dimension (extent as a share of
    the table's extent) at the weighted quantile floor(k/2)/k, weights being bytes, until each leaf
    is one shard; ``shards`` is given, or follows from ``target_bytes``. Rows equal in the
    dimension are ordered by a hash of the text, then by a hash of the id, so that one hot value
    does not stop the balance. Equal texts take the smallest coordinates among their copies and
    so go together, unless a cut falls into a group that holds over ``slack`` of a leaf's bytes:
    then the group itself is divided. ``slot`` numbers the rows of a shard from 0.

    A text dimension counts by the rank of its whole value among the distinct ones. Size is the UTF-8 bytes of the text plus 1; a NULL text has size 1 and the checksum of no
    bytes. NULL, NaN and infinite coordinates count as the smallest value. Repeated rows are kept.
    An empty table gives an empty result. Other columns are not looked at. Driver state is one
    entry per node of the tree, so it is bounded by ``shards``.
    """
    raw = F.coalesce(q(text_col), F.lit("")).cast("binary")
    names = [f"_c{i}" for i in range(len(dims))]
    base = df.select(
        q(id_col).alias("_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(q(text_col)).alias("_hash"),
        *[_coordinate(df, d).alias(n) for d, n in zip(dims, names, strict=True)])
    base = stored(base, "kd-rows")
    texts = [n for n in names if base.schema[n].dataType == T.StringType()]
    if texts:
        for n in texts:
            base = _ranked(base, n)
        base = stored(base, "kd-ranked")
    ends = base.agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"),
        *[f(n).alias(f"{f.__name__}{n}") for n in names for f in (F.min, F.max)],
    ).first()
    if shards is None:
        shards = max(1, math.ceil((ends["bytes"] or 0) / target_bytes))
    cells = []
    for n in names:
        lo, hi = ends[f"min{n}"], ends[f"max{n}"]
        wide = hi is not None and hi > lo
        cells.append((F.floor((F.col(n) - lo) / (hi - lo) * (CELL - 1)) + 1 if wide
                      else F.lit(1)).cast("long"))
    grid = base.select("_id", "size", "text_crc32", "_hash", *[
        F.when(F.col(n).isNull(), 0).otherwise(c).alias(n) for n, c in zip(names, cells, strict=True)
    ])
    same = ["_hash", "text_crc32", "size"]
    copies = grid.groupBy(*same).agg(
        F.count("*").alias("_n"), *[F.min(n).alias(f"_g{n}") for n in names]
    ).where("_n > 1").drop("_n")
    points = stored(grid.join(copies, same, "left").select(
        "_id", "size", "text_crc32",
        *[F.coalesce(f"_g{n}", n).alias(n) for n in names],
        (F.shiftright("_hash", 20).bitwiseAND(CELL) * 4096
         + F.xxhash64("_id").bitwiseAND(4095)).alias("_tie"),
    ), "kd-points")

    total = ends["bytes"] or 0
    leaves, node = [shards], F.lit(0)
    while max(leaves) > 1:
        at = points.withColumn("node", node.cast("int"))
        extents = {r.node: r for r in at.groupBy("node").agg(
            F.sum("size").alias("w"),
            *[(F.max(n) - F.min(n)).alias(f"x{n}") for n in names],
        ).collect()}
        widest, needs = [], []
        for i, k in enumerate(leaves):
            e = extents.get(i)
            widest.append(max(range(len(names)), key=lambda d: e[f"x{names[d]}"]) if e and names
                          else 0)
            needs.append(e.w * (k // 2) // k if e and k > 1 else None)
        which = F.element_at(longs(widest), F.col("node") + 1).cast("int")
        axis = F.element_at(F.array(*[F.col(n) for n in names]), which + 1) if names else F.lit(0)
        keyed = at.select("node", (axis * (1 << 36) + F.col("_tie")).alias("key"),
                          F.col("size").alias("weight"))
        cuts = weighted_cuts(keyed, needs, int(slack * total / shards))
        at_node = node.cast("int") + 1
        which = F.element_at(longs(widest), at_node).cast("int")
        axis = F.element_at(F.array(*[F.col(n) for n in names]), which + 1) if names else F.lit(0)
        right = axis * (1 << 36) + F.col("_tie") > F.element_at(longs(cuts), at_node)
        points = stored(points.withColumn("_node", (node * 2 + right.cast("int")).cast("int"))
                        if "_node" not in points.columns
                        else points.withColumn("_node", (F.col("_node") * 2 + right.cast("int"))
                                               .cast("int")), "kd-level")
        node = F.col("_node")
        leaves = [x for k in leaves for x in ((k // 2, k - k // 2) if k > 1 else (k, 0))]
    first = [sum(leaves[:i]) for i in range(len(leaves))]
    placed = points.withColumn("shard", F.element_at(longs(first), node.cast("int") + 1).cast("int"))
    return _numbered(placed, ends["n"], shards).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot"
    )


def _numbered(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """``slot``: the rows of a shard from 0, numbered in runs of bounded size."""
    runs = 1 + rows // (shards * ROWS_PER_RUN)
    placed = placed.withColumn("run", F.pmod(F.xxhash64("_id", "_tie"), F.lit(runs)).cast("int"))
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).select(
        "shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "run").orderBy("_tie", "_id"))
    return placed.withColumn("at", inside).join(starts, ["shard", "run"]).withColumn(
        "slot", (F.col("start") + F.col("at") - 1).cast("long"))


def op1_kd_shards(spark, sf: str) -> DataFrame:
    """All documents in 16 shards of near-equal bytes."""
    return kd_shards(table(spark, sf, "documents"), ["n_chars", "source", "lang"], shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
