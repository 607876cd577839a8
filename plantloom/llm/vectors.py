"""Search of stated queries in sharded vector indexes: blocks of queries meet lanes of shards."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantloom.llm.common import q, stored

SHARD_ROWS = 8192  # vectors of one index
BLOCK_ROWS = 256  # queries that are searched together
LANE_SHARDS = 8  # indexes that one task goes through, sharing its queries' k-th scores


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """``id, vec`` of the rows that take part: no NULL id or vector, every component finite."""
    vec = F.transform(q(vec_col), lambda x: x.cast("double"))
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(q(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.coalesce((F.size("vec") > 0) & ok, F.lit(False)))
    return rows if zero else rows.where(F.exists("vec", lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1)


def build_indexes(rows: DataFrame, build) -> DataFrame:
    """``dim, shard, rows, index``: one pickled index for about 8192 vectors of equal length."""
    n = rows.count()
    shards = -(-n // SHARD_ROWS) or 1

    def one(group: pa.Table) -> pa.Table:
        order = np.argsort(group["id"].to_numpy(), kind="stable")
        ids, vec = group["id"].to_numpy()[order], matrix(group["vec"])[order]
        return pa.table({"dim": pa.array([vec.shape[1]], pa.int32()),
                         "shard": pa.array([group["shard"][0].as_py()], pa.int64()),
                         "index": pa.array([pickle.dumps(build(ids, vec))], pa.binary())})

    keyed = rows.withColumn("dim", F.size("vec")).withColumn(
        "shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)))
    return stored(keyed.groupBy("dim", "shard").applyInArrow(
        one, "dim int, shard long, index binary"), "vec-indexes")


def search(rows: DataFrame, indexes: DataFrame, every: int, k: int, look) -> DataFrame:
    """``query_id, rank, id, score``: the best k per query over all indexes of its dimension.

    Queries are the ids divisible by ``every``. ``look(index, ids, vec, least, k)`` gives for each
    query (its row numbers, ids, keys), larger keys first; ``least`` is the k-th key each query has
    so far, -inf at first. The first lane of indexes is searched before the others, so that those
    start with a k-th key.
    """
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = asked.withColumn("dim", F.size("vec"))
    blocks = -(-asked.count() // BLOCK_ROWS) or 1
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")),
                   "vec-queries")
    ranked = Window.partitionBy("dim").orderBy("shard")
    where = indexes.select("dim", "shard", F.floor(
        (F.row_number().over(ranked) - 1) / LANE_SHARDS).cast("int").alias("lane"))
    placed = stored(indexes.join(where, ["dim", "shard"]), "vec-lanes")
    lanes = placed.groupBy("dim").agg((F.max("lane") + 1).alias("lanes"))
    schema = "query_id long, id long, key double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vec = left["id"].to_numpy(), matrix(left["vec"]) if len(left) else None
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                          "key": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        least = left["least"].to_numpy().copy()
        best = [(np.zeros(0, "int64"), np.zeros(0)) for _ in ids]
        for blob in right["index"]:
            who, found, keys = look(pickle.loads(blob.as_py()), ids, vec, least, k)
            for i in np.unique(who):
                own = who == i
                a = np.concatenate([best[i][0], found[own]])
                b = np.concatenate([best[i][1], keys[own]])
                top = np.lexsort((a, -b))[:k]
                best[i] = a[top], b[top]
                if len(top) == k:
                    least[i] = max(least[i], b[top[-1]])
        return pa.table({
            "query_id": pa.array(np.repeat(ids, [len(a) for a, _ in best])),
            "id": pa.array(np.concatenate([a for a, _ in best])),
            "key": pa.array(np.concatenate([b for _, b in best]))})

    def round_(queries: DataFrame, indexes: DataFrame) -> DataFrame:
        spread = indexes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["dim", "lane", "block"]
        return queries.select(*key, "id", "vec", "least").groupBy(*key).cogroup(
            spread.select(*key, "index").groupBy(*key)).applyInArrow(run, schema)

    first = stored(round_(asked.withColumn("lane", F.lit(0)).withColumn("least", F.lit(-np.inf)),
                          placed.where("lane = 0")), "vec-first")
    kth = first.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count("*") >= k, F.min("key")).alias("kth"))
    later = asked.join(lanes, "dim").where("lanes > 1").join(kth, "id", "left").withColumn(
        "lane", F.explode(F.sequence(F.lit(1), F.col("lanes") - 1))).withColumn(
        "least", F.coalesce("kth", F.lit(-np.inf)))
    both = first.union(round_(later, placed.where("lane > 0")))
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
