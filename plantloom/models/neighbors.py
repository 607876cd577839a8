"""Exact nearest neighbours: rows dealt to pivots, searched under triangle-inequality bounds.

Every training row stands in the cell of its nearest pivot. A query first searches the cells
nearest to it, which bounds its k-th distance; after that it visits only cells whose own bound
beats that distance, and there only rows whose distance to the pivot differs from its own by less.
Cells are split into shards and their queries into blocks of bounded size, so a hot cell is many
tasks; each keeps the k best candidates per query, so no pairs are emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.operators.position import cuts_at
from plantloom.session import written

BLOCK = 4096
PIVOTS, PIVOT_ROWS = 256, 2048  # at most so many pivots, one for so many rows


def _best(held, d, ids, labels, k):
    """Merge new candidates into the k best per query (distance, then id)."""
    if held is not None:
        d = np.hstack([held[0], d])
        ids = np.hstack([held[1], np.broadcast_to(ids, (d.shape[0], len(ids)))])
        labels = np.hstack([held[2], np.broadcast_to(labels, (d.shape[0], len(labels)))])
    else:
        ids = np.broadcast_to(ids, d.shape)
        labels = np.broadcast_to(labels, d.shape)
    order = np.lexsort((ids, d), axis=1)[:, :k]
    pick = lambda m: np.take_along_axis(m, order, axis=1)
    return pick(d), pick(ids), pick(labels)


# Training rows of a shard, and those compared at a time.
SHARD, CHUNK = 65_536, 8192
FOUND = "q long, i long, l long, d double, compared long"
SLACK = 1e-7  # of the largest length met; distances are differences of squares


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    sq = (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2 * q @ t.T
    return np.sqrt(np.maximum(sq, 0.0))


def _lists(m: np.ndarray) -> pa.ListArray:
    edge = (np.arange(len(m) + 1) * m.shape[1]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(np.ascontiguousarray(m).ravel()))


def _dealt(batches, pivots: np.ndarray):
    """(id, label, vector, cell, distance to its pivot) of training rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _matrix(batch.column(2))
        d = _distances(v, pivots)
        cell = d.argmin(1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _lists(v), pa.array(cell.astype("int32")),
             pa.array(d[np.arange(len(v)), cell])], names=["i", "l", "v", "c", "p"])


def _visits(batches, pivots: np.ndarray, rows: np.ndarray, radius: np.ndarray, k: int, later: bool):
    """(query, vector, cell, distance to its pivot, limit): the home cells, or all others in reach.

    Home are the nearest cells that hold k rows together. A row of another cell is at least
    d - radius from the query, and at least (d² - d0²) / (2 |p - p0|) by the plane between the
    cell's pivot and the query's nearest one.
    """
    apart = _distances(pivots, pivots)
    for batch in batches:
        if not batch.num_rows:
            continue
        v, limit = _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
        d = _distances(v, pivots)
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(rows[order], axis=1) - rows[order]
        home = np.zeros(d.shape, bool)
        np.put_along_axis(home, order, before < k, axis=1)
        go = home
        if later:
            near = order[:, 0]
            room = limit + SLACK * (1 + np.sqrt((v * v).sum(1)))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (d ** 2 - d[np.arange(len(d)), near][:, None] ** 2) / (2 * apart[near])
            plane[np.isnan(plane)] = -np.inf
            go = ~home & (rows > 0) & (np.maximum(d - radius, plane) <= room[:, None])
        at, cell = np.nonzero(go & (rows > 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), _lists(v[at]), pa.array(cell.astype("int32")),
             pa.array(d[at, cell]), pa.array(limit[at])], names=["q", "v", "c", "p", "t"])


def _searched(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best rows of a shard for each query, and how many it was compared with."""
    if not len(left) or not len(right):
        return pa.table([pa.array([], t) for t in (
            pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())],
            names=["q", "i", "l", "d", "compared"])
    left = left.take(pa.array(np.argsort(left["p"].to_numpy(), kind="stable")))
    right = right.take(pa.array(np.argsort(right["p"].to_numpy(), kind="stable")))
    q_ids, q, at, limit = left["q"].to_numpy(), _matrix(left["v"]), left["p"].to_numpy(), left["t"].to_numpy()
    t, far = _matrix(right["v"]), right["p"].to_numpy()
    ids, labels = right["i"].to_numpy(), right["l"].to_numpy()
    room = limit + SLACK * (1 + np.sqrt((q * q).sum(1)))
    out, compared = [], 0
    for a in range(0, len(q), 256):  # queries of like distance to the pivot look at like rows
        own = slice(a, a + 256)
        lo = np.searchsorted(far, (at[own] - room[own]).min(), "left")
        hi = np.searchsorted(far, (at[own] + room[own]).max(), "right")
        held = None
        for b in range(lo, hi, CHUNK):
            part = slice(b, min(b + CHUNK, hi))
            held = _best(held, _distances(q[own], t[part]), ids[part], labels[part], k)
        if held is not None:
            d, i, lab = held
            n = np.zeros(d.shape, "int64")
            n[:, 0] = hi - lo
            out.append((np.repeat(q_ids[own], d.shape[1]), i.ravel(), lab.ravel(), d.ravel(), n.ravel()))
    joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
    return pa.table([pa.array(x, kind) for x, kind in zip(joined, (
        pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)],
        names=["q", "i", "l", "d", "compared"])


def _first_k(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("q").orderBy("d", "i")
    return found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)


def nearest(
    train: DataFrame,
    queries: DataFrame,
    vector: str,
    label: str,
    train_id: str,
    query_id: str,
    k: int,
    block: int = BLOCK,
    pivot_rows: int = PIVOT_ROWS,
    shard: int = SHARD,
) -> DataFrame:
    """(query_id, neighbor, label, distance, place) of the k nearest training rows.

    At most 256 pivots, one for ``pivot_rows`` rows, by the smallest seeded hashes of the ids;
    they and their cells' sizes and radii are all that the driver holds.
    """
    found = candidates(train, queries, vector, label, train_id, query_id, k, block, pivot_rows, shard)
    return _first_k(found, k).select(
        F.col("q").alias(query_id), F.col("i").alias("neighbor"), F.col("l").alias("label"),
        F.col("d").alias("distance"), "place")


def candidates(train, queries, vector, label, train_id, query_id, k, block, pivot_rows, shard) -> DataFrame:
    """``q, i, l, d, compared``: each query's best rows of every shard it visits.

    ``compared`` is the number of distances that were computed for a query there, once a shard.
    """
    base = train.select(
        col(train_id).cast("long").alias("i"), col(label).cast("long").alias("l"), col(vector).alias("v"))
    asked = queries.select(col(query_id).cast("long").alias("q"),
                           F.transform(col(vector), lambda x: x.cast("double")).alias("v"))
    total = asked.count()
    if not total:
        raise ValueError("no query rows")
    count = base.count()
    wanted = min(PIVOTS, count // pivot_rows)
    if wanted <= 1:  # one cell, where no distance can be spared
        every = [F.lit(0).alias("c"), F.lit(0.0).alias("p")]
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(max(1, n))).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
        lanes, blocks = -(-count // shard), -(-total // block)
        left = asked.select("q", "v", *every, F.lit(float("inf")).alias("t"),
                            deal("q", blocks).alias("b"), each(lanes).alias("s"))
        right = base.select("i", "l", "v", *every, deal("i", lanes).alias("s"), each(blocks).alias("b"))
        return left.groupBy("c", "s", "b").cogroup(right.groupBy("c", "s", "b")).applyInArrow(
            lambda a, b: _searched(a, b, k), FOUND)
    drawn = base.orderBy(F.xxhash64(F.lit(7), "i"), "i").limit(wanted).select("v").toArrow()
    pivots = np.unique(_matrix(drawn["v"]), axis=0) if len(drawn) else np.zeros((1, 1))
    dealt = written(base.mapInArrow(
        lambda it: _dealt(it, pivots), "i long, l long, v array<double>, c int, p double"), "pivot-cells")
    cells = {r.c: r for r in dealt.groupBy("c").agg(
        F.count("*").alias("n"), F.max("p").alias("radius")).collect()}
    rows = np.array([cells[c].n if c in cells else 0 for c in range(len(pivots))])
    radius = np.array([cells[c].radius if c in cells else 0.0 for c in range(len(pivots))])
    shards = F.element_at(F.array(*[F.lit(int(-(-n // shard)) or 1) for n in rows]), F.col("c") + 1)
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("i"), shards).cast("int"))

    def round_(asked: DataFrame, later: bool) -> DataFrame:
        visits = written(asked.mapInArrow(
            lambda it: _visits(it, pivots, rows, radius, k, later),
            "q long, v array<double>, c int, p double, t double"), "pivot-visits")
        sizes = {r.c: r["count"] for r in visits.groupBy("c").count().collect()}
        blocks = F.element_at(F.array(*[
            F.lit(-(-sizes.get(c, 0) // block) or 1) for c in range(len(pivots))]), F.col("c") + 1)
        left = visits.withColumn("b", F.pmod(F.xxhash64("q"), blocks).cast("int")).withColumn(
            "s", F.explode(F.sequence(F.lit(0), shards - 1)))
        met = [c for c, n in sizes.items() if n]
        right = dealt.where(F.col("c").isin(met)).withColumn(
            "b", F.explode(F.sequence(F.lit(0), blocks - 1)))
        return left.groupBy("c", "s", "b").cogroup(right.groupBy("c", "s", "b")).applyInArrow(
            lambda a, b: _searched(a, b, k), FOUND)

    first = written(round_(asked.withColumn("t", F.lit(float("inf"))), False), "pivot-first")
    if len(pivots) == 1:  # all drawn rows are copies
        return first
    limit = _first_k(first, k).groupBy("q").agg(
        F.when(F.count("*") == k, F.max("d")).otherwise(F.lit(float("inf"))).alias("t"))
    return first.union(round_(asked.join(limit, "q").select("q", "v", "t"), True))


def knn_classify(
    train: DataFrame, queries: DataFrame, vector: str, label: str, row_id: str, k: int = 3, **options
) -> DataFrame:
    """(row_id, prediction): majority label of the k nearest rows, ties to the lower label."""
    near = nearest(train, queries, vector, label, row_id, row_id, k, **options)
    votes = near.groupBy(row_id, "label").agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by("label", F.struct(F.col("n"), -F.col("label")))
    return votes.groupBy(row_id).agg(top.alias("prediction"))


def hopkins(
    df: DataFrame, vector: str, row_id: str, share: float = 0.05, seed: int = 42, **options
) -> DataFrame:
    """Hopkins statistic on length-normalised rows: u / (u + w) of nearest distances.

    The uniform points and the sampled rows follow from digests of their numbers and the seed.
    """
    square = lambda x: x.cast("double") * x.cast("double")
    norm = F.sqrt(F.aggregate(col(vector), F.lit(0.0), lambda a, x: a + square(x)))
    unit = F.transform(
        col(vector), lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0))
    )
    rows = df.select(
        col(row_id).cast("long").alias("id"), unit.alias("v"), F.lit(0).alias("label")
    )
    n = rows.count()
    m = int(n * share)
    if m < 1:
        raise ValueError("too few rows for a sample")
    dims = (
        rows.select(F.posexplode("v").alias("j", "x")).groupBy("j")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("j").collect()
    )

    def drawn(*parts) -> Column:
        """A number in [0, 1) that the parts alone decide."""
        digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)

    spots = F.array(*[
        F.lit(d["lo"]) + drawn(F.col("id"), F.lit(d["j"]), F.lit(seed)) * F.lit(d["hi"] - d["lo"])
        for d in dims])
    uniform = rows.sparkSession.range(m).select("id", spots.alias("v"))
    keyed = rows.withColumn("__h", drawn(F.lit("row"), F.col("id"), F.lit(seed)))
    sample = keyed.filter(cuts_at(keyed, ["__h", "id"], [m])[0].before()).select("id", "v")
    near = lambda q, k: nearest(rows, q, "v", "label", "id", "id", k, **options)
    u = near(uniform, 1).agg(F.sum("distance").alias("u"), F.lit(0).alias("__k"))
    # The nearest row of a sampled row is itself.
    w = near(sample, 2).filter("place = 2").agg(
        F.sum("distance").alias("w"), F.lit(0).alias("__k")
    )
    return u.join(w, "__k").select(
        (F.col("u") / (F.col("u") + F.col("w"))).alias("hopkins"), F.lit(m).alias("sampled")
    )
