"""Exact inner-product search by branch and bound in ball trees."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.llm.common import table
from plantloom.llm.vectors import build_indexes, search, valid_vectors

LEAF = 128  # vectors of a leaf


class BallTree:
    """Nodes (centre, radius, first, end, left, right) over rows reordered so that nodes are runs."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray):
        order = np.arange(len(ids))
        centres, radii, spans, children = [], [], [], []

        def node(a: int, b: int) -> int:
            own = vec[order[a:b]]
            centre = own.mean(0)
            me = len(centres)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())))
            spans.append((a, b))
            children.append((-1, -1))
            return me

        todo = [node(0, len(ids))]
        while todo:
            me = todo.pop()
            a, b = spans[me]
            if b - a <= LEAF or not radii[me]:
                continue
            own = vec[order[a:b]]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            order[a:b] = order[a:b][np.argsort(own[:, axis], kind="stable")]
            middle = (a + b) // 2
            children[me] = node(a, middle), node(middle, b)
            todo += children[me]
        self.ids, self.vec = ids[order], vec[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.spans, self.children = spans, children


def look(tree: BallTree, ids, vec, least, k: int):
    """The tree's best k of each query among those that can reach its k-th score so far.

    Nodes are visited by their bound, centre · query + radius · |query|; a search ends when the
    best bound left is below the k-th score. Ties with it are kept, so equal scores are ranked by
    id later.
    """
    norm = np.sqrt((vec ** 2).sum(1))
    bound = vec @ tree.centres.T + norm[:, None] * tree.radii
    bound += 1e-9 * (np.abs(bound) + norm[:, None] * (tree.radii + 1)) + 1e-9
    exact = np.abs(vec).max() * np.abs(tree.vec).max() * vec.shape[1] < 2.0 ** 52
    points = tree.vec if exact else tree.vec.astype("int64").astype(object)
    out_who, out_ids, out_keys = [], [], []
    for i in range(len(ids)):
        limit, open_ = least[i], [(-bound[i, 0], 0)]
        got_ids, got = np.zeros(0, "int64"), np.zeros(0)
        while open_:
            top, me = heapq.heappop(open_)
            if -top < limit:
                break
            a, b = tree.spans[me]
            left, right = tree.children[me]
            if left >= 0:
                for c in (left, right):
                    if bound[i, c] >= limit:
                        heapq.heappush(open_, (-bound[i, c], c))
                continue
            scores = (points[a:b] @ (vec[i] if exact else vec[i].astype("int64").astype(object)))
            scores = scores.astype("float64")
            keep = (scores >= limit) & (tree.ids[a:b] != ids[i])
            got_ids = np.concatenate([got_ids, tree.ids[a:b][keep]])
            got = np.concatenate([got, scores[keep]])
            if len(got) > k:
                best = np.lexsort((got_ids, -got))[:k]
                got_ids, got = got_ids[best], got[best]
            if len(got) == k:
                limit = max(limit, got.min())
        out_who.append(np.full(len(got), i))
        out_ids.append(got_ids)
        out_keys.append(got)
    return np.concatenate(out_who), np.concatenate(out_ids), np.concatenate(out_keys)


def exact_topk(
    df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024,
    every: int = 100, k: int = 10,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: each query's k largest integer inner products.

    Components become floor(scale · x); queries are the rows whose id is divisible by ``every``,
    candidates all rows with another id. Each shard of about 8192 vectors has a ball tree; a task
    takes a block of queries through its shards and carries their k-th scores on. Ties go to the
    smaller id. Rows with a NULL id, a NULL vector or a NULL or non-finite component take no part;
    vectors of another length than the query's are no candidates; rows that repeat an id are all
    candidates, and as a query such an id asks once, with its smallest vector. Fewer candidates
    than k are all returned; an empty table gives an empty result. Other columns are not read.
    """
    rows = valid_vectors(df, id_col, vec_col, zero=True)
    rows = rows.select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("double"))
                       .alias("vec"))
    found = search(rows, build_indexes(rows, BallTree), every, k, look)
    return found.select("query_id", "rank", F.col("id").alias(id_col),
                        F.col("key").cast("long").alias("score"))


def op5_ball_tree_topk(spark, sf: str) -> DataFrame:
    """Top 10 inner products over all embeddings."""
    return exact_topk(table(spark, sf, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
