"""Approximate nearest neighbours in robust-pruned directed graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.llm.common import table
from plantloom.llm.vectors import build_indexes, search, valid_vectors

DEGREE = 24  # edges of a node after pruning
ROOM = 36  # edges that a node may have before it is pruned again
BEAM = 48
RELAXED = 1.2  # an edge goes if another neighbour is nearer to its end by this factor
BATCH = 256
STEP = 4  # nodes that a search opens at a time


class Graph:
    """A directed graph over the vectors of one shard, entered at the vector nearest the mean."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray):
        self.ids, self.vec = ids, vec
        self.square = (vec ** 2).sum(1)
        n = len(ids)
        rng = np.random.default_rng(n)
        self.entry = int(np.argmin(((vec - vec.mean(0)) ** 2).sum(1)))
        self.edges = np.full((n, ROOM), -1, "int32")
        start = min(8, n - 1)
        if start:  # some random edges so that every node can be reached at first
            self.edges[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            self._insert(order[a: a + BATCH])

    def distances(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each point to its row of nodes."""
        dots = np.matmul(self.vec[nodes], points[:, :, None])[:, :, 0]
        return np.maximum((points ** 2).sum(1)[:, None] + self.square[nodes] - 2 * dots, 0)

    def beam(self, points: np.ndarray, width: int):
        """The ``width`` nearest nodes that a greedy search finds for each point: (nodes, squares)."""
        b, n = len(points), len(self.ids)
        nodes = np.full((b, width), -1, "int64")
        far = np.full((b, width), np.inf)
        opened = np.ones((b, width), bool)
        nodes[:, 0] = self.entry
        far[:, 0] = self.distances(points, nodes[:, :1])[:, 0]
        opened[:, 0] = False
        seen = np.full((b, n), -1, "int32")
        seen[:, self.entry] = 0
        while True:
            waiting = np.where(opened, np.inf, far)
            pick = np.argsort(waiting, axis=1)[:, :STEP]
            use = np.isfinite(np.take_along_axis(waiting, pick, 1))
            live = np.flatnonzero(use.any(1))
            if not len(live):
                return nodes, far
            np.put_along_axis(opened, pick, True, 1)
            near = self.edges[np.where(use, np.take_along_axis(nodes, pick, 1), 0)][live]
            near = np.where(use[live][:, :, None], near, -1).reshape(len(live), -1)
            safe = np.maximum(near, 0)
            new = (near >= 0) & (seen[live[:, None], safe] < 0)
            mark = np.arange(near.shape[1], dtype="int32")[None, :].repeat(len(live), 0)
            lr = live[:, None].repeat(near.shape[1], 1)
            seen[lr[new], safe[new]] = mark[new]
            new &= seen[live[:, None], safe] == mark
            d = np.where(new, self.distances(points[live], safe), np.inf)
            all_nodes = np.concatenate([nodes[live], np.where(new, near, -1)], 1)
            all_far = np.concatenate([far[live], d], 1)
            all_open = np.concatenate([opened[live], ~new], 1)
            top = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            nodes[live] = np.take_along_axis(all_nodes, top, 1)
            far[live] = np.take_along_axis(all_far, top, 1)
            opened[live] = np.take_along_axis(all_open, top, 1)

    def prune(self, own: np.ndarray, nodes: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Diverse neighbours: nearest first, dropping those that a kept one is nearer to."""
        order = np.argsort(far, axis=1, kind="stable")
        nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
        alive = np.isfinite(far) & (nodes >= 0) & (nodes != own[:, None])
        safe = np.where(alive, nodes, 0)
        v = self.vec[safe]
        square = self.square[safe]
        between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        out = np.full((len(own), DEGREE), -1, "int32")
        rows = np.arange(len(own))
        for k in range(DEGREE):
            has = alive.any(1)
            if not has.any():
                break
            first = alive.argmax(1)
            out[has, k] = nodes[rows, first][has]
            covered = RELAXED ** 2 * between[rows, first] <= far
            alive &= ~covered
            alive[rows, first] = False
        return out

    def _insert(self, own: np.ndarray) -> None:
        nodes, far = self.beam(self.vec[own], BEAM)
        old = self.edges[own].astype("int64")
        old_far = np.where(old >= 0, self.distances(self.vec[own], np.maximum(old, 0)), np.inf)
        repeated = (old[:, :, None] == nodes[:, None, :]).any(2)
        old_far[repeated] = np.inf
        kept = self.prune(own, np.concatenate([nodes, old], 1), np.concatenate([far, old_far], 1))
        self.edges[own] = -1
        self.edges[own, :DEGREE] = kept
        source, place = np.nonzero(kept >= 0)
        self._link(kept[source, place].astype("int64"), own[source])

    def _link(self, ends: np.ndarray, back: np.ndarray) -> None:
        """Add the edges end → back, pruning nodes that run out of room."""
        order = np.argsort(ends, kind="stable")
        ends, back = ends[order], back[order]
        have = (self.edges[ends] == back[:, None]).any(1)
        ends, back = ends[~have], back[~have]
        while len(ends):
            who, first = np.unique(ends, return_index=True)
            new = back[first]
            degree = (self.edges[who] >= 0).sum(1)
            full = degree >= ROOM
            if full.any():
                f = who[full]
                now = self.edges[f].astype("int64")
                now_far = self.distances(self.vec[f], now)
                kept = self.prune(f, now, now_far)
                self.edges[f] = -1
                self.edges[f, :DEGREE] = kept
                degree = (self.edges[who] >= 0).sum(1)
            self.edges[who, degree] = new
            rest = np.ones(len(ends), bool)
            rest[first] = False
            ends, back = ends[rest], back[rest]


def look(graph: Graph, ids, vec, least, k: int, beam: int = 4 * BEAM):
    """Nearest nodes of each query that its beam search finds; keys are negative distances."""
    nodes, _ = graph.beam(vec, max(beam, k + 1))
    rows, at = np.nonzero((nodes >= 0) & (graph.ids[np.maximum(nodes, 0)] != ids[:, None]))
    found = nodes[rows, at]
    keys = -np.sqrt(((graph.vec[found] - vec[rows]) ** 2).sum(1))
    near = keys >= least[rows]
    return rows[near], graph.ids[found][near], keys[near]


def nearest(
    df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100,
    k: int = 10,
) -> DataFrame:
    """``query_id, rank, <id_col>, score``: the k nearest vectors found, by Euclidean distance.

    Every shard of about 8192 vectors is one graph: each vector is searched greedily from the
    entry, the candidates are pruned to at most 24 diverse edges, and edges back are added. Each
    query goes through all shards by beam search; distances are those of the original vectors in
    double precision, ties go to the smaller id. Every row is indexed. Rows with a NULL id, a NULL
    or zero vector, or a NULL or non-finite component take no part; vectors of another length than
    the query's are no candidates; repeated ids, few candidates and empty tables as in
    ``exact_topk``. Recall at 10 against brute force is measured in tests/llm.
    """
    rows = valid_vectors(df, id_col, vec_col, zero=False)
    found = search(rows, build_indexes(rows, Graph), every, k, look)
    return found.select("query_id", "rank", F.col("id").alias(id_col), (-F.col("key")).alias("score"))


def op6_robust_graph(spark, sf: str) -> DataFrame:
    """Ten nearest neighbours over all embeddings."""
    return nearest(table(spark, sf, "embeddings"))
