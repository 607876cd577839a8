"""Histogram boosting on Spark: regression, classes, out-of-fold scores, permutation tests.

Rows are binned and summed to cells (distinct rows of bins) in one pass; cells are all that the
losses need. Up to ``CELLS`` of them, a counted bound, a model is grown inside one task and many
models (shuffled targets, folds) run side by side. Above it every level of a round is one pass
over the stored cells that adds up gradient sums per (model, node, feature, bin).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.models.gram import SUMS, added, batches_of
from plantloom.models.trees import (
    BoostSpec,
    Trees,
    allowed_features,
    boost,
    boost_many,
    choose,
    descend,
    gradients,
    histogram,
    leaf_values,
    softmax,
    start,
)
from plantloom.operators.quantiles import column_quantiles
from plantloom.session import written

CELLS = 50_000  # cells up to which a model is grown inside one task
HELD = 200_000  # cells that a task sums before it hands them on
BLOCK_ROWS = 50_000  # rows among which one task shuffles targets
SPREAD = 256  # tasks from which on several blocks are shuffled in one
TOGETHER = 16  # shuffled targets that are grown in one task, and the most blocks of one
STORED = 8  # rounds after which the cells are written with their scores


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Per feature the upper edges of its bins: distinct equal-frequency values, the largest left out."""
    probs = [i / (bins - 2) for i in range(bins - 1)] if bins > 2 else [0.5]
    found = column_quantiles(df, list(features), probs)
    return [np.unique([v for v in found[c] if v is not None])[:-1].astype(float) for c in features]


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of rows of values: 0 for NULL and NaN, then 1 + the number of edges below the value."""
    out = np.zeros(values.shape, "uint8")
    for j, e in enumerate(edges):
        known = ~np.isnan(values[:, j])
        out[known, j] = np.searchsorted(e, values[known, j], "left") + 1
    return out


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([
        batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float)
        for c in names])


def _summed(keys: np.ndarray, stats: np.ndarray):
    """(distinct rows of ``keys``, summed ``stats``)."""
    raw = np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel()
    order = np.argsort(raw, kind="stable")
    first = np.flatnonzero(np.append(True, raw[order][1:] != raw[order][:-1])) if len(raw) else []
    return keys[order][first], np.add.reduceat(stats[order], first, axis=0) if len(raw) else stats


def _cell_batch(keys: np.ndarray, stats: np.ndarray, names: Sequence[str], **more) -> pa.RecordBatch:
    packed = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(keys.shape[1]), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays(
        [packed.cast(pa.binary()), *(pa.array(v) for v in more.values()),
         *(pa.array(np.ascontiguousarray(x)) for x in stats.T)], names=["cell", *more, *names])


def cells_of(
    df: DataFrame, features: Sequence[str], label: str, edges: Sequence[np.ndarray],
    classes: int | None = None, fold: Column | None = None,
) -> DataFrame:
    """``cell, fold, n, s0 …``: rows and sums of the label (or rows of each class) per cell and fold.

    Rows without a label, or with a class outside 0 … ``classes`` - 1, take no part.
    """
    names = [f"c{i}" for i in range(len(features))]
    rows = df.where(col(label).isNotNull()).select(
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        col(label).cast("double").alias("y"),
        *[col(c).cast("double").alias(n) for n, c in zip(names, features, strict=True)])
    outputs = [f"s{k}" for k in range(classes or 1)]

    def sums(batches):
        held, stats = np.zeros((0, len(features) + 4), "uint8"), np.zeros((0, len(outputs) + 1))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            fold = batch.column(0).to_numpy(zero_copy_only=False).astype("int32")
            own = np.isfinite(y) if classes is None else np.isin(y, np.arange(classes))
            keys = np.hstack([np.ascontiguousarray(fold).view("uint8").reshape(-1, 4),
                              binned(_matrix(batch, names), edges)])[own]
            s = y[own, None] if classes is None else (y[own, None] == np.arange(classes)) * 1.0
            held, stats = _summed(np.vstack([held, keys]), np.vstack(
                [stats, np.hstack([np.ones((len(s), 1)), s])]))
            if len(held) > HELD:
                yield rows_of(held, stats)
                held, stats = held[:0], stats[:0]
        yield rows_of(held, stats)

    def rows_of(held, stats):
        fold = np.ascontiguousarray(held[:, :4]).view("int32").ravel()
        return _cell_batch(np.ascontiguousarray(held[:, 4:]), stats, ["n", *outputs], fold=fold)

    kinds = ", ".join(f"{c} double" for c in ["n", *outputs])
    return rows.mapInArrow(sums, f"cell binary, fold int, {kinds}").groupBy("cell", "fold").agg(
        *[F.sum(c).alias(c) for c in ["n", *outputs]])


def _pivot(table: pa.Table, folds: Sequence[int], outputs: int):
    """(bins, n by fold, sums by fold) of the distinct cells of a table of cells and folds."""
    raw = np.array(table["cell"].to_pylist(), dtype=object)
    names, at = np.unique(raw, return_inverse=True)
    where = np.searchsorted(folds, table["fold"].to_numpy())
    n = np.zeros((len(folds), len(names)))
    s = np.zeros((len(folds), len(names), outputs))
    np.add.at(n, (where, at), table["n"].to_numpy())
    np.add.at(s, (where, at), np.column_stack([table[f"s{k}"].to_numpy() for k in range(outputs)]))
    return np.frombuffer(b"".join(names), "uint8").reshape(len(names), -1), n, s


@dataclass
class Boosted:
    """Fitted trees: per model (one, or one a fold) its start scores and the trees of each round."""

    features: list[str]
    edges: list[np.ndarray]
    spec: BoostSpec
    folds: list[int]
    base: list[np.ndarray]
    trees: list[list[Trees]]

    def scored(self, df: DataFrame, fold: str | None = None, name: str = "__scores") -> DataFrame:
        """Add the raw scores as an array; with ``fold``, by the model that did not see the row."""
        held = df.sparkSession.sparkContext.broadcast((self.edges, self.base, self.trees))
        where = {f: i for i, f in enumerate(self.folds)}

        def scores(parts):
            edges, base, trees = held.value
            for values, own in parts:
                x = np.array(values.to_list(), dtype=float).reshape(len(values), -1)
                bins, out = binned(x, edges).astype("int64"), np.zeros((len(x), len(base[0])))
                model = own.map(where).to_numpy() if fold else np.zeros(len(x), "int64")
                for m in np.unique(model):
                    at = model == m
                    out[at] = base[m] + sum((t.scores(bins[at]) for t in trees[m]),
                                            np.zeros((int(at.sum()), len(base[m]))))
                yield pd.Series(list(out))

        row = F.array(*[col(c).cast("double") for c in self.features])
        udf = F.pandas_udf(_typed(scores), "array<double>")
        own = F.coalesce(col(fold).cast("int"), F.lit(-1)) if fold else F.lit(0)
        return df.withColumn(name, udf(row, own))

    def predict(self, df: DataFrame, fold: str | None = None) -> DataFrame:
        """Add ``prediction``; for classes also ``probability``, an array that sums to 1."""
        out = self.scored(df, fold)
        if self.spec.loss == "squared":
            return out.withColumn("prediction", F.col("__scores")[0]).drop("__scores")
        top = F.array_max("__scores")
        weights = F.transform("__scores", lambda v: F.exp(v - top))
        total = F.aggregate("__w", F.lit(0.0), lambda a, v: a + v)
        return (
            out.withColumn("__top", top).withColumn("__w", weights)
            .withColumn("prediction", (F.array_position("__scores", F.col("__top")) - 1).cast("int"))
            .withColumn("probability", F.transform("__w", lambda v: v / total))
            .drop("__scores", "__top", "__w"))


def _typed(fn):
    """The iterator form of a pandas UDF of two columns."""
    from collections.abc import Iterator

    def typed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from fn(parts)

    typed.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]],
                             "return": Iterator[pd.Series]}
    return typed


def fit_boosting(
    df: DataFrame, features: Sequence[str], label: str, spec: BoostSpec | None = None,
    classes: int | None = None, fold: str | None = None, cells: int = CELLS, **changes,
) -> Boosted:
    """Boosted trees with second-order gains; with ``fold`` one model per fold, fitted on the others.

    ``classes`` asks for K trees a round on the gradients of the multinomial deviance. Missing
    feature values go to the side that gains more. A NULL fold is a fold. Equal inputs give equal
    trees, whatever the partitioning, up to the rounding of sums.
    """
    spec = spec or BoostSpec(loss="softmax" if classes else "squared", **changes)
    own = F.coalesce(col(fold).cast("int"), F.lit(-1)) if fold else None
    edges = bin_edges(df, features, min(spec.bins, 255))
    table = written(cells_of(df, features, label, edges, classes, own), "boost-cells")
    folds = sorted(r.fold for r in table.select("fold").distinct().collect())
    if not folds:
        raise ValueError("no rows with a label to fit on")
    width, outputs = max(len(e) for e in edges) + 2, classes or 1
    grow = _grown_in_tasks if table.count() <= cells else _grown_by_passes
    base, trees = grow(table, folds, outputs, len(features), width, spec, bool(fold))
    return Boosted(list(features), edges, spec, folds if fold else [0], base, trees)


TREES = "model int, turn int, kind int, shape array<int>, v array<double>"


def _grown_in_tasks(table, folds, outputs, p, width, spec, by_fold):
    """One task a model, over all cells."""
    models = range(len(folds) if by_fold else 1)
    spread = table.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))

    def one(group: pa.Table) -> pa.Table:
        model = group["model"][0].as_py()
        bins, n, s = _pivot(group, folds, outputs)
        if by_fold and len(folds) > 1:
            n, s = n.sum(0) - n[model], s.sum(0) - s[model]
        else:
            n, s = n.sum(0), s.sum(0)
        _, base, trees = boost(bins, n, s, width, spec)
        rows = [(model, -1, 0, [len(base)], base.tolist())]
        for turn, t in enumerate(trees):
            for kind, x in enumerate((t.feature, t.cut, t.missing_left, t.leaf)):
                rows.append((model, turn, kind, list(x.shape), x.astype(float).ravel().tolist()))
        return pa.Table.from_pylist(
            [dict(zip(("model", "turn", "kind", "shape", "v"), r, strict=True)) for r in rows],
            pa.schema([("model", pa.int32()), ("turn", pa.int32()), ("kind", pa.int32()),
                       ("shape", pa.list_(pa.int32())), ("v", pa.list_(pa.float64()))]))

    found = {(r.model, r.turn, r.kind): np.array(r.v).reshape(r["shape"])
             for r in spread.groupBy("model").applyInArrow(one, TREES).collect()}
    kinds = ("int64", "int64", "bool", "float64")
    return ([found[m, -1, 0] for m in models],
            [[Trees(*(found[m, t, k].astype(kind) for k, kind in enumerate(kinds)))
              for t in range(spec.rounds)] for m in models])


def _grown_by_passes(table, folds, outputs, p, width, spec, by_fold):
    """Level by level over the stored cells; their scores are written every few rounds."""
    models = len(folds) if by_fold and len(folds) > 1 else 1
    names = ["n", *[f"s{k}" for k in range(outputs)]]
    totals = {r["fold"]: np.array([r[c] for c in names]) for r in table.groupBy("fold").agg(
        *[F.sum(c).alias(c) for c in names]).collect()}
    everything = sum(totals.values())
    learned = [everything - totals[f] if models > 1 else everything for f in folds[:models]]
    base = [start(x[1:], x[0], spec) for x in learned]
    rows = table.select("*", F.array(*[F.lit(float(v)) for b in base for v in b]).alias("scores"))
    spark, trees, fresh = table.sparkSession, [[] for _ in range(models)], 0

    def state(batch: pa.RecordBatch, new):
        bins = np.frombuffer(b"".join(batch.column("cell").to_pylist()), "uint8").reshape(-1, p)
        bins = bins.astype("int64")
        flat = batch.column("scores").flatten().to_numpy().reshape(len(bins), models, outputs).copy()
        for m in range(models):
            for t in new[m]:
                flat[:, m] += t.scores(bins)
        return bins, flat

    for turn in range(spec.rounds):
        inner = (1 << spec.depth) - 1
        feature = np.zeros((models, outputs, inner), "int64")
        cut = np.full((models, outputs, inner), width)
        left = np.ones((models, outputs, inner), bool)
        g = h = None
        recent = [t[len(t) - fresh:] for t in trees]
        for level in range(spec.depth):
            sent = spark.sparkContext.broadcast((recent, feature, cut, left))

            def sums(batches, sent=sent, level=level):
                total = {}
                new, feature, cut, left = sent.value
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    bins, scores = state(batch, new)
                    fold = batch.column("fold").to_numpy()
                    stats = _matrix(batch, names)
                    for m in range(models):
                        use = fold != folds[m] if models > 1 else np.ones(len(bins), bool)
                        n, s = stats[use, 0], stats[use, 1:]
                        grad, hess = gradients(scores[use, m], n, s, spec)
                        for k in range(outputs):
                            node = np.zeros(int(use.sum()), "int64")
                            for up in range(level):
                                node = descend(bins[use], node, up, feature[m, k], cut[m, k], left[m, k])
                            hist = histogram(bins[use], node, np.stack(
                                [grad[:, k], hess[:, k], n], axis=1), 1 << level, width)
                            key = m * outputs + k, 0
                            total[key] = total[key] + hist if key in total else hist
                yield from batches_of(total)

            got = added(rows.mapInArrow(sums, SUMS))
            own = slice((1 << level) - 1, (1 << (level + 1)) - 1)
            ends = [[choose(got[m * outputs + k, 0], spec, allowed_features(spec, p, turn, k))
                     for k in range(outputs)] for m in range(models)]
            for m in range(models):
                for k in range(outputs):
                    feature[m, k, own], cut[m, k, own], left[m, k, own] = ends[m][k][:3]
            g, h = ([[e[i] for e in row] for row in ends] for i in (3, 4))
        for m in range(models):
            leaf = np.stack([leaf_values(g[m][k], h[m][k], spec) for k in range(outputs)])
            trees[m].append(Trees(feature[m], cut[m], left[m], leaf))
        fresh += 1
        if fresh == STORED and turn + 1 < spec.rounds:
            sent = spark.sparkContext.broadcast([t[len(t) - fresh:] for t in trees])

            def moved(batches, sent=sent):
                for batch in batches:
                    if batch.num_rows:
                        flat = state(batch, sent.value)[1].reshape(batch.num_rows, -1)
                        edge = pa.array((np.arange(len(flat) + 1) * flat.shape[1]).astype("int32"))
                        yield batch.set_column(
                            batch.schema.get_field_index("scores"), "scores",
                            pa.ListArray.from_arrays(edge, pa.array(flat.ravel())))

            rows, fresh = written(rows.mapInArrow(moved, rows.schema), "boost-scores"), 0
    return base, trees


def permutation_test_boosted(
    df: DataFrame, features: Sequence[str], target: str, group: str, keys: Sequence[str],
    n: int = 200, folds: int = 5, spec: BoostSpec | None = None, seed: int = 42,
    block_rows: int = BLOCK_ROWS, cells: int = CELLS,
) -> DataFrame:
    """Out-of-fold R² of boosted trees under grouped folds, against ``n`` shuffles of the target.

    ``r2, n_as_good, n_permutations, p_value, best_shuffled_r2, n_rows, n_groups``; p is
    (as good + 1) / (n + 1). Folds come from ``group_folds``. Rows go once, by a seeded hash of
    ``keys``, to blocks of about ``block_rows``; the target is shuffled inside each block, which
    keeps the test exact, and all shuffled targets are summed to cells in that pass. With at most
    ``cells`` cells all (shuffle, fold) models are grown side by side, one task for a few
    shuffles; with more, shuffles are grown one after the other by passes over the cells.
    Rows with a missing feature or target take no part.
    """
    from plantloom.operators.split import group_folds

    spec = spec or BoostSpec(rounds=200, depth=2, rate=0.05)
    needed = [*features, target]
    known = df.na.drop(subset=[f"`{c}`" for c in needed])
    names = [f"c{i}" for i in range(len(features))]
    slim = known.select(
        col(group).alias("group"), F.xxhash64(F.lit(seed), *[col(k) for k in keys]).alias("h"),
        *[col(c).cast("double").alias(a) for a, c in zip([*names, "y"], needed, strict=True)])
    rows = written(group_folds(slim, "group", folds).drop("group"), "boost-rows")
    groups = slim.agg(F.count_distinct(F.coalesce(F.col("group").cast("string"), F.lit("\0")))).first()[0]
    size = rows.count()
    edges = bin_edges(rows, names, min(spec.bins, 255))
    width = max(len(e) for e in edges) + 2
    blocks, parts = max(1, -(-size // block_rows)), -(-(n + 1) // TOGETHER)
    outputs = [f"s{k}" for k in range(TOGETHER)]

    # Blocks of one task, whose sums leave it as one; small tables keep a task for each block.
    at_once = max(1, min(TOGETHER, blocks // SPREAD))

    def shuffled(some: pa.Table) -> pa.Table:
        at = some["b"].to_numpy()
        keys, sums = np.zeros((0, len(names) + 4), "uint8"), np.zeros((0, n + 2))
        for b in np.unique(at):
            more, own = one_block(some.filter(pa.array(at == b)), int(b))
            keys, sums = _summed(np.vstack([keys, more]), np.vstack([sums, own]))
        fold, out = np.ascontiguousarray(keys[:, :4]).view("int32").ravel(), []
        for part in range(parts):
            mine = sums[:, 1 + part * TOGETHER:1 + (part + 1) * TOGETHER]
            wide = np.zeros((len(keys), TOGETHER + 1))
            wide[:, 0], wide[:, 1:mine.shape[1] + 1] = sums[:, 0], mine
            out.append(_cell_batch(
                np.ascontiguousarray(keys[:, 4:]), wide, ["n", *outputs], fold=fold,
                part=np.full(len(keys), part, "int32")))
        return pa.Table.from_batches(out)

    def one_block(block: pa.Table, b: int):
        """(distinct folds and bins, their rows and the sums of the target and its shuffles)"""
        x = np.column_stack([block[c].to_numpy() for c in names])
        y, fold, h = (block[c].to_numpy() for c in ("y", "fold", "h"))
        order = np.lexsort([*x.T, y, h])
        x, y, fold = x[order], y[order], fold[order].astype("int32")
        keys = np.hstack([np.ascontiguousarray(fold).view("uint8").reshape(-1, 4), binned(x, edges)])
        raw = np.ascontiguousarray(keys).view(f"V{keys.shape[1]}").ravel()
        first, at = np.unique(raw, return_index=True, return_inverse=True)[1:]
        rng = np.random.default_rng([seed, b])
        sums = np.zeros((len(first), n + 2))
        sums[:, 0], sums[:, 1] = np.bincount(at), np.bincount(at, y)
        for k in range(1, n + 1):
            sums[:, k + 1] = np.bincount(at, y[rng.permutation(len(y))])
        return keys[first], sums

    kinds = ", ".join(f"{c} double" for c in ["n", *outputs])
    table = written(
        rows.withColumn("b", F.pmod(F.xxhash64("h"), F.lit(blocks)))
        .groupBy(F.floor(F.col("b") / at_once).alias("g")).applyInArrow(
            shuffled, f"cell binary, fold int, part int, {kinds}")
        .groupBy("part", "cell", "fold").agg(*[F.sum(c).alias(c) for c in ["n", *outputs]]),
        "boost-shuffles")
    square = rows.agg(F.sum(F.col("y") * F.col("y")), F.sum("y")).first()
    dealt = sorted(r.fold for r in rows.select("fold").distinct().collect())
    first = table.where("part = 0")
    if first.count() <= cells:
        errors = _errors_in_tasks(table, dealt, width, spec, n)
    else:
        errors = _errors_by_passes(table, dealt, len(names), width, spec, n)
    if not size:
        raise ValueError("no complete rows to fit on")
    total = square[0] - square[1] ** 2 / size
    scores = 1 - (square[0] + errors) / total if total > 0 else np.full(n + 1, np.nan)
    ge = int((scores[1:] >= scores[0] - 1e-12).sum())
    return df.sparkSession.createDataFrame(
        [(float(scores[0]), ge, n, (ge + 1) / (n + 1), float(scores[1:].max(initial=-np.inf)), size,
          groups)],
        "r2 double, n_as_good int, n_permutations int, p_value double, best_shuffled_r2 double,"
        " n_rows long, n_groups long")


def _held_out_error(scores, n, s) -> float:
    """What the squared error of the rows of some cells is above their sum of squares."""
    return float((scores * (n * scores - 2 * s)).sum())


def _errors_in_tasks(table: DataFrame, folds, width: int, spec: BoostSpec, n: int) -> np.ndarray:
    """One task for a fold and ``TOGETHER`` targets, whose models are grown side by side."""
    spread = table.withColumn("held", F.explode(F.array(*[F.lit(i) for i in range(len(folds))])))

    def some(group: pa.Table) -> pa.Table:
        part, f = group["part"][0].as_py(), group["held"][0].as_py()
        bins, rows, sums = _pivot(group, folds, TOGETHER)
        live = min(TOGETHER, n + 1 - part * TOGETHER)
        sums = sums[:, :, :live]
        scores = boost_many(bins, rows.sum(0) - rows[f], sums.sum(0) - sums[f], width, spec)
        error = (scores * (rows[f][:, None] * scores - 2 * sums[f])).sum(0)
        return pa.table({"k": pa.array(np.arange(live) + part * TOGETHER, pa.int32()),
                         "error": pa.array(error)})

    got = spread.groupBy("part", "held").applyInArrow(some, "k int, error double").collect()
    errors = np.zeros(n + 1)
    for r in sorted(got, key=lambda r: (r.k, r.error)):
        errors[r.k] += r.error
    return errors


def _errors_by_passes(table, folds, p: int, width: int, spec: BoostSpec, n: int) -> np.ndarray:
    errors = np.zeros(n + 1)
    for k in range(n + 1):
        own = table.where(F.col("part") == k // TOGETHER).select(
            "cell", "fold", "n", F.col(f"s{k % TOGETHER}").alias("s0"))
        base, trees = _grown_by_passes(own, folds, 1, p, width, spec, True)

        def error(batches, base=base, trees=trees):
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), "uint8")
                    bins = bins.reshape(-1, p).astype("int64")
                    fold, stats = batch.column(1).to_numpy(), _matrix(batch, ["n", "s0"])
                    for m, f in enumerate(folds[: len(base)]):
                        at = fold == f
                        scores = base[m][0] + sum(t.scores(bins[at])[:, 0] for t in trees[m])
                        total += _held_out_error(scores, *stats[at].T)
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["error"])

        errors[k] = own.mapInArrow(error, "error double").agg(F.sum("error")).first()[0]
    return errors
