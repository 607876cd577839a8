"""One-pass sufficient statistics: keyed sums of ZᵀZ over all rows.

Executors add up small matrices per Arrow batch; the per-task sums are reduced by a Spark
aggregate, and only one matrix per key (bounded by the number of columns and keys, not by
the rows) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col

Matrix = np.ndarray


def _column(batch: pa.RecordBatch, i: int) -> Matrix:
    return batch.column(i).to_numpy(zero_copy_only=False).astype(float)


SUMS = "k int, part int, shape array<int>, v array<double>"
# Tasks that add up the matrices of all others.
ADDERS = 16
# The key of rows whose key is NULL: a group like any other.
NULL_KEY = -(1 << 31)


def int_key(name: str):
    return F.coalesce(col(name).cast("int"), F.lit(NULL_KEY))


def keyed_sums(
    df: DataFrame,
    columns: Sequence[str],
    block: Callable[[Matrix], dict[int, Matrix]],
    key: str | None = None,
    array: str | None = None,
) -> dict[tuple[int, int], Matrix]:
    """Sum ``block(rows)`` over all rows: {(key value, part number): matrix}.

    ``block`` gets an n×p matrix (an ``array`` column is appended to it) and returns small
    matrices by part number, whose sums over row subsets add up.
    """
    k = F.lit(0) if key is None else int_key(key)
    sel = [k.alias("k"), *[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]]
    if array:
        sel.append(col(array).alias("arr"))
    p = len(columns)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], Matrix] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([_column(batch, i + 1) for i in range(p)])
            if array:
                wide = np.array(batch.column(p + 1).to_pylist(), dtype=float)
                x = np.hstack([x, wide])
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for value in np.unique(keys):
                for part, m in block(x[keys == value]).items():
                    spot = (int(value), part)
                    total[spot] = total[spot] + m if spot in total else m
        yield from batches_of(total)

    return added(df.select(*sel).mapInArrow(sums, SUMS))


def batches_of(total: dict[tuple[int, int], Matrix]) -> Iterator[pa.RecordBatch]:
    for (value, part), m in total.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([value], pa.int32()),
                pa.array([part], pa.int32()),
                pa.array([list(m.shape)], pa.list_(pa.int32())),
                pa.array([m.ravel()], pa.list_(pa.float64())),
            ],
            names=["k", "part", "shape", "v"],
        )


def added(partial: DataFrame) -> dict[tuple[int, int], Matrix]:
    """Sum the matrices that tasks made: whole ones are added in a few tasks, then here.

    What travels is one row per task, key and part, whatever the size of the matrices.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], Matrix] = {}
        for batch in batches:
            keys, parts = (batch.column(i).to_pylist() for i in (0, 1))
            for i, spot in enumerate(zip(keys, parts, strict=True)):
                shape = batch.column(2)[i].values.to_numpy()
                m = batch.column(3)[i].values.to_numpy().reshape(shape)
                total[spot] = total[spot] + m if spot in total else m
        yield from batches_of(total)

    out: dict[tuple[int, int], Matrix] = {}
    for r in partial.repartition(ADDERS).mapInArrow(add, SUMS).collect():
        spot, m = (r["k"], r["part"]), np.array(r["v"]).reshape(r["shape"])
        out[spot] = out[spot] + m if spot in out else m
    return out


def column_means(df: DataFrame, columns: Sequence[str]) -> Matrix:
    row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return np.array([m or 0.0 for m in row], dtype=float)


def gram(
    df: DataFrame, features: Sequence[str], target: str, key: str | None = None,
    shift: Matrix | None = None,
) -> dict[int, Matrix]:
    """Per key the Gram matrix of [1, features…, target], each less its ``shift``."""

    def block(x: Matrix) -> dict[int, Matrix]:
        z = np.hstack([np.ones((len(x), 1)), x if shift is None else x - shift])
        return {0: z.T @ z}

    got = keyed_sums(df, [*features, target], block, key)
    return {k: m for (k, _), m in got.items()}


def unshifted(beta: Matrix, shift: Matrix) -> Matrix:
    """Coefficients (intercept first) for the columns as they were before the shift."""
    out = np.array(beta, dtype=float)
    out[0] += shift[-1] - shift[:-1] @ out[1:]
    return out


def solve_ols(g: Matrix, ridge: float = 0.0) -> Matrix:
    """Coefficients (intercept first) from a Gram matrix of [1, X, y]."""
    a, b = g[:-1, :-1].copy(), g[:-1, -1]
    if ridge:
        a[1:, 1:] += ridge * np.eye(len(a) - 1)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def sse(g: Matrix, beta: Matrix) -> float:
    """Sum of squared errors of ``beta`` on the rows behind the Gram matrix."""
    a, b, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    return max(0.0, float(yy - 2 * beta @ b + beta @ a @ beta))


def sst(g: Matrix) -> float:
    n, sy, yy = g[0, 0], g[0, -1], g[-1, -1]
    return float(yy - sy * sy / n) if n else 0.0
