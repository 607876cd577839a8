"""Kernel support-vector regression by distributed iteratively reweighted least squares.

The loss max(0, |r| - ε) is (|r - ε| + |r + ε|) / 2 - ε, and |t| lies below t²/(2c) + c/2, touching
it at |t| = c. So each step solves a ridge regression whose two weights per row come from the
step before: one pass that lifts rows to random features on the fly and adds up weighted Gram
matrices. The loss never rises. Equal rows are counted once, in the first pass, and stand for all of
them in the steps; nothing but these counts and the matrices is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.models.gram import keyed_sums
from plantloom.models.kernel import KernelSpec, _scaled, basis
from plantloom.operators.scale import Scaler, fit_robust
from plantloom.session import written

SMALLEST = 1e-2  # distance from the tube's edge, in scaled units, below which a weight no longer grows


@dataclass
class SupportVectorModel:
    """Weights of [1, random features] on robustly scaled features and target."""

    spec: KernelSpec
    features: list[str]
    x_scaler: Scaler
    y_centre: float
    y_scale: float
    weights: np.ndarray
    epsilon: float
    losses: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        w, b = self.spec.frequencies(len(self.features))
        weights, centre, scale = self.weights, self.y_centre, self.y_scale

        @F.pandas_udf("double")
        def predicted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(basis(part.to_numpy(dtype=float), w, b) @ weights * scale + centre)

        cols = [self.x_scaler.expr(c).alias(f"f{i}") for i, c in enumerate(self.features)]
        return df.withColumn(name, predicted(F.struct(*cols)))


def _step(rows: DataFrame, p: int, spec: KernelSpec, weights: np.ndarray | None, epsilon: float):
    """(weighted ZᵀZ, weighted Zᵀy, loss of the weights, rows) over all rows, ``__n`` equal ones each."""
    w, b = spec.frequencies(p)

    def block(x: np.ndarray) -> dict[int, np.ndarray]:
        z, y, n = basis(x[:, :p], w, b), x[:, p], x[:, p + 1]
        if weights is None:  # the first step is least squares
            up = down = np.full(len(y), 0.5)
            loss = 0.0
        else:
            r = y - z @ weights
            up = 0.25 / np.maximum(np.abs(r - epsilon), SMALLEST)
            down = 0.25 / np.maximum(np.abs(r + epsilon), SMALLEST)
            loss = float(n @ np.maximum(np.abs(r) - epsilon, 0))
        up, down = up * n, down * n
        target = up * (y - epsilon) + down * (y + epsilon)
        return {0: (z * (up + down)[:, None]).T @ z, 1: (z.T @ target)[:, None],
                2: np.array([[loss, n.sum()]])}

    got = keyed_sums(rows, [*[f"f{i}" for i in range(p)], "__y", "__n"], block)
    if not got:
        raise ValueError("no complete rows to fit on")
    (loss, n), = got[0, 2]
    return got[0, 0], got[0, 1][:, 0], loss, n


def fit_svr(
    df: DataFrame, features: Sequence[str], target: str, spec: KernelSpec | None = None,
    epsilon: float = 0.1, cost: float = 1.0, steps: int = 40, tolerance: float = 1e-6,
) -> SupportVectorModel:
    """ε-insensitive regression on features of an RBF kernel; ``cost`` weighs the loss of a row.

    ``epsilon`` is in units of the target's robust scale. Minimises |w|²/2 + cost · Σ loss; the
    intercept is free. It stops when a step lowers that by less than ``tolerance`` of it. Rows with
    a missing value take no part.
    """
    spec = spec or KernelSpec(nu=None, length_scale=3.0)
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, target]])
    x_scaler, y_scaler = fit_robust(known, features), fit_robust(known, [target])
    rows = _scaled(known, features, target, x_scaler, y_scaler)
    rows = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")), "svr-rows")
    p, weights, losses = len(features), None, []
    penalty = np.eye(spec.width + 1) / (2 * cost)
    penalty[0, 0] = 0
    for _ in range(steps):
        a, b, loss, n = _step(rows, p, spec, weights, epsilon)
        if weights is not None:
            losses.append(loss + float(weights[1:] @ weights[1:]) / (2 * cost))
            if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * max(losses[-2], 1e-12):
                break
        weights = np.linalg.solve(a + penalty + 1e-12 * np.trace(a) / len(a) * np.eye(len(a)), b)
    centre, scale = y_scaler.params[target]
    return SupportVectorModel(
        spec, list(features), x_scaler, float(centre), float(scale), weights, epsilon, losses)
