"""Linear models from Gram sums: OLS, gradient descent, elimination, folds, permutations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.models.gram import (
    SUMS,
    added,
    batches_of,
    column_means,
    gram,
    int_key,
    solve_ols,
    sse,
    sst,
    unshifted,
)

# Rows among which one task shuffles the targets of a permutation test.
BLOCK_ROWS = 50_000


def linear_expr(features: Sequence[str], beta: Sequence[float]) -> Column:
    """Intercept-first coefficients as a column expression."""
    out = F.lit(float(beta[0]))
    for name, b in zip(features, beta[1:]):
        out = out + col(name) * F.lit(float(b))
    return out


def fit_ols(df: DataFrame, features: Sequence[str], target: str) -> np.ndarray:
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, target]])
    shift = column_means(known, [*features, target])
    return unshifted(solve_ols(gram(known, features, target, shift=shift)[0]), shift)


def fit_gradient_descent(
    df: DataFrame, features: Sequence[str], target: str, rate: float = 0.01, steps: int = 150
) -> np.ndarray:
    """Plain gradient descent from zero; each step needs only the Gram matrix."""
    g = gram(df.na.drop(subset=[f"`{c}`" for c in [*features, target]]), features, target)[0]
    a, b, n = g[:-1, :-1], g[:-1, -1], g[0, 0]
    beta = np.zeros(len(b))
    for _ in range(steps):
        beta = beta + rate * 2 * (b - a @ beta) / n
    return beta


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    x = dof / (dof + t * t)
    a, b = dof / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def p_values(g: np.ndarray) -> np.ndarray:
    """OLS p-values (intercept first) from the Gram matrix of [1, X, y]."""
    beta = solve_ols(g)
    n, k = g[0, 0], len(beta)
    dof = n - k
    cov = np.linalg.pinv(g[:-1, :-1]) * (sse(g, beta) / dof)
    se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    return np.array([t_two_sided(b / s, dof) if s > 0 else 0.0 for b, s in zip(beta, se)])


def backward_elimination(
    df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.05
) -> tuple[list[str], list[tuple[str, float]]]:
    """Drop the worst p-value above the threshold until none is left.

    One pass over the data; every refit uses a sub-matrix of the same Gram matrix.
    """
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, target]])
    g = gram(known, features, target, shift=column_means(known, [*features, target]))[0]
    kept, removed = list(range(len(features))), []
    while kept:
        pick = [0, *[i + 1 for i in kept], len(features) + 1]
        p = p_values(g[np.ix_(pick, pick)])[1:]
        worst = int(np.argmax(p))
        if p[worst] <= threshold:
            break
        removed.append((features[kept[worst]], float(p[worst])))
        kept.pop(worst)
    return [features[i] for i in kept], removed


def _fold_betas(grams: dict[int, np.ndarray], ridge: float) -> dict[int, np.ndarray]:
    whole = sum(grams.values())
    return {f: solve_ols(whole - g, ridge) for f, g in grams.items()}


def oof_linear(
    df: DataFrame, features: Sequence[str], target: str, fold: str, ridge: float = 0.0
) -> DataFrame:
    """Out-of-fold predictions: all fold models come from one pass of per-fold Gram sums.

    Rows without a fold are a fold.
    """
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, target]])
    shift = column_means(known, [*features, target])
    betas = _fold_betas(gram(known, features, target, fold, shift), ridge)
    betas = {f: unshifted(b, shift) for f, b in betas.items()}
    if not betas:
        raise ValueError("no complete rows to fit on")
    width = len(features) + 1
    table = F.create_map(
        *[e for f, b in betas.items() for e in (F.lit(f), F.array(*[F.lit(float(v)) for v in b]))]
    )
    mine = F.try_element_at(table, int_key(fold))
    pred = mine[0]
    for j, name in zip(range(1, width), features):
        pred = pred + col(name) * mine[j]
    return known.withColumn("prediction", pred)


def _permuted_sums(
    rows: DataFrame, p: int, n: int, seed: int, shift: np.ndarray
) -> DataFrame:
    """Per block of rows and fold: XᵀX, XᵀY and YᵀY, Y being the target and its ``n`` shuffles.

    Each shuffle is drawn inside the block from (seed, block, shuffle).
    """

    def sums(block: pa.Table) -> pa.Table:
        fold, at = block["fold"].to_numpy(), block["__b"][0].as_py()
        x = np.column_stack([block[f"c{i}"].to_numpy() for i in range(p + 1)]) - shift
        order = np.argsort(block["__h"].to_numpy(), kind="stable")
        fold, x = fold[order], x[order]
        y = x[:, p]
        # Rows by fold, so that a fold is a slice of the rows and of every shuffled target.
        by_fold = np.argsort(fold, kind="stable")
        folds, start = np.unique(fold[by_fold], return_index=True)
        own = [slice(a, b) for a, b in zip(start, [*start[1:], len(fold)], strict=True)]
        z = np.hstack([np.ones((len(x), 1)), x[:, :p]])[by_fold]
        rng = np.random.default_rng([seed, at])
        cross = np.empty((len(folds), p + 1, n + 1))
        square = np.empty((len(folds), 1, n + 1))
        for k in range(n + 1):
            shuffled = y[by_fold] if k == 0 else y[rng.permutation(len(y))[by_fold]]
            for i, rows_of in enumerate(own):
                part = shuffled[rows_of]
                cross[i][:, k] = z[rows_of].T @ part
                square[i][0, k] = part @ part
        out = {}
        for i, f in enumerate(folds):
            mine = z[own[i]]
            out |= {(int(f), 0): mine.T @ mine, (int(f), 1): cross[i], (int(f), 2): square[i]}
        return pa.Table.from_batches(list(batches_of(out)))

    return rows.groupBy("__b").applyInArrow(sums, SUMS)


def permutation_test(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    fold: str,
    keys: Sequence[str],
    n: int = 200,
    ridge: float = 1e-9,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Out-of-fold R² against ``n`` target shuffles under the same folds; p = (ge+1)/(n+1).

    Rows are dealt once, by a seeded hash of their key, to blocks of about ``block_rows``; the
    target is shuffled inside each block, which keeps the test exact. One pass collects, per fold,
    XᵀX, XᵀY and YᵀY for the real and all shuffled targets.
    """
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, target]])
    p = len(features)
    shift = column_means(known, [*features, target])
    blocks = max(1, -(-known.count() // block_rows))
    rows = known.select(
        F.coalesce(col(fold).cast("int"), F.lit(-1)).alias("fold"),
        *[col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, target])],
        F.xxhash64(F.lit(seed), *[col(k) for k in keys]).alias("__h"),
    ).withColumn("__b", F.pmod(F.xxhash64("__h"), F.lit(blocks)))
    got = added(_permuted_sums(rows, p, n, seed, shift))
    folds = sorted({k for k, _ in got})
    xx, xy, yy = (sum(got[f, part] for f in folds) for part in (0, 1, 2))
    errors = np.zeros(n + 1)
    for f in folds:
        a, b, c = got[f, 0], got[f, 1], got[f, 2][0]
        ridge_eye = ridge * np.eye(p + 1)
        beta = np.linalg.lstsq(xx - a + ridge_eye, xy - b, rcond=None)[0]
        errors += c - 2 * (beta * b).sum(axis=0) + (beta * (a @ beta)).sum(axis=0)
    total = yy[0] - xy[0] ** 2 / xx[0, 0]
    scores = 1 - errors / total
    ge = int((scores[1:] >= scores[0]).sum())
    return df.sparkSession.createDataFrame(
        [(float(scores[0]), ge, n, (ge + 1) / (n + 1), float(scores[1:].max()), int(xx[0, 0]))],
        "r2 double, n_as_good int, n_permutations int, p_value double, best_shuffled_r2 double,"
        " n_rows long",
    )


def grams_r2(train, test) -> float:
    """R² on the test Gram matrix of the OLS fit on the training one."""
    spread = sst(test)
    return float("nan") if spread <= 0 else 1 - sse(test, solve_ols(train)) / spread
