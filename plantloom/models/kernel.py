"""Probabilistic regressor: random Fourier features of a kernel + Bayesian linear regression.

The features approximate a Matérn (or RBF) kernel (Rahimi & Recht 2007): frequencies are
Student-t with 2ν degrees of freedom (Gaussian for RBF) over the length scale.  Fitting
needs only ΦᵀΦ and Φᵀy over all rows, so there is no row cap; the solve is D×D.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.models.gram import keyed_sums
from plantloom.operators.scale import Scaler


BLOCK = 1024  # rows whose features are made at a time


@dataclass(frozen=True)
class KernelSpec:
    """Kernel and noise settings of one trial."""

    length_scale: float = 3.0
    nu: float | None = 1.5
    noise: float = 0.01
    alpha: float = 1e-3
    width: int = 128
    seed: int = 42

    def frequencies(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        w = rng.standard_normal((p, self.width)) / self.length_scale
        if self.nu is not None:
            w = w * np.sqrt(2 * self.nu / rng.chisquare(2 * self.nu, self.width))
        return w, rng.uniform(0, 2 * np.pi, self.width)


def basis(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[1, random features]; the features have unit kernel scale."""
    out = np.empty((len(x), w.shape[1] + 1))
    out[:, 0] = 1.0
    z = x @ w
    z += b
    np.cos(z, out=z)
    np.multiply(z, np.sqrt(2.0 / w.shape[1]), out=out[:, 1:])
    return out


def blocks_of(x: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of rows whose features stay in the processor's cache."""
    for a in range(0, len(x), BLOCK):
        yield x[a: a + BLOCK]


@dataclass
class KernelModel:
    spec: KernelSpec
    features: list[str]
    x_scaler: Scaler
    y_centre: float
    y_scale: float
    mean: np.ndarray
    cov: np.ndarray
    noise_var: float

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``std`` in target units."""
        w, b = self.spec.frequencies(len(self.features))
        mean, root = self.mean, np.linalg.cholesky(_jitter(self.cov))
        noise, centre, scale = self.noise_var, self.y_centre, self.y_scale

        @F.pandas_udf("mean double, std double")
        def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = np.empty((2, len(part)))
                for i, x in enumerate(blocks_of(part.to_numpy(dtype=float))):
                    phi = basis(x, w, b)
                    at = slice(i * BLOCK, i * BLOCK + len(x))
                    z = phi @ root
                    out[0, at] = phi @ mean * scale + centre
                    out[1, at] = np.sqrt(np.einsum("ij,ij->i", z, z) + noise) * scale
                yield pd.DataFrame({"mean": out[0], "std": out[1]})

        cols = [self.x_scaler.expr(c).alias(f"f{i}") for i, c in enumerate(self.features)]
        out = df.withColumn("__k", predict(F.struct(*cols)))
        return (
            out.withColumn("prediction", col("__k")["mean"])
            .withColumn("std", col("__k")["std"])
            .drop("__k")
        )

    def to_dict(self) -> dict:
        return {
            "spec": asdict(self.spec),
            "features": self.features,
            "x_scaler": {k: list(v) for k, v in self.x_scaler.params.items()},
            "y_centre": self.y_centre,
            "y_scale": self.y_scale,
            "mean": self.mean.tolist(),
            "cov": self.cov.tolist(),
            "noise_var": self.noise_var,
        }

    @classmethod
    def from_dict(cls, d: dict) -> KernelModel:
        more = ()
        if "landmarks" in d:
            from plantloom.models.inducing import InducingModel

            cls, more = InducingModel, (np.array(d["landmarks"]), np.array(d["root"]), d["signal"])
        return cls(
            KernelSpec(**d["spec"]),
            list(d["features"]),
            Scaler({k: tuple(v) for k, v in d["x_scaler"].items()}),
            d["y_centre"],
            d["y_scale"],
            np.array(d["mean"]),
            np.array(d["cov"]),
            d["noise_var"],
            *more,
        )


def _jitter(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2 + 1e-10 * np.eye(len(m)) * max(1.0, float(np.trace(m)) / len(m))


def _scaled(df: DataFrame, features, target, x_scaler, y_scaler, key=None) -> DataFrame:
    cols = [x_scaler.expr(c).alias(f"f{i}") for i, c in enumerate(features)]
    extra = [col(key).alias(key)] if key else []
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, target]])
    return known.select(*extra, *cols, y_scaler.expr(target).alias("__y"))


def _grams(df, p: int, specs: Sequence[KernelSpec], key: str | None):
    """{(key, trial): Gram of [1, Φ, y]} for all trials in one pass."""
    maps = [s.frequencies(p) for s in specs]

    def block(x: np.ndarray) -> dict[int, np.ndarray]:
        out = {}
        for t, (w, b) in enumerate(maps):
            out[t] = np.zeros((w.shape[1] + 2, w.shape[1] + 2))
            for part in blocks_of(x):
                z = np.hstack([basis(part[:, :p], w, b), part[:, p:]])
                out[t] += z.T @ z
        return out

    return keyed_sums(df, [*[f"f{i}" for i in range(p)], "__y"], block, key)


def _posterior(g: np.ndarray, signal: float, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the weights; the intercept has a wide prior."""
    a, b = g[:-1, :-1], g[:-1, -1]
    prior = np.full(len(b), 1.0 / signal)
    prior[0] = 1e-6
    cov = np.linalg.inv(a / noise + np.diag(prior))
    cov = (cov + cov.T) / 2
    return cov @ b / noise, cov


def _tune_evidence(g: np.ndarray, signal: float, noise: float, steps: int = 30):
    """Fixed-point updates of signal and noise variance (evidence maximisation)."""
    a, b, yy, n = g[:-1, :-1], g[:-1, -1], g[-1, -1], g[0, 0]
    for _ in range(steps):
        mean, cov = _posterior(g, signal, noise)
        used = len(b) - np.trace(cov) / signal
        error = max(float(yy - 2 * mean @ b + mean @ a @ mean), 1e-12)
        noise = float(np.clip(error / max(n - used, 1.0), 1e-6, 1e3))
        signal = float(np.clip(mean[1:] @ mean[1:] / max(used - 1, 1e-3), 1e-3, 1e3))
    return signal, noise


def fit_kernel(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    x_scaler: Scaler,
    y_scaler: Scaler,
    spec: KernelSpec,
) -> KernelModel:
    """Fit on all rows; signal and noise variances follow from the evidence."""
    g = _grams(_scaled(df, features, target, x_scaler, y_scaler), len(features), [spec], None)[0, 0]
    signal, noise = _tune_evidence(g, 1.0, spec.noise + spec.alpha)
    mean, cov = _posterior(g, signal, noise)
    centre, scale = y_scaler.params[target]
    return KernelModel(spec, list(features), x_scaler, centre, scale, mean, cov, noise)


def random_grid(trials: int = 15, width: int = 128, seed: int = 42) -> list[KernelSpec]:
    """Seeded settings over the searched ranges (log-uniform scales, ν in {1.5, 2.5})."""
    rng = np.random.default_rng(seed)

    def log_uniform(lo: float, hi: float) -> float:
        return float(np.exp(rng.uniform(np.log(lo), np.log(hi))))

    return [
        KernelSpec(
            length_scale=log_uniform(1.0, 25.0),
            nu=float(rng.choice([1.5, 2.5])),
            noise=log_uniform(0.001, 0.1),
            alpha=log_uniform(1e-4, 1e-1),
            width=width,
            seed=seed + t,
        )
        for t in range(trials)
    ]


def forward_search(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    x_scaler: Scaler,
    y_scaler: Scaler,
    block: str,
    specs: Sequence[KernelSpec],
) -> list[tuple[KernelSpec, float]]:
    """Mean forward-chaining R² per setting (each fold clamped at -1), best first.

    One pass collects the Gram sums of every (block, trial); a fold's training set is the
    sum of the blocks before it.
    """
    scaled = _scaled(df, features, target, x_scaler, y_scaler, block)
    got = _grams(scaled, len(features), specs, block)
    blocks = sorted({k for k, _ in got})
    results = []
    for t, spec in enumerate(specs):
        scores, past = [], got[blocks[0], t]
        for b in blocks[1:]:
            test = got[b, t]
            mean, _ = _posterior(past, 1.0, spec.noise + spec.alpha)
            err = test[-1, -1] - 2 * mean @ test[:-1, -1] + mean @ test[:-1, :-1] @ mean
            spread = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
            scores.append(max(1 - err / spread, -1.0) if spread > 0 else -1.0)
            past = past + test
        results.append((spec, float(np.mean(scores)) if scores else -1.0))
    return sorted(results, key=lambda r: -r[1])
