"""Probabilistic regressor on inducing points, whose spread grows back to the prior off the data.

Landmarks are centres of the rows (Lloyd steps over all rows, from rows of the smallest hashes).
With k(x) the kernel values to the landmarks and K = L Lᵀ those among them, φ(x) = L⁻¹ k(x) are
features of a Bayesian linear regression; ΦᵀΦ and Φᵀy over all rows are one pass. What the
landmarks cannot explain at x, signal · (1 - |φ(x)|²), is added to the variance there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.models.gram import keyed_sums
from plantloom.models.kernel import KernelModel, KernelSpec, _jitter, _posterior, _scaled, _tune_evidence
from plantloom.operators.scale import Scaler

LLOYD_STEPS = 5


def kernel_values(x: np.ndarray, y: np.ndarray, spec: KernelSpec) -> np.ndarray:
    """Unit kernel of all pairs: Matérn 3/2 or 5/2, or RBF without ``nu``."""
    sq = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    r = np.sqrt(np.maximum(sq, 0)) / spec.length_scale
    if spec.nu is None:
        return np.exp(-r * r / 2)
    if spec.nu == 1.5:
        return (1 + np.sqrt(3) * r) * np.exp(-np.sqrt(3) * r)
    if spec.nu == 2.5:
        return (1 + np.sqrt(5) * r + 5 * r * r / 3) * np.exp(-np.sqrt(5) * r)
    raise ValueError("nu must be 1.5, 2.5 or None")


def landmarks_of(rows: DataFrame, p: int, width: int, steps: int = LLOYD_STEPS) -> np.ndarray:
    """At most ``width`` distinct centres of the columns f0 … of all rows."""
    names = [f"f{i}" for i in range(p)]
    first = rows.select(*names).distinct().orderBy(F.xxhash64(F.lit(42), *names), *names).limit(width)
    centres = np.array([list(r) for r in first.collect()], dtype=float).reshape(-1, p)
    for _ in range(steps if len(centres) == width else 0):
        held = centres

        def block(x: np.ndarray, held=held) -> dict[int, np.ndarray]:
            near = ((held * held).sum(1)[None, :] - 2 * x @ held.T).argmin(1)
            own = np.hstack([np.ones((len(x), 1)), x])
            total = np.zeros((len(held), p + 1))
            np.add.at(total, near, own)
            return {0: total}

        total = keyed_sums(rows, names, block)[0, 0]
        used = total[:, 0] > 0
        centres = np.where(used[:, None], total[:, 1:] / np.maximum(total[:, :1], 1), centres)
    return np.unique(np.round(centres, 12), axis=0)


def whitened(x: np.ndarray, landmarks: np.ndarray, root: np.ndarray, spec: KernelSpec) -> np.ndarray:
    return kernel_values(x, landmarks, spec) @ root.T


@dataclass
class InducingModel(KernelModel):
    landmarks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    root: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    signal: float = 1.0

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``std`` in target units."""
        spec, landmarks, root, signal = self.spec, self.landmarks, self.root, self.signal
        mean, half = self.mean, np.linalg.cholesky(_jitter(self.cov))
        noise, centre, scale = self.noise_var, self.y_centre, self.y_scale

        @F.pandas_udf("mean double, std double")
        def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                phi = whitened(part.to_numpy(dtype=float), landmarks, root, spec)
                rest = signal * np.maximum(1 - (phi * phi).sum(axis=1), 0)
                z = np.hstack([np.ones((len(phi), 1)), phi])
                spread = np.sqrt(((z @ half) ** 2).sum(axis=1) + rest + noise)
                yield pd.DataFrame({"mean": z @ mean * scale + centre, "std": spread * scale})

        cols = [self.x_scaler.expr(c).alias(f"f{i}") for i, c in enumerate(self.features)]
        out = df.withColumn("__k", predict(F.struct(*cols)))
        return (out.withColumn("prediction", col("__k")["mean"])
                .withColumn("std", col("__k")["std"]).drop("__k"))

    @property
    def prior_std(self) -> float:
        """Standard deviation of the target where nothing is known."""
        return float(np.sqrt(self.signal + self.noise_var) * self.y_scale)

    def to_dict(self) -> dict:
        return {**super().to_dict(), "landmarks": self.landmarks.tolist(),
                "root": self.root.tolist(), "signal": self.signal}


def fit_inducing(
    df: DataFrame, features: Sequence[str], target: str, x_scaler: Scaler, y_scaler: Scaler,
    spec: KernelSpec,
) -> InducingModel:
    """Fit on all rows with up to ``spec.width`` landmarks."""
    rows, p = _scaled(df, features, target, x_scaler, y_scaler), len(features)
    landmarks = landmarks_of(rows, p, spec.width)
    if not len(landmarks):
        raise ValueError("no complete rows to fit on")
    k = kernel_values(landmarks, landmarks, spec)
    root = np.linalg.inv(np.linalg.cholesky(k + 1e-8 * np.eye(len(k))))

    def block(x: np.ndarray) -> dict[int, np.ndarray]:
        phi = whitened(x[:, :p], landmarks, root, spec)
        z = np.hstack([np.ones((len(x), 1)), phi, x[:, p:]])
        return {0: z.T @ z}

    g = keyed_sums(rows, [*[f"f{i}" for i in range(p)], "__y"], block)[0, 0]
    signal, noise = _tune_evidence(g, 1.0, spec.noise + spec.alpha)
    mean, cov = _posterior(g, signal, noise)
    centre, scale = y_scaler.params[target]
    return InducingModel(spec, list(features), x_scaler, centre, scale, mean, cov, noise,
                         landmarks, root, signal)
