"""Multi-layer perceptron with rectified units and Adam, by rounds of local mini-batch training.

Rows are dealt to lanes of bounded size by a seeded hash of their values, and stored as one blob a
lane. In each round every lane goes once through its rows in seeded mini-batches, starting from
the shared weights and moments; then both are averaged by rows. A table of one lane is plain
sequential Adam. The averages are sums of integers, so reruns agree to the bit, whatever the order
of the tasks; equal rows are dealt by their place, so that copies do not fill one lane.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.models.trees import softmax
from plantloom.session import written

LANE_ROWS = 16_384
UNIT = float(1 << 22)  # the averages' steps are 1 / UNIT of a row's share


@dataclass(frozen=True)
class PerceptronSpec:
    """``tolerance`` and ``patience`` end the training: rounds without that much less loss."""

    hidden: tuple[int, ...] = (25, 25, 25)
    rounds: int = 200
    batch: int = 200
    rate: float = 1e-3
    l2: float = 1e-4
    tolerance: float = 1e-4
    patience: int = 10
    seed: int = 42


def _shapes(spec: PerceptronSpec, p: int, classes: int) -> list[tuple[int, int]]:
    sizes = [p, *spec.hidden, classes]
    return [(a + 1, b) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]


def _layers(flat: np.ndarray, shapes) -> list[np.ndarray]:
    """Views of the layers' weights, the last row being the bias."""
    out, at = [], 0
    for a, b in shapes:
        out.append(flat[at: at + a * b].reshape(a, b))
        at += a * b
    return out


def _first_weights(shapes, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([
        rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a - 1 + b)) for a, b in shapes])


def forward(x: np.ndarray, layers: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Outputs of all layers; the last are the classes' probabilities."""
    out = [x]
    for i, w in enumerate(layers):
        z = out[-1] @ w[:-1] + w[-1]
        out.append(np.maximum(z, 0) if i + 1 < len(layers) else softmax(z))
    return out


def gradient(x, y, flat, shapes, l2: float) -> tuple[float, np.ndarray]:
    """(mean cross entropy, its gradient with the l2 penalty) of a mini-batch."""
    layers, n = _layers(flat, shapes), len(x)
    out = forward(x, layers)
    loss = float(-np.log(np.maximum(out[-1][np.arange(n), y], 1e-300)).mean())
    delta = out[-1].copy()
    delta[np.arange(n), y] -= 1
    grad = np.empty_like(flat)
    parts = _layers(grad, shapes)
    for i in reversed(range(len(layers))):
        parts[i][:-1] = (out[i].T @ delta + l2 * layers[i][:-1]) / n
        parts[i][-1] = delta.mean(0)
        if i:
            delta = (delta @ layers[i][:-1].T) * (out[i] > 0)
    return loss, grad


def _round(x, y, state: np.ndarray, step: int, turn: int, lane: int, shapes, spec) -> np.ndarray:
    """One pass of Adam over a lane: (weights, both moments, mean loss) after it."""
    w, m, v = (s.copy() for s in state)
    order = np.random.default_rng([spec.seed, turn, lane]).permutation(len(x))
    losses = 0.0
    for k, a in enumerate(range(0, len(x), spec.batch), step + 1):
        own = order[a: a + spec.batch]
        loss, g = gradient(x[own], y[own], w, shapes, spec.l2)
        losses += loss * len(own)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= spec.rate * np.sqrt(1 - 0.999 ** k) / (1 - 0.9 ** k) * m / (np.sqrt(v) + 1e-8)
    return np.concatenate([w, m, v, [losses / len(x)]])


@dataclass
class Perceptron:
    spec: PerceptronSpec
    features: list[str]
    shapes: list[tuple[int, int]]
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (by class) and ``prediction``; NULL where a feature is missing."""
        layers = [w.copy() for w in _layers(self.weights, self.shapes)]

        @F.pandas_udf("array<double>")
        def shares(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.array(part.to_list(), dtype=float).reshape(len(part), -1)
                p = forward(np.nan_to_num(x), layers)[-1]
                whole = ~np.isnan(x).any(1)
                yield pd.Series([list(r) if ok else None for r, ok in zip(p, whole, strict=True)])

        row = F.array(*[col(c).cast("double") for c in self.features])
        out = df.withColumn("probability", shares(row))
        top = F.array_position("probability", F.array_max("probability"))
        return out.withColumn("prediction", (top - 1).cast("int"))


def fit_perceptron(
    df: DataFrame, features: Sequence[str], label: str, classes: int,
    spec: PerceptronSpec | None = None, lane_rows: int = LANE_ROWS, **changes,
) -> Perceptron:
    """Classes 0 … ``classes`` - 1 from features that should be scaled; complete rows only."""
    spec = spec or PerceptronSpec(**changes)
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, label]])
    names = [f"c{i}" for i in range(len(features))]
    rows = known.select(*[col(c).cast("double").alias(n) for n, c in zip(names, features, strict=True)],
                        col(label).cast("int").alias("y"))
    lanes = max(1, -(-rows.count() // lane_rows))
    shapes = _shapes(spec, len(features), classes)
    size = sum(a * b for a, b in shapes)

    def packed(part: pa.Table) -> pa.Table:
        x = np.column_stack([part[c].to_numpy() for c in [*names, "y"]]).astype(float)
        x = x[np.lexsort(x.T)]
        return pa.table({"lane": pa.array([part["lane"][0].as_py()], pa.int64()),
                         "n": pa.array([len(x)], pa.int64()), "rows": pa.array([x.tobytes()])})

    spread = F.xxhash64(F.lit(spec.seed), *names, F.monotonically_increasing_id() % lanes)
    table = written(
        rows.withColumn("lane", F.pmod(spread, F.lit(lanes))).groupBy("lane").applyInArrow(
            packed, "lane long, n long, rows binary"), "perceptron-lanes")
    total = table.agg({"n": "sum"}).first()[0]
    if not total:
        raise ValueError("no complete rows to fit on")

    state, step, losses, waited = np.zeros((3, size)), 0, [], 0
    state[0] = _first_weights(shapes, spec.seed)
    per_lane = -(-min(total, lane_rows) // spec.batch)
    for turn in range(spec.rounds):
        sent = df.sparkSession.sparkContext.broadcast(state)

        def trained(batches, sent=sent, step=step, turn=turn):
            sums = np.zeros(3 * size + 1, "int64")
            for batch in batches:
                for lane, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    x = np.frombuffer(raw.as_buffer()).reshape(-1, len(names) + 1)
                    out = _round(x[:, :-1], x[:, -1].astype("int64"), sent.value, step, turn, lane,
                                 shapes, spec)
                    sums += np.rint(out * len(x) * UNIT).astype("int64")
            yield pa.RecordBatch.from_arrays(
                [pa.array([sums], pa.list_(pa.int64()))], names=["s"])

        got = table.mapInArrow(trained, "s array<long>").select(F.posexplode("s").alias("i", "v")).groupBy(
            "i").agg(F.sum("v").alias("v")).toArrow()
        mean = np.zeros(3 * size + 1)
        mean[got["i"].to_numpy()] = got["v"].to_numpy() / UNIT / total
        state, step = mean[:-1].reshape(3, size), step + per_lane
        state[2] = np.maximum(state[2], 0)
        best = min(losses, default=np.inf)
        losses.append(float(mean[-1]))
        waited = 0 if losses[-1] < best - spec.tolerance else waited + 1
        sent.unpersist()
        if waited >= spec.patience:
            break
    return Perceptron(spec, list(features), shapes, state[0], losses)
