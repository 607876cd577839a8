import numpy as np
import pytest

from plantloom.models.perceptron import (
    PerceptronSpec, _first_weights, _round, _shapes, fit_perceptron, gradient,
)


def _rows(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (n, 2))
    x = x[(np.abs(x) > 0.1).all(1)]
    return x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)


def _frame(spark, x, y):
    return spark.createDataFrame(
        [(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "`a.b` double, b double, y int")


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    spec = PerceptronSpec(hidden=(4, 3))
    shapes = _shapes(spec, 2, 3)
    flat, x, y = _first_weights(shapes, 1), rng.normal(size=(7, 2)), rng.integers(0, 3, 7)
    _, g = gradient(x, y, flat, shapes, 0.0)
    for i in range(0, len(flat), 5):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        want = (gradient(x, y, up, shapes, 0.0)[0] - gradient(x, y, down, shapes, 0.0)[0]) / 2e-6
        assert g[i] == pytest.approx(want, abs=1e-6)


def test_crossed_bands_and_equal_reruns(spark):
    x, y = _rows()
    df = _frame(spark, x, y)
    args = dict(rounds=60, rate=1e-2, batch=50)
    one = fit_perceptron(df, ["a.b", "b"], "y", 2, **args)
    out = one.predict(df).toPandas()
    assert (out["prediction"] == out["y"]).mean() > 0.99
    assert np.allclose([sum(p) for p in out["probability"]], 1)
    again = fit_perceptron(df.repartition(9), ["a.b", "b"], "y", 2, **args)
    assert (one.weights == again.weights).all()
    lanes = fit_perceptron(df, ["a.b", "b"], "y", 2, lane_rows=300, **args)
    more = fit_perceptron(df, ["a.b", "b"], "y", 2, lane_rows=300, **args)
    assert (lanes.weights == more.weights).all()
    out = lanes.predict(df).toPandas()
    assert (out["prediction"] == out["y"]).mean() > 0.97


def test_one_lane_is_sequential_adam(spark):
    x, y = _rows(200)
    spec = PerceptronSpec(hidden=(5,), rounds=2, batch=40)
    got = fit_perceptron(_frame(spark, x, y), ["a.b", "b"], "y", 2, spec)
    full = np.column_stack([x, y])
    full = full[np.lexsort(full.T)]
    shapes = _shapes(spec, 2, 2)
    size = sum(a * b for a, b in shapes)
    state, step = np.zeros((3, size)), 0
    state[0] = _first_weights(shapes, spec.seed)
    for turn in range(2):
        out = _round(full[:, :2], full[:, 2].astype(int), state, step, turn, 0, shapes, spec)
        state, step = out[:-1].reshape(3, size), step + -(-len(full) // 40)
    assert np.allclose(got.weights, state[0], atol=1e-6)


def test_edge_cases(spark):
    x, y = _rows(60)
    df = _frame(spark, x, y)
    with pytest.raises(ValueError, match="no complete rows"):
        fit_perceptron(df.limit(0), ["b"], "y", 2)
    model = fit_perceptron(df.union(df.selectExpr("NULL", "b", "y")), ["a.b", "b"], "y", 2, rounds=2)
    got = model.predict(df.selectExpr("NULL AS `a.b`", "b", "y").limit(2)).collect()
    assert all(r.prediction is None and r.probability is None for r in got)
