import numpy as np
import pytest

from plantloom.models.boosting import BoostSpec, cells_of, bin_edges, fit_boosting, permutation_test_boosted
from plantloom.models.trees import boost, boost_many, choose, histogram


def plain_best(bins, g, h, spec):
    """(gain, feature, cut, missing left) of the best split by trying all."""
    out = []
    for j in range(bins.shape[1]):
        for cut in range(1, int(bins.max()) + 1):
            for left in (True, False):
                to_left = np.where(bins[:, j] == 0, left, bins[:, j] <= cut)
                if to_left.all() or not to_left.any():
                    continue
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + spec.l2)
                gain = 0.5 * (part(to_left) + part(~to_left) - g.sum() ** 2 / (h.sum() + spec.l2))
                out.append((gain, -j, -cut, left))
    return max(out)


@pytest.mark.parametrize("seed", range(6))
def test_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0 if seed % 2 else 1, 6, (60, 3))
    g, h = rng.normal(size=60), rng.uniform(0.1, 1, 60)
    spec = BoostSpec(l2=0.3)
    hist = histogram(bins, np.zeros(60, "int64"), np.stack([g, h, np.ones(60)], 1), 1, 8)
    feature, cut, left, gs, hs = choose(hist, spec, np.ones(3, bool))
    gain, j, c, side = plain_best(bins, g, h, spec)
    to_left = np.where(bins[:, feature[0]] == 0, left[0], bins[:, feature[0]] <= cut[0])
    got = 0.5 * (gs[0] ** 2 / (hs[0] + 0.3) + gs[1] ** 2 / (hs[1] + 0.3)
                 - g.sum() ** 2 / (h.sum() + 0.3))
    assert got == pytest.approx(gain) and gs[0] == pytest.approx(g[to_left].sum())
    no = choose(hist, BoostSpec(l2=0.3, gamma=gain + 1e-6), np.ones(3, bool))
    assert no[4][1] == 0 and no[3][0] == pytest.approx(g.sum())


def test_models_side_by_side_are_those_one_by_one():
    rng = np.random.default_rng(0)
    bins, n = rng.integers(0, 9, (80, 3)), rng.integers(0, 4, 80).astype(float)
    sums = rng.normal(size=(80, 5)) * n[:, None]
    spec = BoostSpec(rounds=15, depth=3, rate=0.2, l2=0.2, min_rows=2)
    many = boost_many(bins, n, sums, 10, spec)
    for k in range(5):
        one, _, _ = boost(bins, n, sums[:, k: k + 1], 10, spec)
        assert np.allclose(one[:, 0], many[:, k], atol=1e-9)


def _frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 7, (n, 3)).astype(float)
    y = 2 * (x[:, 0] > 3) * (x[:, 1] > 2) + 0.5 * x[:, 2] + rng.normal(0, 0.2, n)
    rows = [(i, int(i % 5), int(i % 37), *(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(r)),
             float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(
        rows, "id long, fold int, hole int, a double, `b.c` double, d double, y double")


FEATURES = ["a", "b.c", "d"]


def test_tasks_and_passes_and_partitionings_agree(spark):
    df = _frame(spark)
    spec = BoostSpec(rounds=11, depth=3, rate=0.3, l2=0.1, columns=0.7)
    scores = []
    for frame, cells in ((df, 10 ** 6), (df.repartition(13), 10 ** 6), (df, 0)):
        model = fit_boosting(frame, FEATURES, "y", spec, fold="fold", cells=cells)
        out = model.predict(df, "fold").orderBy("id").toPandas()["prediction"].to_numpy()
        scores.append(out)
    assert np.allclose(scores[0], scores[1], atol=1e-9) and np.allclose(scores[0], scores[2], atol=1e-9)
    y = df.orderBy("id").toPandas()["y"].to_numpy()
    assert 1 - ((y - scores[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.75


def test_fold_models_do_not_see_their_fold(spark):
    df = _frame(spark, 400)
    spec = BoostSpec(rounds=5, depth=2)
    model = fit_boosting(df, FEATURES, "y", spec, fold="fold")
    rest = fit_boosting(df.where("fold <> 2"), FEATURES, "y", spec)
    rest.edges = model.edges
    cells = cells_of(df.where("fold <> 2"), FEATURES, "y", bin_edges(df, FEATURES, 64))
    rows = cells.toPandas()
    bins = np.frombuffer(b"".join(bytes(c) for c in rows["cell"]), "uint8").reshape(-1, 3)
    width = max(map(len, model.edges)) + 2
    _, base, _ = boost(bins, rows["n"].to_numpy(), rows[["s0"]].to_numpy(), width, spec)
    assert model.base[2][0] == pytest.approx(base[0])
    null = df.selectExpr("*", "IF(fold = 2, NULL, fold) AS f2")
    out = fit_boosting(null, FEATURES, "y", spec, fold="f2").predict(null, "f2")
    assert out.count() == 400 and out.where("prediction IS NULL").count() == 0


def test_classes_that_one_against_rest_confuses(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 10, (4000, 2)).astype(float)
    c = ((x[:, 0] > 4) ^ (x[:, 1] > 4)).astype(int) + 2 * ((x[:, 0] == 9) & (x[:, 1] > 4))
    c = np.minimum(c, 2)
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, c, strict=True)],
                               "a double, b double, c int")
    for cells in (10 ** 6, 0):
        model = fit_boosting(df, ["a", "b"], "c", classes=3, rounds=20, depth=3, rate=0.3, cells=cells)
        out = model.predict(df).toPandas()
        assert (out["prediction"] == out["c"]).all()
        p = np.array(out["probability"].tolist())
        assert np.allclose(p.sum(1), 1) and (p >= 0).all() and (p.max(1) > 0.8).all()


def test_missing_values_learn_their_side(spark):
    rows = [(float(i % 10) if i % 3 else None, 10.0 if i % 3 == 0 or i % 10 > 6 else 2.0)
            for i in range(900)]
    df = spark.createDataFrame(rows, "a double, y double")
    model = fit_boosting(df, ["a"], "y", rounds=1, depth=1, rate=1.0, l2=0.5)
    got = {r.a: r.prediction for r in model.predict(df).distinct().collect()}
    y = np.array([r[1] for r in rows])
    high = y > 5
    for side, key in ((high, None), (~high, 3.0)):
        want = y.mean() + (y[side] - y.mean()).sum() / (side.sum() + 0.5)
        assert got[key] == pytest.approx(want)
    assert got[9.0] == got[None]


def test_edge_cases(spark):
    df = _frame(spark, 50)
    with pytest.raises(ValueError, match="no rows"):
        fit_boosting(df.limit(0), FEATURES, "y")
    flat = fit_boosting(df.selectExpr("1.0 AS a", "y"), ["a"], "y", rounds=2)
    got = flat.predict(df.selectExpr("1.0 AS a", "y")).agg({"prediction": "avg", "y": "avg"}).first()
    assert got[0] == pytest.approx(got[1])


def test_permutations_find_a_planted_signal(spark):
    df = _frame(spark, 1200).fillna(0.0)
    spec = BoostSpec(rounds=10, depth=2, rate=0.3, bins=16)
    args = dict(group="hole", keys=["id"], n=20, spec=spec)
    a = permutation_test_boosted(df, FEATURES, "y", **args).first()
    assert a.r2 > 0.6 and a.n_as_good == 0 and a.p_value == pytest.approx(1 / 21)
    assert a.best_shuffled_r2 < 0.1 and (a.n_rows, a.n_groups) == (1200, 37)
    b = permutation_test_boosted(df.repartition(7), FEATURES, "y", **args).first()
    assert b.n_as_good == 0 and b.r2 == pytest.approx(a.r2, abs=1e-9)
    assert b.best_shuffled_r2 == pytest.approx(a.best_shuffled_r2, abs=1e-9)
    few = dict(args, n=2, spec=BoostSpec(rounds=3, depth=2, rate=0.3, bins=16))
    one = permutation_test_boosted(df, FEATURES, "y", **few).first()
    two = permutation_test_boosted(df, FEATURES, "y", **few, cells=0).first()
    assert one.r2 == pytest.approx(two.r2) and one.best_shuffled_r2 == pytest.approx(two.best_shuffled_r2)
    null = permutation_test_boosted(
        df.selectExpr("*", "pmod(xxhash64(id), 1000) / 1000.0 AS z"), FEATURES, "z", **args).first()
    assert null.p_value > 0.05


def test_blocks_of_one_task_give_the_same_permutation_test(spark, monkeypatch):
    from plantloom.models import boosting

    df = spark.range(3000).selectExpr(
        "id", "id % 40 AS g", "CAST(id % 11 AS DOUBLE) AS x", "IF(id % 11 < 4, 1D, 2D) + id * 7919 % 5 AS y")
    sizes = []
    for spread in (256, 1):  # with 1 task, the 6 blocks are in one
        monkeypatch.setattr(boosting, "SPREAD", spread)
        sizes.append(boosting.permutation_test_boosted(
            df, ["x"], "y", "g", ["id"], n=20, block_rows=500,
            spec=BoostSpec(rounds=5, depth=2, rate=0.3)).first())
    assert sizes[0].n_rows == 3000 and sizes[0].n_as_good == sizes[1].n_as_good == 0
    for a, b in zip(*sizes):
        assert abs(a - b) < 1e-9
