import numpy as np
import pytest
from pyspark.sql import functions as F

from plantloom.models import kernel, learners, linear, neighbors, svr
from plantloom.models.gram import added, gram
from plantloom.operators import scale, split
from plantloom.plans import score
from plantloom.plans.train import SensorModel, train


@pytest.fixture(scope="module")
def line(spark):
    df = spark.range(1200).select(
        "id", (F.rand(1) * 10).alias("a.x"), (F.rand(2) * 5).alias("b [K]"), F.rand(3).alias("noise"))
    return df.withColumn("y", 2 * F.col("`a.x`") - 3 * F.col("`b [K]`") + 1 + 0.1 * F.randn(4)).cache()


X = ["a.x", "b [K]", "noise"]


def test_ols_p_values_and_elimination(line):
    beta = linear.fit_ols(line, X, "y")
    assert beta[:3] == pytest.approx([1, 2, -3], abs=0.05)
    model = learners.fit(line, X, "y", "linear", solver="normal").stages[-1]
    want = model.summary.pValues  # the intercept comes last
    got = linear.p_values(gram(line, X, "y")[0])
    assert got[1:] == pytest.approx(want[:-1], abs=1e-6)
    kept, removed = linear.backward_elimination(line, X, "y", 0.001)
    assert kept == X[:2] and removed[0][0] == "noise"


def test_gradient_descent_approaches_ols(line):
    scaled = scale.fit_minmax(line, X).apply(line)
    gd = linear.fit_gradient_descent(scaled, X, "y", rate=0.2, steps=20000)
    assert gd == pytest.approx(linear.fit_ols(scaled, X, "y"), abs=1e-3)


def test_permutation_test(line):
    rows = split.kfold(line, ["id"], 4)
    real = linear.permutation_test(rows, X, "y", "fold", ["id"], n=19).first()
    assert real["n_as_good"] == 0 and real["p_value"] == 1 / 20 and real["r2"] > 0.99
    # A target made of hash bits has nothing to do with the features.
    idle = rows.withColumn("y", (F.xxhash64(F.lit(3), "id") % 1000).cast("double"))
    none = linear.permutation_test(idle, X, "y", "fold", ["id"], n=99).first()
    assert none["p_value"] > 0.05 and abs(none["r2"]) < 0.05


def test_permutations_are_permutations(line):
    """Shuffles in blocks keep every value, and the result does not hang on the row order."""
    rows = line.select(
        (F.col("id") % 2).cast("int").alias("fold"), F.col("`a.x`").alias("c0"), F.col("y").alias("c1"),
        F.xxhash64("id").alias("__h"), (F.col("id") % 3).alias("__b"))
    got = added(linear._permuted_sums(rows, 1, 5, 42, np.zeros(2)))
    square, cross = (sum(got[f, part] for f in (0, 1)) for part in (2, 1))
    assert square[0] == pytest.approx(np.full(6, square[0, 0]))
    assert cross[0] == pytest.approx(np.full(6, cross[0, 0]))
    assert len(np.unique(cross[1].round(6))) == 6
    again = added(linear._permuted_sums(rows.repartition(7), 1, 5, 42, np.zeros(2)))
    assert again[0, 1] == pytest.approx(got[0, 1])


def test_kernel_regressor_is_calibrated(spark):
    df = spark.range(3000).select(
        "id", (F.rand(5) * 6).alias("x")).withColumn("y", F.sin("x") * 3 + 0.3 * F.randn(6)).cache()
    fit_rows, test_rows = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    xs, ys = scale.fit_robust(fit_rows, ["x"]), scale.fit_robust(fit_rows, ["y"])
    for nu in (1.5, 2.5):
        spec = kernel.KernelSpec(length_scale=1.0, nu=nu, width=64)
        out = kernel.fit_kernel(fit_rows, ["x"], "y", xs, ys, spec).score(test_rows)
        row = out.agg(
            F.avg((F.abs(F.col("y") - F.col("prediction")) < 1.96 * F.col("std")).cast("int")).alias("in95"),
            F.avg("std").alias("std"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"),
        ).first()
        assert 0.92 < row["in95"] < 0.98 and 0.25 < row["std"] < 0.4 and row["mae"] < 0.3


def test_train_save_load(spark, line, tmp_path):
    model, scored = train(line, "y", X, ["id"], lags=(), trials=3, width=48)
    assert model.kind == "kernel" and model.metrics["r2"] > 0.95
    path = str(tmp_path / "models" / "one")
    signed = model.save(spark, path)
    again = SensorModel.load(spark, path)
    a, b = (m.predict(line).agg(F.sum("prediction")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)
    SensorModel.load(spark, path, signed)
    with pytest.raises(ValueError):
        SensorModel.load(spark, path, "0" * 64)
    # Unsigned copy, then an altered one.
    other = str(tmp_path / "models" / "two")
    text = spark.read.text(f"{path}/info")
    text.coalesce(1).write.text(f"{other}/info")
    with pytest.raises(ValueError, match="manifest"):
        SensorModel.load(spark, other)
    SensorModel.load(spark, other, trust_unsigned=True)
    text.coalesce(1).write.mode("append").text(f"{path}/info")
    with pytest.raises(ValueError, match="match"):
        SensorModel.load(spark, path)


def test_fallback_latest_and_leak(spark, line, tmp_path):
    from plantloom.sources.sinks import latest_model

    df = line.withColumn("y", (F.xxhash64(F.lit(5), "id") % 1000).cast("double")).withColumn("leak", F.col("y") * 2)
    model, _ = train(df, "y", [*X, "leak"], ["id"], trials=2, width=16, boosted={"maxIter": 3})
    assert model.kind == "boosted" and model.removed["leak"] == "leak"
    assert model.metrics["r2"] < 0.5
    top = model.importances(3)
    assert len(top) == 3 and sum(v for _, v in top) <= 1 + 1e-9
    path = str(tmp_path / "store" / "m")
    model.save(spark, path)
    assert latest_model(spark, str(tmp_path / "store")).endswith("/store/m")
    again = SensorModel.load(spark, path)
    last = score.score_latest(df, again, ["id"]).first()
    assert last["id"] == 1199 and last["confidence_pct"] == 85.0
    assert score.score_series(df, again, ["id"], n_points=20, min_history=1190).count() == 10
    with pytest.raises(ValueError, match="copy"):
        train(df, "y", ["leak"], ["id"], strict_leakage=True)


def test_same_seed_same_model(line):
    runs = [train(line, "y", X, ["id"], lags=(), trials=2, width=32)[0].metrics["r2"] for _ in range(2)]
    assert abs(runs[0] - runs[1]) < 1e-9


def test_nearest_matches_brute_force_over_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame(
        [(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)],
        "id long, v array<double>, label int").repartition(6)
    q = df.filter("id < 50")
    got = neighbors.nearest(df, q, "v", "label", "id", "id", 4, block=16).orderBy("id", "place").collect()
    d = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(-1))
    assert [r["neighbor"] for r in got] == np.argsort(d, axis=1)[:, :4].ravel().tolist()


def test_pivots_spare_most_distances_and_lose_no_neighbour(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 1, 8)) * 10 + rng.normal(size=(30, 40, 8))).reshape(-1, 8)
    df = spark.createDataFrame(
        [(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)],
        "id long, v array<double>, label int").repartition(5)
    q = df.filter("id % 4 = 0")
    args = (df, q, "v", "label", "id", "id", 5)
    got = neighbors.nearest(*args, block=16, pivot_rows=20, shard=25).orderBy("id", "place").collect()
    d = np.sqrt(((x[::4, None] - x[None]) ** 2).sum(-1))
    assert [r["neighbor"] for r in got] == np.argsort(d, axis=1, kind="stable")[:, :5].ravel().tolist()
    work = neighbors.candidates(*args, 16, 20, 25).agg(F.sum("compared")).first()[0]
    assert 5 * 300 <= work < 0.3 * 300 * 1200
    few = neighbors.nearest(df.limit(3), q, "v", "label", "id", "id", 5, pivot_rows=1)
    assert few.groupBy("id").count().filter("count <> 3").count() == 0


def test_neighbours_with_ties_and_copies(spark):
    rows = [(i, [float(i % 7), 0.0], i % 2) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = neighbors.nearest(df, df.filter("id < 7"), "v", "label", "id", "id", 3, pivot_rows=10).collect()
    for r in got:
        assert r["neighbor"] == r["id"] + 7 * (r["place"] - 1) and r["distance"] == 0


def test_svr_ignores_outliers_and_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (1500, 2))
    y = np.sin(x[:, 0]) + 0.5 * x[:, 1]
    off = np.arange(1500) % 15 == 0
    df = spark.createDataFrame(
        [(i, float(a), float(b), float(t + 40 * o)) for i, ((a, b), t, o) in enumerate(zip(x, y, off))],
        "id long, a double, `b.c` double, y double")
    models = [svr.fit_svr(df.repartition(n), ["a", "b.c"], "y", steps=30) for n in (1, 40)]
    assert np.abs(models[0].weights - models[1].weights).max() < 1e-9
    fall = np.diff(models[0].losses)
    assert (fall <= 1e-9 * models[0].losses[0]).all()
    got = models[0].predict(df).orderBy("id").toPandas()["prediction"].to_numpy()
    plain = np.abs(y - np.mean(y + 40 * off))[~off].mean()
    assert np.abs(got - y)[~off].mean() < 0.15 < plain / 5  # outliers of 40 at one row in 15
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_rows_without_a_fold_are_a_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(float(v), None if i % 7 == 0 else i % 3, 2 * float(v) + 1) for i, v in enumerate(rng.normal(size=210))]
    df = spark.createDataFrame(rows, "x double, fold int, y double")
    got = linear.oof_linear(df, ["x"], "y", "fold").filter("abs(prediction - y) < 1e-6")
    assert got.count() == 210
    assert learners.out_of_fold(df, ["x"], "y", "fold", "linear", range(3)).count() == 210


def test_hopkins_tells_clusters_from_noise(spark):
    rng = np.random.default_rng(1)
    tight = np.repeat(rng.normal(size=(4, 6)), 100, axis=0) + 0.01 * rng.normal(size=(400, 6))
    loose = rng.normal(size=(400, 6))
    values = []
    for x in (tight, loose):
        df = spark.createDataFrame(
            [(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
        values.append(neighbors.hopkins(df, "v", "id").first()["hopkins"])
    assert values[0] > 0.9 and values[1] < 0.75


def test_folds_and_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 13).alias("g"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("c"))
    f = split.group_folds(df, "g", 5)
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    sizes = [r["count"] for r in split.kfold(df, ["id"], 7, target_rows=100).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    a = {r["id"] for r in split.sample_cap(df, 100, ["id"], ["id"]).collect()}
    b = {r["id"] for r in split.sample_cap(df, 100, ["id"], ["id"]).collect()}
    assert len(a) == 100 and a == b
    blocks = split.forward_folds(df, ["id"]).groupBy("block").agg(F.min("id").alias("lo"), F.count("id").alias("n")).orderBy("block").collect()
    assert [(r["lo"], r["n"]) for r in blocks] == [(0, 250), (250, 250), (500, 250), (750, 250)]


def test_spread_grows_back_to_the_prior_off_the_data(spark):
    from plantloom.models.inducing import fit_inducing
    from plantloom.operators.scale import fit_robust

    rng = np.random.default_rng(8)
    x = rng.uniform(-3, 3, 2000)
    y = np.sin(x) + rng.normal(0, 0.1, 2000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    both = fit_robust(df, ["x", "y"])
    args = (["x"], "y", both.only(["x"]), both.only(["y"]), kernel.KernelSpec(length_scale=0.5, width=40))
    model = fit_inducing(df, *args)
    got = model.score(df).toPandas()
    assert 0.9 <= (np.abs(got["y"] - got["prediction"]) <= 1.96 * got["std"]).mean() <= 1.0
    assert np.abs(got["prediction"] - np.sin(got["x"])).max() < 0.1 and got["std"].max() < 0.2
    far = model.score(spark.createDataFrame([(50.0,), (-50.0,)], "x double")).toPandas()
    assert (far["std"] >= model.prior_std * (1 - 1e-9)).all() and model.prior_std > 0.3
    again = kernel.KernelModel.from_dict(model.to_dict())
    assert type(again) is type(model) and again.score(df.limit(1)).first()["std"] == model.score(df.limit(1)).first()["std"]
    other = fit_inducing(df.repartition(11), *args).score(df).toPandas()
    assert np.allclose(sorted(other["std"]), sorted(got["std"]), rtol=1e-4)


def test_trees_of_weighted_cells_are_those_of_the_rows(spark):
    df = spark.range(6000).selectExpr(
        "id", "CAST(id % 13 AS DOUBLE) AS a", "CAST(id * 7919 % 6007 AS DOUBLE) AS p",
        "IF(id % 13 < 5, 10D, 20D) + IF(id * 7919 % 6007 < 2000, 4D, 0D) + id % 3 AS y",
        "CAST(IF(id % 13 < 5, 0, IF(id % 13 < 9, 1, 2)) AS INT) AS c")
    x, plain = ["a", "p"], dict(maxBins=32, maxDepth=3)
    for kind, label, more in (
            ("boosted", "y", dict(maxIter=4, subsamplingRate=1.0)),
            ("forest", "y", dict(numTrees=2, bootstrap=False, featureSubsetStrategy="all")),
            ("boosted_classifier", "c", dict(maxIter=2)), ("tree_classifier", "c", {})):
        by_rows, by_cells = (learners.fit(
            df, x, label, kind, 3 if label == "c" else None, cells_from=n, **plain, **more)
            for n in (10_000, 6000))
        assert len(by_rows.stages) == 1 and len(by_cells.stages) == 3
        got, want = ([r.prediction for r in learners.score(m, df, x).orderBy("id").collect()]
                     for m in (by_cells, by_rows))
        if label == "c":
            assert got == want
        else:  # bounds of the bins of p are exact quantiles here, of a sample there
            assert np.mean(np.abs(np.subtract(got, want)) < 0.15) > 0.95
            best = df.selectExpr("avg(y) OVER (PARTITION BY id % 13 < 5, id * 7919 % 6007 < 2000) AS m",
                                 "id").orderBy("id").toPandas()["m"]
            assert kind == "boosted" or np.mean(np.abs(got - best) < 0.3) > 0.95
        assert set(learners.score(by_cells, df, x).columns) == {*df.columns, "prediction"}


def test_least_rows_of_a_node_count_rows_of_cells(spark):
    df = spark.range(4000).selectExpr("CAST(id % 20 AS DOUBLE) AS x", "IF(id % 20 = 7, 9D, 0D) AS y")
    one = dict(numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=3)
    for least, found in ((200, True), (201, False)):  # 200 rows, one cell, have x = 7
        model = learners.fit(df, ["x"], "y", "forest", cells_from=1, minInstancesPerNode=least, **one)
        assert (learners.score(model, df, ["x"]).agg({"prediction": "max"}).first()[0] == 9.0) is found


def test_grid_search_on_cells(spark):
    df = spark.range(5000).selectExpr("CAST(id % 50 AS DOUBLE) AS x", "IF(id % 50 < 25, 1D, 2D) AS y")
    found = learners.grid_search(
        df, ["x"], "y", "forest", {"maxDepth": [0, 2]}, cells_from=1, numTrees=2, bootstrap=False)
    scores = {r.params["maxDepth"]: r.score for r in found.collect()}
    assert scores["2"] == pytest.approx(1) and abs(scores["0"]) < 0.01


def test_svr_steps_read_equal_rows_once(spark, monkeypatch):
    df = spark.range(3000).selectExpr("CAST(id % 10 AS DOUBLE) AS x", "CAST(id % 10 * 2 AS DOUBLE) AS y")
    read, plain = [], svr.keyed_sums
    monkeypatch.setattr(svr, "keyed_sums", lambda rows, *a: read.append(rows.count()) or plain(rows, *a))
    model = svr.fit_svr(df, ["x"], "y", steps=5)
    assert set(read) == {10}
    off = model.predict(df).selectExpr("max(abs(prediction - y))").first()[0]
    assert off < 1.5
