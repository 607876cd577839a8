"""Registered queries: models, scoring, sources and sinks, streams."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantloom.models import boosting, learners, linear, neighbors, svr
from plantloom.operators import metrics, scale, stats
from plantloom.operators.position import cuts_at
from plantloom.plans import experiments, score
from plantloom.plans.registry import query, rounded
from plantloom.plans.tables import (
    FINITE_SQL,
    LINE,
    PLANT_SQL,
    SAMPLES_SQL,
    TIME,
    events,
    plant,
    samples,
    table,
)
from plantloom.plans.train import train
from plantloom.session import ROCKSDB_PROVIDER, scratch_path
from plantloom.sources import readers, sinks
from plantloom.streaming import etl, stateful

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LEAD = ["l_quantity", "l_discount", "l_tax"]
_PC = ["l_quantity", "l_discount"]

# ── linear models from sufficient statistics ────────────────────────────────────────────


@query("fit_linear", f"""WITH {SAMPLES_SQL}, s AS (SELECT regr_slope(y, l_quantity) AS w, regr_intercept(y, l_quantity) AS b
FROM samples) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(b + w * l_quantity, 5) AS prediction
FROM samples, s""")
def _(spark, sf):
    s = samples(spark, sf)
    beta = linear.fit_ols(s, ["l_quantity"], "y")
    out = s.withColumn("prediction", linear.linear_expr(["l_quantity"], beta))
    return rounded(out.select(*LINE, "prediction"), 5)


@query("fit_gradient_descent", f"""WITH RECURSIVE {SAMPLES_SQL}, g AS (SELECT count(*)::DOUBLE AS n, sum(l_quantity / 50) AS x,
  sum(y) AS t, sum(l_quantity / 50 * l_quantity / 50) AS xx, sum(l_quantity / 50 * y) AS xt FROM samples),
d(i, b, w) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
  SELECT i + 1, b + 0.02 * (t - b * n - w * x) / n, w + 0.02 * (xt - b * x - w * xx) / n FROM d, g WHERE i < 150)
SELECT round(b, 6) AS intercept, round(w, 6) AS slope FROM d WHERE i = 150""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("q", F.col("l_quantity") / 50)
    b, w = linear.fit_gradient_descent(s, ["q"], "y", 0.01, 150)
    return rounded(spark.createDataFrame([(float(b), float(w))], "intercept double, slope double"))


_OOF_SQL = f"""{SAMPLES_SQL}, f AS (SELECT *, (l_suppkey % 5)::INT AS fold FROM samples), m AS (
  SELECT k.range::INT AS fold, regr_slope(y, l_quantity) AS w, regr_intercept(y, l_quantity) AS b
  FROM f JOIN range(5) k ON f.fold <> k.range GROUP BY 1),
p AS (SELECT f.fold, y, b + w * l_quantity AS p FROM f JOIN m ON f.fold = m.fold)"""


def _folded(spark, sf):
    return samples(spark, sf).withColumn("fold", (F.col("l_suppkey") % 5).cast("int"))


@query("oof_predict", f"""WITH {_OOF_SQL} SELECT fold, count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae FROM p GROUP BY 1""")
def _(spark, sf):
    oof = linear.oof_linear(_folded(spark, sf), ["l_quantity"], "y", "fold")
    return rounded(metrics.regression_metrics(oof, "y", "prediction", ["fold"]).drop("mape"))


@query("permutation_test", f"""WITH {_OOF_SQL} SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
  0 AS n_as_good, 200 AS n_permutations, round(1.0::DOUBLE / 201, 6) AS p_value, count(*) AS n_rows FROM p""")
def _(spark, sf):
    got = linear.permutation_test(
        _folded(spark, sf), ["l_quantity"], "y", "fold", LINE, n=200
    )
    return rounded(got.drop("best_shuffled_r2"))


_SIGNAL_SQL = f"""WITH {SAMPLES_SQL}, t AS (SELECT l_suppkey, u,
  CASE WHEN l_quantity <= 25 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END + CASE WHEN l_discount > 0.055 THEN 4 ELSE 0 END AS step,
  (l_orderkey * 7 + l_partkey * 3) % 11 AS e FROM samples, (SELECT unnest([1, -1]) AS u))
SELECT 'signal' AS target, round(1 - sum((u * e) ** 2) / (var_pop(step + u * e) * count(*)), 5) AS r2,
  round(1.0::DOUBLE / 201, 6) AS p_value, TRUE AS significant, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_groups FROM t
UNION ALL SELECT 'none', NULL, NULL, FALSE, count(*), count(DISTINCT l_suppkey) FROM samples"""


@query("permutation_test_boosted", _SIGNAL_SQL)
def _(spark, sf):
    """A planted signal, each row with its noise added and taken away, so that the mean of any
    group and cell is the step; and a target that follows no feature. No supplier in two folds."""
    s = _stepped(spark, sf)
    e = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 3) % 11
    pairs = s.withColumn("u", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn(
        "t", F.col("step") + F.col("u") * e)
    noise = s.withColumn("t", (F.col("l_orderkey") * 104_729 + F.col("l_partkey") * 7919
                               + F.col("l_linenumber") * 31) % 997)
    cols = ["l_quantity", "l_discount"]
    out = []
    for name, df, keys in (("signal", pairs, [*LINE, "u"]), ("none", noise, LINE)):
        r = boosting.permutation_test_boosted(df, cols, "t", "l_suppkey", keys)
        planted = F.lit(name == "signal")
        out.append(r.select(
            F.lit(name).alias("target"), F.when(planted, F.round("r2", 5)).alias("r2"),
            F.when(planted, F.round("p_value", 6)).alias("p_value"),
            (F.col("p_value") < 0.05).alias("significant"), "n_rows", "n_groups"))
    return out[0].unionByName(out[1])


_TWO_SQL = f"""{SAMPLES_SQL}, a AS (SELECT count(*)::DOUBLE AS n, var_pop(l_quantity) * count(*) AS xx, var_pop(l_tax) * count(*) AS zz,
  covar_pop(l_quantity, l_tax) * count(*) AS xz, covar_pop(l_quantity, t) * count(*) AS xy, covar_pop(l_tax, t) * count(*) AS zy,
  var_pop(t) * count(*) AS yy FROM (SELECT *, 3 * l_quantity + (l_orderkey * 7 + l_partkey * 3) % 11 AS t FROM samples)),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM a),
e AS (SELECT *, (yy - bx * xy - bz * zy) / (n - 3) AS s2, xx * zz - xz * xz AS det FROM b)"""


@query("backward_elimination", f"""WITH {_TWO_SQL} SELECT 'l_quantity' AS feature, abs(bx) / sqrt(s2 * zz / det) > 1.96 AS kept FROM e
UNION ALL SELECT 'l_tax', abs(bz) / sqrt(s2 * xx / det) > 1.96 FROM e""")
def _(spark, sf):
    """A target that follows one of two features; the other has no effect of its own."""
    noise = (F.col("l_orderkey") * 7 + F.col("l_partkey") * 3) % 11
    s = samples(spark, sf).withColumn("t", 3 * F.col("l_quantity") + noise)
    kept, removed = linear.backward_elimination(s, ["l_quantity", "l_tax"], "t")
    rows = [(n, True) for n in kept] + [(n, False) for n, _ in removed]
    return spark.createDataFrame(rows, "feature string, kept boolean")


# ── neighbours ──────────────────────────────────────────────────────────────────────────


@query("knn_classify", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 4 = 0), t AS (SELECT * FROM embeddings WHERE vec_id % 4 <> 0),
d AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY
  list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.vec_id) AS rn FROM q, t),
v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE rn <= 3 GROUP BY 1, 2)
SELECT vec_id, arg_max(label, (n, -label))::BIGINT AS prediction FROM v GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    q = F.col("vec_id") % 4 == 0
    return neighbors.knn_classify(e.filter(~q), e.filter(q), "embedding", "label", "vec_id", 3)


@query("hopkins", """WITH v AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[],
  lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
n AS (SELECT count(*) AS n, floor(count(*) * 0.05::DOUBLE)::BIGINT AS m, max(len(v)) AS dims FROM v),
d AS (SELECT j, min(v[j + 1]) AS lo, max(v[j + 1]) AS hi FROM v, n, range(n.dims) AS t(j) GROUP BY j),
u AS (SELECT i, list(lo + ('0x' || substr(md5(i || ':' || j || ':42'), 1, 13))::UBIGINT / 4503599627370496.0 * (hi - lo) ORDER BY j) AS v
  FROM d, n, range(n.m) AS t(i) GROUP BY i),
s AS (SELECT id, v FROM v ORDER BY ('0x' || substr(md5('row:' || id || ':42'), 1, 13))::UBIGINT, id LIMIT (SELECT m FROM n)),
a AS (SELECT sum(x) AS u FROM (SELECT min(list_distance(u.v, v.v)) AS x FROM u, v GROUP BY u.i)),
b AS (SELECT sum(x) AS w FROM (SELECT s.id, list_distance(s.v, v.v) AS x, row_number() OVER (
  PARTITION BY s.id ORDER BY list_distance(s.v, v.v), v.id) AS rn FROM s, v) WHERE rn = 2)
SELECT round(u / (u + w), 6) AS hopkins, m::INT AS sampled FROM a, b, n""")
def _(spark, sf):
    return rounded(neighbors.hopkins(table(spark, sf, "embeddings"), "embedding", "vec_id"))


# ── learners ────────────────────────────────────────────────────────────────────────────

_SPLIT, _TEST = "l_suppkey % 5 <> 0", "l_suppkey % 5 = 0"


def _report(scored: DataFrame) -> DataFrame:
    return rounded(metrics.regression_metrics(scored, "y", "prediction").drop("mape"))


# A target of four levels that a tree of depth 2 finds exactly, so the prediction is a group mean.
_STEP_SQL = f"""{SAMPLES_SQL}, st AS (SELECT *, l_suppkey % 5 AS fold, l_quantity <= 25 AS low, l_discount > 0.055 AS off,
  CASE WHEN l_quantity <= 25 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END + CASE WHEN l_discount > 0.055 THEN 4 ELSE 0 END AS step FROM samples)"""
_MEANS_SQL = f"""{_STEP_SQL}, g AS (SELECT low, off, avg(step) AS p FROM st WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2),
p AS (SELECT step, p FROM st JOIN g USING (low, off) WHERE l_suppkey % 5 = 0)"""
_METRICS_SQL = """SELECT count(*) AS n, round(1 - sum((step - p) ** 2) / (var_pop(step) * count(*)), 6) AS r2,
  round(sqrt(avg((step - p) ** 2)), 6) AS rmse, round(avg(abs(step - p)), 6) AS mae FROM p"""
# Every value of a feature can be a threshold.
_EXACT = {"maxBins": 64, "subsamplingRate": 1.0}
_FOREST = {**_EXACT, "bootstrap": False, "featureSubsetStrategy": "all"}


def _stepped(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount")
    step = F.when(q <= 25, 10.0).otherwise(20.0) + F.when(d > 0.055, 4).otherwise(0)
    return _folded(spark, sf).withColumn("step", step)


def _fit_score(spark, sf, kind, **params):
    s = _stepped(spark, sf)
    model = learners.fit(s.filter(_SPLIT), NUM, "step", kind, **params)
    scored = learners.score(model, s.filter(_TEST), NUM)
    return rounded(metrics.regression_metrics(scored, "step", "prediction").drop("mape"))


@query("fit_boosted", f"WITH {_MEANS_SQL} {_METRICS_SQL}")
def _(spark, sf):
    return _fit_score(spark, sf, "boosted", **_EXACT)


@query("fit_forest", f"WITH {_MEANS_SQL} {_METRICS_SQL}")
def _(spark, sf):
    return _fit_score(spark, sf, "forest", **_FOREST)


@query("fit_kernel_svr", """SELECT count(*) AS n, 1.0::DOUBLE AS r2 FROM lineitem WHERE l_suppkey % 5 = 0""")
def _(spark, sf):
    """A target that is linear in two features, but for one training row in 20 that is far off."""
    flat = 2 * F.col("l_quantity") - 300 * F.col("l_discount")
    s = samples(spark, sf).withColumn("flat", flat)
    off = s.filter(_SPLIT).withColumn("flat", F.when(
        F.col("l_orderkey") % 20 == 0, 5000.0).otherwise(F.col("flat")))
    model = svr.fit_svr(off, _PC, "flat", steps=25)
    report = metrics.regression_metrics(model.predict(s.filter(_TEST)), "flat", "prediction")
    return rounded(report.select("n", "r2"), 1)


@query("grid_search", "SELECT unnest([2, 4, 8])::INT AS depth, 1.0::DOUBLE AS score")
def _(spark, sf):
    """Every depth from 2 finds the planted steps, so each point scores 1."""
    found = learners.grid_search(
        _stepped(spark, sf), NUM, "step", "forest", {"maxDepth": [2, 4, 8]}, numTrees=20, **_FOREST)
    return rounded(found.select(F.col("params")["maxDepth"].cast("int").alias("depth"), "score"))


@query("oof_boosted", f"""WITH {_STEP_SQL}, f AS (SELECT k.range AS fold, low, off, avg(step) AS p FROM st JOIN range(5) k
  ON st.fold <> k.range GROUP BY ALL), p AS (SELECT step, p FROM st JOIN f USING (fold, low, off)) {_METRICS_SQL}""")
def _(spark, sf):
    oof = learners.out_of_fold(
        _stepped(spark, sf), NUM, "step", "fold", "boosted", range(5), maxIter=50, **_EXACT)
    return rounded(metrics.regression_metrics(oof, "step", "prediction").drop("mape"))


@query("softmax_boosted", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > 0.045 AND l_quantity <= 25 THEN 2
  WHEN (l_quantity <= 25) <> (l_discount <= 0.055) THEN 1 ELSE 0 END AS prediction, 1.0::DOUBLE AS total, TRUE AS sure
FROM lineitem WHERE l_suppkey % 5 = 0""")
def _(spark, sf):
    """Three classes that cross each other: no class is told from the rest by one feature."""
    low, cheap = F.col("l_quantity") <= 25, F.col("l_discount") <= 0.055
    c = F.when((F.col("l_tax") > 0.045) & low, 2).when(low != cheap, 1).otherwise(0)
    s = samples(spark, sf).withColumn("c", c)
    model = boosting.fit_boosting(s.filter(_SPLIT), _LEAD, "c", classes=3)
    out = model.predict(s.filter(_TEST))
    total = F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select(*LINE, "prediction", total.alias("total"),
                              (F.array_max("probability") > 0.9).alias("sure")))


@query("boosted_leaf", f"""WITH {SAMPLES_SQL}, t AS (SELECT l_linenumber % 3 = 0 AS missing, l_quantity <= 25 AS low,
  CASE WHEN l_linenumber % 3 <> 0 AND l_quantity <= 25 THEN 10 ELSE 20 END + l_partkey % 7 AS t FROM samples),
s AS (SELECT *, NOT missing AND low AS a, avg(t) OVER () AS base FROM t),
g AS (SELECT a, max(base) + 0.5 * sum(t - base) / (count(*) + 5) AS p FROM s GROUP BY a)
SELECT missing, CASE WHEN NOT missing THEN low END AS low, count(*) AS n, round(max(p), 6) AS prediction
FROM s JOIN g USING (a) GROUP BY 1, 2""")
def _(spark, sf):
    """One tree of one split: leaf values with an l2 penalty, missing readings on their own side."""
    missing = F.col("l_linenumber") % 3 == 0
    x = F.when(~missing, F.col("l_quantity"))
    s = samples(spark, sf).withColumn("x", x).withColumn(
        "t", F.when(F.col("x") <= 25, 10).otherwise(20) + F.col("l_partkey") % 7)
    model = boosting.fit_boosting(
        s, ["x", "l_tax"], "t", rounds=1, depth=1, rate=0.5, l2=5.0, gamma=0.1)
    out = model.predict(s).groupBy(missing.alias("missing"), (F.col("x") <= 25).alias("low")).agg(
        F.count("*").alias("n"), F.max("prediction").alias("prediction"))
    return rounded(out)


@query("importances", """SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice']) AS feature,
  unnest([1.0, 0.0, 0.0])::DOUBLE AS importance""")
def _(spark, sf):
    """One feature drives the target and has all the importance."""
    s = samples(spark, sf).withColumn("half", F.when(F.col("l_quantity") <= 25, 10.0).otherwise(20.0))
    model = learners.fit(s, NUM, "half", "boosted", **_EXACT)
    return spark.createDataFrame(
        learners.importances(model, NUM, 3), "feature string, importance double"
    )


@query("pca_projection", """WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS b, min(l_discount) AS c,
  max(l_discount) - min(l_discount) AS d FROM lineitem), x AS (SELECT (l_quantity - a) / b AS q, (l_discount - c) / d AS d FROM lineitem, r),
v AS (SELECT (var_pop(q) + var_pop(d)) / 2 AS m, sqrt(((var_pop(q) - var_pop(d)) / 2) ** 2 + covar_pop(q, d) ** 2) AS h FROM x)
SELECT round(m + h, 6) AS var1, round(m - h, 6) AS var2 FROM v""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    out = learners.pca_projection(scale.fit_minmax(li, _PC).apply(li), _PC)
    return rounded(out.agg(*[F.var_pop(f"pc{i}").alias(f"var{i}") for i in (1, 2)]))


def _classified(spark, sf):
    """Three classes of the planted target on min-max scaled readings."""
    s = samples(spark, sf)
    label = F.when(F.col("y") < 50, 0).when(F.col("y") < 100, 1).otherwise(2)
    return scale.fit_minmax(s.filter(_SPLIT), NUM).apply(s.withColumn("c", label))


def _classify(spark, sf, kind, **params):
    s = _classified(spark, sf)
    model = learners.fit(s.filter(_SPLIT), NUM, "c", kind, classes=3, **params)
    scored = learners.score(model, s.filter(_TEST), NUM)
    return scored.withColumn("prediction", F.col("prediction").cast("int"))


_NB_SQL = f"""WITH {SAMPLES_SQL}, r AS (SELECT min(l_quantity) AS a0, max(l_quantity) - min(l_quantity) AS b0,
  min(l_discount) AS a1, max(l_discount) - min(l_discount) AS b1 FROM samples WHERE l_suppkey % 5 <> 0),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN y < 50 THEN 0 WHEN y < 100 THEN 1 ELSE 2 END AS c,
  (l_quantity - a0) / b0 AS q, (l_discount - a1) / b1 AS d FROM samples, r),
t AS (SELECT * FROM x WHERE l_suppkey % 5 <> 0),
e AS (SELECT 1e-9 * greatest(var_pop(q), var_pop(d)) AS eps, count(*)::DOUBLE AS n FROM t),
k AS (SELECT c, count(*) / max(n) AS prior, avg(q) AS mq, avg(d) AS md, var_pop(q) + max(eps) AS vq,
  var_pop(d) + max(eps) AS vd FROM t, e GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c, (SELECT arg_max(k.c, ln(prior)
  - 0.5 * (ln(2 * pi() * vq) + (x.q - mq) ** 2 / vq) - 0.5 * (ln(2 * pi() * vd) + (x.d - md) ** 2 / vd)) FROM k) AS prediction
FROM x WHERE l_suppkey % 5 = 0"""


@query("naive_bayes", _NB_SQL)
def _(spark, sf):
    s = _classified(spark, sf)
    cols = ["l_quantity", "l_discount"]
    model = learners.fit(s.filter(_SPLIT), cols, "c", "naive_bayes")
    scored = learners.score(model, s.filter(_TEST), cols)
    return scored.select(*LINE, "c", F.col("prediction").cast("int").alias("prediction"))


# Three classes by thresholds of one feature: trees find them exactly.
_BANDS_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity <= 17 THEN 0 WHEN l_quantity <= 34 THEN 1
  ELSE 2 END AS prediction FROM lineitem WHERE l_suppkey % 5 = 0"""


def _bands(spark, sf, kind, **params):
    q = F.col("l_quantity")
    s = samples(spark, sf).withColumn("c", F.when(q <= 17, 0).when(q <= 34, 1).otherwise(2))
    model = learners.fit(s.filter(_SPLIT), NUM, "c", kind, classes=3, maxBins=64, **params)
    scored = learners.score(model, s.filter(_TEST), NUM)
    return scored.select(*LINE, F.col("prediction").cast("int").alias("prediction"))


@query("forest_classifier", _BANDS_SQL)
def _(spark, sf):
    return _bands(spark, sf, "forest_classifier", bootstrap=False, featureSubsetStrategy="all")


@query("boosted_classifier", _BANDS_SQL)
def _(spark, sf):
    return _bands(spark, sf, "boosted_classifier", maxIter=20)


@query("tree_classifier", _BANDS_SQL)
def _(spark, sf):
    return _bands(spark, sf, "tree_classifier")


# Rows whose largest of three scaled readings leads by half a range: each class against the rest
# is linearly separable.
_LEAD_SQL = """WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) - min(l_quantity) AS b, min(l_discount) AS c,
  max(l_discount) - min(l_discount) AS d, min(l_tax) AS e, max(l_tax) - min(l_tax) AS f FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [(l_quantity - a) / b, (l_discount - c) / d, (l_tax - e) / f] AS v FROM lineitem, r),
y AS (SELECT *, list_sort(v, 'DESC') AS s FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (list_position(v, s[1]) - 1)::INT AS prediction FROM y
WHERE s[1] - s[2] >= 0.505 AND l_suppkey % 5 = 0"""


def _leading(spark, sf, kind, **params):
    li = table(spark, sf, "lineitem")
    s = scale.fit_minmax(li, _LEAD).apply(li)
    v = F.array(*_LEAD)
    ranked = F.sort_array(v, asc=False)
    s = s.withColumn("c", (F.array_position(v, ranked[0]) - 1).cast("int"))
    s = s.filter(ranked[0] - ranked[1] >= 0.505)
    model = learners.fit(s.filter(_SPLIT), _LEAD, "c", kind, classes=3, **params)
    scored = learners.score(model, s.filter(_TEST), _LEAD)
    return scored.select(*LINE, F.col("prediction").cast("int").alias("prediction"))


@query("linear_svc", _LEAD_SQL)
def _(spark, sf):
    return _leading(spark, sf, "linear_svc")


@query("perceptron", _LEAD_SQL)
def _(spark, sf):
    return _leading(spark, sf, "perceptron")


_CROSS_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_quantity > 25) <> (l_discount > 0.05))::INT AS prediction
FROM lineitem WHERE abs(l_quantity - 25.5) > 8 AND abs(l_discount - 0.05) > 0.015 AND l_suppkey % 5 = 0"""


@query("perceptron_relu", _CROSS_SQL)
def _(spark, sf):
    """Two bands that cross: no line parts the classes, rectified units do."""
    from plantloom.models.perceptron import fit_perceptron

    li = table(spark, sf, "lineitem")
    q, d = F.col("l_quantity"), F.col("l_discount")
    s = li.filter((F.abs(q - 25.5) > 8) & (F.abs(d - 0.05) > 0.015)).withColumn(
        "c", ((q > 25) != (d > 0.05)).cast("int")).withColumn("q", (q - 25) / 25).withColumn(
        "d", (d - 0.05) / 0.05)
    model = fit_perceptron(s.filter(_SPLIT), ["q", "d"], "c", 2, rate=5e-3)
    return model.predict(s.filter(_TEST)).select(*LINE, "prediction")


# ── probabilistic soft sensor and scoring ───────────────────────────────────────────────


@query("fit_probabilistic", """SELECT DISTINCT 'kernel' AS model, 10 * floor(l_quantity / 10) AS q, 3 * floor(round(l_discount * 100) / 3) AS d,
  round(3 * 10 * floor(l_quantity / 10) - 4 * 3 * floor(round(l_discount * 100) / 3), 0) AS prediction, TRUE AS sure, TRUE AS cv_fits FROM lineitem""")
def _(spark, sf):
    """Predictions, spread and search score of a target that is linear in two coarse readings."""
    s = samples(spark, sf).withColumns({
        "q": F.floor(F.col("l_quantity") / 10) * 10.0,
        "d": F.floor(F.round(F.col("l_discount") * 100) / 3) * 3.0,
        "tie": F.xxhash64(*LINE[1:])})
    s = s.withColumn("y", 3 * F.col("q") - 4 * F.col("d"))
    model, scored = train(s, "y", ["q", "d"], ["l_orderkey", "tie"], lags=(), trials=4, width=64)
    return rounded(scored.groupBy("q", "d").agg(
        F.round(F.avg("prediction"), 0).alias("prediction"), (F.max("std") < 1).alias("sure")
    ).withColumn("model", F.lit(model.kind)).withColumn("cv_fits", F.lit(bool(model.cv_score > 0.98))))


def _series_model(spark, sf):
    e = events(spark, sf).withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("double"))
    model, _ = train(
        e, "value", ["k"], TIME, ["user_id"], trials=2, width=32, force="kernel"
    )
    return e, model


@query("inducing_posterior", """SELECT q.range AS q, round(2.0::DOUBLE * q.range + 7, 0) AS prediction, TRUE AS sure, FALSE AS prior FROM range(5, 46, 5) AS q
UNION ALL SELECT unnest([500, -500]), NULL, FALSE, TRUE""")
def _(spark, sf):
    """Predictions where readings are, and the spread of the prior where none are."""
    from plantloom.models.inducing import fit_inducing
    from plantloom.models.kernel import KernelSpec

    s = samples(spark, sf).withColumn("y", 2 * F.col("l_quantity") + 7)
    both = scale.fit_robust(s, ["l_quantity", "y"])
    model = fit_inducing(s, ["l_quantity"], "y", both.only(["l_quantity"]), both.only(["y"]),
                         KernelSpec(length_scale=1.0, width=48))
    spots = spark.createDataFrame([(q,) for q in [*range(5, 46, 5), 500, -500]], "q long")
    scored = model.score(spots.withColumn("l_quantity", F.col("q").cast("double")))
    known = F.abs("q") < 100
    return rounded(scored.select(
        "q", F.when(known, F.round("prediction", 0)).alias("prediction"),
        (F.col("std") < 1).alias("sure"), (F.col("std") >= model.prior_std).alias("prior")))


_OKAY = """TRUE AS predicted, TRUE AS confident, 'kernel' AS model_used"""


def _sane(scored: DataFrame, *keys: str) -> DataFrame:
    return rounded(scored.select(
        *keys, "real", F.col("predicted").isNotNull().alias("predicted"),
        F.col("confidence_pct").between(5, 99).alias("confident"), "model_used",
    ))


_LATTICE_SQL = """(50 * floor(CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 25) + 100 * (event_id % 50 // 25))"""


@query("score_latest", f"""SELECT user_id, event_id, round({_LATTICE_SQL}, 0) AS real, round({_LATTICE_SQL}, 0) AS predicted,
  TRUE AS sure, TRUE AS confident, 'kernel' AS model_used FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, sf):
    """A target that is linear in two coarse readings: values predicted, with their spread."""
    k = F.floor(F.regexp_extract("props", "[0-9]+", 0).cast("double") / 25) * 25.0
    m = F.floor(F.col("event_id") % 50 / 25) * 25.0
    e = events(spark, sf).withColumn("k", k).withColumn("m", m).withColumn(
        "value", 2 * F.col("k") + 4 * F.col("m"))
    model, _ = train(e, "value", ["k", "m"], TIME, ["user_id"], lags=(), trials=2, width=32,
                     force="kernel", inducing=True)
    scored = score.score_latest(e, model, TIME, ["user_id"])
    return rounded(scored.select(
        "user_id", "event_id", "real", F.round("predicted", 0).alias("predicted"),
        (F.col("confidence_std") < 25).alias("sure"),
        F.col("confidence_pct").between(5, 99).alias("confident"), "model_used"))


@query("score_series", f"""SELECT user_id, event_id, round(value, 6) AS real, {_OKAY} FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= 10 AND n - rn >= 50""")
def _(spark, sf):
    e, model = _series_model(spark, sf)
    out = score.score_series(e, model, TIME, ["user_id"], n_points=10, min_history=50)
    return _sane(out, "user_id", "event_id")


@query("score_scenarios")
def _(spark, sf):
    s = samples(spark, sf).withColumnRenamed("l_quantity", "air_flow").withColumn(
        "tie", F.xxhash64("l_linenumber", "l_partkey", "l_suppkey"))
    cols = ["air_flow", *NUM[1:]]
    model, _ = train(s, "y", cols, ["l_orderkey", "tie"], lags=(), trials=2, width=64, force="kernel")
    out = score.score_scenarios(s, model, [0.9, 1.0, 1.1], LINE)
    return rounded(out)


@query("horizon_eval", """WITH h AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS slot, arg_min(value, (ts, event_id)) AS y FROM events
  GROUP BY 1 HAVING count(*) > 1), o AS (SELECT *, row_number() OVER (ORDER BY slot) AS rn FROM h),
f AS (SELECT k AS horizon, a.slot, a.y, b.y AS t FROM (SELECT unnest([1, 3, 6, 12, 24]) AS k) JOIN o a ON TRUE JOIN o b ON b.rn = a.rn + k),
c AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY slot) AS r, count(*) OVER (PARTITION BY horizon) AS n FROM f)
SELECT 'y' AS target, horizon, count(*) AS n, round(1 - sum((t - y) ** 2) / (var_pop(t) * count(*)), 6) AS persistence_r2,
  TRUE AS scored FROM c WHERE r > floor(n * 0.8::DOUBLE) GROUP BY horizon""")
def _(spark, sf):
    hourly = _hours(spark, sf)
    names = [c for c in hourly.columns if c.startswith("value__")]
    report = experiments.evaluate_horizons(hourly, names, ["y"], ["slot"])
    return rounded(report.select(
        "target", "horizon", "n", "persistence_r2", (F.col("model_r2") <= 1).alias("scored")))


def _hours(spark, sf):
    e = events(spark, sf).withColumn("y", F.col("value"))
    return stats.resample(e, "ts", ["value"], ["y"], "event_id").na.drop()


# Hours numbered in time order.
_HOURS_SQL = """o AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS rn FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS slot FROM events GROUP BY 1 HAVING count(*) > 1))"""


def _numbered(spark, sf):
    from plantloom.operators.order import with_ordinal

    return with_ordinal(_hours(spark, sf).select("slot"), ["slot"], name="rn")


@query("best_horizon", f"""WITH {_HOURS_SQL}, y AS (SELECT rn, 10.0::DOUBLE * (rn // 24 % 2) AS y FROM o),
f AS (SELECT k AS horizon, a.rn, a.y, b.y AS t FROM (SELECT unnest([1, 3, 6, 12, 24]) AS k) JOIN y a ON TRUE JOIN y b ON b.rn = a.rn + k),
c AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY rn) AS r, count(*) OVER (PARTITION BY horizon) AS n FROM f),
p AS (SELECT horizon, count(*) AS n, 1 - sum((t - y) ** 2) / (var_pop(t) * count(*)) AS p FROM c WHERE r > floor(n * 0.8::DOUBLE) GROUP BY 1)
SELECT 'y' AS target, horizon, n, 1.0::DOUBLE AS model_r2, round(p, 6) AS persistence_r2, 'model' AS verdict, round(1 - p, 6) AS gap
FROM p ORDER BY gap DESC, horizon LIMIT 1""")
def _(spark, sf):
    """A reading that turns every 24 hours, all horizons at the registered defaults."""
    y = F.floor(F.col("rn") / 24) % 2 * 10.0
    hours = _numbered(spark, sf).withColumn("y", y).withColumn("phase", F.col("rn") % 24)
    report = experiments.evaluate_horizons(hours, ["y", "phase"], ["y"], ["slot"])
    return rounded(experiments.best_horizon(report))


@query("hourly_experiment", f"""WITH {_HOURS_SQL}, a AS (SELECT rn, ('0x' || substr(md5(rn::VARCHAR), 1, 6))::UBIGINT % 10 AS a FROM o),
y AS (SELECT rn, a, 10.0::DOUBLE * (coalesce(lag(a) OVER (ORDER BY rn), 0) > 4)::INT + (a > 4)::INT AS y, count(*) OVER () AS n FROM a),
t AS (SELECT *, lag(y) OVER (ORDER BY rn) AS p, rn < floor(n * 0.8::DOUBLE) AS tr FROM y),
g AS (SELECT a, avg(y) AS g FROM t WHERE tr GROUP BY a), m AS (SELECT avg(y) AS m FROM t WHERE tr),
s AS (SELECT unnest(['mean', 'persistence', 'nowcast', 'input_lags']) AS model, unnest([m, p, g, y]) AS q, y FROM t JOIN g USING (a), m WHERE NOT tr),
r AS (SELECT model, count(*) AS n, 1 - sum((y - q) ** 2) / (var_pop(y) * count(*)) AS r2, avg(abs(y - q)) AS mae FROM s GROUP BY 1)
SELECT model, n, round(r2, 3) AS r2, round(mae, 3) AS mae,
  CASE WHEN model IN ('nowcast', 'input_lags') THEN r2 > (SELECT r2 FROM r WHERE model = 'persistence') + 0.02 END AS beats_persistence FROM r""")
def _(spark, sf):
    """A target that follows the reading of the hour before more than that of the hour itself."""
    a = F.conv(F.substring(F.md5(F.col("rn").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 10
    hours = _numbered(spark, sf).withColumn("a", a)
    before = F.coalesce(F.lag("a").over(Window.orderBy("rn")), F.lit(0))
    hours = hours.withColumn("y", 10.0 * (before > 4).cast("int") + (F.col("a") > 4).cast("int"))
    return rounded(experiments.hourly_experiment(hours, ["a"], "y", ["slot"]), 3)


@query("model_comparison", """WITH f AS (SELECT p_size, CASE WHEN p_size <= 25 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS y,
  (row_number() OVER (ORDER BY md5(concat_ws('|', '42', p_partkey::VARCHAR)), p_partkey) - 1) % 5 AS fold FROM part),
m AS (SELECT k.range AS fold, regr_slope(y, p_size) AS w, regr_intercept(y, p_size) AS b FROM f JOIN range(5) k ON f.fold <> k.range GROUP BY 1),
s AS (SELECT unnest(['linear', 'boosted', 'forest']) AS model, unnest([b + w * p_size, y, y]) AS q, y FROM f JOIN m USING (fold))
SELECT 'y' AS target, model, count(*) AS n, round(avg(y), 3) AS mean, round(stddev_pop(y), 3) AS std,
  round(1 - sum((y - q) ** 2) / (var_pop(y) * count(*)), 3) AS r2, round(avg(abs(y - q)), 3) AS mae FROM s GROUP BY 2""")
def _(spark, sf):
    """A step that trees of all rows find in every fold and a line does not; few rows of another target."""
    parts = table(spark, sf, "part").withColumn(
        "y", F.when(F.col("p_size") <= 25, 10.0).otherwise(20.0)).withColumn(
        "few", F.when(F.col("p_partkey") <= 10, F.col("p_size")))
    report = experiments.compare_models(parts, ["p_size"], ["y", "few"], ["p_partkey"], forest=_FOREST)
    return rounded(report, 3)


# ── sources and sinks ───────────────────────────────────────────────────────────────────


@query("load_dataset", f"""WITH e AS (SELECT ts, event_id, user_id, value AS v FROM events)
SELECT ts, event_id, user_id, round(v, 6) AS value FROM e""")
def _(spark, sf):
    config = readers.DatasetConfig(
        "events.parquet", "value", "ts", include=("_id", "type"), exclude=("type",)
    )
    return rounded(readers.load_dataset(spark, sf, config).drop("seq"))


@query("prepare_dataset", f"""WITH {FINITE_SQL}, f AS (SELECT event_id, ts,
  last_value(feed_flow IGNORE NULLS) OVER w AS feed_flow, last_value(pulp_ph IGNORE NULLS) OVER w AS pulp_ph
  FROM finite WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, ts, round(feed_flow, 6) AS feed_flow, round(pulp_ph, 6) AS pulp_ph FROM f
WHERE feed_flow IS NOT NULL AND pulp_ph IS NOT NULL""")
def _(spark, sf):
    from plantloom.operators.clean import inf_to_null

    config = readers.DatasetConfig("", "pulp_ph", "ts", include=("feed", "tank"), exclude=("tank",))
    p = inf_to_null(plant(spark, sf), ["feed_flow", "mystery"])
    return rounded(readers.prepare_dataset(p, config, TIME))


@query("csv_round_trip", """SELECT o_orderdate AS date, o_orderkey::DOUBLE AS o_orderkey,
  round(o_totalprice, 6) AS total_price_usd FROM orders""")
def _(spark, sf):
    path = scratch_path(spark, "orders-csv")
    price = F.regexp_replace(F.col("o_totalprice").cast("decimal(14,2)").cast("string"), r"\.", ",")
    table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("Date"), "o_orderkey",
        price.alias("Total Price (USD)"),
    ).write.options(header=True, sep=";").csv(path)
    return rounded(readers.read_sensor_csv(spark, path).drop("seq"))


@query("whitespace_table", """SELECT unit_number, time_cycles, round(s_1, 6) AS s_1 FROM (SELECT user_id AS unit_number,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS time_cycles, value AS s_1 FROM events)""")
def _(spark, sf):
    from plantloom.operators.order import with_ordinal

    path = scratch_path(spark, "cycles-text")
    c = with_ordinal(events(spark, sf), TIME, ["user_id"], "o")
    c.select(F.concat_ws("  ", "user_id", (F.col("o") + 1).cast("string"), "value").alias("value")).write.text(path)
    names = ["unit_number", "time_cycles", "s_1"]
    return rounded(readers.read_whitespace(spark, path, names, names[:2]))


@query("cached_table", """SELECT date_trunc('hour', ts)::TIMESTAMP AS slot, round(avg(value), 6) AS value__mean FROM events GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "hours-cache")

    def build():
        return stats.resample(events(spark, sf), "ts", ["value"], seq="event_id")

    readers.cached_table(spark, path, build)
    again = readers.cached_table(spark, path, build)
    return rounded(again.select("slot", "value__mean"))


@query("append_table", "SELECT event_id, round(value, 6) AS value FROM events")
def _(spark, sf):
    path = scratch_path(spark, "clean-table")
    e = events(spark, sf).select("event_id", "value")
    low = F.col("value") < 50
    sinks.append_table(e.filter(low), path, first=True)
    sinks.append_table(e.filter(~low), path)
    return rounded(spark.read.parquet(path))


@query("metrics_sink", f"""WITH {SAMPLES_SQL} SELECT l_returnflag, count(*) AS n, round(avg(abs(y - l_quantity)), 6) AS mae
FROM samples GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    got = metrics.regression_metrics(samples(spark, sf), "y", "l_quantity", ["l_returnflag"])
    sinks.write_metrics(got, path)
    return rounded(
        spark.read.schema("l_returnflag string, n long, mae double").json(path)
    )


@query("raw_load", """SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus || ';' || o_orderpriority AS "Kind; rank",
  CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::VARCHAR END AS o_custkey FROM orders""")
def _(spark, sf):
    """Text columns as they are: separators inside quotes, and lines without their last field."""
    path = scratch_path(spark, "raw-csv")
    o = table(spark, sf, "orders")
    key, kind = F.col("o_orderkey"), F.concat_ws(";", "o_orderstatus", "o_orderpriority")
    line = F.concat(key.cast("string"), F.lit(';"'), kind, F.lit('"'), F.when(
        key % 3 == 0, "").otherwise(F.concat(F.lit(";"), F.col("o_custkey").cast("string"))))

    def headed(batches):
        yield pa.RecordBatch.from_pydict({"value": ['o_orderkey;"Kind; rank";o_custkey']})
        yield from batches

    # Every task writes a file with a header of its own.
    o.select(line.alias("value")).mapInArrow(headed, "value string").write.text(path)
    return readers.read_raw_csv(spark, path, ";")


@query("csv_stream", """SELECT o_orderdate::TIMESTAMP AS date, o_orderkey::DOUBLE AS o_orderkey,
  round(o_totalprice, 2) AS total_price_usd FROM orders""")
def _(spark, sf):
    """CSV files as they arrive, with names, numbers, dates and column rules."""
    path, out, log = (scratch_path(spark, n) for n in ("csv-in", "csv-out", "csv-log"))
    price = F.regexp_replace(F.col("o_totalprice").cast("decimal(14,2)").cast("string"), r"\.", ",")
    o = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("Date"), "o_orderkey",
        price.alias("Total Price (USD)"), F.col("o_comment").alias("note")
        if "o_comment" in table(spark, sf, "orders").columns else F.lit("n").alias("note"))
    o.repartition(3).write.options(header=True, sep=";").csv(path)
    rules = readers.DatasetConfig("", "total_price_usd", "date", include=("key",))
    stream = readers.stream_sensor_csv(
        spark, path, ["Date", "o_orderkey", "Total Price (USD)", "note"], sep=";",
        files_per_trigger=1, rules=rules)
    etl.write_stream_table(stream, out, log)
    return rounded(spark.read.parquet(out))


@query("model_store", f"""WITH {SAMPLES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_quantity <= 25 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS prediction FROM samples WHERE l_suppkey % 5 = 0""")
def _(spark, sf):
    """A fitted model written, checked against its digest, read again and applied."""
    from plantloom.sources import sinks

    s = samples(spark, sf).withColumn("half", F.when(F.col("l_quantity") <= 25, 10.0).otherwise(20.0))
    model = learners.fit(s.filter(_SPLIT), NUM, "half", "forest", numTrees=5, **_FOREST)
    path = scratch_path(spark, "model")
    signed = sinks.save_model(spark, path, {"kind": "forest"}, model)
    _, again, _ = sinks.load_model(spark, path, signed)
    return rounded(learners.score(again, s.filter(_TEST), NUM).select(*LINE, "prediction"))


@query("target_guards", """SELECT 'value' AS target, CASE WHEN count(value) >= 10 AND min(value) < max(value) THEN 'ok' END AS verdict FROM events
UNION ALL SELECT 'flat', CASE WHEN min(1) = max(1) THEN 'constant' END FROM events
UNION ALL SELECT 'event_type', CASE WHEN count(try_cast(event_type AS DOUBLE)) = 0 AND count(event_type) > 0 THEN 'not numeric' END FROM events
UNION ALL SELECT 'endless', CASE WHEN count(*) FILTER (WHERE event_id % 101 = 0) > 0 THEN 'infinite' END FROM events
UNION ALL SELECT 'few', CASE WHEN count(*) FILTER (WHERE event_id < 5) < 10 THEN 'needed' END FROM events
UNION ALL SELECT 'absent', 'not found'""")
def _(spark, sf):
    """What the guards of a regression target say about columns of each kind."""
    from plantloom.operators.validate import check_target

    e = events(spark, sf).select(
        "value", "event_type", F.lit(1.0).alias("flat"),
        F.when(F.col("event_id") % 101 == 0, float("inf")).otherwise(F.col("value")).alias("endless"),
        F.when(F.col("event_id") < 5, F.col("value")).alias("few"))
    rows = []
    for name in ("value", "flat", "event_type", "endless", "few", "absent"):
        try:
            check_target(e, name)
            rows.append((name, "ok"))
        except ValueError as exc:
            words = ("constant", "not numeric", "infinite", "needed", "not found")
            rows.append((name, next(w for w in words if w in str(exc))))
    return spark.createDataFrame(rows, "target string, verdict string")


@query("chrono_sort", """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events""")
def _(spark, sf):
    """The sorted table's rows numbered as they come."""
    from plantloom.operators.order import row_sorted, with_ordinal

    rows = row_sorted(events(spark, sf), TIME).withColumn("m", F.monotonically_increasing_id())
    return with_ordinal(rows.select("event_id", "m"), ["m"], name="place").select("event_id", "place")


# ── streams ─────────────────────────────────────────────────────────────────────────────


@query("stream_hourly", """SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS slot, count(*) AS n, round(avg(value), 6) AS value__mean,
  round(stddev_samp(value), 6) AS value__std, round(min(value), 6) AS value__min, round(max(value), 6) AS value__max,
  round(arg_max(value, (ts, event_id)), 6) AS value__last FROM events GROUP BY 1, 2""")
def _(spark, sf):
    """All hours, the last ones included, of events that arrive up to 42 minutes out of order."""
    out, log = scratch_path(spark, "stream-hours"), scratch_path(spark, "stream-hours-log")
    late = F.make_dt_interval(mins=(F.col("event_id") % 7 * 7).cast("int"))
    e = events(spark, sf).withColumn("arrival", F.col("ts") + late)
    _arriving(e, "event-files", 3, lambda src: etl.write_updates(
        etl.hourly_stream(src, "ts", ["value"], seq="event_id", series=["event_type"]), out, log,
    ), order=["arrival", "event_id"])
    return rounded(etl.read_latest(spark, out, ["event_type", "slot"]))


_OK = """(feed_flow IS NULL OR feed_flow BETWEEN 0 AND 50000)
  AND (pulp_ph IS NULL OR pulp_ph BETWEEN 0 AND 14) AND (tank_level IS NULL OR tank_level BETWEEN -500 AND 1500)"""


def _arriving(df: DataFrame, label: str, n: int, run, order=TIME) -> None:
    """Write the frame in ``n`` time slices and start the stream after each of them.

    Every start resumes from the checkpoint and sees only the files that are new.
    """
    path = scratch_path(df.sparkSession, label)
    total = df.count()
    rest = df
    for cut in cuts_at(df, order, [total * (i + 1) // n for i in range(n)]):
        rest.filter(cut.before()).write.mode("append").parquet(path)
        rest = rest.filter(~cut.before())
        run(df.sparkSession.readStream.schema(df.schema).parquet(path))


def _stream_etl(spark, sf):
    out, stat, log = (scratch_path(spark, n) for n in ("etl-rows", "etl-stats", "etl-log"))
    sensors = ["feed_flow", "pulp_ph", "tank_level", "mystery"]
    _arriving(plant(spark, sf), "plant-files", 3, lambda src: etl.run_stream_etl(
        src, out, stat, log, "ts", sensors, skip=["event_id", "user_id"], fill_value=0.0,
    ))
    return spark.read.parquet(out), spark.read.parquet(stat)


@query("stream_etl", f"""WITH {PLANT_SQL} SELECT event_id, round(coalesce(feed_flow, 0.0), 6) AS feed_flow,
  round(coalesce(pulp_ph, 0.0), 6) AS pulp_ph, round(CASE WHEN isinf(mystery) THEN 0.0 ELSE mystery END, 6) AS mystery
FROM plant WHERE {_OK}""")
def _(spark, sf):
    rows, _ = _stream_etl(spark, sf)
    return rounded(rows.select("event_id", "feed_flow", "pulp_ph", "mystery"))


@query("stream_clean", f"""WITH {PLANT_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM plant),
b AS (SELECT *, (rn >= n // 3)::INT + (rn >= n * 2 // 3)::INT AS batch FROM r WHERE {_OK}),
f AS (SELECT *, CASE WHEN isinf(mystery) THEN NULL ELSE mystery END AS m FROM b)
SELECT event_id, round(coalesce(feed_flow, avg(feed_flow) OVER p), 6) AS feed_flow, round(coalesce(pulp_ph, avg(pulp_ph) OVER p), 6) AS pulp_ph,
  round(coalesce(m, avg(m) OVER p), 6) AS mystery FROM f WINDOW p AS (PARTITION BY batch)""")
def _(spark, sf):
    """Each micro-batch cleaned by the mean strategy."""
    out, stat, log = (scratch_path(spark, n) for n in ("clean-rows", "clean-stats", "clean-log"))
    sensors = ["feed_flow", "pulp_ph", "mystery"]
    _arriving(plant(spark, sf), "plant-files", 3, lambda src: etl.run_stream_etl(
        src, out, stat, log, "ts", sensors, skip=["event_id", "user_id"], strategy="mean"))
    return rounded(spark.read.parquet(out).select("event_id", *sensors))


@query("stream_etl_stats", f"""WITH {PLANT_SQL} SELECT count(*)::BIGINT AS rows_in, count(*) FILTER (WHERE {_OK}) AS rows_out,
  count(*) FILTER (WHERE NOT ({_OK})) AS rows_rejected, count(*) FILTER (WHERE {_OK} AND isinf(mystery)) AS inf_replaced,
  3::BIGINT AS batches FROM plant""")
def _(spark, sf):
    _, stat = _stream_etl(spark, sf)
    sums = [F.sum(c).alias(c) for c in ("rows_in", "rows_out", "rows_rejected", "inf_replaced")]
    return stat.agg(*sums, F.count(F.lit(1)).alias("batches"))


def _stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def _delayed(df: DataFrame) -> DataFrame:
    """Events that arrive up to 42 minutes after their time, so out of order across batches."""
    return df.withColumn(
        "arrival", F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7 * 7).cast("int")))


ARRIVAL = ["arrival", "event_id"]


@query("stream_ffill", f"""WITH {PLANT_SQL} SELECT event_id, round(last_value(pulp_ph IGNORE NULLS) OVER (PARTITION BY user_id
  ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS pulp_ph FROM plant""")
def _(spark, sf):
    """Readings that arrive out of order, filled as in the sorted table."""
    _stateful(spark)
    out, log = scratch_path(spark, "ffill-rows"), scratch_path(spark, "ffill-log")
    p = _delayed(plant(spark, sf).select("event_id", "ts", "user_id", "pulp_ph"))
    _arriving(p, "plant-files", 4, lambda src: etl.write_updates(
        stateful.ffill_stream(src, ["pulp_ph"], ["user_id"], TIME), out, log), ARRIVAL)
    return rounded(etl.read_latest(spark, out, ["event_id"]).select("event_id", "pulp_ph"))


@query("stream_features", """SELECT event_id, round(lag(value, 1) OVER w, 6) AS value_lag_1, round(lag(value, 20) OVER w, 6) AS value_lag_20,
  round(lag(value, 1) OVER w - lag(value, 6) OVER w, 6) AS value_diff_5, round(avg(value) OVER r, 6) AS value_rolling_mean_10,
  round(stddev_samp(value) OVER r, 6) AS value_rolling_std_10, round(b + s * lag(value, 1) OVER w, 6) AS prediction
FROM events, (SELECT regr_slope(value, x) AS s, regr_intercept(value, x) AS b FROM (SELECT value,
  lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
  r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    """Online scoring: state → features → the model fitted on batch features, per micro-batch."""
    from plantloom.operators.timeseries import lag_features

    _stateful(spark)
    e = events(spark, sf).select("event_id", "ts", "user_id", "value")
    beta = linear.fit_ols(lag_features(e, "value", TIME, ["user_id"]), ["value_lag_1"], "value")
    out, log = scratch_path(spark, "scored"), scratch_path(spark, "scored-log")
    predict = lambda b: b.withColumn(
        "prediction", linear.linear_expr(["value_lag_1"], beta))
    _arriving(_delayed(e), "event-files", 4, lambda src: etl.score_stream(
        stateful.lag_stream(src, "value", ["user_id"], TIME), predict, out, log), ARRIVAL)
    cols = ["value_lag_1", "value_lag_20", "value_diff_5", "value_rolling_mean_10",
            "value_rolling_std_10", "prediction"]
    return rounded(etl.read_latest(spark, out, ["event_id"]).select("event_id", *cols))

