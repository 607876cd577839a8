"""Spark ML learners behind one name → estimator table, with safe feature names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import (
    Evaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.operators.quantiles import column_quantiles

VECTOR, LABEL = "__features", "__label"
WEIGHT, BINNED = "__weight", "__binned"
CELLS_FROM = 1_000_000  # rows from which trees are grown on weighted cells of equal bins


def estimator(kind: str, width: int | None = None, classes: int | None = None, **params):
    """An estimator by name; ``params`` override the defaults taken from the experiments."""
    base = {"featuresCol": VECTOR, "labelCol": LABEL}
    if kind == "boosted":
        return GBTRegressor(**base, **{**dict(
            maxIter=150, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=10,
            seed=42), **params})
    if kind == "linear":
        return LinearRegression(**base, **params)
    if kind == "forest":
        return RandomForestRegressor(**base, **{**dict(
            numTrees=300, maxDepth=4, featureSubsetStrategy="sqrt", seed=42), **params})
    if kind == "forest_classifier":
        return RandomForestClassifier(**base, **{**dict(numTrees=100, maxDepth=5, seed=42), **params})
    if kind == "boosted_classifier":
        gbt = GBTClassifier(**base, **{**dict(maxIter=100, maxDepth=3, seed=42), **params})
        return gbt if (classes or 2) <= 2 else OneVsRest(classifier=gbt, **base)
    if kind == "linear_svc":
        svc = LinearSVC(**base, **params)
        return svc if (classes or 2) <= 2 else OneVsRest(classifier=svc, **base)
    if kind == "naive_bayes":
        return NaiveBayes(**base, modelType="gaussian", **params)
    if kind == "tree_classifier":
        return DecisionTreeClassifier(**base, **{**dict(seed=42), **params})
    if kind == "perceptron":
        layers = params.pop("layers", [width, 25, 25, 25, classes or 2])
        return MultilayerPerceptronClassifier(**base, layers=layers, seed=42, **params)
    raise ValueError(f"unknown learner {kind!r}")


def assembled(
    df: DataFrame, features: Sequence[str], label: str | None = None, keep: bool = False
) -> DataFrame:
    """Add the feature vector (positional names inside, so any column name works)."""
    slim = df.withColumns({f"__f{i}": col(c).cast("double") for i, c in enumerate(features)})
    if label:
        slim = slim.withColumn(LABEL, col(label).cast("double"))
    names = [f"__f{i}" for i in range(len(features))]
    done = VectorAssembler(inputCols=names, outputCol=VECTOR, handleInvalid="skip").transform(slim)
    return done if keep else done.drop(*names)


def _by_weight(stage, kind: str):
    """The tree learner inside ``stage`` if weighted cells teach it what their rows would, else None.

    Cells are not drawn like rows, so a learner that draws rows is left alone.
    """
    tree = stage.getClassifier() if isinstance(stage, OneVsRest) else stage
    given = {p.name: v for p, v in tree.extractParamMap().items()}
    if "maxBins" not in given or given.get("subsamplingRate", 1.0) < 1 or given.get("bootstrap"):
        return None
    if kind == "boosted" and given["lossType"] != "squared":
        return None
    return tree


def _split_points(df: DataFrame, names: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Inner bounds of equal-frequency bins of the columns with more than ``bins`` values."""
    rough = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    few = [c for c in names if rough[c] <= 2 * bins]
    if few:
        seen = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in few])).alias("x"))
        counts = seen.distinct().groupBy("x.c").count().collect()
        few = [r["c"] for r in counts if r["count"] <= bins]
    many = [c for c in names if c not in few]
    found = column_quantiles(df, many, [i / bins for i in range(1, bins)])
    return {c: sorted({v for v in found[c] if v is not None}) for c in many}


def _weighted(rows: DataFrame, names: Sequence[str], regression: bool, stage, tree, extra=()):
    """(stages that bin, cells with weights, stage that is fitted to the cells).

    Features of more than ``maxBins`` values are cut to so many bins, as tree learners do; rows of
    equal bins (and classes) are one cell with their number as weight. Within a cell all rows go the
    same way in every tree, so the mean of a regression target is all that a split or leaf needs.
    """
    bins = tree.getOrDefault("maxBins")
    points = _split_points(rows, names, bins)
    ends = float("inf")
    binner, inner = [], {c: c for c in names}
    if points:
        inner |= {c: f"{c}b" for c in points}
        binner = [Bucketizer(
            splitsArray=[[-ends, *p, ends] for p in points.values()], inputCols=list(points),
            outputCols=[inner[c] for c in points], handleInvalid="keep")]
    for b in binner:
        rows = b.transform(rows)
    keys = [*inner.values(), *([] if regression else [LABEL]), *extra]
    mean = [F.avg(LABEL).alias(LABEL)] if regression else []
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT), *mean)
    binner.append(VectorAssembler(inputCols=list(inner.values()), outputCol=BINNED))
    kept = cells.persist()
    total = kept.agg(F.sum(WEIGHT)).first()[0] or 1.0
    # At least so many rows a node, told as a share of the weights; half a row for rounding.
    least = min(0.499, max(0.0, tree.getOrDefault("minInstancesPerNode") - 0.5) / total)
    params = {tree.minInstancesPerNode: 1, tree.minWeightFractionPerNode: least,
              tree.weightCol: WEIGHT, tree.featuresCol: BINNED}
    grown = tree.copy(params)
    if stage is not tree:
        grown = stage.copy({stage.classifier: grown, stage.weightCol: WEIGHT, stage.featuresCol: BINNED})
    return binner, kept, grown


def fit(
    df: DataFrame, features: Sequence[str], label: str, kind: str, classes: int | None = None,
    cells_from: int = CELLS_FROM, **params,
) -> PipelineModel:
    """Fit on complete rows; the input is kept in memory (or on disk) for the iterations.

    From ``cells_from`` rows on, tree learners that draw no rows are fitted to weighted cells of
    equal bins, so that their passes do not grow with the rows.
    """
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, label]])
    stage = estimator(kind, len(features), classes, **params)
    tree = _by_weight(stage, kind)
    if tree is not None and known.count() >= cells_from:
        names = [f"__f{i}" for i in range(len(features))]
        rows = assembled(known, features, label, keep=True).select(*names, LABEL)
        binner, cells, grown = _weighted(
            rows, names, kind in ("boosted", "forest"), stage, tree)
        try:
            return PipelineModel([*binner, grown.fit(binner[-1].transform(cells))])
        finally:
            cells.unpersist()
    ready = assembled(known, features, label).select(VECTOR, LABEL)
    ready.persist()
    try:
        return Pipeline(stages=[stage]).fit(ready)
    finally:
        ready.unpersist()


def score(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``prediction``; the other model columns are dropped."""
    out = model.transform(assembled(df, features, keep=True))
    made = [f"__f{i}{b}" for i in range(len(features)) for b in ("", "b")]
    return out.drop(VECTOR, LABEL, BINNED, *made, "rawPrediction", "probability")


def importances(model: PipelineModel, features: Sequence[str], top: int = 10) -> list[tuple[str, float]]:
    """Normalised importances, largest first; linear models use |coefficient|."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        raw = [float(v) for v in last.featureImportances.toArray()]
    elif hasattr(last, "coefficients"):
        raw = [abs(float(v)) for v in last.coefficients.toArray()]
    else:
        raise ValueError("the model has no importances")
    total = sum(raw)
    ranked = sorted(zip(features, raw), key=lambda r: (-r[1], r[0]))[:top]
    return [(n, v / total if total else 0.0) for n, v in ranked]


def out_of_fold(
    df: DataFrame, features: Sequence[str], label: str, fold: str, kind: str, folds: Sequence[int],
    **params,
) -> DataFrame:
    """Each fold is scored by the model fitted on all others; the rows without a fold are one."""
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, label]])
    own = known.filter(col(fold).isNull()).isEmpty()
    parts = []
    for f in [*folds, *([] if own else [None])]:
        mine = col(fold).eqNullSafe(F.lit(f))
        model = fit(known.filter(~mine), features, label, kind, **params)
        parts.append(score(model, known.filter(mine), features))
    return reduce(lambda a, b: a.unionByName(b), parts)


class _WeightedR2(Evaluator):
    """R² of the rows behind weighted cells; the weights of Spark's own are not numbers of rows."""

    def _evaluate(self, dataset: DataFrame) -> float:
        y, w = F.col(LABEL), F.col(WEIGHT)
        mean = dataset.agg(F.sum(w * y) / F.sum(w)).first()[0]
        off, spread = dataset.agg(
            F.sum(w * (y - F.col("prediction")) ** 2), F.sum(w * (y - F.lit(mean)) ** 2)).first()
        return 1 - off / spread if spread else float("nan")


def grid_search(
    df: DataFrame, features: Sequence[str], label: str, kind: str,
    grid: Mapping[str, Sequence], folds: int = 3, parallelism: int = 4,
    cells_from: int = CELLS_FROM, **params,
) -> DataFrame:
    """Cross-validated score of every grid point, best first.

    From ``cells_from`` rows on, trees are grown on and judged by weighted cells as in :func:`fit`;
    the rows are dealt to folds before, and cells keep equal targets only.
    """
    stage = estimator(kind, len(features), **params)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(stage.getParam(name), list(values))
    points = builder.build()
    regression = kind in ("boosted", "linear", "forest")
    judge = (
        RegressionEvaluator(labelCol=LABEL, metricName="r2")
        if regression
        else MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    )
    known = df.na.drop(subset=[f"`{c}`" for c in [*features, label]])
    names = [f"__f{i}" for i in range(len(features))]
    tree = _by_weight(stage, kind)
    # The share of the weights that stands for the least rows of a node is of one setting.
    few = tree is not None and not {"maxBins", "minInstancesPerNode", "subsamplingRate", "bootstrap",
                                    "lossType"} & set(grid) and known.count() >= cells_from
    if few:
        rows = assembled(known, features, label, keep=True).select(*names, LABEL).withColumn(
            "__fold", F.floor(F.rand(42) * folds).cast("int"))
        binner, held, stage = _weighted(rows, names, False, stage, tree, ["__fold"])
        ready = binner[-1].transform(held)
        judge = _WeightedR2() if regression else judge.copy({judge.weightCol: WEIGHT})
        least = stage.getOrDefault("minWeightFractionPerNode") * folds / (folds - 1)
        stage = stage.copy({stage.minWeightFractionPerNode: min(0.499, least)})
        points = [{stage.getParam(p.name): v for p, v in point.items()} for point in points]
    else:
        ready = assembled(known, features, label).select(VECTOR, LABEL)
        held = ready.persist()
    try:
        found = CrossValidator(
            estimator=stage, estimatorParamMaps=points, evaluator=judge, numFolds=folds,
            parallelism=parallelism, seed=42, foldCol="__fold" if few else "",
        ).fit(ready)
    finally:
        held.unpersist()
    rows = [
        ({p.name: str(v) for p, v in point.items()}, float(m))
        for point, m in zip(points, found.avgMetrics)
    ]
    rows.sort(key=lambda r: -r[1])
    return df.sparkSession.createDataFrame(rows, "params map<string,string>, score double")


def pca_projection(df: DataFrame, features: Sequence[str], k: int | None = None) -> DataFrame:
    """Centred principal components as columns pc1…pck."""
    k = k or len(features)
    stages = [
        StandardScaler(inputCol=VECTOR, outputCol="__c", withMean=True, withStd=False),
        PCA(k=k, inputCol="__c", outputCol="__pc"),
    ]
    ready = assembled(df, features)
    out = Pipeline(stages=stages).fit(ready).transform(ready)
    arr = out.withColumn("__a", vector_to_array("__pc"))
    return arr.withColumns({f"pc{i + 1}": F.col("__a")[i] for i in range(k)}).drop(
        VECTOR, "__c", "__pc", "__a"
    )
