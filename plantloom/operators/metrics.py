"""Evaluation: regression metrics, confusion table, class report, MCC, residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.operators.stats import histogram


def regression_metrics(
    df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """n, R², RMSE, MAE, MAPE in one pass; undefined values are NULL, never a flattering 0."""
    t, p = col(y).cast("double"), col(prediction).cast("double")
    both = df.filter(t.isNotNull() & p.isNotNull())
    err = t - p
    # Equal extremes, not a rounded variance, decide that the target is constant.
    spread = F.when(F.min(t) < F.max(t), F.var_pop(t) * F.count(t))
    aggs = [
        F.count(t).alias("n"),
        (1 - F.try_divide(F.sum(err * err), spread)).alias("r2"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.abs(F.try_divide(err, t))) * 100).alias("mape"),
    ]
    return (both.groupBy(*[col(c) for c in by]) if by else both).agg(*aggs)


def mean_baseline(train: DataFrame, test: DataFrame, y: str) -> DataFrame:
    """Metrics of predicting the training mean on the test rows."""
    mean = train.agg(F.avg(col(y)).alias("m")).first()["m"]
    return regression_metrics(test.withColumn("__p", F.lit(mean)), y, "__p")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _per_class(cells: DataFrame) -> DataFrame:
    """Per class: true count, predicted count, hits (from the small confusion table)."""
    sides = F.explode(
        F.array(
            F.struct(
                F.col("label").alias("class"),
                F.col("n").alias("actual"),
                F.lit(0).cast("long").alias("predicted"),
                F.when(F.col("label") == F.col("prediction"), F.col("n"))
                .otherwise(0).alias("hit"),
            ),
            F.struct(
                F.col("prediction").alias("class"),
                F.lit(0).cast("long").alias("actual"),
                F.col("n").alias("predicted"),
                F.lit(0).cast("long").alias("hit"),
            ),
        )
    )
    return (
        cells.select(sides.alias("s")).select("s.*").groupBy("class")
        .agg(
            F.sum("actual").alias("actual"),
            F.sum("predicted").alias("predicted"),
            F.sum("hit").alias("hit"),
        )
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows: one per class, then accuracy, macro average and weighted average."""
    zero = F.lit(0.0)
    c = _per_class(confusion(df, label, prediction))
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("predicted")), zero)
    recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("actual")), zero)
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("hit"), F.col("predicted") + F.col("actual")), zero
    )
    classes = c.select(
        F.col("class").cast("string").alias("name"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        F.col("actual").alias("support"),
        F.col("hit").alias("__hit"),
    )
    w = F.sum("support")
    none = F.lit(None).cast("double")

    def weighted(name: str):
        return F.try_divide(F.sum(F.col(name) * F.col("support")), w)

    totals = classes.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("name"),
                none.alias("precision"),
                none.alias("recall"),
                F.try_divide(F.sum("__hit").cast("double"), w).alias("f1"),
                w.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("name"),
                F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"),
                F.avg("f1").alias("f1"),
                w.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("name"),
                weighted("precision").alias("precision"),
                weighted("recall").alias("recall"),
                weighted("f1").alias("f1"),
                w.alias("support"),
            ),
        ).alias("rows")
    ).select(F.explode("rows").alias("r")).select("r.*")
    return classes.drop("__hit").unionByName(totals)


def mcc(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Matthews correlation from class counts; 0 where it is undefined."""
    c = _per_class(confusion(df, label, prediction)).select(
        *[F.col(n).cast("double").alias(n) for n in ("actual", "predicted", "hit")]
    )
    s, hits = F.sum("actual"), F.sum("hit")
    cross = F.sum(F.col("actual") * F.col("predicted"))
    va = s * s - F.sum(F.col("actual") * F.col("actual"))
    vp = s * s - F.sum(F.col("predicted") * F.col("predicted"))
    return c.agg(
        F.coalesce(F.try_divide(hits * s - cross, F.sqrt(va * vp)), F.lit(0.0)).alias("mcc")
    )


def class_error_rate(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean |y - ŷ| / y on class codes."""
    t, p = col(label).cast("double"), col(prediction).cast("double")
    return df.agg(F.avg(F.try_divide(F.abs(t - p), t)).alias("error_rate"))


def residual_histogram(df: DataFrame, y: str, prediction: str, bins: int = 50) -> DataFrame:
    return histogram(df.select((col(y) - col(prediction)).alias("residual")), "residual", bins)


def residual_table(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """Prediction against error, row by row."""
    return df.withColumn("residual", col(y) - col(prediction))
