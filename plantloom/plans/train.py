"""Training flow: features → split → prune → scale → search → fit → honest test metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.functions.scalars import confidence
from plantloom.models import learners
from plantloom.models.inducing import fit_inducing
from plantloom.models.kernel import KernelModel, fit_kernel, forward_search, random_grid
from plantloom.operators.metrics import regression_metrics
from plantloom.operators.order import subsample
from plantloom.operators.prune import prune_features
from plantloom.operators.scale import fit_robust
from plantloom.operators.split import chronological_split, forward_folds
from plantloom.operators.timeseries import LAGS, autocorr_diagnosis, feature_names, lag_features
from plantloom.operators.validate import check_target, drop_missing
from plantloom.session import written
from plantloom.sources import sinks

FALLBACK_BELOW = 0.60


@dataclass
class SensorModel:
    """A fitted soft sensor: either the kernel regressor or the boosted-tree fallback."""

    target: str
    features: list[str]
    lags: list[int]
    kind: str
    kernel: KernelModel | None = None
    pipeline: PipelineModel | None = None
    cv_score: float | None = None
    removed: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    diagnosis: dict[str, object] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, ``std`` (target units; 0 for trees) and ``confidence``."""
        missing = [c for c in self.features if c not in df.columns]
        ready = df.withColumns({c: F.lit(0.0) for c in missing})
        if self.kernel is not None:
            out = self.kernel.score(ready)
        else:
            out = learners.score(self.pipeline, ready, self.features).withColumn(
                "std", F.lit(0.0)
            )
        out = out.withColumn("confidence", confidence(col("std"), col("prediction")))
        return out.drop(*missing)

    def importances(self, top: int = 10) -> list[tuple[str, float]]:
        if self.pipeline is None:
            raise ValueError("only tree models report importances")
        return learners.importances(self.pipeline, self.features, top)

    def save(self, spark: SparkSession, path: str) -> str:
        info = {
            "kind": self.kind, "target": self.target, "features": self.features,
            "lags": self.lags, "cv_score": self.cv_score, "removed": self.removed,
            "metrics": self.metrics, "diagnosis": self.diagnosis,
            "kernel": self.kernel.to_dict() if self.kernel else None,
        }
        return sinks.save_model(spark, path, info, self.pipeline)

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, expected: str | None = None,
        trust_unsigned: bool = False,
    ) -> SensorModel:
        info, pipeline, kernel = sinks.load_model(spark, path, expected, trust_unsigned)
        return cls(
            info["target"], info["features"], info["lags"], info["kind"], kernel, pipeline,
            info["cv_score"], info["removed"], info["metrics"], info.get("diagnosis", {}),
        )


def train(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    order: Sequence[str],
    series: Sequence[str] = (),
    lags: Sequence[int] = LAGS,
    test_size: float = 0.2,
    trials: int = 15,
    width: int = 128,
    fallback: bool = True,
    force: str | None = None,
    strict_leakage: bool = False,
    seed: int = 42,
    boosted: dict | None = None,
    step: int | str = 1,
    diagnose: bool = False,
    inducing: bool = False,
    **options,
) -> tuple[SensorModel, DataFrame]:
    """(model, scored test rows).  Every statistic is fitted on the training side only.

    ``step`` takes every so many rows of each series; ``auto`` the step that the autocorrelation
    diagnosis of the target recommends. With it, or with ``diagnose``, the diagnosis stays with
    the model. ``inducing`` fits the kernel regressor on landmarks, so that ``std`` grows back to
    the prior away from the training rows.
    """
    check_target(df, target)
    inputs = list(features)
    rows = df.select(*[col(c) for c in dict.fromkeys([*order, *series, *inputs, target])])
    diagnosis = {}
    if diagnose or step == "auto":
        diagnosis = autocorr_diagnosis(rows, target, order, **options).first().asDict()
    step = int(diagnosis["recommended_step"]) if step == "auto" else step
    if step > 1:
        rows = subsample(rows, step, order, series, **options)
    if lags:
        rows = lag_features(rows, target, order, series, lags, **options)
        inputs += feature_names(target, lags)
    rows = written(drop_missing(rows, [*inputs, target]), "features")
    parts = chronological_split(rows, order, test_size)
    train_rows, test_rows = (parts.filter(f).drop("is_train") for f in ("is_train", "NOT is_train"))
    kept, removed = prune_features(train_rows, inputs, target, strict=strict_leakage)
    if not kept:
        raise ValueError(f"no usable feature is left: {removed}")
    model = SensorModel(
        target, kept, list(lags), "kernel", removed=removed, diagnosis={**diagnosis, "step": step})
    if force != "boosted":
        both = fit_robust(train_rows, [*kept, target])
        x_scaler, y_scaler = both.only(kept), both.only([target])
        blocks = forward_folds(train_rows, order)
        ranked = forward_search(
            blocks, kept, target, x_scaler, y_scaler, "block", random_grid(trials, width, seed)
        )
        spec, model.cv_score = ranked[0]
    if force == "boosted" or (fallback and force is None and model.cv_score < FALLBACK_BELOW):
        model.kind = "boosted"
        model.pipeline = learners.fit(train_rows, kept, target, "boosted", **(boosted or {}))
    else:
        fit = fit_inducing if inducing else fit_kernel
        model.kernel = fit(train_rows, kept, target, x_scaler, y_scaler, spec)
    scored = model.predict(test_rows)
    row = regression_metrics(scored, target, "prediction").first()
    model.metrics = row.asDict()
    return model, scored
