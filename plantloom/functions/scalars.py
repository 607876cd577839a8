"""Scalar expressions: confidence, error bands, class bands, verdict labels, bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantloom.functions.names import col


def confidence(std: Column, prediction: Column) -> Column:
    """Percent confidence from the relative spread; fixed 85 where no spread is known."""
    spread = F.abs(F.try_divide(std, prediction))
    score = F.least(F.greatest(F.lit(100.0) * F.exp(-3 * spread), F.lit(5.0)), F.lit(99.0))
    return (
        F.when(std.isNull() | prediction.isNull(), F.lit(None).cast("double"))
        .when(std == 0, F.lit(85.0))
        .when(F.abs(prediction) < 1e-6, F.lit(50.0))
        .otherwise(score)
    )


def relative_error(prediction: Column, real: Column) -> Column:
    """|p - r| / r in percent; 0 where the real value is 0."""
    return F.when(real == 0, F.lit(0.0)).otherwise(
        F.abs(prediction - real) / F.when(real != 0, real) * 100
    )


def error_band(error: Column) -> Column:
    return F.when(error < 5, "good").when(error < 15, "fair").otherwise("poor")


def prediction_interval(prediction: Column, std: Column, z: float = 1.96) -> tuple[Column, Column]:
    return prediction - F.lit(z) * std, prediction + F.lit(z) * std


def class_band(value: Column, first: float = 68, gap: float = 69, second: float = 137) -> Column:
    """1 up to ``first``, 2 in (``gap``, ``second``], else 3 (the gap value itself is 3)."""
    return F.when(value <= first, 1).when((value > gap) & (value <= second), 2).otherwise(3)


def flag_class(flags: Sequence[str]) -> Column:
    """Class number of the last raised flag (1-based), 0 if none is raised."""
    out = None
    for number, name in reversed(list(enumerate(flags, start=1))):
        hit = col(name) == 1
        out = F.when(hit, number) if out is None else out.when(hit, number)
    return out.otherwise(0)


def r2_quality(r2: Column) -> Column:
    return F.when(r2 > 0.8, "excellent").when(r2 > 0.5, "acceptable").otherwise("poor")


def model_verdict(model_r2: Column, persistence_r2: Column, margin: float = 0.02) -> Column:
    return (
        F.when(model_r2 > persistence_r2 + margin, "model")
        .when(model_r2 > persistence_r2 - margin, "tie")
        .otherwise("persistence")
    )


def signal_verdict(r2: Column, p_value: Column) -> Column:
    return F.when((r2 > 0.3) & (p_value < 0.05), "real").when(r2 > 0.1, "weak").otherwise("none")


def strength_verdict(r2: Column) -> Column:
    return F.when(r2 > 0.5, "strong").when(r2 > 0.2, "moderate").otherwise("none")


def baseline_verdict(r2: Column, baseline_r2: Column) -> Column:
    return (
        F.when(r2 > baseline_r2 + 0.15, "clear gain")
        .when(r2 > baseline_r2, "small gain")
        .otherwise("no gain")
    )


def milling_features(speed: Column, torque: Column, wear: Column, air: Column, process: Column):
    """Derived columns of the milling table."""
    power = speed * torque
    return {
        "Power": power,
        "Power wear": power * wear,
        "Temperature difference": process - air,
        "Temperature power": F.try_divide(process - air, power),
    }


def airflow_columns(names: Sequence[str]) -> list[str]:
    return [n for n in names if any(p in n.lower() for p in ("air", "flow", "aire"))]


def perturb(names: Sequence[str], factor: Column | float, noise: float = 0.0, seed: int = 42):
    """What-if scaling of the air and flow columns, optional seeded noise."""
    scale = factor if isinstance(factor, Column) else F.lit(float(factor))
    out: Mapping[str, Column] = {}
    for i, n in enumerate(airflow_columns(names)):
        shake = F.randn(seed + i) * noise if noise else F.lit(0.0)
        out = {**out, n: col(n) * scale + shake}
    return out
