"""Table and metric sinks, and the checked model store."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantloom.functions.names import col
from plantloom.models.kernel import KernelModel


def append_table(df: DataFrame, path: str, kind: str = "parquet", first: bool = False) -> None:
    """Append to the clean table (``first`` starts it anew)."""
    writer = df.write.mode("overwrite" if first else "append")
    writer.options(header=True).format(kind).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _content(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha) of every file of a saved model, hashed where it is read."""
    root = path.split(":", 1)[-1].rstrip("/") + "/"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    )
    return files.select(
        F.substring_index(col("path"), root, -1).alias("file"), F.sha2("content", 256).alias("sha")
    )


def digest(spark: SparkSession, path: str) -> str:
    """One SHA-256 over the sorted (file, hash) list of a saved model."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "file", "sha")))
    return _content(spark, path).agg(F.sha2(F.concat_ws("\n", lines), 256).alias("d")).first()["d"]


def save_model(spark: SparkSession, path: str, info: dict, pipeline: PipelineModel | None = None) -> str:
    """Write the metadata (and a Spark ML pipeline) plus a manifest; returns the digest."""
    path = path.rstrip("/")
    row = spark.createDataFrame([(json.dumps(info),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/info")
    if pipeline is not None:
        pipeline.write().overwrite().save(f"{path}/pipeline")
    signed = digest(spark, path)
    spark.createDataFrame([(signed,)], "digest string").coalesce(1).write.mode("overwrite").json(
        f"{path}.manifest"
    )
    return signed


def verify_model(
    spark: SparkSession, path: str, expected: str | None = None, trust_unsigned: bool = False
) -> None:
    """Raise ValueError unless the files match the expected digest or the manifest."""
    path = path.rstrip("/")
    if expected is None:
        try:
            expected = spark.read.schema("digest string").json(f"{path}.manifest").first()["digest"]
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
    if expected is None:
        if trust_unsigned:
            return
        raise ValueError(f"model {path!r} has no manifest; pass a digest or trust it explicitly")
    if digest(spark, path) != expected:
        raise ValueError(f"model {path!r} does not match its digest")


def load_model(
    spark: SparkSession, path: str, expected: str | None = None, trust_unsigned: bool = False
) -> tuple[dict, PipelineModel | None, KernelModel | None]:
    """(metadata, pipeline, kernel model) after verification; nothing is unpickled."""
    path = path.rstrip("/")
    verify_model(spark, path, expected, trust_unsigned)
    info = json.loads(spark.read.text(f"{path}/info", wholetext=True).first()["value"])
    if info["kind"] == "kernel":
        return info, None, KernelModel.from_dict(info["kernel"])
    return info, PipelineModel.load(f"{path}/pipeline"), None


def latest_model(spark: SparkSession, folder: str) -> str:
    """Path of the most recently written model below ``folder``."""
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter="part-*")
        .load(folder)
        .filter(col("path").contains("/info/"))
    )
    found = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()["p"]
    if found is None:
        raise ValueError(f"no model below {folder!r}")
    return found.rsplit("/info/", 1)[0]
