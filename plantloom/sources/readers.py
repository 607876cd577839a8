"""Tolerant file readers for sensor tables, and config-driven loading."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantloom.functions.names import col, sanitize_columns, select_by_rules
from plantloom.functions.safe import nan_to_null
from plantloom.operators.clean import ffill
from plantloom.operators.encode import numeric_coerce
from plantloom.operators.validate import drop_missing
from plantloom.sources.typing import date_value, parse_dates

SEPARATORS = (",", ";", "\t", "|")
_BAD = "__bad_line"


def _fields(line, sep: str):
    """Number of fields of a line; a separator between double quotes is part of its field."""
    cut = "\\" + sep if sep == "|" else sep
    return F.size(F.split(F.regexp_replace(line, '"[^"]*"', "q"), cut))


def detect_separator(spark: SparkSession, path: str, lines: int | None = None) -> str:
    """The candidate that cuts the lines into the steadiest number (> 1) of fields.

    All lines count unless ``lines`` asks for the first ones only.
    """
    head = spark.read.text(path)
    if lines is not None:
        head = head.limit(lines)
    fields = {s: _fields(col("value"), s) for s in SEPARATORS}
    aggs = [F.mode(n).alias(f"m{i}") for i, n in enumerate(fields.values())]
    modes = head.agg(*aggs).first()
    shares = head.agg(
        *[
            F.avg((n == F.lit(modes[i] or 0)).cast("double")).alias(f"s{i}")
            for i, n in enumerate(fields.values())
        ]
    ).first()
    ranked = [
        (shares[i], modes[i], -i, s) for i, s in enumerate(SEPARATORS) if (modes[i] or 0) > 1
    ]
    return max(ranked)[3] if ranked else ","


def read_raw_csv(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str = "utf-8",
    place: str | None = None, detect_lines: int | None = None,
) -> DataFrame:
    """Header CSV as text columns; over-long lines are skipped, short ones padded.

    ``place`` names a column that orders the rows as files and lines do: file, block, row.
    """
    sep = sep or detect_separator(spark, path, detect_lines)
    options = {"sep": sep, "header": True, "encoding": encoding}
    schema = spark.read.options(**options).csv(path).schema
    width = len(schema)
    lines = (
        spark.read.options(
            **options, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, columnPruning=False
        )
        .schema(schema.add(_BAD, "string"))
        .csv(path)
    )
    # Spark refuses a scan that needs the bad-line column alone, so the test also reads a field.
    reads_field = F.length(F.concat_ws("", col(schema.names[0]))) >= 0
    too_long = col(_BAD).isNotNull() & (_fields(col(_BAD), sep) > width) & reads_field
    if place:
        lines = lines.withColumn(place, _place())
    return lines.filter(~too_long).drop(_BAD)


def _place():
    """Position of a row in its files: name, start of the block read, running number in a task."""
    block = F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0")
    row = F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
    return F.concat_ws(":", F.col("_metadata.file_path"), block, row)


def read_sensor_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str = "utf-8",
    max_rows: int | None = None,
    date_column: str = "date",
) -> DataFrame:
    """Clean names, numbers with comma or point, parsed dates.

    ``seq`` orders the rows as files and lines do; ``max_rows`` takes the first of them.
    """
    raw = sanitize_columns(read_raw_csv(spark, path, sep, encoding, place="seq"))
    if max_rows is not None:
        raw = raw.orderBy("seq").limit(max_rows)
    numbers = [c for c in raw.columns if c != "seq" and "date" not in c.lower()]
    typed = nan_to_null(numeric_coerce(raw, numbers))
    typed = typed.select(*[col(c) for c in typed.columns if c != "seq"], "seq")
    return parse_dates(typed, date_column) if date_column in typed.columns else typed


def read_whitespace(
    spark: SparkSession, path: str, names: Sequence[str], integers: Sequence[str] = ()
) -> DataFrame:
    """Header-less, blank-separated table with supplied names."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    cells = lines.select(parts.alias("p"))
    return cells.select(
        *[
            F.get("p", F.lit(i)).try_cast("bigint" if n in integers else "double").alias(n)
            for i, n in enumerate(names)
        ]
    )


def stream_csv(
    spark: SparkSession, folder: str, schema, sep: str = ",", files_per_trigger: int = 10
) -> DataFrame:
    """New files of a folder as a stream of micro-batches."""
    return (
        spark.readStream.schema(schema)
        .options(sep=sep, header=True, maxFilesPerTrigger=files_per_trigger)
        .csv(folder)
    )


def stream_sensor_csv(
    spark: SparkSession, folder: str, header: Sequence[str], date_column: str = "date",
    sep: str = ",", files_per_trigger: int = 10, rules: DatasetConfig | None = None,
) -> DataFrame:
    """New CSV files as typed rows: clean names, numbers, dates, and the column rules.

    ``header`` names the columns of the files. A stream has no whole column to look at, so each
    date takes the first format that reads it.
    """
    schema = ", ".join(f"`{c}` string" for c in header)
    raw = sanitize_columns(stream_csv(spark, folder, schema, sep, files_per_trigger))
    numbers = [c for c in raw.columns if "date" not in c and c != date_column]
    typed = nan_to_null(numeric_coerce(raw, numbers))
    if date_column in typed.columns:
        typed = typed.withColumn(date_column, date_value(F.trim(col(date_column))))
    if rules is None:
        return typed
    return select_by_rules(
        typed, rules.target, rules.include, rules.exclude, rules.forced_drop, keep=[date_column])


def resolve_inside(root: str, filename: str) -> str:
    """The path of ``filename`` below ``root``; anything that escapes raises ValueError."""
    scheme = urlsplit(root).scheme
    if scheme and scheme != "file":
        base = root.rstrip("/") + "/"
        full = base + posixpath.normpath(filename)
        if filename.startswith("/") or urlsplit(filename).scheme or "/../" in full + "/":
            raise ValueError(f"{filename!r} leaves the data root")
        return full
    base = os.path.realpath(urlsplit(root).path if scheme else root)
    full = os.path.realpath(os.path.join(base, filename))
    if not full.startswith(base + os.sep):
        raise ValueError(f"{filename!r} leaves the data root")
    return full


@dataclass(frozen=True)
class DatasetConfig:
    """The parts of a dataset description the engine uses."""

    filename: str
    target: str
    timestamp: str
    separator: str = ","
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    forced_drop: tuple[str, ...] = ()

    @classmethod
    def from_mapping(cls, d: Mapping) -> DatasetConfig:
        files, rules = d["files"], d.get("feature_engineering", {})
        return cls(
            files["filename"],
            d["modeling"]["target_column"],
            files["timestamp_column"],
            files.get("separator", ","),
            tuple(rules.get("include_patterns", ())),
            tuple(rules.get("exclude_patterns", ())),
            tuple(rules.get("forced_drop", ())),
        )


def prepare_dataset(
    df: DataFrame, config: DatasetConfig, order: Sequence[str], **options
) -> DataFrame:
    """Column rules → forward fill → drop incomplete rows, for a frame already read."""
    kept = select_by_rules(
        df, config.target, config.include, config.exclude, config.forced_drop, keep=order
    )
    names = [c for c in kept.columns if c not in order]
    return drop_missing(ffill(kept, names, order, **options), names)


def load_dataset(spark: SparkSession, root: str, config: DatasetConfig, **options) -> DataFrame:
    """Read the configured file, parse its timestamp, apply the rules and fill gaps."""
    path = resolve_inside(root, config.filename)
    ts = config.timestamp
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path).withColumn("seq", _place())
        if dict(raw.dtypes)[ts] != "timestamp":
            raw = raw.withColumn(ts, col(ts).cast("timestamp"))
    else:
        text = read_raw_csv(spark, path, config.separator, place="seq")
        numbers = numeric_coerce(text, [c for c in text.columns if c not in (ts, "seq")])
        raw = parse_dates(numbers, ts)
    return prepare_dataset(nan_to_null(raw), config, [ts, "seq"], **options)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the parquet cache at ``path``, or build and write it first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
