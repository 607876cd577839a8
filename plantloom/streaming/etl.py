"""Incremental flows: validated append with statistics, hourly aggregates, online scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plantloom.functions.names import PhysicalRules, col
from plantloom.functions.safe import finite, is_infinite
from plantloom.operators.clean import impute
from plantloom.operators.validate import RULES, validate_rows


def _drain(writer, checkpoint: str, wait: bool) -> StreamingQuery:
    query = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    if wait:
        query.awaitTermination()
    return query


def run_stream_etl(
    stream: DataFrame,
    table_path: str,
    stats_path: str,
    checkpoint: str,
    ts: str,
    columns: Sequence[str],
    rules: PhysicalRules = RULES,
    skip: Sequence[str] = (),
    fill_value: float | None = None,
    wait: bool = True,
    strategy: str | None = None,
    order: Sequence[str] = (),
    series: Sequence[str] = (),
) -> StreamingQuery:
    """Validate → clean → append; one statistics row per micro-batch.

    Infinities become missing. A ``strategy`` of ``operators.clean`` fills missing values from
    the rows of the same micro-batch, and ``fill_value`` what is still missing.

    The checkpoint makes a restart resume after the last finished batch.  Both outputs are
    written below a batch folder in overwrite mode, so a batch that is run again after a
    failure replaces its own rows.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"etl_{batch_id}")
        kept = validate_rows(batch, ts, rules, skip=skip, observation=seen)
        infs = sum((F.count_if(is_infinite(col(c))) for c in columns), F.lit(0))
        cleaned = Observation(f"clean_{batch_id}")
        kept = kept.observe(cleaned, infs.cast("long").alias("inf_replaced"))
        out = kept.withColumns({c: finite(col(c)) for c in columns})
        if strategy is not None:
            out = impute(out, columns, strategy, order, series)
        if fill_value is not None:
            out = out.withColumns({c: F.coalesce(col(c), F.lit(fill_value)) for c in columns})
        out.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")
        n = seen.get
        row = [(n["rows_in"], n["rows_out"], n["rows_in"] - n["rows_out"],
                cleaned.get["inf_replaced"])]
        batch.sparkSession.createDataFrame(
            row, "rows_in long, rows_out long, rows_rejected long, inf_replaced long"
        ).write.mode("overwrite").parquet(f"{stats_path}/batch={batch_id}")

    return _drain(stream.writeStream.foreachBatch(one_batch), checkpoint, wait)


def hourly_stream(
    stream: DataFrame,
    ts: str,
    sensors: Sequence[str],
    targets: Sequence[str] = (),
    seq: str | None = None,
    series: Sequence[str] = (),
    delay: str = "1 hour",
    width: str = "1 hour",
) -> DataFrame:
    """Windowed sensor aggregates; rows later than ``delay`` are dropped by the watermark."""
    place = F.struct(col(ts), col(seq)) if seq else col(ts)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in sensors:
        v = col(c)
        aggs += [
            F.avg(v).alias(f"{c}__mean"),
            F.stddev_samp(v).alias(f"{c}__std"),
            F.min(v).alias(f"{c}__min"),
            F.max(v).alias(f"{c}__max"),
            F.max_by(v, F.when(v.isNotNull(), place)).alias(f"{c}__last"),
        ]
    for c in targets:
        aggs.append(F.min_by(col(c), F.when(col(c).isNotNull(), place)).alias(c))
    return (
        stream.withWatermark(ts, delay)
        .groupBy(*[col(c) for c in series], F.window(col(ts), width).alias("w"))
        .agg(*aggs)
        .withColumn("slot", col("w")["start"])
        .drop("w")
    )


def write_updates(
    stream: DataFrame, path: str, checkpoint: str, wait: bool = True
) -> StreamingQuery:
    """Keep what each micro-batch changed; with :func:`read_latest` a table that is always whole.

    A batch that runs again after a failure overwrites its own folder.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _drain(
        stream.writeStream.outputMode("update").foreachBatch(one_batch), checkpoint, wait
    )


def read_latest(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """The last state of every key, windows that are still open included."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*[col(c) for c in rest]), col("batch")).alias("__last")
    return rows.groupBy(*[col(c) for c in keys]).agg(last).select(
        *[col(c) for c in keys], *[col("__last")[c].alias(c) for c in rest]
    )


def write_stream_table(
    stream: DataFrame, path: str, checkpoint: str, wait: bool = True
) -> StreamingQuery:
    """Append a stream to a parquet table (exactly once through the sink's own log)."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    return _drain(writer, checkpoint, wait)


def score_stream(
    features: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    wait: bool = True,
) -> StreamingQuery:
    """Apply a fitted model to each micro-batch of feature rows and keep the results."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        predict(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _drain(features.writeStream.foreachBatch(one_batch), checkpoint, wait)
