"""The driver's tables as sensor tables, and the same views in SQL for the oracles.

The dirt is deterministic (derived from keys), so both engines see the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INF = float("inf")
TIME = ["ts", "event_id"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
PLANT_SENSORS = ["feed_flow", "pulp_ph", "tank_level", "mystery"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def plant(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a wide sensor table with missing, infinite and out-of-range readings."""
    e, v, i = events(spark, sf), F.col("value"), F.col("event_id")
    none = F.lit(None).cast("double")
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("double")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.when(i % 97 == 0, none).when(i % 101 == 0, INF).when(i % 89 == 0, -5.0)
        .otherwise(v).alias("feed_flow"),
        F.when(i % 53 == 0, none).otherwise(k / 7.0).alias("pulp_ph"),
        (v * 4 - 200).alias("tank_level"),
        F.when(i % 211 == 0, INF).otherwise(v * 0.5).alias("mystery"),
    )


PLANT_SQL = """plant AS (
  SELECT event_id, ts, user_id, event_type,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 'Infinity'::DOUBLE
         WHEN event_id % 89 = 0 THEN -5.0 ELSE value END AS feed_flow,
    CASE WHEN event_id % 53 = 0 THEN NULL
         ELSE CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 7.0 END AS pulp_ph,
    value * 4 - 200 AS tank_level,
    CASE WHEN event_id % 211 = 0 THEN 'Infinity'::DOUBLE ELSE value * 0.5 END AS mystery
  FROM events)"""

# Only ±infinity replaced.
FINITE_SQL = PLANT_SQL + """, finite AS (
  SELECT event_id, ts, user_id, event_type,
    CASE WHEN isinf(feed_flow) THEN NULL ELSE feed_flow END AS feed_flow,
    pulp_ph, tank_level,
    CASE WHEN isinf(mystery) THEN NULL ELSE mystery END AS mystery
  FROM plant)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a sample table with a planted linear target and a copy of it."""
    li = table(spark, sf, "lineitem")
    noise = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey") * 3) % 11
    y = 3 * F.col("l_quantity") - 40 * F.col("l_discount") + 5 * F.col("l_tax") + noise - 5
    return li.withColumn("y", y)


SAMPLES_SQL = """samples AS (
  SELECT *, 3 * l_quantity - 40 * l_discount + 5 * l_tax
    + (l_orderkey * 7 + l_linenumber * 13 + l_partkey * 3) % 11 - 5 AS y
  FROM lineitem)"""
