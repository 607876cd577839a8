"""Registered queries: validation, cleaning, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantloom.functions.names import PhysicalRules
from plantloom.operators import clean, stats, validate
from plantloom.plans.registry import query, rounded
from plantloom.plans.tables import (
    FINITE_SQL,
    PLANT_SENSORS,
    PLANT_SQL,
    TIME,
    plant,
    table,
)

KEYS = ["event_id", "user_id"]
RULES = PhysicalRules()

_OK = """(feed_flow IS NULL OR feed_flow BETWEEN 0 AND 50000)
  AND (pulp_ph IS NULL OR pulp_ph BETWEEN 0 AND 14)
  AND (tank_level IS NULL OR tank_level BETWEEN -500 AND 1500)"""


@query("physical_validate", f"""WITH {PLANT_SQL}
SELECT event_id, ts, event_type, round(feed_flow, 6) AS feed_flow, round(pulp_ph, 6) AS pulp_ph,
  round(tank_level, 6) AS tank_level, round(mystery, 6) AS mystery FROM plant WHERE {_OK}""")
def _(spark, sf):
    kept = validate.validate_rows(plant(spark, sf), "ts", skip=KEYS)
    return rounded(kept.drop("user_id"))


@query("physical_validate_override", f"""WITH {PLANT_SQL}
SELECT event_id, round(mystery, 6) AS mystery FROM plant
WHERE {_OK} AND (mystery IS NULL OR mystery BETWEEN 0 AND 100)""")
def _(spark, sf):
    rules = RULES.with_rule("mystery", 0.0, 100.0)
    kept = validate.validate_rows(plant(spark, sf), "ts", rules, skip=KEYS)
    return rounded(kept.select("event_id", "mystery"))


@query("validation_stats", f"""WITH {PLANT_SQL}, c AS (
  SELECT count(*) AS rows_in, count(*) FILTER (WHERE {_OK}) AS rows_out,
    count(*) FILTER (WHERE NOT feed_flow BETWEEN 0 AND 50000) AS bad_feed_flow,
    count(*) FILTER (WHERE NOT pulp_ph BETWEEN 0 AND 14) AS bad_pulp_ph,
    count(*) FILTER (WHERE NOT tank_level BETWEEN -500 AND 1500) AS bad_tank_level
  FROM plant)
SELECT rows_in, rows_out, rows_in - rows_out AS rows_rejected, 0::BIGINT AS rows_without_timestamp,
  round((rows_in - rows_out) * 100.0::DOUBLE / rows_in, 2) AS reject_pct,
  CASE WHEN (rows_in - rows_out) * 100.0::DOUBLE / rows_in > 10 THEN 'high'
       WHEN (rows_in - rows_out) * 100.0::DOUBLE / rows_in > 5 THEN 'moderate' ELSE 'ok' END AS severity,
  bad_feed_flow, bad_pulp_ph, bad_tank_level, 'PH' AS category_of_ph,
  'UNKNOWN' AS category_of_mystery FROM c""")
def _(spark, sf):
    got = validate.validation_stats(plant(spark, sf), "ts", skip=KEYS)
    bad = lambda c: F.coalesce(F.try_element_at("invalid_by_column", F.lit(c)), F.lit(0))
    return got.select(
        "rows_in", "rows_out", "rows_rejected", "rows_without_timestamp", "reject_pct", "severity",
        *[bad(c).alias(f"bad_{c}") for c in ("feed_flow", "pulp_ph", "tank_level")],
        F.try_element_at("categories", F.lit("pulp_ph")).alias("category_of_ph"),
        F.try_element_at("categories", F.lit("mystery")).alias("category_of_mystery"),
    )


def _diag_sql(c: str, cat: str, lo: str, hi: str) -> str:
    bad = "FALSE" if cat == "UNKNOWN" else f"{c} IS NOT NULL AND NOT {c} BETWEEN {lo} AND {hi}"
    mean = (
        f"CASE WHEN count(*) FILTER (WHERE isinf({c})) > 0 THEN 'Infinity'::DOUBLE"
        f" ELSE avg(CASE WHEN isinf({c}) THEN NULL ELSE {c} END) END"
    )
    return f"""SELECT '{c}' AS "column", '{cat}' AS category, {lo}::DOUBLE AS min_allowed,
  {hi}::DOUBLE AS max_allowed, count(*) AS n_total, count(*) - count({c}) AS n_null,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS pct_null,
  count(*) FILTER (WHERE {bad}) AS n_invalid,
  round(count(*) FILTER (WHERE {bad}) * 100.0::DOUBLE / count(*), 2) AS pct_invalid,
  round(min(CASE WHEN {bad} THEN {c} END)::DOUBLE, 6) AS example_invalid,
  round(min({c}), 6) AS min_real, round(max({c}), 6) AS max_real, round({mean}, 6) AS mean
FROM plant"""


_DIAG = " UNION ALL ".join([
    _diag_sql("feed_flow", "FLOW_RATE", "0", "50000"),
    _diag_sql("pulp_ph", "PH", "0", "14"),
    _diag_sql("tank_level", "LEVEL", "(-500)", "1500"),
    _diag_sql("mystery", "UNKNOWN", "'-Infinity'", "'Infinity'"),
])


@query("diagnose_columns", f"WITH {PLANT_SQL} {_DIAG}")
def _(spark, sf):
    return rounded(validate.diagnose(plant(spark, sf), skip=KEYS))


@query("invalid_summary",
       f"WITH {PLANT_SQL}, d AS ({_DIAG}) SELECT * FROM d WHERE n_invalid > 0 OR pct_null > 10")
def _(spark, sf):
    return rounded(validate.invalid_summary(plant(spark, sf), skip=KEYS))


_NAMES_SQL = """CASE event_type WHEN 'click' THEN 'mill_power_kw' WHEN 'view' THEN 'pulp_ph'
  WHEN 'purchase' THEN 'Torque [Nm]' WHEN 'signup' THEN 'ore_density' ELSE 'mystery' END"""


def _long(spark, sf):
    t = F.col("event_type")
    name = (
        F.when(t == "click", "mill_power_kw").when(t == "view", "pulp_ph")
        .when(t == "purchase", "Torque [Nm]").when(t == "signup", "ore_density")
        .otherwise("mystery")
    )
    return plant(spark, sf).select("event_id", name.alias("sensor"), F.col("feed_flow").alias("v"))


_LIMITS_SQL = """limits AS (SELECT * FROM (VALUES
  ('mill_power_kw', 'POWER', 0.0, 50000.0), ('pulp_ph', 'PH', 0.0, 14.0),
  ('Torque [Nm]', 'TORQUE', 0.0, 500.0), ('ore_density', 'DENSITY', 0.5, 5.0)
  ) AS t(sensor, category, lo, hi))"""


@query("validate_values", f"""WITH {PLANT_SQL}, {_LIMITS_SQL},
r AS (SELECT p.event_id, {_NAMES_SQL} AS sensor, feed_flow AS v FROM plant p),
j AS (SELECT r.*, CASE WHEN v IS NULL THEN 'not a number' WHEN isinf(v) THEN 'infinite'
   WHEN l.sensor IS NULL THEN 'no category' WHEN v < lo THEN 'below minimum'
   WHEN v > hi THEN 'above maximum' END AS reason
  FROM r LEFT JOIN limits l ON r.sensor = l.sensor)
SELECT event_id, sensor, reason IS NULL AS valid, reason FROM j""")
def _(spark, sf):
    checked = validate.check_values(_long(spark, sf), "sensor", "v", strict=True)
    return checked.select("event_id", "sensor", "valid", "reason")


@query("physical_category", f"""WITH {_LIMITS_SQL}, r AS (SELECT {_NAMES_SQL} AS sensor FROM events)
SELECT r.sensor, coalesce(category, 'UNKNOWN') AS category,
  coalesce(lo, '-Infinity'::DOUBLE) AS lo, coalesce(hi, 'Infinity'::DOUBLE) AS hi, count(*) AS n
FROM r LEFT JOIN limits l ON r.sensor = l.sensor GROUP BY ALL""")
def _(spark, sf):
    named = RULES.classify(_long(spark, sf), "sensor")
    return named.groupBy(
        "sensor", "category", F.col("min_allowed").alias("lo"), F.col("max_allowed").alias("hi")
    ).agg(F.count(F.lit(1)).alias("n"))


_SEEN = ["feed_flow", "pulp_ph", "tank_level", "mystery"]


@query("rules_table", f"""WITH {PLANT_SQL}, r AS (SELECT * FROM (VALUES
  ('feed_flow', 'FLOW_RATE', 0.0::DOUBLE, 50000.0::DOUBLE, FALSE), ('pulp_ph', 'PH', 0.0, 14.0, FALSE),
  ('tank_level', 'LEVEL', -500.0, 1500.0, FALSE),
  ('mystery', 'UNKNOWN', 0.0, 9.0, TRUE)) AS t("column", category, min_allowed, max_allowed, has_override)),
u AS (UNPIVOT (SELECT feed_flow, pulp_ph, tank_level, mystery FROM plant)
      ON feed_flow, pulp_ph, tank_level, mystery INTO NAME name VALUE v)
SELECT r.*, count(v) AS n_readings FROM r LEFT JOIN u ON r."column" = u.name GROUP BY ALL""")
def _(spark, sf):
    rules = RULES.with_rule("Mystery", 0.0, 9.0)
    known = plant(spark, sf).agg(*[F.count(c).alias(c) for c in _SEEN])
    long = known.unpivot([], _SEEN, "column", "n_readings")
    return rules.table(spark, _SEEN).drop("unit").join(long, "column", "left")


@query("drop_unknown_columns",
       f"WITH {PLANT_SQL} SELECT event_id, ts, user_id, event_type, round(feed_flow, 6) AS feed_flow,"
       " round(pulp_ph, 6) AS pulp_ph, round(tank_level, 6) AS tank_level FROM plant")
def _(spark, sf):
    return rounded(validate.drop_unknown_columns(plant(spark, sf), skip=KEYS))


@query("drop_missing", f"""WITH {FINITE_SQL}
SELECT event_id FROM finite WHERE feed_flow IS NOT NULL AND pulp_ph IS NOT NULL""")
def _(spark, sf):
    done = validate.drop_missing(
        clean.inf_to_null(plant(spark, sf), ["feed_flow", "mystery"]), ["feed_flow", "pulp_ph"]
    )
    return done.select("event_id")


@query("inf_to_null", f"""WITH {FINITE_SQL} SELECT event_id, round(feed_flow, 6) AS feed_flow,
  round(mystery, 6) AS mystery FROM finite""")
def _(spark, sf):
    return rounded(
        clean.inf_to_null(plant(spark, sf), PLANT_SENSORS).select("event_id", "feed_flow", "mystery")
    )


def _fill_sql(pick) -> str:
    cols = ", ".join(f"round(coalesce({pick(c)}, 0.0), 6) AS {c}" for c in PLANT_SENSORS)
    return f"WITH {FINITE_SQL} SELECT event_id, {cols} FROM finite"


def _cleaned(spark, sf, strategy, **options):
    out = clean.clean(
        plant(spark, sf), strategy, TIME, columns=PLANT_SENSORS, **options
    ) if strategy in ("ffill", "bfill", "interpolate") else clean.clean(
        plant(spark, sf), strategy, columns=PLANT_SENSORS, **options
    )
    return rounded(out.select("event_id", *PLANT_SENSORS))


@query("clean_ffill", _fill_sql(
    lambda c: f"last_value({c} IGNORE NULLS) OVER (ORDER BY ts, event_id"
              " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def _(spark, sf):
    return _cleaned(spark, sf, "ffill")


@query("clean_ffill_by_unit", f"""WITH {FINITE_SQL} SELECT event_id,
  round(last_value(feed_flow IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS feed_flow,
  round(last_value(pulp_ph IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS pulp_ph FROM finite""")
def _(spark, sf):
    cols = ["feed_flow", "pulp_ph"]
    src = clean.inf_to_null(plant(spark, sf), cols)
    out = clean.ffill(src, cols, TIME, ["user_id"])
    return rounded(out.select("event_id", *cols))


@query("clean_bfill", _fill_sql(
    lambda c: f"first_value({c} IGNORE NULLS) OVER (ORDER BY ts, event_id"
              " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
def _(spark, sf):
    return _cleaned(spark, sf, "bfill")


def _interp_sql() -> str:
    lines = []
    for c in PLANT_SENSORS:
        lines.append(f"""
  last_value({c} IGNORE NULLS) OVER prev AS {c}_v0, first_value({c} IGNORE NULLS) OVER next AS {c}_v1,
  last_value(CASE WHEN {c} IS NOT NULL THEN o END IGNORE NULLS) OVER prev AS {c}_o0,
  first_value(CASE WHEN {c} IS NOT NULL THEN o END IGNORE NULLS) OVER next AS {c}_o1""")
    outs = ", ".join(
        f"round(coalesce({c}, {c}_v0 + ({c}_v1 - {c}_v0) * (o - {c}_o0) / nullif({c}_o1 - {c}_o0, 0),"
        f" {c}_v0, {c}_v1, 0.0), 6) AS {c}" for c in PLANT_SENSORS
    )
    return f"""WITH {FINITE_SQL}, n AS (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) AS o FROM finite), w AS (
  SELECT *, {','.join(lines)} FROM n WINDOW
    prev AS (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    next AS (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, {outs} FROM w"""


@query("clean_interpolate", _interp_sql())
def _(spark, sf):
    return _cleaned(spark, sf, "interpolate")


def _stat_sql(fn) -> str:
    cols = ", ".join(
        f"round(coalesce({c}, (SELECT {fn(c)} FROM finite)), 6) AS {c}" for c in PLANT_SENSORS
    )
    return f"WITH {FINITE_SQL} SELECT event_id, {cols} FROM finite"


@query("clean_mean", _stat_sql(lambda c: f"avg({c})"))
def _(spark, sf):
    return _cleaned(spark, sf, "mean")


@query("clean_median", _stat_sql(lambda c: f"quantile_cont({c}::DOUBLE, 0.5)"))
def _(spark, sf):
    return _cleaned(spark, sf, "median")


@query("fill_mode", """WITH t AS (SELECT o_orderkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders),
m AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority FROM t""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))
    )
    return clean.fill_mode(o, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


def _outlier_sql(lo_hi) -> str:
    cols = ", ".join(
        f"round(CASE WHEN {c} BETWEEN b.{c}_lo AND b.{c}_hi THEN {c} END, 6) AS {c}"
        for c in PLANT_SENSORS
    )
    bounds = ", ".join(
        f"{lo} AS {c}_lo, {hi} AS {c}_hi" for c in PLANT_SENSORS for lo, hi in [lo_hi(c)]
    )
    return (f"WITH {FINITE_SQL}, b AS (SELECT {bounds} FROM finite)"
            f" SELECT event_id, {cols} FROM finite, b")


def _masked(spark, sf, method, threshold):
    src = clean.inf_to_null(plant(spark, sf), PLANT_SENSORS)
    out = clean.mask_outliers(src, PLANT_SENSORS, method, threshold)
    return rounded(out.select("event_id", *PLANT_SENSORS))


@query("outliers_zscore", _outlier_sql(
    lambda c: (f"avg({c}) - 3.0 * stddev_samp({c})", f"avg({c}) + 3.0 * stddev_samp({c})")))
def _(spark, sf):
    return _masked(spark, sf, "zscore", 3.0)


@query("outliers_iqr", _outlier_sql(lambda c: (
    f"quantile_cont({c}::DOUBLE, 0.25) - 1.5 * (quantile_cont({c}::DOUBLE, 0.75)"
    f" - quantile_cont({c}::DOUBLE, 0.25))",
    f"quantile_cont({c}::DOUBLE, 0.75) + 1.5 * (quantile_cont({c}::DOUBLE, 0.75)"
    f" - quantile_cont({c}::DOUBLE, 0.25))")))
def _(spark, sf):
    return _masked(spark, sf, "iqr", 1.5)


@query("cleaning_stats", f"""WITH {FINITE_SQL}, z AS (
  SELECT avg(feed_flow) AS m, stddev_samp(feed_flow) AS s FROM finite), o AS (
  SELECT f.event_id, f.ts, f.feed_flow AS before,
    CASE WHEN f.feed_flow BETWEEN m - 3 * s AND m + 3 * s THEN f.feed_flow END AS masked
  FROM finite f, z), l AS (
  SELECT *, last_value(masked IGNORE NULLS) OVER (ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM o)
SELECT count(*) AS rows, (SELECT count(*) FROM plant WHERE isinf(feed_flow)) AS inf_replaced,
  count(before) - count(masked) AS outliers_masked, count(filled) - count(masked) AS nulls_imputed
FROM l""")
def _(spark, sf):
    return clean.cleaning_stats(
        plant(spark, sf), "ffill", TIME, columns=["feed_flow"], outliers="zscore"
    )


def _quality_sql(c: str) -> str:
    fin = f"CASE WHEN isinf({c}) THEN NULL ELSE {c} END"
    inf = f"count(*) FILTER (WHERE isinf({c}))"
    return f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS pct_null, {inf} AS n_inf,
  round(min({c}), 6) AS min, round(max({c}), 6) AS max,
  round(CASE WHEN {inf} > 0 THEN 'Infinity'::DOUBLE ELSE avg({fin}) END, 6) AS mean,
  round(CASE WHEN {inf} > 0 THEN NULL ELSE stddev_samp({fin}) END, 6) AS std FROM plant"""


@query("quality_report",
       f"WITH {PLANT_SQL} " + " UNION ALL ".join(_quality_sql(c) for c in PLANT_SENSORS))
def _(spark, sf):
    return rounded(clean.quality_report(plant(spark, sf), PLANT_SENSORS))


@query("null_counts", f"""WITH {PLANT_SQL}, u AS (
  SELECT count(*) AS n, count(feed_flow) AS feed_flow, count(pulp_ph) AS pulp_ph,
    count(event_type) AS event_type FROM plant)
SELECT 'feed_flow' AS "column", n - feed_flow AS n_null,
  round((n - feed_flow) * 100.0::DOUBLE / n, 6) AS pct_null FROM u
UNION ALL SELECT 'pulp_ph', n - pulp_ph, round((n - pulp_ph) * 100.0::DOUBLE / n, 6) FROM u
UNION ALL SELECT 'event_type', n - event_type, round((n - event_type) * 100.0::DOUBLE / n, 6) FROM u""")
def _(spark, sf):
    return rounded(stats.null_counts(plant(spark, sf), ["feed_flow", "pulp_ph", "event_type"]))

