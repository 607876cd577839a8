"""Registered queries: ordered features, labels, splits, joins, typing, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantloom.functions.names import select_by_rules
from plantloom.functions.scalars import (
    baseline_verdict,
    class_band,
    error_band,
    flag_class,
    milling_features,
    model_verdict,
    prediction_interval,
    r2_quality,
    relative_error,
    signal_verdict,
    strength_verdict,
)
from plantloom.operators import encode, joins, metrics, order, position, split, timeseries
from plantloom.plans.registry import query, rounded
from plantloom.plans.tables import LINE, SAMPLES_SQL, TIME, events, samples, table
from plantloom.sources.typing import parse_dates

# ── ordered features ────────────────────────────────────────────────────────────────────

_LAGS_SQL = """
  round(lag(value, 1) OVER w, 6) AS value_lag_1, round(lag(value, 5) OVER w, 6) AS value_lag_5,
  round(lag(value, 10) OVER w, 6) AS value_lag_10, round(lag(value, 20) OVER w, 6) AS value_lag_20,
  round(lag(value, 1) OVER w - lag(value, 2) OVER w, 6) AS value_diff_1,
  round(lag(value, 1) OVER w - lag(value, 6) OVER w, 6) AS value_diff_5,
  round(avg(value) OVER r, 6) AS value_rolling_mean_10,
  round(stddev_samp(value) OVER r, 6) AS value_rolling_std_10"""


def _lag_sql(part: str = "") -> str:
    return f"""SELECT event_id, {_LAGS_SQL} FROM events WINDOW w AS ({part} ORDER BY ts, event_id),
  r AS ({part} ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


_FEATURES = timeseries.feature_names("value")


@query("lag_features", _lag_sql())
def _(spark, sf):
    out = timeseries.lag_features(events(spark, sf), "value", TIME)
    return rounded(out.select("event_id", *_FEATURES))


@query("lag_features_by_unit", _lag_sql("PARTITION BY user_id"))
def _(spark, sf):
    out = timeseries.lag_features(events(spark, sf), "value", TIME, ["user_id"])
    return rounded(out.select("event_id", *_FEATURES))


@query("input_lags", "SELECT event_id, " + ", ".join(
    f'round(coalesce(lag({c}, {k}) OVER w, 0.0), 6) AS "{c}_t-{k}"'
    for k in (1, 2, 3) for c in ("value", "user_id"))
    + " FROM (SELECT event_id, ts, value, user_id::DOUBLE AS user_id FROM events)"
      " WINDOW w AS (ORDER BY ts, event_id)")
def _(spark, sf):
    e = events(spark, sf).withColumn("user_id", F.col("user_id").cast("double"))
    out = timeseries.input_lags(e, ["value", "user_id"], TIME)
    names = [f"{c}_t-{k}" for k in (1, 2, 3) for c in ("value", "user_id")]
    return rounded(out.select("event_id", *names))


@query("unit_rolling", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events)
SELECT event_id, round(CASE WHEN rn <= 10 THEN value ELSE avg(value) OVER (PARTITION BY user_id
  ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END, 6) AS value_rm FROM t""")
def _(spark, sf):
    out = timeseries.unit_rolling_mean(
        events(spark, sf), ["value"], ["user_id"], TIME
    )
    return rounded(out.select("event_id", "value_rm"))


_CYCLES_SQL = """cycles AS (SELECT event_id, user_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS time_cycles FROM events)"""


def _cycles(spark, sf):
    placed = order.with_ordinal(events(spark, sf), TIME, ["user_id"], "o")
    return placed.select(
        "event_id", "user_id", "value", (F.col("o") + 1).cast("long").alias("time_cycles")
    )


@query("rul_label", f"""WITH {_CYCLES_SQL} SELECT event_id, time_cycles,
  max(time_cycles) OVER (PARTITION BY user_id) - time_cycles AS "RUL" FROM cycles""")
def _(spark, sf):
    out = timeseries.rul_label(_cycles(spark, sf), ["user_id"], "time_cycles")
    return out.select("event_id", "time_cycles", "RUL")


@query("class_bands", f"""WITH {_CYCLES_SQL}, r AS (SELECT event_id,
  max(time_cycles) OVER (PARTITION BY user_id) - time_cycles AS k FROM cycles)
SELECT event_id, k, least(k, 50) AS clipped,
  CASE WHEN k <= 20 THEN 1 WHEN k > 21 AND k <= 45 THEN 2 ELSE 3 END AS band FROM r""")
def _(spark, sf):
    r = timeseries.rul_label(_cycles(spark, sf), ["user_id"], "time_cycles", "k")
    r = r.withColumn("band", class_band(F.col("k"), 20, 21, 45)).withColumn("clipped", F.col("k"))
    return encode.clip_upper(r, "clipped", 50).select("event_id", "k", "clipped", "band")


_HORIZON_SQL = " UNION ALL ".join(
    f"""SELECT event_id, {h} AS horizon, round(value, 6) AS value, round(lead(value, {h}) OVER w, 6) AS target,
  lead(event_id, {h}) OVER w AS f FROM events WINDOW w AS (ORDER BY ts, event_id)"""
    for h in timeseries.HORIZONS
)


@query("horizon_target",
       f"SELECT event_id, horizon, value, target FROM ({_HORIZON_SQL}) WHERE f IS NOT NULL")
def _(spark, sf):
    out = timeseries.horizon_targets(events(spark, sf), "value", TIME)
    return rounded(out.select("event_id", "horizon", "value", "target"))


@query("persistence_baseline", """WITH t AS (SELECT value AS y, lag(value) OVER (ORDER BY ts, event_id) AS p FROM events)
SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(avg(abs((y - p) / nullif(y, 0))) * 100, 4) AS mape FROM t WHERE p IS NOT NULL""")
def _(spark, sf):
    out = timeseries.persistence(events(spark, sf), "value", TIME)
    got = metrics.regression_metrics(out, "value", "persistence")
    return rounded(got.withColumn("mape", F.round("mape", 4)))


@query("mean_baseline", """WITH t AS (SELECT value AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS o,
  count(*) OVER () AS n FROM events), m AS (SELECT avg(y) AS p FROM t WHERE o < floor(n * 0.8::DOUBLE))
SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(avg(abs((y - p) / nullif(y, 0))) * 100, 4) AS mape
FROM t, m WHERE o >= floor(n * 0.8::DOUBLE)""")
def _(spark, sf):
    parts = split.chronological_split(events(spark, sf), TIME)
    got = metrics.mean_baseline(parts.filter("is_train"), parts.filter("NOT is_train"), "value")
    return rounded(got.withColumn("mape", F.round("mape", 4)))


_PROBES = [1, *timeseries.PROBE_LAGS]


@query("autocorr_diag", "WITH l AS (SELECT value AS y, " + ", ".join(
    f"lag(value, {k}) OVER (ORDER BY ts, event_id) AS l{k}" for k in _PROBES)
    + " FROM events), s AS (SELECT count(*) AS n, avg(y) AS m, stddev_samp(y) AS sd, " + ", ".join(
        f"corr(y, l{k}) AS a{k}" for k in _PROBES)
    + """ FROM l)
SELECT n AS n_samples, round(m, 6) AS mean, round(sd, 6) AS std, round(sd / m * 100, 6) AS cv,
  round(a1, 6) AS autocorr_1, round(a10, 6) AS autocorr_10, round(a50, 6) AS autocorr_50,
  CASE """ + " ".join(f"WHEN a{k} < 0.85 THEN {k}" for k in timeseries.PROBE_LAGS)
    + """ ELSE 200 END AS recommended_step, CASE WHEN a1 > 0.98 THEN 'critical' WHEN a1 > 0.95 THEN 'high'
  WHEN a1 > 0.9 THEN 'moderate' ELSE 'ok' END AS severity FROM s""")
def _(spark, sf):
    return rounded(timeseries.autocorr_diagnosis(events(spark, sf), "value", TIME))


@query("subsample", """SELECT event_id, ord FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord
  FROM events) WHERE ord % 7 = 0""")
def _(spark, sf):
    placed = order.with_ordinal(events(spark, sf), TIME)
    return order.subsample(placed, 7, TIME).select("event_id", "ord")


@query("tail_rows", """SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props
FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def _(spark, sf):
    return rounded(position.last_rows(events(spark, sf), 500, TIME))


@query("tail_rows_large", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE
  (l_partkey * 100000000 + l_orderkey * 1000 + l_suppkey) IN (
   SELECT l_partkey * 100000000 + l_orderkey * 1000 + l_suppkey FROM lineitem
   ORDER BY 1 DESC LIMIT 20000)""")
def _(spark, sf):
    key = F.col("l_partkey") * 100000000 + F.col("l_orderkey") * 1000 + F.col("l_suppkey")
    li = table(spark, sf, "lineitem").withColumn("k", key)
    return position.last_rows(li, 20000, ["k"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("trailing_slice", """SELECT event_id, round(value, 6) AS value FROM (SELECT *,
  row_number() OVER (ORDER BY ts, event_id) - 1 AS o, count(*) OVER () AS n FROM events)
WHERE o >= n // 2 - 100 AND o < n // 2""")
def _(spark, sf):
    e = events(spark, sf)
    out = position.trailing_slice(e, 100, e.count() // 2, TIME)
    return rounded(out.select("event_id", "value"))


# ── splits ──────────────────────────────────────────────────────────────────────────────


@query("chrono_split", """SELECT event_id, o < floor(n * 0.8::DOUBLE) AS is_train FROM (SELECT event_id,
  row_number() OVER (ORDER BY ts, event_id) - 1 AS o, count(*) OVER () AS n FROM events)""")
def _(spark, sf):
    return split.chronological_split(events(spark, sf), TIME).select("event_id", "is_train")


@query("chrono_split_ties", """SELECT o_orderkey, o < floor(n * 0.7::DOUBLE) AS is_train FROM (SELECT o_orderkey,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS o, count(*) OVER () AS n FROM orders)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    cut = split.chronological_split(o, ["o_orderdate", "o_orderkey"], 0.3)
    return cut.select("o_orderkey", "is_train")


@query("forward_folds", """SELECT event_id, CASE WHEN o < n - 3 * (n // 4) THEN 0 WHEN o < n - 2 * (n // 4) THEN 1
  WHEN o < n - n // 4 THEN 2 ELSE 3 END AS block FROM (SELECT event_id,
  row_number() OVER (ORDER BY ts, event_id) - 1 AS o, count(*) OVER () AS n FROM events)""")
def _(spark, sf):
    return split.forward_folds(events(spark, sf), TIME).select("event_id", "block")


@query("strat_order_split", """SELECT event_id, event_type, o < floor(n * 0.8::DOUBLE) AS is_train FROM (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS o,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def _(spark, sf):
    out = split.stratified_split(events(spark, sf), "event_type", 0.2, order=TIME)
    return out.select("event_id", "event_type", "is_train")


_MD5 = "md5(concat_ws('|', '42', {}::VARCHAR))"


@query("strat_random_split", f"""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format("event_id")}, event_id)
  <= floor(count(*) OVER (PARTITION BY event_type) * 0.65::DOUBLE) AS is_train FROM events""")
def _(spark, sf):
    out = split.stratified_split(events(spark, sf), "event_type", 0.35, keys=["event_id"])
    return out.select("event_id", "is_train")


@query("random_split", f"""SELECT event_id, row_number() OVER (ORDER BY {_MD5.format("event_id")}, event_id)
  > ceil(count(*) OVER () * 0.3::DOUBLE) AS is_train FROM events""")
def _(spark, sf):
    return split.random_split(events(spark, sf), ["event_id"], 0.3).select("event_id", "is_train")


@query("unit_split", """SELECT 0::BIGINT AS units_on_both_sides, count(DISTINCT user_id) AS n_units,
  floor(count(DISTINCT user_id) * 0.2::DOUBLE)::BIGINT AS n_test_units, count(*) AS n_rows FROM events""")
def _(spark, sf):
    sides = split.unit_split(events(spark, sf), "user_id", 0.2).groupBy("user_id").agg(
        F.countDistinct("is_train").alias("sides"), F.min("is_train").alias("t"),
        F.count(F.lit(1)).alias("n"),
    )
    return sides.agg(
        F.count_if(F.col("sides") > 1).alias("units_on_both_sides"),
        F.count(F.lit(1)).alias("n_units"),
        F.count_if(~F.col("t")).alias("n_test_units"),
        F.sum("n").alias("n_rows"),
    )


@query("kfold", f"""SELECT event_id, ((row_number() OVER (ORDER BY {_MD5.format("event_id")}, event_id) - 1) % 5)::INT AS fold
FROM events""")
def _(spark, sf):
    return split.kfold(events(spark, sf), ["event_id"], 5).select("event_id", "fold")


@query("group_folds", """SELECT count(DISTINCT l_suppkey) AS n_groups, 0::BIGINT AS groups_in_two_folds,
  5::BIGINT AS n_folds, count(*) AS n_rows, TRUE AS balanced FROM lineitem""")
def _(spark, sf):
    li = split.group_folds(table(spark, sf, "lineitem"), "l_suppkey", 5)
    per = li.groupBy("l_suppkey", "fold").agg(F.count(F.lit(1)).alias("n"))
    split_up = per.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("f"), F.sum("n").alias("n"), F.max("fold").alias("fold")
    )
    folds = split_up.groupBy("fold").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("f") > 1).alias("bad"), F.max("n").alias("widest"),
    )
    # Dealt there and back, two folds differ by less than the largest group.
    return folds.agg(
        F.sum("groups").alias("n_groups"),
        F.sum("bad").alias("groups_in_two_folds"),
        F.count(F.lit(1)).alias("n_folds"),
        F.sum("n").alias("n_rows"),
        (F.max("n") - F.min("n") <= F.max("widest")).alias("balanced"),
    )


@query("sample_cap", f"SELECT event_id, user_id FROM events ORDER BY {_MD5.format('event_id')}, event_id LIMIT 1800")
def _(spark, sf):
    return split.sample_cap(events(spark, sf), 1800, ["event_id"], TIME).select("event_id", "user_id")


@query("random_row", f"SELECT event_id, user_id, round(value, 6) AS value FROM events ORDER BY {_MD5.format('event_id')} LIMIT 1")
def _(spark, sf):
    return rounded(split.random_row(events(spark, sf), ["event_id"]).select("event_id", "user_id", "value"))


# ── joins ───────────────────────────────────────────────────────────────────────────────


@query("join_suffix", """SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 6) AS price,
  round(o_totalprice, 6) AS price_order FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _(spark, sf):
    """Lines and their orders: the key is unique on one side."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), *LINE[1:], F.col("l_extendedprice").alias("price"))
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return rounded(joins.join_suffix(li, o, ["k"], "_order"))


@query("join_integrity", """WITH l AS (SELECT o_orderkey AS k, count(*) AS nl FROM orders GROUP BY 1),
r AS (SELECT l_orderkey AS k, count(*) AS nr FROM lineitem GROUP BY 1),
j AS (SELECT * FROM l FULL JOIN r USING (k))
SELECT sum(nl)::BIGINT AS left_rows, count(nl) AS left_keys, sum(nr)::BIGINT AS right_rows,
  count(nr) AS right_keys, min(nr) AS right_min_per_key, max(nr) AS right_max_per_key,
  sum(nl * nr)::BIGINT AS joined_rows, sum(nl * nr) > sum(nl) AS multiplies FROM j""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return joins.join_integrity(o, li, ["k"])


@query("concat_rows", """SELECT s_suppkey AS id, 's' AS side, round(s_acctbal, 6) AS bal FROM supplier
UNION ALL SELECT c_custkey, 'c', round(c_acctbal, 6) FROM customer""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.lit("s").alias("side"), F.col("s_acctbal").alias("bal")
    )
    c = table(spark, sf, "customer").select(
        F.lit("c").alias("side"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")
    )
    return rounded(joins.concat_rows([s, c]))


@query("concat_columns", """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders),
b AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS p FROM events)
SELECT o_orderkey, event_id FROM a FULL JOIN b USING (p)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    e = events(spark, sf).select("event_id", "ts")
    return joins.concat_columns(o, e, ["o_orderkey"], TIME).select(
        "o_orderkey", "event_id"
    )


# ── typing and encoding ─────────────────────────────────────────────────────────────────


@query("select_by_rules", "SELECT l_extendedprice, l_discount, l_linestatus, l_shipdate FROM lineitem")
def _(spark, sf):
    return select_by_rules(
        table(spark, sf, "lineitem"), "l_extendedprice",
        include=["price", "date", "status", "key", "disc"], exclude=["key", "ext"],
        forced_drop=["l_tax"],
    )


@query("numeric_coerce", """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE round(l_extendedprice, 6) END AS price, 'x ' AS date_text FROM lineitem""")
def _(spark, sf):
    text = F.regexp_replace(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), r"\.", ",")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.concat(F.lit(" "), text)).alias("price"),
        F.lit("x ").alias("date_text"),
    )
    return rounded(encode.numeric_coerce(li))


@query("parse_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS date FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 == 0, "unknown")
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")).alias("date"),
    )
    return rounded(parse_dates(o, "date"))


@query("cast_where_possible", """SELECT p_partkey, p_brand, p_size::DOUBLE AS size_text FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", "p_brand", F.col("p_size").cast("string").alias("size_text")
    )
    return rounded(encode.cast_where_possible(p))


@query("drop_columns", "SELECT p_partkey, p_brand FROM part")
def _(spark, sf):
    return table(spark, sf, "part").drop("p_name", "p_type", "p_size", "p_retailprice")


@query("derived_features", """SELECT l_orderkey, l_linenumber, l_partkey, round(s * t, 4) AS "Power",
  round(s * t * l_quantity, 4) AS "Power wear", round(l_extendedprice - l_tax, 6) AS "Temperature difference",
  ((l_extendedprice - l_tax) / nullif(s * t, 0))::REAL::DOUBLE AS "Temperature power"
FROM (SELECT *, l_suppkey::DOUBLE AS s, l_discount AS t FROM lineitem)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    new = milling_features(
        F.col("l_suppkey").cast("double"), F.col("l_discount"), F.col("l_quantity"), F.col("l_tax"),
        F.col("l_extendedprice"),
    )
    out = li.select("l_orderkey", "l_linenumber", "l_partkey", *[e.alias(n) for n, e in new.items()])
    digits = {"Power": 4, "Power wear": 4, "Temperature difference": 6}
    # The ratio spans seven orders of magnitude: compared at single precision.
    ratio = F.col("Temperature power").cast("float").cast("double")
    return out.withColumns(
        {**{n: F.round(n, d) for n, d in digits.items()}, "Temperature power": ratio}
    )


@query("flag_label", """SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 5 WHEN event_id % 23 = 0 THEN 4
  WHEN event_id % 19 = 0 THEN 3 WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS failure
FROM events""")
def _(spark, sf):
    flags = {"TWF": 13, "HDF": 17, "PWF": 19, "OSF": 23, "RNF": 31}
    e = events(spark, sf).withColumns(
        {n: (F.col("event_id") % m == 0).cast("int") for n, m in flags.items()}
    )
    return e.select("event_id", flag_class(list(flags)).alias("failure"))


@query("one_hot", """SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'N')::INT AS "l_returnflag_N",
  (l_returnflag = 'R')::INT AS "l_returnflag_R", (l_linestatus = 'O')::INT AS "l_linestatus_O" FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"
    )
    return encode.one_hot(li, ["l_returnflag", "l_linestatus"])


@query("sentinel_to_null", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS o_orderstatus
FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return encode.sentinel_to_null(o, ["o_orderstatus"], "P")


@query("align_features", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax, 6) AS l_tax, 0.0::DOUBLE AS gone,
  round(l_quantity, 6) AS l_quantity FROM lineitem""")
def _(spark, sf):
    return rounded(encode.align_features(
        table(spark, sf, "lineitem"), ["l_tax", "gone", "l_quantity"],
        keep=["l_orderkey", "l_linenumber", "l_partkey"],
    ))


@query("whatif_sweep", """SELECT event_id, f.f AS factor, round(value * f.f, 6) AS air_flow, round(value, 6) AS level
FROM events, (VALUES (0.8::DOUBLE), (1.0), (1.2)) f(f)""")
def _(spark, sf):
    e = events(spark, sf).select(
        "event_id", F.col("value").alias("air_flow"), F.col("value").alias("level")
    )
    return rounded(encode.scenario_sweep(e, [0.8, 1.0, 1.2]))


# ── metrics ─────────────────────────────────────────────────────────────────────────────

_PRED = "2.9 * l_quantity + 1"


@query("regression_metrics", f"""WITH {SAMPLES_SQL}, t AS (SELECT l_returnflag, y, {_PRED} AS p FROM samples)
SELECT l_returnflag, count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(avg(abs((y - p) / nullif(y, 0))) * 100, 2) AS mape FROM t GROUP BY 1""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("p", 2.9 * F.col("l_quantity") + 1)
    got = metrics.regression_metrics(s, "y", "p", ["l_returnflag"])
    return rounded(got.withColumn("mape", F.round("mape", 2)))


_CLASS_SQL = """c AS (SELECT 1 + l_suppkey % 3 AS t, 1 + (l_suppkey + (l_orderkey % 10 = 0)::INT) % 3 AS p
  FROM lineitem)"""


def _classes(spark, sf):
    hit = (F.col("l_orderkey") % 10 == 0).cast("int")
    return table(spark, sf, "lineitem").select(
        (1 + F.col("l_suppkey") % 3).alias("t"), (1 + (F.col("l_suppkey") + hit) % 3).alias("p")
    )


@query("confusion", f"WITH {_CLASS_SQL} SELECT t AS label, p AS prediction, count(*) AS n FROM c GROUP BY ALL")
def _(spark, sf):
    return metrics.confusion(_classes(spark, sf), "t", "p")


_PER_CLASS = f"""{_CLASS_SQL}, k AS (SELECT t AS c FROM c UNION SELECT p FROM c), s AS (
  SELECT c::VARCHAR AS name, (SELECT count(*) FROM c WHERE t = k.c)::DOUBLE AS a,
    (SELECT count(*) FROM c WHERE p = k.c)::DOUBLE AS b,
    (SELECT count(*) FROM c WHERE p = k.c AND t = k.c)::DOUBLE AS h FROM k)"""


@query("class_report", f"""WITH {_PER_CLASS}, r AS (SELECT name, coalesce(h / nullif(b, 0), 0) AS precision,
  coalesce(h / nullif(a, 0), 0) AS recall, coalesce(2 * h / nullif(a + b, 0), 0) AS f1, a, h FROM s)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  a::BIGINT AS support FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(h) / sum(a), 6), sum(a)::BIGINT FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(a)::BIGINT FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * a) / sum(a), 6), round(sum(recall * a) / sum(a), 6),
  round(sum(f1 * a) / sum(a), 6), sum(a)::BIGINT FROM r""")
def _(spark, sf):
    return rounded(metrics.classification_report(_classes(spark, sf), "t", "p"))


@query("mcc", f"""WITH {_PER_CLASS} SELECT round((sum(h) * sum(a) - sum(a * b))
  / sqrt((sum(a) ** 2 - sum(b * b)) * (sum(a) ** 2 - sum(a * a))), 6) AS mcc FROM s""")
def _(spark, sf):
    return rounded(metrics.mcc(_classes(spark, sf), "t", "p"))


@query("label_mcc", """WITH c AS (SELECT quality AS t, 1 - toxic AS p FROM labels), s AS (SELECT
  count(*) FILTER (WHERE t = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (WHERE t = 0 AND p = 0)::DOUBLE AS tn,
  count(*) FILTER (WHERE t = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (WHERE t = 1 AND p = 0)::DOUBLE AS fn FROM c)
SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM s""")
def _(spark, sf):
    lab = table(spark, sf, "labels").select(
        F.col("quality").alias("t"), (1 - F.col("toxic")).alias("p")
    )
    return rounded(metrics.mcc(lab, "t", "p"))


@query("class_error_rate", f"WITH {_CLASS_SQL} SELECT round(avg(abs(t - p) / t::DOUBLE), 6) AS error_rate FROM c")
def _(spark, sf):
    return rounded(metrics.class_error_rate(_classes(spark, sf), "t", "p"))


@query("residual_histogram", f"""WITH {SAMPLES_SQL}, r AS (SELECT y - ({_PRED}) AS x FROM samples),
s AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 50 AS w FROM r)
SELECT sum(n)::BIGINT AS n_rows, 50::BIGINT AS n_bins, round(min(lo), 4) AS lower, round(max(hi), 4) AS upper
FROM (SELECT count(*) AS n FROM r), s""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("p", 2.9 * F.col("l_quantity") + 1)
    h = metrics.residual_histogram(s, "y", "p", 50)
    return rounded(h.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_bins"),
        F.min("lower").alias("lower"), F.max("upper").alias("upper"),
    ), 4)


@query("residual_table", f"""WITH {SAMPLES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round({_PRED}, 6) AS p, round(y - ({_PRED}), 6) AS residual FROM samples""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("p", 2.9 * F.col("l_quantity") + 1)
    return rounded(metrics.residual_table(s, "y", "p").select(*LINE, "p", "residual"))


@query("pred_interval", f"""WITH {SAMPLES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round({_PRED} - 1.96 * l_discount, 6) AS low, round({_PRED} + 1.96 * l_discount, 6) AS high FROM samples""")
def _(spark, sf):
    low, high = prediction_interval(2.9 * F.col("l_quantity") + 1, F.col("l_discount"))
    s = samples(spark, sf)
    return rounded(s.select(*LINE, low.alias("low"), high.alias("high")))


@query("relative_error", f"""WITH {SAMPLES_SQL}, t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_quantity = 0 THEN 0 ELSE abs({_PRED} - l_quantity * 2.7) / (l_quantity * 2.7) * 100 END AS e FROM samples)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e, 6) AS error_pct,
  CASE WHEN e < 5 THEN 'good' WHEN e < 15 THEN 'fair' ELSE 'poor' END AS band FROM t""")
def _(spark, sf):
    e = relative_error(2.9 * F.col("l_quantity") + 1, F.col("l_quantity") * 2.7)
    s = samples(spark, sf).withColumn("error_pct", e)
    return rounded(s.select(*LINE, "error_pct", error_band(F.col("error_pct")).alias("band")))


@query("verdicts", f"""WITH {SAMPLES_SQL}, t AS (SELECT l_suppkey, y, {_PRED} AS p, l_quantity * 2 + 10 AS b FROM samples),
m AS (SELECT l_suppkey, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r, 1 - sum((y - b) ** 2) / (var_pop(y) * count(*)) AS q
  FROM t GROUP BY 1)
SELECT l_suppkey, CASE WHEN r > 0.8 THEN 'excellent' WHEN r > 0.5 THEN 'acceptable' ELSE 'poor' END AS quality,
  CASE WHEN r > q + 0.02 THEN 'model' WHEN r > q - 0.02 THEN 'tie' ELSE 'persistence' END AS verdict,
  CASE WHEN r > 0.3 AND q < 0.05 THEN 'real' WHEN r > 0.1 THEN 'weak' ELSE 'none' END AS signal,
  CASE WHEN q > 0.5 THEN 'strong' WHEN q > 0.2 THEN 'moderate' ELSE 'none' END AS strength,
  CASE WHEN r > q + 0.15 THEN 'clear gain' WHEN r > q THEN 'small gain' ELSE 'no gain' END AS gain FROM m""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("p", 2.9 * F.col("l_quantity") + 1).withColumn(
        "b", F.col("l_quantity") * 2 + 10
    )
    a = metrics.regression_metrics(s, "y", "p", ["l_suppkey"]).select("l_suppkey", F.col("r2").alias("r"))
    b = metrics.regression_metrics(s, "y", "b", ["l_suppkey"]).select("l_suppkey", F.col("r2").alias("q"))
    r, q = F.col("r"), F.col("q")
    return a.join(b, "l_suppkey").select(
        "l_suppkey", r2_quality(r).alias("quality"), model_verdict(r, q).alias("verdict"),
        signal_verdict(r, q).alias("signal"), strength_verdict(q).alias("strength"),
        baseline_verdict(r, q).alias("gain"),
    )
