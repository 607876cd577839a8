"""Registered queries: aggregation, profiling, correlation, pruning, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantloom.functions.scalars import confidence
from plantloom.operators import prune, scale, stats, timeseries
from plantloom.plans.registry import query, rounded
from plantloom.plans.tables import (
    PLANT_SENSORS,
    PLANT_SQL,
    SAMPLES_SQL,
    TIME,
    events,
    plant,
    samples,
    table,
)
from plantloom.sources.profile import ingestion_stats, schema_report

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c: str) -> str:
    q = lambda p: f"round(quantile_cont({c}::DOUBLE, {p}), 6)"
    return f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, {q(0.25)} AS p25, {q(0.5)} AS p50,
  {q(0.75)} AS p75, round(max({c}), 6) AS max FROM lineitem"""


@query("describe", " UNION ALL ".join(_describe_sql(c) for c in NUM))
def _(spark, sf):
    return rounded(stats.describe(table(spark, sf, "lineitem"), NUM))


_RESAMPLE = """round(avg(v), 6) AS value__mean, round(stddev_samp(v), 6) AS value__std,
  round(min(v), 6) AS value__min, round(max(v), 6) AS value__max,
  round(arg_max(v, (ts, event_id)) FILTER (WHERE v IS NOT NULL), 6) AS value__last"""


@query("hourly_resample", f"""WITH e AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS v,
   CASE WHEN event_id % 53 = 0 THEN NULL ELSE value * 2 END AS y FROM events)
SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS slot, {_RESAMPLE},
  round(arg_min(y, (ts, event_id)) FILTER (WHERE y IS NOT NULL), 6) AS y
FROM e GROUP BY 1, 2""")
def _(spark, sf):
    i = F.col("event_id")
    e = events(spark, sf).withColumn("y", F.when(i % 53 != 0, F.col("value") * 2)).withColumn(
        "value", F.when(i % 97 != 0, F.col("value"))
    )
    return rounded(stats.resample(e, "ts", ["value"], ["y"], "event_id", "hour", ["event_type"]))


@query("group_stats", f"""WITH {PLANT_SQL} SELECT user_id, count(*) AS n_rows,
  round(max(pulp_ph), 6) AS pulp_ph__max,
  round(arg_max(pulp_ph, (ts, event_id)) FILTER (WHERE pulp_ph IS NOT NULL), 6) AS pulp_ph__last,
  count(DISTINCT pulp_ph) AS pulp_ph__distinct FROM plant GROUP BY 1""")
def _(spark, sf):
    return rounded(stats.group_stats(plant(spark, sf), ["user_id"], ["pulp_ph"], TIME))


@query("value_counts", """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n
FROM orders GROUP BY ALL UNION ALL
SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def _(spark, sf):
    return stats.value_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("hist_width", """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
  (max(l_extendedprice) - min(l_extendedprice)) / 50 AS w FROM lineitem), c AS (
  SELECT least(floor((l_extendedprice - lo) / w), 49)::INT AS bin, count(*) AS n
  FROM lineitem, s GROUP BY 1)
SELECT b.range::INT AS bin, round(lo + b.range * w, 6) AS lower, round(lo + (b.range + 1) * w, 6) AS upper,
  coalesce(n, 0) AS n FROM range(50) b CROSS JOIN s LEFT JOIN c ON c.bin = b.range""")
def _(spark, sf):
    return rounded(stats.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50))


@query("hist_freq", """WITH r AS (SELECT l_extendedprice AS v,
    row_number() OVER (ORDER BY l_extendedprice) - 1 AS o, count(*) OVER () AS n FROM lineitem),
h AS (SELECT k, least(k * max(n) / 4.0::DOUBLE, max(n) - 1) AS h FROM r, range(5) t(k) GROUP BY k),
e AS (SELECT k, (SELECT v FROM r WHERE o = floor(h)) AS a, (SELECT v FROM r WHERE o = ceil(h)) AS b, h FROM h),
f AS (SELECT k, a + (b - a) * (h - floor(h)) AS edge FROM e),
b AS (SELECT x.k AS bin, x.edge AS lower, y.edge AS upper FROM f x JOIN f y ON y.k = x.k + 1)
SELECT bin::INT AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
  (SELECT count(*) FROM lineitem WHERE l_extendedprice >= lower
     AND (l_extendedprice < upper OR (bin = 3 AND l_extendedprice <= upper))) AS n FROM b""")
def _(spark, sf):
    return rounded(stats.equal_frequency(table(spark, sf, "lineitem"), "l_extendedprice", 4))


@query("box_stats", """SELECT l_returnflag, l_linestatus, round(min(l_extendedprice), 6) AS low,
  round(quantile_cont(l_extendedprice::DOUBLE, 0.25), 6) AS q1,
  round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS median,
  round(quantile_cont(l_extendedprice::DOUBLE, 0.75), 6) AS q3, round(max(l_extendedprice), 6) AS high
FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(
        stats.box_stats(li, "l_extendedprice", ["l_returnflag", "l_linestatus"])
    )


def _corr_sql(a: str, b: str, where: str = "") -> str:
    r = f"corr({a}, {b})"
    return (f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan({r}) THEN NULL ELSE {r} END, 6)"
            f" AS r FROM samples {where}")


_CORR_COLS = [*NUM, "y", "flat"]
_FLAT_SQL = SAMPLES_SQL.replace("AS y\n", "AS y, 1500.0::DOUBLE AS flat\n")


@query("corr_matrix", f"WITH {_FLAT_SQL} " + " UNION ALL ".join(
    _corr_sql(a, b) for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:]))
def _(spark, sf):
    s = samples(spark, sf).withColumn("flat", F.lit(1500.0))
    return rounded(stats.correlations(s, _CORR_COLS))


def _wide(spark, sf):
    """Thirty columns made of the four readings, every third one with gaps."""
    li, out = table(spark, sf, "lineitem"), {}
    for i in range(30):
        base = F.col(NUM[i % 4]) * (i + 1) + F.col(NUM[(i + 1) % 4]) * (i % 7)
        gap = F.when(F.col("l_linenumber") != 1 + i % 7, base)
        out[f"s{i}"] = gap if i % 3 == 0 else base
    return li.select(*[e.alias(n) for n, e in out.items()])


def _wide_column(i: int) -> str:
    base = f"{NUM[i % 4]} * {i + 1} + {NUM[(i + 1) % 4]} * {i % 7}"
    return f"CASE WHEN l_linenumber <> {1 + i % 7} THEN {base} END" if i % 3 == 0 else base


_WIDE_SQL = "wide AS (SELECT " + ", ".join(
    f"{_wide_column(i)} AS s{i}" for i in range(30)) + " FROM lineitem)"


@query("corr_matrix_wide", f"WITH {_WIDE_SQL} " + " UNION ALL ".join(
    f"SELECT 's{i}' AS a, 's{j}' AS b, round(corr(s{i}, s{j}), 6) AS r FROM wide"
    for i in range(30) for j in range(i + 1, 30)))
def _(spark, sf):
    return rounded(stats.correlations(_wide(spark, sf), [f"s{i}" for i in range(30)]))


@query("strong_corr", f"WITH {SAMPLES_SQL}, t AS (" + " UNION ALL ".join(
    _corr_sql(a, b) for i, a in enumerate([*NUM, "y"]) for b in [*NUM, "y"][i + 1:])
    + ") SELECT * FROM t WHERE abs(r) >= 0.8")
def _(spark, sf):
    return rounded(stats.strong_correlations(samples(spark, sf), [*NUM, "y"]))


def _profile_sql(c: str, kind: str, numeric: bool) -> str:
    num = lambda e: f"round({e}, 6)" if numeric else "NULL::DOUBLE"
    return f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) AS n_rows,
  count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct,
  {f'count(*) FILTER (WHERE {c} = 0)' if numeric else 'NULL::BIGINT'} AS n_zero,
  {num(f'avg({c})')} AS mean, {num(f'stddev_samp({c})')} AS std, {num(f'skewness({c})')} AS skewness,
  {num(f'kurtosis({c})')} AS kurtosis, {num(f'min({c})::DOUBLE')} AS min,
  {num(f'quantile_cont({c}::DOUBLE, 0.25)')} AS p25, {num(f'quantile_cont({c}::DOUBLE, 0.5)')} AS p50,
  {num(f'quantile_cont({c}::DOUBLE, 0.75)')} AS p75, {num(f'max({c})::DOUBLE')} AS max FROM part"""


@query("column_profile", " UNION ALL ".join([
    _profile_sql("p_brand", "string", False), _profile_sql("p_size", "int", True),
    _profile_sql("p_retailprice", "double", True)]))
def _(spark, sf):
    cols = ["p_brand", "p_size", "p_retailprice"]
    return rounded(stats.column_profile(table(spark, sf, "part"), cols))


@query("top_values", """(SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part
  GROUP BY 2 ORDER BY n DESC, value LIMIT 5) UNION ALL
(SELECT 'p_type', p_type, count(*) AS n FROM part GROUP BY 2 ORDER BY n DESC, 2 LIMIT 5)""")
def _(spark, sf):
    return stats.top_values(table(spark, sf, "part"), ["p_brand", "p_type"], 5)


_TYPES = ["click", "error", "purchase", "signup", "view"]


def _cycle_sql() -> str:
    parts = []
    for t in _TYPES:
        f = f"FILTER (WHERE event_type = '{t}')"
        q = lambda p: f"round(quantile_cont(value::DOUBLE, {p}) {f}, 6)"
        parts.append(f"""round(avg(value) {f}, 6) AS {t}_mean, round(stddev_samp(value) {f}, 6) AS {t}_std,
  round(min(value) {f}, 6) AS {t}_min, round(max(value) {f}, 6) AS {t}_max, {q(0.25)} AS {t}_p25,
  {q(0.5)} AS {t}_p50, {q(0.75)} AS {t}_p75,
  round(CASE WHEN var_pop(event_id) {f} > 0 THEN regr_slope(value, event_id) {f} END, 6) AS {t}_slope""")
    return ("SELECT date_trunc('day', ts)::TIMESTAMP AS day, " + ", ".join(parts)
            + " FROM events GROUP BY 1")


@query("cycle_features", _cycle_sql())
def _(spark, sf):
    e = events(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    return rounded(
        stats.cycle_features(e, ["day"], "event_type", "value", "event_id", _TYPES)
    )


@query("shift_rollup", f"""WITH {PLANT_SQL}, s AS (SELECT *, 60 + tank_level / 20 AS pred,
  CASE WHEN event_id % 5 = 0 THEN 85.0 ELSE 95.0 - (event_id % 17) END AS conf FROM plant), g AS (
  SELECT time_bucket(INTERVAL 8 HOURS, ts, TIMESTAMP '2000-01-01')::TIMESTAMP AS shift_start, avg(pred) AS m,
    avg(conf) AS c, avg(CASE WHEN feed_flow BETWEEN 0 AND 50000 THEN 0.0 ELSE 1.0 END) AS h1,
    avg(CASE WHEN pulp_ph BETWEEN 0 AND 14 THEN 0.0 ELSE 1.0 END) AS h2 FROM s GROUP BY 1)
SELECT shift_start, round(m, 6) AS recovery_avg, 80.0::DOUBLE AS recovery_target,
  round((m - 80) * 1250, 6) AS financial_impact, round(c, 6) AS confidence_avg,
  CASE WHEN c > 85 THEN 'stable' ELSE 'noisy' END AS status,
  CASE WHEN m >= 80 THEN 'hold' ELSE 'adjust air' END AS recommendation, 'boosted' AS model_name,
  CASE WHEN h1 = 0 THEN 'ok' WHEN h1 <= 0.1 THEN 'warn' ELSE 'fault' END AS health_flow,
  CASE WHEN h2 = 0 THEN 'ok' WHEN h2 <= 0.1 THEN 'warn' ELSE 'fault' END AS health_ph FROM g""")
def _(spark, sf):
    i = F.col("event_id")
    p = plant(spark, sf).withColumn("pred", 60 + F.col("tank_level") / 20).withColumn(
        "conf", F.when(i % 5 == 0, 85.0).otherwise(95.0 - (i % 17))
    )
    out = stats.shift_rollup(
        p, "ts", "pred", "conf", model="boosted",
        health={
            "flow": ~F.col("feed_flow").between(0, 50000), "ph": ~F.col("pulp_ph").between(0, 14)
        },
    )
    return rounded(
        out.withColumn("health_flow", F.col("sensor_health")["flow"])
        .withColumn("health_ph", F.col("sensor_health")["ph"]).drop("sensor_health")
    )


@query("ingestion_stats", f"""WITH {PLANT_SQL} SELECT count(*) AS n_rows, 4 AS n_columns,
  'events' AS source, round(((count(*) - count(feed_flow)) + (count(*) - count(pulp_ph))
  + (count(*) - count(tank_level)) + (count(*) - count(mystery))) * 100.0::DOUBLE / 4 / count(*), 2) AS null_pct
FROM plant""")
def _(spark, sf):
    return ingestion_stats(plant(spark, sf).select(*PLANT_SENSORS), "events")


def _schema_sql(c: str, kind: str, numeric: bool) -> str:
    num = lambda e: f"round({e}, 6)" if numeric else "NULL::DOUBLE"
    return f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) - count({c}) AS n_null,
  round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS pct_null, {num(f'min({c})::DOUBLE')} AS min,
  {num(f'max({c})::DOUBLE')} AS max, {num(f'avg({c})')} AS mean, {num(f'stddev_samp({c})')} AS std FROM plant"""


@query("schema_report", f"WITH {PLANT_SQL} " + " UNION ALL ".join([
    _schema_sql("event_type", "string", False), _schema_sql("user_id", "bigint", True),
    _schema_sql("pulp_ph", "double", True), _schema_sql("tank_level", "double", True)]))
def _(spark, sf):
    p = plant(spark, sf).select("event_type", "user_id", "pulp_ph", "tank_level")
    return rounded(schema_report(p))


@query("time_profile", """WITH g AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) AS g
  FROM (SELECT date_trunc('minute', ts) AS ts, event_id FROM events)),
t AS (SELECT g, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY 1 ORDER BY n DESC, g LIMIT 1)
SELECT (SELECT min(date_trunc('minute', ts))::TIMESTAMP FROM events) AS first_ts,
  (SELECT max(date_trunc('minute', ts))::TIMESTAMP FROM events) AS last_ts,
  g / 1e6 AS gap_seconds, n AS gap_count FROM t""")
def _(spark, sf):
    e = events(spark, sf).withColumn("ts", F.date_trunc("minute", "ts"))
    return rounded(timeseries.gap_frequency(e, "ts", TIME))


@query("leak_drop", f"WITH {SAMPLES_SQL}, s2 AS (SELECT *, y * 2 + 1 AS leak_copy, 1500.0::DOUBLE AS flat"
       " FROM samples), r AS (" + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, CASE WHEN isnan(corr({c}, y)) THEN NULL ELSE corr({c}, y) END AS r FROM s2"
           for c in [*NUM, "leak_copy", "flat"])
       + ") SELECT feature, round(r, 6) AS r, coalesce(abs(r) >= 0.999, FALSE) AS leak FROM r")
def _(spark, sf):
    s = samples(spark, sf).withColumn("leak_copy", F.col("y") * 2 + 1).withColumn(
        "flat", F.lit(1500.0)
    )
    return rounded(prune.leakage_report(s, [*NUM, "leak_copy", "flat"], "y"))


@query("constant_drop", """SELECT event_id, round(value, 6) AS value FROM events""")
def _(spark, sf):
    e = events(spark, sf).select("event_id", "value").withColumn("still", F.lit(7.0))
    kept, _gone = prune.drop_constant(e, ["value", "still"])
    return rounded(kept)


@query("collinear_drop", """SELECT l_orderkey, l_linenumber, round(l_tax, 6) AS l_tax,
  round(l_quantity * 3 + 1, 6) AS q3 FROM lineitem""")
def _(spark, sf):
    # quantity ~ q2 ~ q3 (exact multiples): both earlier columns of the chain go.
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax",
        (F.col("l_quantity") * 2).alias("q2"), (F.col("l_quantity") * 3 + 1).alias("q3"),
    )
    kept, _gone = prune.drop_collinear(li, ["l_quantity", "l_tax", "q2", "q3"])
    return rounded(kept)


@query("redundancy_report", """WITH w AS (SELECT l_quantity AS a, l_tax AS b, l_quantity * 2 AS c FROM lineitem),
p AS (SELECT 'c' AS name, corr(a, c) AS r FROM w UNION ALL SELECT 'b', corr(a, b) FROM w
  UNION ALL SELECT 'c', corr(b, c) FROM w)
SELECT DISTINCT name FROM p WHERE abs(r) > 0.95""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"),
        (F.col("l_quantity") * 2).alias("c"),
    )
    names = prune.redundant_columns(li, ["a", "b", "c"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("low_variation", """SELECT 'l_quantity' AS "column", round(stddev_samp(l_quantity) / avg(l_quantity) * 100, 6) AS cv,
  stddev_samp(l_quantity) / avg(l_quantity) * 100 < 5 AS flat FROM lineitem
UNION ALL SELECT 'shifted', round(stddev_samp(l_tax + 10) / avg(l_tax + 10) * 100, 6),
  stddev_samp(l_tax + 10) / avg(l_tax + 10) * 100 < 5 FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("shifted", F.col("l_tax") + 10)
    return rounded(prune.low_variation(li, ["l_quantity", "shifted"]))


@query("top_corr", f"WITH {SAMPLES_SQL}, r AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, y)) AS r FROM samples" for c in NUM)
    + ") SELECT feature, round(r, 6) AS abs_r FROM r ORDER BY r DESC LIMIT 3")
def _(spark, sf):
    return rounded(prune.top_correlations(samples(spark, sf), NUM, "y", 3))


@query("tautology", f"WITH {SAMPLES_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{t}' AS b, round(corr({a}, {t}), 6) AS r FROM samples"
    for a in ("l_quantity",) for t in ("y", "l_tax")))
def _(spark, sf):
    return rounded(prune.tautology(samples(spark, sf), "l_qu", ["y", "l_tax"]))


_TRAIN = """train AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')"""


def _scale_sql(centre, spread) -> str:
    parts = ", ".join(f"{centre(c)} AS {c}_m, {spread(c)} AS {c}_s" for c in NUM)
    outs = ", ".join(
        f"round(({c} - {c}_m) / CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END, 6) AS {c}" for c in NUM
    )
    return f"""WITH {_TRAIN}, p AS (SELECT {parts} FROM train)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {outs} FROM lineitem, p"""


_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _scaled(spark, sf, fit):
    li = table(spark, sf, "lineitem")
    train = li.filter(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return rounded(fit(train, NUM).apply(li).select(*_KEYS, *NUM))


@query("robust_scale", _scale_sql(
    lambda c: f"quantile_cont({c}::DOUBLE, 0.5)",
    lambda c: f"quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)"))
def _(spark, sf):
    return _scaled(spark, sf, scale.fit_robust)


@query("minmax_scale", _scale_sql(lambda c: f"min({c})", lambda c: f"max({c}) - min({c})"))
def _(spark, sf):
    return _scaled(spark, sf, scale.fit_minmax)


@query("scale_inverse", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       + ", ".join(f"round({c}, 4) AS {c}" for c in NUM) + " FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    s = scale.fit_robust(li, NUM)
    return rounded(s.invert(s.apply(li)).select(*_KEYS, *NUM), 4)


@query("confidence", """WITH t AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_discount * 100 END AS sd,
   CASE WHEN l_quantity = 7 THEN 0 ELSE l_quantity END AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN sd = 0 THEN 85.0
  WHEN abs(p) < 1e-6 THEN 50.0 ELSE least(greatest(100 * exp(-3 * abs(sd / nullif(p, 0))), 5), 99) END, 6) AS confidence
FROM t""")
def _(spark, sf):
    sd = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_discount") * 100)
    p = F.when(F.col("l_quantity") == 7, 0.0).otherwise(F.col("l_quantity"))
    li = table(spark, sf, "lineitem").withColumn("confidence", confidence(sd, p))
    return rounded(li.select(*_KEYS, "confidence"))


@query("sensor_day_baselines", f"""WITH {PLANT_SQL}, v AS (
  SELECT * FROM plant WHERE (feed_flow IS NULL OR feed_flow BETWEEN 0 AND 50000)
    AND (pulp_ph IS NULL OR pulp_ph BETWEEN 0 AND 14)
    AND (tank_level IS NULL OR tank_level BETWEEN -500 AND 1500)), c AS (
  SELECT ts, event_id, coalesce(last_value(feed_flow IGNORE NULLS) OVER w, 0.0) AS feed_flow,
    coalesce(last_value(pulp_ph IGNORE NULLS) OVER w, 0.0) AS pulp_ph FROM v
  WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), h AS (
  SELECT date_trunc('hour', ts) AS slot, avg(feed_flow) AS x, avg(pulp_ph) AS y FROM c GROUP BY 1), f AS (
  SELECT slot, x, y, lag(y) OVER (ORDER BY slot) AS prev, row_number() OVER (ORDER BY slot) - 1 AS o,
    count(*) OVER () AS n FROM h), s AS (
  SELECT *, o < (n * 0.8::DOUBLE)::DOUBLE AND o < floor(n * 0.8::DOUBLE) AS is_train FROM f), m AS (
  SELECT avg(y) AS mu FROM s WHERE is_train), e AS (
  SELECT 'mean' AS model, y, mu AS p FROM s, m WHERE NOT is_train
  UNION ALL SELECT 'persistence', y, prev FROM s WHERE NOT is_train)
SELECT model, count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
  round(avg(abs((y - p) / nullif(y, 0))) * 100, 6) AS mape FROM e GROUP BY 1""")
def _(spark, sf):
    from plantloom.plans.etl import baseline_report

    return rounded(baseline_report(
        plant(spark, sf), "ts", "event_id", "feed_flow", "pulp_ph", skip=["user_id", "mystery"]))

