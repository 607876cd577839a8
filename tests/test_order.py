"""The cell layout must equal the naive single-task window, whatever the cell size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plantloom.operators import clean, order, timeseries
from plantloom.operators.order import CELL, plan_layout

TIME = ["ts", "event_id"]


@pytest.fixture(scope="module")
def ev(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # A hot unit with a third of the rows, and a long outage that spans whole cells.
    i = F.col("event_id")
    return e.withColumn("unit", F.when(i % 3 == 0, 7).otherwise(F.col("user_id") % 40)).withColumn(
        "v", F.when(~i.between(200, 420) & (i % 7 != 0) & (i > 3), F.col("value"))
    ).cache()


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b.select(*a.columns)).count() == 0


LAYOUTS = [
    ((), {"target_rows": 10**6}), ((), {"target_rows": 90}), ((), {"target_rows": 7}),
    (("unit",), {"target_rows": 50}), (("unit",), {"target_rows": 10}),
    (("unit", "event_type"), {"target_rows": 10}),
]


@pytest.mark.parametrize(("series", "sizing"), LAYOUTS)
def test_windows(ev, series, sizing):
    w = Window.partitionBy(*series).orderBy(*TIME)

    def build(over):
        return {
            "a": F.lag("v", 20).over(over),
            "b": F.avg("v").over(over.rowsBetween(-10, -1)),
            "c": F.lead("v", 9).over(over),
        }

    got = order.apply_windows(ev, build, TIME, series, ["v"], back=20, ahead=9, **sizing)
    same(got, ev.withColumns(build(w)))


@pytest.mark.parametrize(("series", "sizing"), LAYOUTS)
def test_ordinal(ev, series, sizing):
    w = Window.partitionBy(*series).orderBy(*TIME)
    want = ev.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))
    same(order.with_ordinal(ev, TIME, series, **sizing), want)


@pytest.mark.parametrize(("series", "sizing"), LAYOUTS)
def test_fills(ev, series, sizing):
    w = Window.partitionBy(*series).orderBy(*TIME)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    future = w.rowsBetween(0, Window.unboundedFollowing)
    same(
        clean.ffill(ev, ["v"], TIME, series, **sizing),
        ev.withColumn("v", F.last("v", True).over(past)),
    )
    same(
        clean.bfill(ev, ["v"], TIME, series, **sizing),
        ev.withColumn("v", F.first("v", True).over(future)),
    )


@pytest.mark.parametrize("target_rows", [7, 60, 10**6])
def test_interpolate_matches_pandas(ev, target_rows):
    got = clean.interpolate(ev, ["v"], TIME, target_rows=target_rows).orderBy(*TIME).toPandas()
    src = ev.orderBy(*TIME).toPandas()
    want = src["v"].interpolate(method="linear", limit_direction="both")
    assert (got["v"] - want).abs().max() < 1e-9


def test_hot_instant_is_split_by_the_second_key(spark):
    # 90 % of the rows share one leading key.
    df = spark.range(2000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(777).alias("t"),
        F.xxhash64("id").alias("u"), "id",
    )
    layout = plan_layout(df, ["t", "u"], target_rows=100)
    assert len(layout.bounds) > 10
    assert layout.attach(df).groupBy(CELL).count().agg(F.max("count")).first()[0] < 250
    want = df.withColumn("ord", (F.row_number().over(Window.orderBy("t", "u")) - 1).cast("long"))
    same(order.with_ordinal(df, ["t", "u"], layout=layout), want)


def test_null_and_long_order_keys(spark):
    df = spark.createDataFrame([(None, 1), (5, 2), (3, 3), (9, 4)] * 50, "t long, k int")
    df = df.withColumn("s", F.monotonically_increasing_id())
    got = order.with_ordinal(df, ["t", "s"], target_rows=20)
    want = df.withColumn("ord", (F.row_number().over(Window.orderBy("t", "s")) - 1).cast("long"))
    same(got.select("s", "ord"), want.select("s", "ord"))


def test_lag_values(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(30)], "t int, y double")
    rows = timeseries.lag_features(df, "y", ["t"]).orderBy("t").collect()
    assert rows[0]["y_lag_1"] is None and rows[0]["y_rolling_mean_10"] is None
    assert rows[25]["y_lag_5"] == 400.0
    assert rows[25]["y_diff_1"] == 24**2 - 23**2
    assert rows[25]["y_diff_5"] == 24**2 - 19**2
    assert rows[3]["y_rolling_mean_10"] == pytest.approx((0 + 1 + 4) / 3)
    assert rows[1]["y_rolling_std_10"] is None


def test_cells_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(order, "FIRST", 3)
    monkeypatch.setattr(order, "FAN", 4)
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(777).alias("t"),
        F.xxhash64("id").alias("u"), (F.col("id") % 2).alias("s"), "id")
    for series in ([], ["s"]):
        layout = plan_layout(df, ["t", "u"], series, target_rows=50)
        assert len(layout.bounds) == 2 and len(layout.finer) >= 2
        sizes = layout.attach(df).groupBy(*series, CELL).count()
        assert sizes.count() > 20 and sizes.agg(F.max("count")).first()[0] < 400
        w = Window.partitionBy(*(series or [F.lit(0)])).orderBy("t", "u")
        want = df.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))
        same(order.with_ordinal(df, ["t", "u"], series, layout=layout), want)
    one = plan_layout(df.limit(0), ["t", "u"], target_rows=50)
    assert not one.is_cut


def test_routing_has_no_nested_loop(spark):
    df = spark.range(500).select("id", F.xxhash64("id").alias("t"))
    layout = plan_layout(df, ["t", "id"], target_rows=20)
    plan = layout.attach(df)._jdf.queryExecution().executedPlan().toString()
    assert len(layout.bounds) > 10 and "NestedLoop" not in plan and "Cartesian" not in plan
