import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantloom.session import ROCKSDB_PROVIDER
from plantloom.streaming import etl, stateful
from plantloom.streaming.stateful import FINAL, ForwardFill, LagFeatures

SCHEMA = T.StructType().add("ts", "timestamp").add("v", "double")
DAY_MS = 86_400_000


class State:
    """A value or list state held in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def put(self, values):
        self.value = list(values)

    def appendValue(self, value):
        self.value = [*(self.value or []), value]

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return State()

    getListState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)


class Clock:
    def __init__(self, day):
        self.ms = 0 if day is None else pd.Timestamp(f"2023-01-{day:02d}").value // 1_000_000

    def getCurrentWatermarkInMs(self):
        return self.ms


def feed(processor, *batches):
    """The rows given out for each (frame, day of the watermark); timers that are due fire."""
    handle = Handle()
    processor.init(handle)
    for frame, day in batches:
        parts = list(processor.handleInputRows((1,), iter([frame]), Clock(day))) if frame is not None else []
        for ms in sorted(t for t in handle.timers if t <= Clock(day).ms):
            handle.timers.discard(ms)
            parts += processor.handleExpiredTimer((1,), Clock(day), None)
        yield pd.concat(parts) if parts else pd.DataFrame(columns=["ts", "v", FINAL])


def rows(days, values):
    return pd.DataFrame({"ts": pd.to_datetime([f"2023-01-{d:02d}" for d in days]), "v": values})


def fill(**options):
    return ForwardFill(["v"], SCHEMA, ["ts"], ["ts", "v", FINAL], **options)


def test_rows_wait_for_the_watermark_and_come_in_order():
    first, second, third = feed(
        fill(), (rows([3, 1], [None, 5.0]), None), (rows([2], [7.0]), 1), (rows([9], [None]), 4))
    assert first["v"].tolist() == [5.0, 5.0] and not first[FINAL].any()
    assert second["ts"].dt.day.tolist() == [1, 2, 3]  # day 3 is told anew
    assert second["v"].tolist() == [5.0, 7.0, 7.0] and second[FINAL].tolist() == [True, False, False]
    assert third["v"].tolist() == [7.0, 7.0, 7.0] and third[FINAL].tolist() == [True, True, False]


def test_a_timer_releases_what_waits_and_the_buffer_empties():
    p = fill(provisional=False)
    first, second, third = feed(
        p, (rows([2, 1], [None, 3.0]), None), (None, 3), (rows([4], [None]), 5))
    assert first.empty and second["v"].tolist() == [3.0, 3.0] and third["v"].tolist() == [3.0]
    assert not p.buffer.exists()


def test_an_idle_series_is_forgotten():
    p = fill(idle_ms=5 * DAY_MS)
    *_, last = feed(p, (rows([1], [3.0]), None), (None, 3), (None, 8), (rows([9], [None]), 10))
    assert pd.isna(last["v"].iloc[-1])
    p = fill(idle_ms=9 * DAY_MS)
    *_, last = feed(p, (rows([1], [3.0]), None), (None, 3), (None, 8), (rows([9], [None]), 10))
    assert last["v"].tolist() == [3.0]


def test_missing_times_come_first():
    frame = pd.DataFrame({"ts": [pd.Timestamp("2023-01-02"), pd.NaT], "v": [None, 4.0]})
    (only,) = feed(fill(), (frame, None))
    assert only["v"].tolist() == [4.0, 4.0] and only[FINAL].tolist() == [True, False]


def test_lag_history_across_batches():
    out = ["ts", "v", "v_lag_1", "v_diff_1", "v_rolling_mean_10", FINAL]
    p = LagFeatures("v", [1], SCHEMA, ["ts"], out)
    first, second, third = feed(
        p, (rows([1, 2, 3], [1.0, 2.0, 4.0]), None), (rows([5], [16.0]), 3), (rows([4], [8.0]), 3))
    assert first["v_lag_1"].isna().tolist() == [True, False, False]
    assert second["v_lag_1"].tolist()[1:] == [1.0, 2.0, 4.0]
    assert third["v_lag_1"].tolist() == [4.0, 8.0] and third["v_diff_1"].tolist() == [2.0, 4.0]
    assert third["v_rolling_mean_10"].iloc[1] == pytest.approx((1 + 2 + 4 + 8) / 4)


def test_random_arrivals_equal_batch_answers():
    rng = np.random.default_rng(0)
    for _ in range(20):
        days = np.arange(1, 29)
        values = np.where(rng.random(28) < 0.4, np.nan, rng.normal(size=28))
        arrival = days + rng.uniform(0, 3, 28)
        batch = np.floor(np.sort(arrival) / 4).astype(int)
        order = np.argsort(arrival)
        batches, mark = [], None
        for b in np.unique(batch):
            own = order[batch == b]
            batches.append((rows(days[own], values[own]), mark))
            mark = max(1, int(days[order[batch <= b]].max()) - 3)
        told = {}
        for frame in feed(fill(), *batches):
            told.update(zip(frame["ts"].dt.day, frame["v"], strict=True))
        want = pd.Series(values, days).ffill()
        assert all(told[d] == want[d] or np.isnan(told[d]) and np.isnan(want[d]) for d in days)


def test_stream_with_late_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    df = spark.range(200).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'a' END AS s",
        "timestamp_seconds(1700000000 + id * 60) AS ts", "IF(id % 5 < 2, CAST(id AS DOUBLE), NULL) AS v")
    late = (F.col("id") * 37 % 11).cast("int")
    parts = df.withColumn("at", F.floor((F.col("id") + late) / 45)).cache()
    for k in range(5):
        part = parts.where(F.col("at") == k).drop("at")
        part.write.mode("append").parquet(str(tmp_path / "in"))
        etl.write_updates(stateful.ffill_stream(
            spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["v"], ["s"],
            ["ts", "id"], delay="15 minutes"), str(tmp_path / "out"), str(tmp_path / "log"))
    got = {r.id: (r.v, r[FINAL]) for r in etl.read_latest(spark, str(tmp_path / "out"), ["id"]).collect()}
    frame = df.toPandas()
    want = frame.groupby("s", dropna=False)["v"].ffill()
    assert len(got) == 200
    for i in range(200):
        assert got[i][0] == want[i] or got[i][0] is None and np.isnan(want[i])
    assert sum(final for _, final in got.values()) > 100


def test_series_of_a_bucket_are_worked_on_side_by_side():
    rng = np.random.default_rng(1)
    n, schema = 400, T.StructType().add("s", "long").add("ts", "timestamp").add("v", "double")
    frame = pd.DataFrame({
        "s": rng.integers(0, 40, n) + (1 << 60), "ts": pd.to_datetime("2023-01-01") + pd.to_timedelta(
            rng.permutation(n) * 100, "min"), "v": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))})
    batch = (frame["ts"] + pd.to_timedelta(rng.uniform(0, 3, n), "D")).dt.day // 4
    names = ["v_lag_1", "v_diff_5", "v_rolling_mean_10", "v_rolling_std_10"]
    fills = ForwardFill(["v"], schema, ["ts"], [*frame.columns, FINAL], series=["s"], idle_ms=90 * DAY_MS)
    lags = LagFeatures("v", [1], schema, ["ts"], [*frame.columns, *names, FINAL], series=["s"])
    batches, mark = [], None
    for b in sorted(batch.unique()):
        batches.append((frame[batch == b], mark))
        mark = max(1, int(frame["ts"][batch <= b].dt.day.max()) - 3)
    want = frame.sort_values(["s", "ts"]).set_index(["s", "ts"])["v"]
    filled, past = want.groupby("s").ffill(), want.groupby("s").shift(1)
    ten = past.groupby("s").rolling(10, min_periods=1)
    made = {"v_lag_1": past, "v_diff_5": past - want.groupby("s").shift(6),
            "v_rolling_mean_10": ten.mean().droplevel(0), "v_rolling_std_10": ten.std().droplevel(0)}
    for processor, told in ((fills, {"v": filled}), (lags, made)):
        got = pd.concat(list(feed(processor, *batches)))
        got["ts"] = pd.to_datetime(got["ts"], utc=True).dt.tz_localize(None)
        got = got.groupby(["s", "ts"]).tail(1).set_index(["s", "ts"])
        assert len(got) == n and got[FINAL].sum() > n / 2
        for name, values in told.items():
            np.testing.assert_allclose(got[name].reindex(values.index), values, atol=1e-9)
        assert len(processor.handle.timers) < 20  # not one a series
