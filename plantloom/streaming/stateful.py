"""Per-series stream state in event-time order: forward fill and causal lag features.

Rows of a series wait in a buffer until the watermark passes them; then no earlier row can come,
and they are worked on in time order. So arrivals that are out of order by less than the delay get
the answer of the batch operators. Rows that still wait are given out as well, with what is known
so far (``is_final`` is false), and again when that changes; ``streaming.etl.read_latest`` takes
the last word on each row. Rows older than the watermark are dropped by Spark, as from a window.

Many short series would cost a call of the processor and a few trips to the state store each, so
series are dealt by hash to ``buckets`` and the series of a bucket are worked on side by side. State
per bucket: the rows of one delay (Arrow chunks in a list state), and a few numbers a series (the
last values, or the last 21 targets) in one Arrow table. One event-time timer releases what waits,
another forgets series that had no rows for ``idle``. The RocksDB state store must be configured,
see ``plantloom.session``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plantloom.functions.names import col
from plantloom.operators.timeseries import LAGS, feature_names

FINAL = "is_final"
BUCKETS = 256  # groups of series that share their state, and the most tasks that work on them
_NONE = np.iinfo("int64").min


def _micros(frame: pd.DataFrame, name: str) -> np.ndarray:
    """The event time in microseconds; a NULL comes before all others."""
    times = pd.to_datetime(frame[name], utc=True)
    out = times.astype("datetime64[us, UTC]").astype("int64").to_numpy().copy()
    out[times.isna().to_numpy()] = _NONE
    return out


class InOrder(StatefulProcessor):
    """Buffers the rows of some series and hands them to ``step`` in order of time.

    ``step(held, code, frame)`` gets the numbers that the rows before left behind, a row of
    ``width`` a series (NaN at first), and rows sorted by series and time with the number of their
    series; it returns what these leave and the rows with their results. ``provisional`` also gives
    out the rows that wait; without it a row comes once. Without ``series`` all rows are one.
    """

    width = 1

    def __init__(self, schema: T.StructType, order: Sequence[str], out: Sequence[str],
                 idle_ms: int | None = None, provisional: bool = True, series: Sequence[str] = ()):
        self.schema, self.order, self.out = schema, list(order), list(out)
        self.idle_ms, self.provisional, self.series = idle_ms, provisional, list(series)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrow = to_arrow_schema(self.schema)
        self.keys = pa.schema([self.arrow.field(c) for c in self.series])
        self.carry = handle.getValueState("carry", "series binary")
        self.buffer = handle.getListState("buffer", "rows binary")

    def step(
        self, held: np.ndarray, code: np.ndarray, frame: pd.DataFrame
    ) -> tuple[np.ndarray, pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        for frame in rows:
            if len(frame):
                self.buffer.appendValue((self._packed(frame),))
        yield from self._released(timerValues, self.provisional)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):
        yield from self._released(timerValues, False, self.idle_ms is not None)

    def _packed(self, frame: pd.DataFrame) -> bytes:
        names = self.schema.names
        return _written(pa.Table.from_pandas(frame[names], self.arrow, preserve_index=False))

    def _waiting(self) -> pd.DataFrame:
        chunks = [_read(x[0]) for x in self.buffer.get()] if self.buffer.exists() else []
        return pa.concat_tables(chunks or [self.arrow.empty_table()]).to_pandas()

    def _known(self) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """(series, time of the last row in microseconds, numbers) of what was worked on."""
        if not self.carry.exists():
            return (self.keys.empty_table().to_pandas(), np.zeros(0, "int64"),
                    np.zeros((0, self.width)))
        table = _read(self.carry.get()[0])
        # Without key columns a frame has no rows of its own.
        keys = table.select(self.series).to_pandas().reindex(range(len(table)))
        held = table["__held"].combine_chunks().values.to_numpy()
        return keys, table["__seen"].to_numpy(), held.reshape(len(table), self.width)

    def _keep(self, keys: pd.DataFrame, seen: np.ndarray, held: np.ndarray) -> None:
        if not len(seen):
            self.carry.clear()
            return
        columns = [pa.array(keys[f.name], f.type, from_pandas=True) for f in self.keys]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(held.ravel()), self.width)
        self.carry.update((_written(pa.table(
            [*columns, pa.array(seen), lists], [*self.series, "__seen", "__held"])),))

    def _released(
        self, timer: Any, provisional: bool, forget: bool = False
    ) -> Iterator[pd.DataFrame]:
        now = timer.getCurrentWatermarkInMs()
        watermark = now * 1000 or _NONE  # 0 until there is one
        frame, (keys, seen, held) = self._waiting(), self._known()
        known = len(seen)
        keys = pd.concat([keys, frame[self.series]], ignore_index=True) if known else frame[self.series]
        code = np.zeros(known + len(frame), "int64")
        if self.series:
            code = keys.groupby(self.series, dropna=False, sort=False).ngroup().to_numpy()
        first = np.unique(code, return_index=True)[1]  # the series that are known come first
        keys, code, n = keys.reindex(first), code[known:], len(first)
        held = np.vstack([held, np.full((n - known, self.width), np.nan)])
        seen = np.append(seen, np.full(n - known, _NONE))
        own = np.arange(n) < known
        by = ["__series", *self.order]
        frame = frame.assign(__series=code).sort_values(
            by, kind="stable", ignore_index=True, na_position="first")
        code = frame.pop("__series").to_numpy()
        clock = _micros(frame, self.order[0])
        done = clock <= watermark
        given = []
        if done.any():
            held, out = self.step(held, code[done], frame[done].reset_index(drop=True))
            given.append(self._given(out, True))
            np.maximum.at(seen, code[done], clock[done])
            own[code[done]] = True
            self.buffer.clear()
            if not done.all():
                self.buffer.put([(self._packed(frame[~done]),)])
        code, clock, frame = code[~done], clock[~done], frame[~done].reset_index(drop=True)
        if provisional and len(frame):
            given.append(self._given(self.step(held, code, frame)[1], False))
        changed = bool(done.any())
        if forget:
            idle = own & (seen // 1000 + (self.idle_ms or 0) <= now)
            idle[code] = False
            own, changed = own & ~idle, changed or bool(idle.any())
        if changed:
            self._keep(keys[own], seen[own], held[own])
        if len(clock):
            self.handle.registerTimer(int(clock.min()) // 1000 + 1)
        if self.idle_ms is not None:
            due = np.append(seen[own], clock)
            due = due[due > _NONE] // 1000 + self.idle_ms
            if (due > now).any():
                self.handle.registerTimer(int(due[due > now].min()))
        yield from given

    def _given(self, frame: pd.DataFrame, final: bool) -> pd.DataFrame:
        frame[FINAL] = final
        return frame[self.out]

    def close(self) -> None:
        pass


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(packed) -> pa.Table:
    return pa.ipc.open_stream(bytes(packed)).read_all()


class ForwardFill(InOrder):
    """Carries the last known value of each column."""

    def __init__(self, columns: Sequence[str], *args, **options):
        super().__init__(*args, **options)
        self.columns = list(columns)
        self.width = len(self.columns)

    def step(self, held, code, frame):
        held = held.copy()
        last = np.append(code[1:] != code[:-1], True)
        for i, c in enumerate(self.columns):
            values = frame[c].astype(float).groupby(code).ffill()
            frame[c] = values.fillna(pd.Series(held[code, i]))
            held[code[last], i] = frame[c].to_numpy()[last]
        return held, frame


class LagFeatures(InOrder):
    """Keeps the last target values of a series and adds the causal features to its rows."""

    def __init__(self, target: str, lags: Sequence[int], *args, **options):
        super().__init__(*args, **options)
        self.target, self.lags = target, list(lags)
        self.width = max([*self.lags, 10]) + 1

    def step(self, held, code, frame):
        # The kept values of each series stand before its rows, so no shift by up to ``width`` leaves it.
        present, start = np.unique(code, return_index=True)
        known, w = frame[self.target].to_numpy(dtype=float), self.width
        at = np.arange(len(code)) + (np.searchsorted(present, code) + 1) * w
        y = np.empty(len(code) + len(present) * w)
        y[at] = known
        before = start + np.arange(len(present)) * w
        y[before[:, None] + np.arange(w)] = held[present]
        y, t = pd.Series(y), self.target
        past = y.shift(1)
        made = {f"{t}_lag_{k}": y.shift(k) for k in self.lags}
        made[f"{t}_diff_1"] = past - y.shift(2)
        made[f"{t}_diff_5"] = past - y.shift(6)
        made[f"{t}_rolling_mean_10"] = past.rolling(10, min_periods=1).mean()
        made[f"{t}_rolling_std_10"] = past.rolling(10, min_periods=1).std()
        for name, values in made.items():
            frame[name] = values.to_numpy()[at]
        end = np.append(before[1:], len(y))
        held = held.copy()
        held[present] = y.to_numpy()[end[:, None] - w + np.arange(w)]
        return held, frame


def _output(schema: T.StructType, names: Sequence[str]) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    known = {f.name for f in fields}
    fields += [T.StructField(n, T.DoubleType(), True) for n in names if n not in known]
    return T.StructType([*fields, T.StructField(FINAL, T.BooleanType(), False)])


def _ordered(
    stream: DataFrame, processor: InOrder, schema, series: Sequence[str], delay: str, buckets: int
) -> DataFrame:
    marked, by = stream.withWatermark(processor.order[0], delay), list(series)
    if all(isinstance(stream.schema[c].dataType, T.AtomicType) for c in series):
        # A column of keys is either NULL all through a group or nowhere, so integers stay integers.
        processor.series = list(series)
        keys = [col(c) for c in series]
        groups = {"__bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets))}
        groups |= {f"__null{i}": c.isNull() for i, c in enumerate(keys)}
        marked, by = marked.withColumns(groups), list(groups)
    return marked.groupBy(*by).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="EventTime")


def ffill_stream(
    stream: DataFrame, columns: Sequence[str], series: Sequence[str], order: Sequence[str],
    delay: str = "1 hour", idle_ms: int | None = None, provisional: bool = True,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Last known value per series in order of time; ``order`` begins with the event time.

    The series are dealt to ``buckets``, which a checkpoint fixes: one is worked on in memory.
    """
    schema = _output(stream.schema, [])
    made = ForwardFill(columns, stream.schema, order, schema.names, idle_ms, provisional)
    return _ordered(stream, made, schema, series, delay, buckets)


def lag_stream(
    stream: DataFrame, target: str, series: Sequence[str], order: Sequence[str],
    lags: Sequence[int] = LAGS, delay: str = "1 hour", idle_ms: int | None = None,
    provisional: bool = True, buckets: int = BUCKETS,
) -> DataFrame:
    """The batch operator ``lag_features`` on a stream, history kept as state per series."""
    schema = _output(stream.schema, feature_names(target, lags))
    made = LagFeatures(target, lags, stream.schema, order, schema.names, idle_ms, provisional)
    return _ordered(stream, made, schema, series, delay, buckets)
