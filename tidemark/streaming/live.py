"""Live repair: keyed, count-bounded state; provisional results refreshed, reconciled ones final.

State by point and sensor: the newest ``max_points`` readings by event time in blocks with an
index of their runs, the starts of periods that are pending or done, and the newest windows. There is no watermark: a late reading counts as long as
it is among the newest. Each message is handled in order of arrival, as if it came alone.

A period is reconstructed once ``min_context`` readings precede it. While no reading
follows, it is refreshed with each message and provisional; once one follows it is
reconstructed for the last time. Starts older than the buffer are forgotten.

A period that the forecaster rejects with a ``ValueError`` is skipped and tried again with the
next message. Any other exception costs the output of its message only, which becomes a row
of type ``error``; the reading itself is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import iso
from ..functions.ship import by_value, ship
from ..operators.buffers import last_arrival, newest
from ..operators.forecast import CONTEXT, Forecaster, LastValue, backward, forward
from .run_buffer import HEADER, Block, RunBuffer

#: Stands for None in the state's arrays of times.
NOTHING = -(1 << 63)

UPDATE = T.StructType(
    [
        T.StructField("type", T.StringType()), T.StructField("point_id", T.StringType()), T.StructField("sensor", T.StringType()),
        T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()),
        T.StructField("start_time", T.TimestampType()), T.StructField("end_time", T.TimestampType()), T.StructField("method", T.StringType()),
        T.StructField("confidence", T.StringType()), T.StructField("times", T.ArrayType(T.TimestampType())), T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def find_periods(ts: np.ndarray, value: np.ndarray, min_hours: float, limit: int = 1) -> list[tuple[int, int]]:
    """First and last position of each frozen period of one ordered buffer."""
    n = len(value)
    filled = pd.Series(value).ffill(limit=limit).to_numpy() if limit > 0 else value
    change = np.ones(n, bool)
    change[1:] = np.isnan(filled[1:]) | np.isnan(filled[:-1]) | (filled[1:] != filled[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    long = (last > first) & ((ts[last] - ts[first]) / 3.6e9 >= min_hours)
    return list(zip(first[long].tolist(), last[long].tolist(), strict=True))


def rebuild(model: Forecaster, value: np.ndarray, first: int, last: int, open_ended: bool, points: int = 3) -> np.ndarray:
    """Reconstructed values of one period of a buffer."""
    n = last - first + 1
    i = np.arange(n)
    y = forward(model, value[:first], n)
    before, after = value[first - 1], None
    if not open_ended:
        w = 1 - i / (n - 1) if n > 1 else np.ones(1)
        back = backward(model, value[last + 1 :], n)
        if len(back) != len(y):
            raise ValueError(f"forecasts of {len(y)} and {len(back)} values can't be blended")
        y, after = y * w + back * (1 - w), value[last + 1]
    k = min(points, n)
    if k > 0:
        y = y + (before - y[0]) * np.clip(1 - i / k, 0, None)
        if after is not None:
            y = y + (after - y[-1]) * np.clip(1 - (n - 1 - i) / k, 0, None)
    return y


#: What leaves Python: times as microseconds.
RAW = T.StructType([T.StructField(f.name, {T.TimestampType(): T.LongType(), T.ArrayType(T.TimestampType()): T.ArrayType(T.LongType())}.get(f.dataType, f.dataType)) for f in UPDATE.fields])
#: Messages after which updates leave and blocks go to the state, so that memory doesn't grow with a batch.
MESSAGES = 10_000
#: In place of a time that is missing.
NO_TIME = -(1 << 63) // 1000

INDEX = T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in (*HEADER, "pending", "done", "windows")] + [T.StructField("next_id", T.LongType())])
BLOCKS = "ts array<long>, value array<double>, start array<boolean>"
WINDOW = "seq long, end_time long, method string, confidence string, times array<long>, values array<double>"
#: Windows of a series that the state keeps for readers.
KEPT_WINDOWS = 200


class Repair(StatefulProcessor):
    """The state of one series, and what each message changes.

    ``blocks`` holds the readings, ``index`` one row that tells of all blocks, what is pending
    and what is done (see :class:`RunBuffer`), ``windows`` the newest version of the newest
    windows. A message reads and writes the blocks around it, and those of the context where a period is rebuilt.
    """

    def __init__(self, model: Forecaster, min_hours: float = 0.25, max_points: int = 2000, min_context: int = 5, open_ended: bool = True):
        self.model, self.min_hours, self.max_points, self.min_context, self.open_ended = model, min_hours, max_points, min_context, open_ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", INDEX)
        self.blocks = handle.getMapState("blocks", "id long", BLOCKS)
        self.windows = handle.getMapState("windows", "start_time long", WINDOW)

    def _load(self, number: int) -> Block:
        ts, value, start = self.blocks.getValue((number,))
        return Block([int(t) for t in ts], [None if v is None or v != v else float(v) for v in value], [bool(x) for x in start])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat([x[["seq", "ts", "value"]] for x in rows]).sort_values("seq", kind="stable")
        header: list[dict] = []
        pending: list[int] = []
        done: list[int] = []
        kept: list[int] = []
        next_id = 0
        if self.index.exists():
            saved = dict(zip(INDEX.names, self.index.get(), strict=True))
            columns = [[int(x) for x in saved[c]] for c in HEADER]
            header = [dict(zip(HEADER, h, strict=True)) for h in zip(*columns, strict=True)]
            for h in header:
                h |= {c: None for c in ("last_known", "first_start", "last_start") if h[c] == NOTHING}
            pending, done, kept, next_id = *([int(x) for x in saved[c]] for c in ("pending", "done", "windows")), int(saved["next_id"])
        held = RunBuffer(self._load, self.max_points, self.min_hours * 3.6e9, header, pending, done, next_id)
        stored, windows = set(kept), {}
        for begin in range(0, len(new), MESSAGES):
            out: list[tuple] = []
            some = new.iloc[begin : begin + MESSAGES]
            for seq, at, value in zip(some["seq"].tolist(), some["ts"].tolist(), some["value"].tolist(), strict=True):
                held.add(at, None if value is None or value != value else float(value))
                so_far = len(out)
                try:
                    self._step(key, seq, at, held, out)
                except Exception as e:  # noqa: BLE001 - one message must not end the feed
                    del out[so_far:]
                    out.append(("error", key[0], key[1], seq, at, None, None, None, f"{type(e).__name__}: {e}", None, None, None))
            self._store(held)
            for row in out:
                if row[0] == "reconstruction":
                    windows[row[6]] = (row[3], *row[7:])
            kept = sorted({*kept, *windows})[-KEPT_WINDOWS:]
            windows = {x: windows[x] for x in kept if x in windows}
            # Columns of objects: numbers that may be missing stay whole.
            yield pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in zip(RAW.names, zip(*out, strict=True), strict=True)})
        for start in stored.difference(kept):
            self.windows.removeKey((start,))
        for start, window in windows.items():
            self.windows.updateValue((start,), window)
        columns = [[NOTHING if h[c] is None else h[c] for h in held.header] for c in HEADER]
        self.index.update((*columns, held.pending, held.done, kept, held.next_id))

    def _store(self, held: RunBuffer) -> None:
        """Blocks go to the state, and are read again when they are needed."""
        for number in held.removed:
            if self.blocks.containsKey((number,)):
                self.blocks.removeKey((number,))
        for number in held.changed:
            b = held.blocks[number]
            self.blocks.updateValue((number,), (b.ts, b.value, b.start))
        for x in (held.removed, held.changed, held.blocks):
            x.clear()

    def _step(self, key: Any, seq: int, at: int, held: RunBuffer, out: list[tuple]) -> None:
        i, j = held.place(at) if held.header else (0, 0)
        there = bool(held.header) and j < held.header[i]["n"] and held.time((i, j)) == at
        out.append(("point", key[0], key[1], seq, at, held.value((i, j)) if there else None, None, None, None, None, None, None))
        newest = held.last_known() if held.pending else None
        context = max(1, min(CONTEXT, getattr(self.model, "context", CONTEXT)))
        for start in list(held.pending):
            if start == held.oldest() or held.known_before(start, self.min_context) < self.min_context:
                continue
            first, last = held.span(start)
            open_ended = newest is None or newest <= last
            if open_ended and not self.open_ended:
                continue
            ts, value, begin = held.around(first, last, context)
            end = int(np.searchsorted(ts, last))
            try:
                y = rebuild(self.model, value, begin, end, open_ended)
            except ValueError:
                continue
            method = f"{self.model.name}-{'forward-only' if open_ended else 'bidirectional'}"
            label = "PROVISIONAL" if open_ended else "RECONCILED"
            times = ts[begin : end + 1].tolist()
            out.append(("reconstruction", key[0], key[1], seq, None, None, times[0], times[-1], method, label, times, [None if v != v else v for v in y.tolist()]))
            if not open_ended:
                held.finish(start)

    def close(self) -> None:
        return None


def live_updates(messages: DataFrame, model: Forecaster | None = None, **parameters: Any) -> DataFrame:
    """Updates of a stream of ``point_id, sensor, ts, value, seq`` (``seq``: order of arrival, e.g. the offset)."""
    ship(messages.sparkSession)
    messages = messages.select("point_id", "sensor", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("ts"), "value", "seq")
    with by_value():
        updates = messages.groupBy("point_id", "sensor").transformWithStateInPandas(
            statefulProcessor=Repair(model or LastValue(), **parameters), outputStructType=RAW, outputMode="Update", timeMode="None"
        )
    time = {f.name: F.timestamp_micros(f.name) for f in UPDATE.fields if f.dataType == T.TimestampType()}
    return updates.withColumns(time | {"times": F.transform("times", F.timestamp_micros)})


def update_messages(updates: DataFrame) -> DataFrame:
    """Updates as JSON messages of the feed, one for each row; errors are no messages."""
    updates = updates.filter("type <> 'error'")
    values = F.transform(F.arrays_zip("times", "values"), lambda x: F.struct(iso(x["times"]).alias("timestamp"), x["values"].alias("value")))
    point = F.struct("type", "point_id", "sensor", iso(F.col("ts")).alias("timestamp"), "value")
    rebuilt = F.struct("type", "point_id", "sensor", iso(F.col("start_time")).alias("start_time"), iso(F.col("end_time")).alias("end_time"), "method", "confidence", values.alias("values"))
    null = {"ignoreNullFields": "false"}
    return updates.select("point_id", "sensor", "seq", F.when(F.col("type") == "point", F.to_json(point, null)).otherwise(F.to_json(rebuilt, null)).alias("message"))


def newest_windows(updates: DataFrame, limit: int | None = 200) -> DataFrame:
    """For a reader: the newest version of each period, and of those the ``limit`` that start last in each series; None is all."""
    from pyspark.sql import Window

    r = updates.filter("type = 'reconstruction'")
    r = r.withColumn("v", F.row_number().over(Window.partitionBy("point_id", "sensor", "start_time").orderBy(F.col("seq").desc()))).filter("v = 1").drop("v")
    if limit is None:
        return r
    return r.withColumn("p", F.row_number().over(Window.partitionBy("point_id", "sensor").orderBy(F.col("start_time").desc()))).filter(F.col("p") <= limit).drop("p")


def snapshot(updates: DataFrame, point_id: str, sensor: str, points: int = 2000, windows: int = 200) -> tuple[DataFrame, DataFrame]:
    """What a reader of one series starts with: its newest readings and its newest windows, in order; an unknown series gives none.

    ``updates`` are those written so far; the reader goes on with the feed after the largest ``seq``.
    """
    own = updates.filter((F.col("point_id") == point_id) & (F.col("sensor") == sensor))
    readings = last_arrival(own.filter("type = 'point'").select("point_id", "sensor", "ts", "value", "seq"), "seq")
    return newest(readings, points).orderBy("ts"), newest_windows(own, windows).orderBy("start_time")


def snapshot_from_state(spark: SparkSession, checkpoint: str, point_id: str | None = None, sensor: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As :func:`snapshot`, from the state of the last batch that is complete: no log of updates is read.

    One series, or all; the state holds no more readings and windows than a reader is given.
    """
    def state(name: str) -> DataFrame:
        rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        rows = rows.select("key.point_id", "key.sensor", "user_map_key", "user_map_value.*")
        for column, wanted in (("point_id", point_id), ("sensor", sensor)):
            rows = rows if wanted is None else rows.filter(F.col(column) == wanted)
        return rows

    time = lambda c: F.timestamp_micros(c)
    readings = state("blocks").select("point_id", "sensor", F.explode(F.arrays_zip("ts", "value")).alias("x"))
    windows = state("windows").select(
        "point_id", "sensor", "seq", time(F.col("user_map_key.start_time")).alias("start_time"), time("end_time").alias("end_time"), "method", "confidence",
        F.transform("times", time).alias("times"), "values",
    )
    return readings.select("point_id", "sensor", time(F.col("x.ts")).alias("ts"), F.col("x.value").alias("value")), windows


def write_updates(updates: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query that writes updates as JSON messages, a folder for each batch, so that a batch done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    writer = update_messages(updates).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
