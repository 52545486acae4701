"""A replay in real time: readings are released when they are due, any number of series side by side.

When a reading is due (seconds after the replay's start) is computed once and written, dealt
out by slices of time. A clock stream gives ticks; each batch releases what became due between
its first and its last tick, so the query's checkpoint says what has been released, and a batch done
again releases the same readings. A task reads only the slices that a batch needs.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runs import SERIES

TICKS = 10
#: Seconds of the replay in one slice of the schedule.
SLICE = 60


def schedule(readings: DataFrame, speed: float = 60.0, loops: int = 1, now: str | None = None) -> DataFrame:
    """Adds ``due`` (seconds), ``loop`` and, with ``now``, ``replay_ts``: every series starts at 0.

    A loop begins the series' mean gap after the end of the one before.
    """
    if speed <= 0 or loops < 1:
        raise ValueError("speed and loops must be positive")
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts"))
    sizes = readings.groupBy(*(F.col(c).alias(f"__{c}") for c in SERIES)).agg(F.min("ts").alias("__first"), (span + span / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).cast("long").alias("__round"))
    rows = readings.join(sizes, F.col("point_id").eqNullSafe(F.col("__point_id")) & F.col("sensor").eqNullSafe(F.col("__sensor")))
    rows = rows.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    at = F.timestamp_diff("MICROSECOND", F.col("__first"), F.col("ts")) + F.col("loop") * F.col("__round")
    out = rows.withColumn("due", at / (1_000_000 * speed))
    if now is not None:
        out = out.withColumn("replay_ts", F.timestamp_add("MICROSECOND", at, F.lit(now).cast("timestamp")))
    return out.drop("__first", "__round", *(f"__{c}" for c in SERIES))


def write_schedule(rows: DataFrame, path: str) -> float:
    """Writes a schedule by slices of time; gives the seconds that the replay takes."""
    rows.withColumn("slice", F.floor(F.col("due") / SLICE).cast("int")).repartition("slice").sortWithinPartitions("slice", "due").write.partitionBy("slice").parquet(path)
    return float(rows.sparkSession.read.parquet(path).agg(F.max("due")).first()[0] or 0.0)


def release(spark: SparkSession, path: str, send: Callable[[DataFrame, int], None], checkpoint: str, ticks: int = TICKS) -> StreamingQuery:
    """Starts a query that hands each batch's readings to ``send`` with the batch's number, in order of ``due``."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", ticks).load()

    def step(batch: DataFrame, number: int) -> None:
        first, last = batch.agg(F.min("value"), F.max("value")).first()
        if first is None:
            return
        # Tick v says that v / ticks seconds have passed; the first one releases what is due at once.
        low, high = (first - 1) / ticks, last / ticks
        planned = spark.read.parquet(path)
        due = planned.filter((F.col("slice") >= int(max(low, 0) // SLICE)) & (F.col("slice") <= int(high // SLICE)) & (F.col("due") > low) & (F.col("due") <= high))
        send(due.drop("slice").orderBy("due"), number)

    return clock.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def replay_in_time(spark: SparkSession, readings: DataFrame, send: Callable[[DataFrame, int], None], folder: str, speed: float = 60.0, loops: int = 1, now: str | None = None, ticks: int = TICKS) -> float:
    """The whole replay; returns when its last reading is released, with the seconds it took.

    ``folder`` holds schedule and checkpoint: a replay that was broken off goes on there.
    """
    path = f"{folder}/schedule"
    if not _there(spark, f"{path}/_SUCCESS"):
        write_schedule(schedule(readings, speed, loops, now), path)
    seconds = float(spark.read.parquet(path).agg(F.max("due")).first()[0] or 0.0)
    began, sent = time.time(), [0.0]

    def counted(rows: DataFrame, number: int) -> None:
        send(rows, number)
        sent[0] = max(sent[0], rows.agg(F.max("due")).first()[0] or 0.0)

    query = release(spark, path, counted, f"{folder}/clock", ticks)
    try:
        while sent[0] < seconds and query.isActive:
            query.awaitTermination(0.1)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
    return time.time() - began


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
