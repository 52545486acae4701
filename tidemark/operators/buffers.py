"""Bounded buffers and summaries by series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import SERIES


def last_arrival(arrivals: DataFrame, order: str) -> DataFrame:
    """One row for each series and time: the one that arrived last."""
    w = Window.partitionBy(*SERIES, "ts").orderBy(F.col(order).desc())
    return arrivals.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def newest(readings: DataFrame, points: int) -> DataFrame:
    """The newest ``points`` rows of each series by event time (Spark stops each group there)."""
    w = Window.partitionBy(*SERIES).orderBy(F.col("ts").desc())
    return readings.withColumn("__place", F.row_number().over(w)).filter(F.col("__place") <= points).drop("__place")


def series_keys(readings: DataFrame) -> DataFrame:
    return readings.select(*SERIES).distinct()


def replay(readings: DataFrame, speed: float = 60.0, now: str | None = None, loops: int = 1) -> DataFrame:
    """Adds the pause before the next message in seconds and, with ``now``, times moved so that the series starts then.

    With several ``loops`` a series begins again after its end, each loop (column ``loop``) after
    the one before; the pause between them is the series' mean gap.
    """
    w = Window.partitionBy(*SERIES).orderBy("ts")
    gap = F.timestamp_diff("MICROSECOND", F.col("ts"), F.lead("ts").over(w)) / 1_000_000
    out = readings.withColumn("delay_seconds", F.greatest(gap / speed, F.lit(0.0)))
    if now is not None:
        first = F.min("ts").over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("replay_ts", F.lit(now).cast("timestamp_ntz") + (F.col("ts") - first))
    if loops == 1:
        return out
    # One row for each series says how long it is; no frame holds a whole series.
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1_000_000
    mean = span / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))
    sizes = readings.groupBy(*(F.col(c).alias(f"__{c}") for c in SERIES)).agg(((span + mean) * 1_000_000).cast("long").alias("__round"), (mean / speed).alias("__pause"))
    out = out.withColumn("__ends", F.lead("ts").over(w).isNull())
    out = out.join(sizes, F.col("point_id").eqNullSafe(F.col("__point_id")) & F.col("sensor").eqNullSafe(F.col("__sensor"))).withColumn("__mean", F.when(F.col("__ends"), F.col("__pause")))
    out = out.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    pause = F.when(F.col("loop") < loops - 1, F.coalesce("__mean", "delay_seconds")).otherwise(F.col("delay_seconds"))
    out = out.withColumn("delay_seconds", pause)
    if now is not None:
        out = out.withColumn("replay_ts", F.timestamp_add("MICROSECOND", F.col("loop") * F.col("__round"), F.col("replay_ts")))
    return out.drop("__round", "__mean", "__pause", "__ends", *(f"__{c}" for c in SERIES))
