"""Detection of frozen readings: runs of one value, with isolated nulls bridged.

All windows share one partitioning and order, so the plan has one exchange and one sort;
the aggregation by run reuses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros_between

SERIES = ["point_id", "sensor"]
HOUR = 3_600_000_000


def bridge_nulls(readings: DataFrame, limit: int = 1) -> DataFrame:
    """Adds ``filled``: the value, or the last one of at most ``limit`` rows before; 0 is off."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    filled = F.last("value", ignorenulls=True).over(w.rowsBetween(-limit, 0)) if limit > 0 else F.col("value")
    return readings.withColumn("filled", filled)


def with_runs(readings: DataFrame, limit: int = 1) -> DataFrame:
    """Adds ``filled``, ``rn`` and ``run``; a null that isn't bridged is a run of its own."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    before = F.lag("filled").over(w)
    changed = F.col("filled").isNull() | before.isNull() | (F.col("filled") != before)
    rows = bridge_nulls(readings, limit).withColumn("changed", changed.cast("int"))
    run = F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("rn", F.row_number().over(w)).withColumn("run", run).drop("changed")


def with_neighbours(runs: DataFrame) -> DataFrame:
    """Adds the values of the rows before and after, and how many readings there are before."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    return runs.withColumns(
        {"prev_value": F.lag("value").over(w), "next_value": F.lead("value").over(w), "valid_before": F.count("value").over(w.rowsBetween(Window.unboundedPreceding, -1))}
    )


def with_known_neighbours(runs: DataFrame) -> DataFrame:
    """As :func:`with_neighbours`, with the nearest readings before and after instead of rows that may be null."""
    w = Window.partitionBy(*SERIES).orderBy("ts")
    back = Window.partitionBy(*SERIES).orderBy(F.col("ts").desc())
    before = lambda over: F.last("value", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumns({"prev_value": before(w), "next_value": before(back), "valid_before": F.count("value").over(w.rowsBetween(Window.unboundedPreceding, -1))})


def periods_of(runs: DataFrame, min_hours: float = 0.25) -> DataFrame:
    """Runs of two rows or more that last at least ``min_hours``; with neighbours' columns where they were added."""
    extra = []
    if "prev_value" in runs.columns:
        extra = [F.min_by("prev_value", "rn").alias("before"), F.max_by("next_value", "rn").alias("after"), F.min_by("valid_before", "rn").alias("valid_before")]
    grouped = runs.groupBy(*SERIES, "run").agg(
        F.min_by("value", "ts").alias("stuck_value"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count(F.lit(1)).alias("n_points"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), *extra,
    )
    span = micros_between(F.col("start_time"), F.col("end_time"))
    found = grouped.filter((F.col("n_points") > 1) & (span >= int(round(min_hours * HOUR))))
    return found.withColumn("duration_seconds", (span / 1_000_000).cast("double")).withColumn("duration_hours", F.round(F.col("duration_seconds") / 3600, 2))


def stuck_periods(readings: DataFrame, min_hours: float = 0.25, limit: int = 1) -> DataFrame:
    """Frozen periods of every series."""
    return periods_of(with_runs(readings, limit), min_hours)


def with_open_end(periods: DataFrame, readings: DataFrame) -> DataFrame:
    """Adds ``is_open_ended``: no reading follows the period. Nulls that follow don't end it."""
    last = readings.filter("value IS NOT NULL").groupBy(*SERIES).agg(F.max("ts").alias("last_reading"))
    return periods.join(last, SERIES, "left").withColumn("is_open_ended", F.coalesce(F.col("last_reading") <= F.col("end_time"), F.lit(True))).drop("last_reading")


def display_table(periods: DataFrame) -> DataFrame:
    """Periods for reading: five columns, times as text."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return periods.select(
        F.col("sensor").alias("Sensor/Metric"), F.col("stuck_value").alias("Stuck Value"), text("start_time").alias("Start Time"),
        text("end_time").alias("End Time"), F.col("duration_hours").alias("Duration (hours)"),
    )
