"""Detection for series that are too long for one task: in chunks of time, stitched at their borders.

Same result as :func:`runs.stuck_periods` with one bridged null. A chunk needs the two rows
before it, which come from a table of one row for each chunk; only a chunk's first and
last run can go on in another chunk, and only those are stitched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros_between
from .runs import HOUR, SERIES


def stuck_periods_long(readings: DataFrame, min_hours: float = 0.25, chunk_hours: float = 24) -> DataFrame:
    """Frozen periods: ``point_id, sensor, stuck_value, start_time, end_time, n_points, duration_seconds``."""
    key = [*SERIES, "chunk"]
    part = Window.partitionBy(*key).orderBy("ts")
    rows = readings.select(*SERIES, "ts", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / int(chunk_hours * HOUR)).alias("chunk"))
    rows = rows.withColumn("previous", F.lag("value").over(part)).withColumn("place", F.row_number().over(part))

    chunks = Window.partitionBy(*SERIES).orderBy("chunk")
    tails = rows.groupBy(*key).agg(F.max_by("value", "ts").alias("last"), F.max_by("previous", "ts").alias("second"), F.count(F.lit(1)).alias("n"))
    tails = tails.select(
        *key, F.lag("last").over(chunks).alias("before1"),
        F.when(F.lag("n").over(chunks) >= 2, F.lag("second").over(chunks)).otherwise(F.lag("last", 2).over(chunks)).alias("before2"),
    )
    first = F.col("place") == 1
    rows = rows.join(tails, key).withColumn("filled", F.coalesce("value", F.when(first, F.col("before1")).otherwise(F.col("previous"))))
    before = F.when(first, F.coalesce("before1", "before2")).otherwise(F.lag("filled").over(part))
    changed = F.col("filled").isNull() | before.isNull() | (F.col("filled") != before)
    rows = rows.withColumn("changed", changed.cast("int")).withColumn("run", F.sum("changed").over(part.rowsBetween(Window.unboundedPreceding, 0)))

    # Run 0 of a chunk goes on from an earlier chunk.
    runs = rows.groupBy(*key, "run").agg(F.min_by("value", "ts").alias("stuck_value"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("n_points"))
    runs = runs.withColumn("last_run", F.max("run").over(Window.partitionBy(*key)))
    inner = runs.filter((F.col("run") > 0) & (F.col("run") < F.col("last_run")))
    border = runs.filter((F.col("run") == 0) | (F.col("run") == F.col("last_run")))
    order = Window.partitionBy(*SERIES).orderBy("chunk", "run").rowsBetween(Window.unboundedPreceding, 0)
    stitched = border.withColumn("whole", F.sum((F.col("run") > 0).cast("int")).over(order)).groupBy(*SERIES, "whole").agg(
        F.min_by("stuck_value", "start_time").alias("stuck_value"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n_points").alias("n_points")
    )
    out = [*SERIES, "stuck_value", "start_time", "end_time", "n_points"]
    found = inner.select(*out).unionByName(stitched.select(*out))
    span = micros_between(F.col("start_time"), F.col("end_time"))
    return found.filter((F.col("n_points") > 1) & (span >= int(round(min_hours * HOUR)))).withColumn("duration_seconds", (span / 1_000_000).cast("double"))
