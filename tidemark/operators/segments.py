"""Runs, neighbours and counts of series of any length, in chunks of time.

The same columns as :func:`runs.with_runs` and :func:`runs.with_neighbours`, for any number of
bridged nulls. Rows are dealt out by series and chunk, so no task needs a whole series. Each
chunk gives one row of a summary (its rows, readings, changes of value, first value and
last rows); summaries are merged along the series, and what a chunk needs of those before it
comes back to its rows: the last rows, and how many rows, readings and runs there are. The
merge is associative: counts add up, and of the last rows the last ones stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import HOUR, SERIES

CHUNK_HOURS = 24.0
KEY = [*SERIES, "chunk"]


def last_known(values: Column) -> Column:
    """The last of an array that isn't null."""
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1))


def tail(values: Column, n: Column | int) -> Column:
    """The last ``n`` of an array, or all where it has fewer."""
    most = F.least(F.size(values), F.lit(n) if isinstance(n, int) else n)
    return F.slice(values, F.size(values) - most + 1, most)


def summaries(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each chunk, with what the chunks before it hand on: ``carry`` (their last ``keep`` values), ``rows_before``, ``valid_before_chunk``; and the first value of the next one."""
    last = F.sort_array(F.collect_list(F.when(F.col("near_end"), F.struct("place", "value"))))
    own = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("valid"), F.max(F.when(F.col("place") == 1, F.struct("value"))).alias("first"), F.transform(last, lambda x: x["value"]).alias("last")
    )
    order = Window.partitionBy(*SERIES).orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A chunk has a row at least, so the last ``keep`` rows lie in as many chunks at most.
    carried = F.flatten(F.collect_list("last").over(order.rowsBetween(-keep, -1)))
    return own.select(
        *KEY, tail(carried, keep).alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("valid").over(before), F.lit(0)).alias("valid_before_chunk"), F.lead("first").over(order).alias("first_after"),
    )


def with_runs_in_chunks(readings: DataFrame, limit: int = 1, chunk_hours: float = CHUNK_HOURS) -> DataFrame:
    """``readings`` with ``filled, rn, run, prev_value, next_value, valid_before``."""
    part = Window.partitionBy(*KEY).orderBy("ts")
    keep = limit + 1
    rows = readings.withColumn("chunk", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / int(chunk_hours * HOUR)))
    rows = rows.withColumns({"place": F.row_number().over(part), "near_end": F.lead(F.lit(1), keep).over(part).isNull()})
    rows = rows.join(summaries(rows.select(*KEY, "place", "near_end", "value"), keep), KEY)

    # A row looks at itself and ``limit`` rows before, of which the chunk's first rows find some in the carry.
    inside = F.last("value", ignorenulls=True).over(part.rowsBetween(-limit, 0)) if limit > 0 else F.col("value")
    missing = F.greatest(F.lit(0), F.lit(limit + 1) - F.col("place"))
    rows = rows.withColumn("filled", F.coalesce(inside, last_known(tail(F.col("carry"), missing))) if limit > 0 else inside)
    before = F.when(F.col("place") > 1, F.lag("filled").over(part)).otherwise(last_known(F.col("carry")) if limit > 0 else F.try_element_at("carry", F.lit(-1)))
    changed = F.col("filled").isNull() | before.isNull() | (F.col("filled") != before)
    rows = rows.withColumn("changed", changed.cast("int"))

    changes = rows.groupBy(*KEY).agg(F.sum("changed").alias("changes"))
    earlier = Window.partitionBy(*SERIES).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(changes.select(*KEY, F.coalesce(F.sum("changes").over(earlier), F.lit(0)).alias("runs_before")), KEY)
    so_far = part.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns(
        {
            "rn": F.col("rows_before") + F.col("place"),
            "run": F.col("runs_before") + F.sum("changed").over(so_far),
            "prev_value": F.when(F.col("place") > 1, F.lag("value").over(part)).otherwise(F.try_element_at("carry", F.lit(-1))),
            "next_value": F.coalesce(F.lead(F.struct("value")).over(part), F.col("first_after"))["value"],
            "valid_before": F.col("valid_before_chunk") + F.count("value").over(part.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    return out.select(*readings.columns, "filled", "rn", "run", "prev_value", "next_value", "valid_before")
