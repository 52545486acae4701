"""Reconstruction of frozen periods: forward and backward forecast, blend, feathered edges.

The last-value forecaster has a closed form over the neighbours of a period, so it is plain
column arithmetic. Other forecasters get one row for each period with as many values on
either side as they look at, in waves: one call for the next chunk of all periods of an
Arrow batch. Those with a step in column arithmetic (drift, seasonal) stay in the JVM. A series is cut into blocks of that many rows, each an array
that is made once; a period takes slices of the at most two blocks on either side (never a
whole series).

A period that starts with the first row of its series can't be reconstructed and is left
out, and so is one that the forecaster rejects with a ``ValueError``. One row of context is
enough. A null neighbour makes the corrected values null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import blend, confidence, feather
from ..functions.ship import ship
from .forecast import CHUNK, CONTEXT, Forecaster, forward_many
from .forecast_columns import forecasts_in_columns, steps_of
from .runs import SERIES, periods_of, with_known_neighbours, with_neighbours, with_open_end, with_runs
from .segments import with_runs_in_chunks

FEATHER = 3


def contexts(runs: DataFrame, periods: DataFrame, limit: int = CONTEXT) -> DataFrame:
    """``periods`` with ``context_before`` and ``context_after``: up to ``limit`` values each, in order, nulls kept."""
    block = lambda c: F.floor(c / limit)
    key = [*SERIES, "run"]
    rows = F.array_sort(F.collect_list(F.struct(F.col("rn").alias("at"), F.col("value").alias("v"))))
    blocks = runs.groupBy(*SERIES, block(F.col("rn")).alias("block")).agg(rows.alias("rows"))
    blocks = blocks.select(*SERIES, "block", F.transform("rows", lambda x: x["v"]).alias("values"), F.col("rows")[0]["at"].alias("base"))
    first, last = F.col("first_rn"), F.col("last_rn")
    before = F.sequence(block(F.greatest(F.lit(1), first - limit)), block(F.greatest(F.lit(1), first - 1)))
    wanted = periods.select(*key, "first_rn", "last_rn", F.explode(F.array_union(before, F.sequence(block(last + 1), block(last + limit)))).alias("block"))
    near = wanted.join(blocks, [*SERIES, "block"])
    top = F.col("base") + F.size("values") - 1

    def side(low: Column, high: Column) -> Column:
        low, high = F.greatest(low, F.col("base")), F.least(high, top)
        part = F.slice("values", (low - F.col("base") + 1).cast("int"), (high - low + 1).cast("int"))
        return F.collect_list(F.when(high >= low, F.struct("block", part.alias("part"))))

    found = near.groupBy(*key).agg(side(first - limit, first - 1).alias("b"), side(last + 1, last + limit).alias("a"))
    values = lambda c: F.flatten(F.transform(F.array_sort(c), lambda x: x["part"]))
    return periods.join(found.select(*key, values("b").alias("context_before"), values("a").alias("context_after")), key)


def forecasts(periods: DataFrame, model: Forecaster, chunk: int = CHUNK, limit: int = CONTEXT) -> DataFrame:
    """Adds ``forward`` and ``backward`` (null where the period is open) as arrays of one value for each row.

    Periods that the forecaster rejects with a ``ValueError`` are left out.
    """
    ship(periods.sparkSession)

    out = T.StructType([*periods.schema.fields, T.StructField("forward", T.ArrayType(T.DoubleType())), T.StructField("backward", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # All periods of the batch go on chunk by chunk together, forwards, then those with an end backwards.
            n = batch["n_points"].astype(int).tolist()
            f = forward_many(model, [np.array(x, float) for x in batch["context_before"]], n, chunk, limit)
            after = [None if open_ended or len(x) == 0 else np.array(x, float)[::-1] for x, open_ended in zip(batch["context_after"], batch["is_open_ended"], strict=True)]
            ended = [i for i, x in enumerate(after) if x is not None and f[i] is not None]
            back = dict(zip(ended, forward_many(model, [after[i] for i in ended], [n[i] for i in ended], chunk, limit), strict=True))
            done = [i for i in range(len(n)) if f[i] is not None and (i not in back or back[i] is not None)]
            if done:
                yield batch.iloc[done].assign(forward=[f[i] for i in done], backward=[back[i][::-1] if i in back else None for i in done])

    return periods.mapInPandas(run, out)


def _imputed(rows: DataFrame, feather_points: int, name: str, version: str, label_all_reconciled: bool) -> DataFrame:
    """Blend, feather and label; ``rows`` have ``f, b, f_first, f_last, b_first, b_last``, neighbours and position ``i`` of ``n``."""
    i, n, both = F.col("i"), F.col("n_points"), ~F.col("is_open_ended")
    value = lambda f, b, at: F.when(both, blend(F.col(f), F.col(b), at, n)).otherwise(F.col(f))
    y = value("f", "b", i)
    first, last = value("f_first", "b_first", F.lit(0)), value("f_last", "b_last", n - 1)
    y = feather(y, first, last, F.col("before"), F.col("after"), i, n, feather_points, F.lit(True), both)
    method = F.concat(F.lit(f"{name}-"), F.when(both, "bidirectional").otherwise("forward-only"))
    label = F.lit("RECONCILED") if label_all_reconciled else confidence(method)
    return rows.select(
        *SERIES, F.col("ts").alias("timestamp"), F.col("value").alias("raw_value"), y.alias("imputed_value"), method.alias("imputation_method"),
        label.alias("imputation_confidence"), F.lit(version).alias("imputation_model_version"), F.col("start_time").alias("period_start"),
    )


def gap_contexts(
    readings: DataFrame, min_hours: float = 0.25, limit: int = 1, chunk_hours: float | None = None, skip_null_neighbours: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows with runs, and the periods with neighbours that can be reconstructed; with ``chunk_hours`` no task needs a whole series.

    Neighbours are the rows next to a period, null or not, or with ``skip_null_neighbours`` the nearest readings.
    """
    if skip_null_neighbours and chunk_hours is not None:
        raise ValueError("the nearest readings of a series in chunks may be any number of chunks away")
    if skip_null_neighbours:
        runs = with_known_neighbours(with_runs(readings, limit))
        return runs, with_open_end(periods_of(runs, min_hours), readings).filter("first_rn > 1")
    runs = with_neighbours(with_runs(readings, limit)) if chunk_hours is None else with_runs_in_chunks(readings, limit, chunk_hours)
    return runs, with_open_end(periods_of(runs, min_hours), readings).filter("first_rn > 1")


def _rows(runs: DataFrame, periods: DataFrame) -> DataFrame:
    return runs.select(*SERIES, "run", "ts", "value", "rn").join(periods, [*SERIES, "run"]).withColumn("i", F.col("rn") - F.col("first_rn"))


def reconstruct_last_value(
    readings: DataFrame, min_hours: float = 0.25, limit: int = 1, feather_points: int = FEATHER, label_all_reconciled: bool = False, chunk_hours: float | None = None,
    skip_null_neighbours: bool = False,
) -> DataFrame:
    """Imputed rows by the last-value forecaster, without leaving the JVM."""
    runs, periods = gap_contexts(readings, min_hours, limit, chunk_hours, skip_null_neighbours)
    rows = _rows(runs, periods)
    for c, of in (("f", "before"), ("f_first", "before"), ("f_last", "before"), ("b", "after"), ("b_first", "after"), ("b_last", "after")):
        rows = rows.withColumn(c, F.col(of))
    return _imputed(rows, feather_points, "last-value", "1", label_all_reconciled)


def reconstruct(
    readings: DataFrame, model: Forecaster, min_hours: float = 0.25, limit: int = 1, feather_points: int = FEATHER,
    chunk: int = CHUNK, context: int | None = None, label_all_reconciled: bool = False, chunk_hours: float | None = None,
    skip_null_neighbours: bool = False,
) -> DataFrame:
    """Imputed rows by any forecaster, with as much context as it looks at unless ``context`` says otherwise.

    A forecaster that has its step as column arithmetic (:func:`forecast_columns.steps_of`) stays in the JVM.
    """
    context = context or model.context
    runs, periods = gap_contexts(readings, min_hours, limit, chunk_hours, skip_null_neighbours)
    narrow = periods.select(*SERIES, "run", "first_rn", "last_rn", "n_points", "is_open_ended", "before", "after", "start_time")
    around = contexts(runs, narrow, context)
    done = (forecasts_in_columns if steps_of(model) else forecasts)(around, model, chunk, context).drop("context_before", "context_after")
    rows = _rows(runs, done)
    at = lambda c, i: F.get(c, i)
    n = F.col("n_points").cast("int")
    for c, of in (("f", "forward"), ("b", "backward")):
        rows = rows.withColumn(c, F.nanvl(at(of, F.col("i").cast("int")), F.lit(None).cast("double")))
        rows = rows.withColumn(f"{c}_first", F.nanvl(at(of, F.lit(0)), F.lit(None).cast("double"))).withColumn(f"{c}_last", F.nanvl(at(of, n - 1), F.lit(None).cast("double")))
    return _imputed(rows, feather_points, model.name, model.version, label_all_reconciled)
