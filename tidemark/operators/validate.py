"""Validation on synthetic gaps: hide known readings, reconstruct them, compare with baselines.

Gaps are drawn where the series' sizes are, with a seeded generator for each trial, and
become equi joins on row numbers; all gaps of all series run in one job.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blend, feather
from ..functions.ship import ship
from .forecast import Forecaster
from .reconstruct import FEATHER, contexts, forecasts
from .runs import SERIES

GAPS = (7, 60, 200)
TRIALS = 10
MIN_CONTEXT = 10
ATTEMPTS = 50


def numbered(readings: DataFrame) -> DataFrame:
    return readings.withColumn("rn", F.row_number().over(Window.partitionBy(*SERIES).orderBy("ts")))


def candidate_starts(readings: DataFrame, gaps: Sequence[int] = GAPS, trials: int = TRIALS, min_context: int = MIN_CONTEXT, attempts: int = ATTEMPTS) -> DataFrame:
    """``gap, trial, attempt, start`` (row number) of every draw; the trial seeds its draws. Short series have none."""
    ship(readings.sparkSession)
    sizes = readings.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for point, sensor, n in zip(batch["point_id"], batch["sensor"], batch["n"], strict=True):
                for gap in gaps:
                    if n < gap + 2 * min_context:
                        continue
                    for trial in range(trials):
                        rng = random.Random(trial)
                        out += [(point, sensor, gap, trial, a, rng.randint(min_context, n - gap - min_context) + 1) for a in range(attempts)]
            yield pd.DataFrame(out, columns=["point_id", "sensor", "gap", "trial", "attempt", "start"])

    return sizes.mapInPandas(draw, "point_id string, sensor string, gap int, trial int, attempt int, start long")


def null_free(rows: DataFrame, gaps: Sequence[int]) -> DataFrame:
    """``gap, start``: row numbers where ``gap`` rows and their neighbours are all readings."""
    w = Window.partitionBy(*SERIES).orderBy("rn")
    found = []
    for gap in gaps:
        # The row before, the gap, and the row after it where there is one; no frame holds a whole series.
        inside = w.rowsBetween(-1, gap)
        nulls = F.sum(F.col("value").isNull().cast("int")).over(inside)
        ok = (nulls == 0) & (F.count(F.lit(1)).over(inside) >= gap + 1) & (F.col("rn") > 1)
        found.append(F.when(ok, F.lit(gap)))
    # All lengths share one sort of the series.
    at = rows.select(*SERIES, F.col("rn").alias("start"), F.array_compact(F.array(*found)).alias("gaps"))
    return at.select(*SERIES, F.explode("gaps").alias("gap"), "start")


def draw_gaps(readings: DataFrame, gaps: Sequence[int] = GAPS, trials: int = TRIALS, min_context: int = MIN_CONTEXT, attempts: int = ATTEMPTS) -> DataFrame:
    """``gap, trial, start``: for each trial the first draw that meets no null."""
    good = null_free(numbered(readings), gaps)
    drawn = candidate_starts(readings, gaps, trials, min_context, attempts)
    return drawn.join(good, [*SERIES, "gap", "start"]).groupBy(*SERIES, "gap", "trial").agg(F.min_by("start", "attempt").alias("start"))


def hidden_rows(readings: DataFrame, gaps: DataFrame) -> DataFrame:
    """The readings in each gap with position ``i`` and the readings before and after it."""
    rows = numbered(readings).select(*SERIES, "rn", "ts", "value")
    at = gaps.withColumn("rn", F.explode(F.sequence(F.col("start") - 1, F.col("start") + F.col("gap"))))
    near = at.join(rows, [*SERIES, "rn"])
    w = Window.partitionBy(*SERIES, "gap", "trial")
    edge = lambda rn: F.max(F.when(F.col("rn") == rn, F.col("value"))).over(w)
    out = near.withColumn("before", edge(F.col("start") - 1)).withColumn("after", edge(F.col("start") + F.col("gap")))
    return out.filter((F.col("rn") >= F.col("start")) & (F.col("rn") < F.col("start") + F.col("gap"))).withColumn("i", F.col("rn") - F.col("start"))


def baselines(hidden: DataFrame) -> DataFrame:
    """Adds ``forward_fill`` and ``linear_interp``; without a reading after the gap both are the one before."""
    after = F.coalesce("after", "before")
    return hidden.withColumn("forward_fill", F.col("before")).withColumn("linear_interp", F.col("before") + (after - F.col("before")) * (F.col("i") + 1) / (F.col("gap") + 1))


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(F.avg((p - t) * (p - t)))


def mape(p: Column, t: Column) -> Column:
    """In percent, without true values of 0; null where there are no others."""
    return F.avg(F.when(t != 0, F.abs((p - t) / F.nullif(t, F.lit(0.0))))) * 100


def scores(predicted: DataFrame) -> DataFrame:
    """Errors of ``model, forward_fill, linear_interp`` by trial, and which baselines the model beats."""
    measures = {f"{c}_{name}": f(F.col(c), F.col("value")) for c in ("model", "forward_fill", "linear_interp") for name, f in (("mae", mae), ("rmse", rmse), ("mape", mape))}
    out = predicted.groupBy(*SERIES, "gap", "trial").agg(*(v.alias(k) for k, v in measures.items()))
    return out.withColumn("beats_forward_fill", F.col("model_mae") < F.col("forward_fill_mae")).withColumn("beats_linear_interp", F.col("model_mae") < F.col("linear_interp_mae"))


def summary(trials: DataFrame) -> DataFrame:
    """Averages of the trials by series and gap length."""
    return trials.groupBy(*SERIES, "gap").agg(
        *(F.avg(c).alias(c) for c in ("model_mae", "forward_fill_mae", "linear_interp_mae")),
        *(F.avg(F.col(c).cast("double")).alias(c) for c in ("beats_forward_fill", "beats_linear_interp")),
        F.count(F.lit(1)).cast("double").alias("num_trials"),
    )


def predict_last_value(hidden: DataFrame) -> DataFrame:
    """Adds ``model``: the blended last-value forecast of each hidden row."""
    both = F.when(F.col("after").isNotNull(), blend(F.col("before"), F.col("after"), F.col("i"), F.col("gap"))).otherwise(F.col("before"))
    return hidden.withColumn("model", both)


def predict(readings: DataFrame, gaps: DataFrame, hidden: DataFrame, model: Forecaster, feather_points: int = FEATHER) -> DataFrame:
    """Adds ``model``: the reconstruction of each hidden row by a forecaster."""
    rows = numbered(readings).select(*SERIES, "rn", "ts", "value")
    periods = gaps.select(
        *SERIES, F.concat_ws("-", "gap", "trial").alias("run"), "gap", "trial", F.col("start").alias("first_rn"), (F.col("start") + F.col("gap") - 1).alias("last_rn"),
        F.col("gap").alias("n_points"), F.lit(False).alias("is_open_ended"),
    )
    done = forecasts(contexts(rows, periods, model.context), model, limit=model.context).select(*SERIES, "gap", "trial", "forward", "backward")
    x = hidden.join(done, [*SERIES, "gap", "trial"])
    n, i = F.col("gap"), F.col("i")
    pick = lambda at: F.when(F.col("backward").isNotNull(), blend(F.get("forward", at), F.get("backward", at), at, n)).otherwise(F.get("forward", at))
    y = feather(pick(i.cast("int")), pick(F.lit(0)), pick((n - 1).cast("int")), F.col("before"), F.col("after"), i, n, feather_points, F.lit(True), F.col("after").isNotNull())
    return x.withColumn("model", y).drop("forward", "backward")


def validate(readings: DataFrame, model: Forecaster, gaps: Sequence[int] = GAPS, trials: int = TRIALS) -> DataFrame:
    """The whole sweep: draws, reconstruction, baselines, scores, averages."""
    drawn = draw_gaps(readings, gaps, trials)
    return summary(scores(predict(readings, drawn, baselines(hidden_rows(readings, drawn)), model)))


