"""Forecasters whose step is column arithmetic: the recurrence over chunks as a fold over arrays, in the JVM.

A chunk is forecast from the last ``limit`` values seen; the next one sees it too. The fold's
state is those values and the chunks forecast so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forecast import CHUNK, CONTEXT, Drift, Forecaster, SeasonalNaive
from .segments import tail

Step = Callable[[Column, int], Column]


def drift(seen: Column, chunk: int) -> Column:
    """Goes on along the line from the first to the last reading; nulls where there is none."""
    known = F.transform(seen, lambda x: x.isNotNull())
    first, size = F.array_position(known, True), F.size(seen)
    last = size - F.array_position(F.reverse(known), True).cast("int") + 1
    near, far = F.get(seen, last - 1), F.get(seen, first.cast("int") - 1)
    slope = F.when(last > first, (near - far) / (last - first)).otherwise(F.lit(0.0))
    # As a struct of an array of one, so that a lambda computes these once and not for each step.
    line = F.array(F.struct(near.alias("near"), slope.alias("slope"), (size - last).alias("gap"), (first > 0).alias("any")))
    steps = F.sequence(F.lit(1), F.lit(chunk))
    one = F.transform(line, lambda k: F.transform(steps, lambda i: F.when(k["any"], k["near"] + k["slope"] * (k["gap"] + i))))
    return F.get(one, F.lit(0))


def seasonal(season: int) -> Step:
    def step(seen: Column, chunk: int) -> Column:
        """Repeats the last whole season."""
        last = F.array(tail(seen, season))
        one = F.transform(last, lambda s: F.transform(F.sequence(F.lit(0), F.lit(chunk - 1)), lambda i: F.get(s, i % F.size(s))))
        return F.get(one, F.lit(0))

    return step


def steps_of(model: Forecaster) -> Step | None:
    """The forecaster's step, where it is one of those that have one."""
    if type(model) is Drift:
        return drift
    return seasonal(model.season) if type(model) is SeasonalNaive else None


def fold(context: Column, n: Column, step: Step, chunk: int = CHUNK, limit: int = CONTEXT) -> Column:
    """``n`` values after the context."""
    empty = F.array().cast("array<array<double>>")
    start = F.struct(tail(context, limit).alias("seen"), empty.alias("out"))

    def merge(state: Column, _: Column) -> Column:
        # The forecast is wanted twice, so it is bound by a lambda.
        some = F.array(step(state["seen"], chunk))
        both = F.transform(some, lambda y: F.struct(tail(F.concat(state["seen"], y), limit).alias("seen"), F.concat(state["out"], F.array(y)).alias("out")))
        return F.get(both, F.lit(0))

    chunks = F.sequence(F.lit(1), F.ceil(n / chunk).cast("int"))
    return F.aggregate(chunks, start, merge, lambda state: F.slice(F.flatten(state["out"]), F.lit(1), n.cast("int")))


def forecasts_in_columns(periods: DataFrame, model: Forecaster, chunk: int = CHUNK, limit: int = CONTEXT) -> DataFrame:
    """As :func:`reconstruct.forecasts`, without leaving the JVM."""
    step = steps_of(model)
    if step is None:
        raise ValueError(f"{model.name} has no step in columns")
    back = F.reverse(fold(F.reverse("context_after"), F.col("n_points"), step, chunk, limit))
    ended = ~F.col("is_open_ended") & (F.size("context_after") > 0)
    return periods.withColumns({"forward": fold(F.col("context_before"), F.col("n_points"), step, chunk, limit), "backward": F.when(ended, back)})
