"""Scans in chunks, forecasts in waves and forecasts in columns against their plain versions."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import reconstruct, runs
from tidemark.operators.forecast import Drift, LastValue, QuantileModel, SeasonalNaive, clear_models, forward, forward_many, padded
from tidemark.operators.forecast_columns import fold, forecasts_in_columns, steps_of
from tidemark.operators.segments import with_runs_in_chunks
from tidemark.sources.readings import on_grid

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "point_id string, sensor string, ts timestamp, value double"


def series(seed, n, point="p"):
    rng, at, rows = random.Random(seed), START, []
    while len(rows) < n:
        for v in [rng.choice([None, 1.0, 2.0])] * rng.choice([1, 1, 1, 2, 5]):
            at += timedelta(minutes=rng.choice([1, 7, 10, 300]))
            rows.append((point, "s", at, v))
    return rows[:n]


@pytest.mark.parametrize("limit", [0, 1, 2, 5])
@pytest.mark.parametrize("hours", [0.05, 3, 10_000])
def test_chunks_give_what_whole_series_give(spark, limit, hours):
    rows = series(limit, 150) + series(9, 1, "one") + series(3, 40, "q") + [("null", "s", START + timedelta(hours=i), None) for i in range(9)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    columns = ["point_id", "ts", "value", "filled", "rn", "run", "prev_value", "next_value", "valid_before"]
    want = runs.with_neighbours(runs.with_runs(table, limit)).select(columns).orderBy("point_id", "ts").collect()
    got = with_runs_in_chunks(table, limit, hours).select(columns).orderBy("point_id", "ts").collect()
    assert got == want
    assert with_runs_in_chunks(table.limit(0), limit, hours).count() == 0


def test_no_window_holds_the_rows_of_a_series(spark):
    table = spark.createDataFrame(series(1, 50), SCHEMA)
    plan = with_runs_in_chunks(table)._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if re.match(r"[\s:+-]*Window ", line)]
    rows = [line for line in over if "ts#" in line]
    assert rows and all(re.search(r"\[point_id#\d+, sensor#\d+, chunk#\d+L\]", line) for line in rows)
    # What is ordered along a series are chunks.
    assert all(re.search(r"\[chunk#\d+L ASC", line) for line in over if line not in rows)


def test_reconstruction_in_chunks(spark):
    table = spark.createDataFrame(series(4, 400), SCHEMA)
    for model in (Drift(), SeasonalNaive(5), LastValue()):
        want, got = (sorted(map(str, reconstruct.reconstruct(table, model, chunk_hours=h).collect())) for h in (None, 2))
        assert got == want and len(got) > 20
    want, got = (sorted(map(str, reconstruct.reconstruct_last_value(table, chunk_hours=h).collect())) for h in (None, 2))
    assert got == want


class Counting:
    """A forecaster that takes many contexts and counts its calls; rejects those that start with 9."""

    name, version, context = "counting", "1", 100

    def __init__(self, many=True):
        self.calls = 0
        if many:
            self.predict_many = self._many

    def predict(self, context, steps):
        self.calls += 1
        if context[-1] == 9:
            raise ValueError("nine")
        return np.nansum(context[-3:]) * np.arange(1, steps + 1) % 7

    def _many(self, contexts, lengths, steps):
        self.calls += 1
        out = []
        for x, size, n in zip(contexts, lengths, steps, strict=True):
            assert np.isnan(x[: len(x) - size]).all()
            x = x[len(x) - size :]
            out.append(None if x[-1] == 9 else np.nansum(x[-3:]) * np.arange(1, n + 1) % 7)
        return out


def test_waves_are_as_many_as_the_longest_period_has_chunks():
    rng = np.random.default_rng(2)
    contexts = [rng.integers(1, 6, rng.integers(1, 40)).astype(float) for _ in range(50)]
    contexts[7] = np.array([1.0, 9.0])
    steps = rng.integers(0, 300, 50).tolist()
    steps[7] = 10
    one, many = Counting(False), Counting()
    want = [None if i == 7 else forward(one, x, n, 64, 30) for i, (x, n) in enumerate(zip(contexts, steps, strict=True))]
    got = forward_many(many, contexts, steps, 64, 30)
    assert got[7] is None and all(np.array_equal(a, b) for i, (a, b) in enumerate(zip(got, want, strict=True)) if i != 7)
    assert many.calls == -(-max(steps) // 64) and one.calls == sum(-(-n // 64) for i, n in enumerate(steps) if i != 7)
    for model in (LastValue(), Drift(), SeasonalNaive(6)):
        contexts[3][:] = np.nan
        contexts[4][::2] = np.nan
        got = forward_many(model, contexts, steps, 16, model.context)
        assert all(np.allclose(a, forward(model, x, n, 16, model.context), equal_nan=True) for a, x, n in zip(got, contexts, steps, strict=True))
    # A rejection of a whole call says nothing about the others.
    fussy = Counting()
    fussy.predict_many = lambda *_: (_ for _ in ()).throw(ValueError("all"))
    again = forward_many(fussy, contexts[:9], steps[:9], 64, 30)
    assert again[7] is None and sum(x is None for x in again) == 1
    short = Counting()
    short.predict_many = lambda c, k, n: [np.zeros(1)] * len(c)
    assert [x is None for x in forward_many(short, contexts[:3], [1, 2, 0])] == [False, True, False]


def test_a_predict_of_its_own_is_not_passed_over():
    class Own(LastValue):
        def predict(self, context, steps):
            return np.full(steps, 7.0)

    class Both(Own):
        def predict_many(self, contexts, lengths, steps):
            return [np.full(n, 8.0) for n in steps]

    assert forward_many(Own(), [np.array([1.0])], [2])[0].tolist() == [7, 7]
    assert forward_many(Both(), [np.array([1.0])], [2])[0].tolist() == [8, 8]
    assert forward_many(LastValue(), [np.array([1.0])], [2])[0].tolist() == [1, 1]


def test_quantile_models_in_batches():
    clear_models()
    asked = []

    class Model:
        def predict_quantiles(self, inputs, prediction_length, quantile_levels):
            asked.append(np.shape(inputs))
            inputs = np.atleast_2d(inputs)
            return None, np.nanmean(inputs, 1)[:, None] + np.arange(prediction_length)

    model, plain = QuantileModel("m", lambda *_: Model(), batched=True), QuantileModel("m", lambda *_: Model())
    contexts, steps = [np.array([1.0, 3.0]), np.array([4.0])], [5, 2]
    got = forward_many(model, contexts, steps)
    assert asked == [(2, 2)] and [x.tolist() for x in got] == [forward(plain, x, n).tolist() for x, n in zip(contexts, steps, strict=True)]
    matrix, lengths = padded(contexts)
    assert lengths.tolist() == [2, 1] and np.isnan(matrix[1, 0])
    clear_models()


@pytest.mark.parametrize("model", [Drift(), SeasonalNaive(5), SeasonalNaive(50)])
def test_fold_over_arrays_is_the_recurrence(spark, model):
    rng = random.Random(6)
    value = lambda: rng.choice([None, rng.random() * 10, rng.random() * 10])
    rows = [(i, [value() for _ in range(rng.randint(1, 30))], rng.randint(2, 90)) for i in range(60)] + [(90, [None, None], 20), (91, [None, 3.0, None], 40), (92, [5.0], 70)]
    table = spark.createDataFrame(rows, "i int, x array<double>, n int")
    got = {r.i: r.y for r in table.select("i", fold(F.col("x"), F.col("n"), steps_of(model), 16, 20).alias("y")).collect()}
    for i, x, n in rows:
        want = forward(model, np.array(x, float), n, 16, 20)
        assert np.allclose(np.array(got[i], float), want, equal_nan=True), i
    assert steps_of(LastValue()) is None and steps_of(type("Own", (Drift,), {})()) is None
    with pytest.raises(ValueError, match="no step"):
        forecasts_in_columns(table, LastValue())


def test_columns_and_python_agree_on_whole_periods(spark):
    table = spark.createDataFrame(series(11, 500), SCHEMA)
    rows, periods = reconstruct.gap_contexts(table)
    narrow = periods.select("point_id", "sensor", "run", "first_rn", "last_rn", "n_points", "is_open_ended", "before", "after", "start_time")
    for model in (Drift(), SeasonalNaive(7)):
        around = reconstruct.contexts(rows, narrow, model.context)
        a, b = ({r.run: r for r in made(around, model, 4, 30).collect()} for made in (reconstruct.forecasts, forecasts_in_columns))
        assert a.keys() == b.keys() and len(a) > 10
        for run in a:
            for c in ("forward", "backward"):
                x, y = a[run][c], b[run][c]
                assert (x is None) == (y is None)
                assert x is None or np.allclose(np.array(x, float), np.array(y, float), equal_nan=True)


def test_nearest_readings_as_neighbours(spark):
    rows = [(v, i) for i, v in enumerate([1.0, 2.0, None, None, 5.0, 5.0, 5.0, None, None, 9.0, 8.0])]
    table = spark.createDataFrame([("p", "s", START + timedelta(minutes=10 * i), v) for v, i in rows], SCHEMA)
    plain, known = ({r.timestamp: r.imputed_value for r in reconstruct.reconstruct_last_value(table, skip_null_neighbours=k).collect()} for k in (False, True))
    assert plain.keys() == known.keys() and set(plain.values()) == {None}
    got = [known[t] for t in sorted(known)]
    assert got[0] == 2.0 and got[-1] == 9.0 and got == sorted(got)
    drift = {r.timestamp: r.imputed_value for r in reconstruct.reconstruct(table, Drift(), skip_null_neighbours=True).collect()}
    assert drift.keys() == known.keys() and None not in drift.values()
    with pytest.raises(ValueError, match="any number of chunks"):
        reconstruct.gap_contexts(table, chunk_hours=1, skip_null_neighbours=True)


def test_regular_grid(spark):
    at = lambda *x: datetime(2026, 1, *x, tzinfo=timezone.utc)
    rows = [("p", "s", at(1, 23, 55), 1.0), ("p", "s", at(2, 0, 5), 2.0), ("p", "s", at(4, 1, 0), None), ("q", None, at(1, 5), 3.0), ("q", None, at(1, 5, 1), 5.0)]
    for every, n in (("10 minutes", 296), ("25 hours", 3), ("2 days", 2)):
        got = on_grid(spark.createDataFrame(rows, SCHEMA), every).orderBy("point_id", "ts").collect()
        own = [r.ts for r in got if r.point_id == "p"]
        assert len({b - a for a, b in zip(own, own[1:], strict=False)}) <= 1 and [r.value for r in got if r.point_id == "q"] == [4.0]
        assert len(own) == len({*own}) and (every != "10 minutes" or len(own) == n)
        assert {r.value for r in got if r.point_id == "p"} - {None} <= {1.0, 2.0, 1.5}
    assert on_grid(spark.createDataFrame([], SCHEMA)).count() == 0
