"""Sources, detection, reconstruction, validation, sinks: planted answers."""

from __future__ import annotations

import io
import json
import random
import urllib.error
from datetime import timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import buffers, reconstruct, runs, validate
from tidemark.operators.catalog import SCHEMA, all_fields, matching_fields
from tidemark.operators.forecast import Drift, LastValue, QuantileModel, SeasonalNaive, backward, clear_models, forward
from tidemark.operators.long_series import stuck_periods_long
from tidemark.plans.batch import run_api_job, run_csv_job, run_job
from tidemark.sources import readings as src
from tidemark.sources import sinks
from tidemark.sources.readings import first_messages, http_client

START = pd.Timestamp("2026-01-01")


def series(spark, values, minutes=10, point="p", sensor="t", start=START):
    rows = [(point, sensor, (start + pd.Timedelta(minutes=minutes * i)).to_pydatetime(), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "point_id string, sensor string, ts timestamp, value double")


def found(spark, values, hours=0.25, limit=1, minutes=10):
    rows = runs.stuck_periods(series(spark, values, minutes), hours, limit).orderBy("start_time").collect()
    return [(r.stuck_value, r.n_points, round(r.duration_hours, 2)) for r in rows]


@pytest.mark.parametrize(
    ("values", "hours", "limit", "minutes", "expect"),
    [
        ([1, 2, 3, 4], 0.25, 1, 10, []),
        ([20, 21, 21, 21, 21, 22], 0.25, 1, 10, [(21, 4, 0.5)]),
        ([20, 21, 21, 22], 0.5, 1, 10, []),
        ([20, 21, 21, 21, 21, 22], 0.5, 1, 10, [(21, 4, 0.5)]),
        ([1, 5, 5, 5, 2, 9, 9, 9, 3], 0.25, 1, 10, [(5, 3, 0.33), (9, 3, 0.33)]),
        ([20, 21, 21, None, 21, 21, 22], 0.5, 1, 10, [(21, 5, 0.67)]),
        ([20, 21, 21, None, 21, 21, 22], 0.5, 0, 10, []),
        ([1, 2, None, 3], 0.25, 1, 20, [(2, 2, 0.33)]),
        ([21, None, None, 21], 0.1, 1, 10, [(21, 2, 0.17)]),
        ([None, None, None], 0.0, 1, 10, []),
        ([], 0.25, 1, 10, []),
    ],
)
def test_detection(spark, values, hours, limit, minutes, expect):
    assert found(spark, values, hours, limit, minutes) == expect


def test_detection_has_one_exchange(spark):
    plan = runs.stuck_periods(series(spark, [1, 1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ArrowEval" not in plan


@pytest.mark.parametrize("chunk", [0.2, 1, 7])
def test_chunks_are_stitched(spark, chunk):
    rng = random.Random(int(chunk * 10))
    df = None
    for k in range(6):
        values = [rng.choice([None, 1, 1, 1, 2]) for _ in range(80)]
        part = series(spark, values, minutes=rng.choice([5, 10, 45]), point=f"p{k}").filter(F.rand(k) < 0.9)
        df = part if df is None else df.unionByName(part)
    df = spark.createDataFrame(df.collect(), df.schema)
    columns = ["point_id", "sensor", "stuck_value", "start_time", "end_time", "n_points"]
    expect = sorted(map(tuple, runs.stuck_periods(df).select(*columns).collect()), key=str)
    assert sorted(map(tuple, stuck_periods_long(df, chunk_hours=chunk).select(*columns).collect()), key=str) == expect and expect


def test_display_table(spark):
    t = runs.display_table(runs.stuck_periods(series(spark, [21, 21, 21, 21])))
    assert t.columns == ["Sensor/Metric", "Stuck Value", "Start Time", "End Time", "Duration (hours)"]
    assert tuple(t.first()) == ("t", 21.0, "2026-01-01 00:00:00", "2026-01-01 00:30:00", 0.5)


def procedural(y, before, after, points):
    y, n = y.copy(), len(y)
    k = min(points, n)
    for i in range(k):
        pass
    if before is not None and k:
        y[:k] += (before - y[0]) * (1 - np.arange(k) / k)
    if after is not None and k:
        y[n - k :] += (after - y[-1]) * (1 - np.arange(k)[::-1] / k)
    return y


def test_feather_matches_the_procedure(spark):
    from tidemark.functions.columns import feather

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4, 10):
        y = rng.normal(size=n)
        rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i int, y double")
        for before, after, k in ((20.0, None, 3), (None, 30.0, 3), (20.0, 30.0, 3), (20.0, 30.0, 5), (None, None, 3), (20.0, 30.0, 0)):
            lit = lambda v: F.lit(0.0 if v is None else v)
            c = feather(F.col("y"), F.lit(float(y[0])), F.lit(float(y[-1])), lit(before), lit(after), F.col("i"), F.lit(n), k, F.lit(before is not None), F.lit(after is not None))
            got = [r.c for r in rows.select("i", c.alias("c")).orderBy("i").collect()]
            assert np.allclose(got, procedural(y, before, after, k))


def imputed(df):
    return [(round(r.imputed_value, 6), r.imputation_method, r.imputation_confidence) for r in df.orderBy("timestamp").collect()]


def test_reconstruction(spark):
    both = series(spark, [20, 20.5, 22, 21, 21, 21, 21, 19, 19.5])
    got = imputed(reconstruct.reconstruct_last_value(both))
    assert [v for v, *_ in got] == [22, 21, 20, 19] and {x[1:] for x in got} == {("last-value-bidirectional", "RECONCILED")}
    assert imputed(reconstruct.reconstruct(both, LastValue())) == got
    open_ = reconstruct.reconstruct_last_value(series(spark, [20, 20.5, 22, 21, 21, 21, None, None]))
    assert {x[1:] for x in imputed(open_)} == {("last-value-forward-only", "PROVISIONAL")}
    assert imputed(reconstruct.reconstruct_last_value(series(spark, [21, 21, 21, 5]))) == []
    one = imputed(reconstruct.reconstruct_last_value(series(spark, [20, 21, 21, 21])))
    assert [v for v, *_ in one] == [20, 20, 20]
    raw = reconstruct.reconstruct_last_value(series(spark, [20, 21, 21, None, 21, 5])).orderBy("timestamp").collect()
    assert [r.raw_value for r in raw] == [21, 21, None, 21]
    all_ = reconstruct.reconstruct_last_value(series(spark, [20, 21, 21, 21]), label_all_reconciled=True)
    assert {x[2] for x in imputed(all_)} == {"RECONCILED"}


def test_contexts_are_bounded_slices(spark):
    rng = random.Random(1)
    values = [rng.choice([None, 1, 2, 2, 2, 3]) for _ in range(300)]
    r, p = reconstruct.gap_contexts(series(spark, values))
    for limit in (1, 7, 64):
        for row in reconstruct.contexts(r, p, limit).collect():
            lo, hi = row.first_rn - 1, row.last_rn
            clean = lambda x: [None if v is None else float(v) for v in x]
            assert row.context_before == clean(values[max(0, lo - limit) : lo])
            assert row.context_after == clean(values[hi : hi + limit])


def test_forecasters():
    assert list(forward(LastValue(), np.array([1.0, 2.0]), 3)) == [2, 2, 2]
    assert list(backward(LastValue(), np.array([30.0, 31.0]), 4)) == [30] * 4
    assert len(forward(LastValue(), np.array([1.0]), 0)) == 0
    assert list(forward(Drift(), np.array([1.0, np.nan, 3.0]), 2)) == [4, 5]
    assert list(SeasonalNaive(3).predict(np.array([9.0, 1, 2, 3]), 5)) == [1, 2, 3, 1, 2]
    sizes, seen = [], []

    class Spy(LastValue):
        def predict(self, context, steps):
            sizes.append(steps)
            seen.append(len(context))
            return super().predict(context, steps)

    assert len(forward(Spy(), np.ones(600), 150)) == 150
    assert sizes == [64, 64, 22] and seen == [512] * 3
    loads = []

    class Model:
        def predict_quantiles(self, inputs, prediction_length, quantile_levels):
            return None, [[inputs[-1]] * prediction_length]

    m = QuantileModel("m", lambda *key: loads.append(key) or Model())
    clear_models()
    assert list(m.predict(np.array([1.0, 4.0]), 2)) == [4, 4] and list(m.predict(np.array([5.0]), 1)) == [5]
    assert loads == [("m", "cpu")]


def test_gap_draws_match_the_seeded_generator(spark):
    values = [None if i % 17 == 3 else float(i) for i in range(120)]
    got = {(r.gap, r.trial): r.start for r in validate.draw_gaps(series(spark, values), (5, 30, 200), 6).collect()}
    expect = {}
    for gap in (5, 30):
        for trial in range(6):
            rng = random.Random(trial)
            for _ in range(50):
                s = rng.randint(10, len(values) - gap - 10)
                if all(v is not None for v in values[s - 1 : s + gap + 1]):
                    expect[gap, trial] = s + 1
                    break
    assert got == expect and any(g == 5 for g, _ in got)


def test_scores(spark):
    rows = [("p", "t", 3, 0, 10.0, 10.0, 5.0, 9.0)] * 3 + [("p", "t", 3, 1, 0.0, 1.0, 0.0, 2.0)] * 2
    df = spark.createDataFrame(rows, "point_id string, sensor string, gap int, trial int, value double, model double, forward_fill double, linear_interp double")
    a, b = validate.scores(df).orderBy("trial").collect()
    assert a.model_mae == 0 and a.beats_forward_fill and a.beats_linear_interp and a.forward_fill_mape == 50
    assert b.model_mape is None and not b.beats_forward_fill and b.beats_linear_interp
    s = validate.summary(validate.scores(df)).first()
    assert (s.num_trials, s.beats_forward_fill, s.model_mae) == (2.0, 0.5, 0.5)


def test_baselines_and_validation(spark):
    df = series(spark, [float(i % 7) for i in range(60)])
    got = validate.validate(df, LastValue(), (7, 200), 4).collect()
    assert [(r.gap, r.num_trials) for r in got] == [(7, 4.0)]
    drawn = validate.draw_gaps(series(spark, range(50)), (5,), 3)
    for r in validate.baselines(validate.hidden_rows(series(spark, range(50)), drawn)).collect():
        assert r.linear_interp == pytest.approx(r.value) and r.forward_fill == r.before


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("timestamp,a1__Sensor__aht_temperature,a1__Sensor__aht_humidity\n2026-01-01T00:20:00Z,3,\n2026-01-01T00:00:00,1,NaN\n2026-01-01T00:10:00+00:00,2,40\n")
    df = src.read_wide_csv(spark, str(path), ["a1__Sensor__aht_humidity"], point_id="x")
    assert [(r.point_id, r.sensor, r.value) for r in df.orderBy("ts").collect()] == [("x", "aht_humidity", None), ("x", "aht_humidity", 40.0), ("x", "aht_humidity", None)]
    assert src.read_wide_csv(spark, str(path)).count() == 6
    with pytest.raises(ValueError, match="available: timestamp"):
        src.read_wide_csv(spark, str(path), ["nope"])
    assert src.matching_columns(spark, str(path), ["TEMP"]) == ["a1__Sensor__aht_temperature"]


def test_payload_and_fetch(spark):
    one = {"timestamp": "2026-01-01T00:10:00Z", "value": None}
    points = [{"id": "p1", "type": "t", "attribute": "temp", "series": [one, {"timestamp": "2026-01-01T00:00:00Z", "value": 1.5}]}, {"id": "p2", "type": "t", "attribute": "hum", "series": []}]
    text = json.dumps({"projects": [{"id": "1", "alias": "a", "equipment": [{"id": "e", "type": "Sensor", "points": points}]}]})
    calls, waits = [], []

    def execute(variables):
        calls.append(variables)
        if len(calls) < 3:
            raise ConnectionError
        return text

    got = src.fetch_payload(spark, execute, {"alias": "a"}, sleep=waits.append).orderBy("ts").collect()
    assert [(r.point_id, r.equipment_id, r.value) for r in got] == [("p1", "e", 1.5), ("p1", "e", None)]
    assert len(calls) == 3 and waits == [2.0, 2.0]
    with pytest.raises(ConnectionError):
        src.fetch_payload(spark, lambda v: (_ for _ in ()).throw(ConnectionError()), {}, retries=1)
    with pytest.raises(ValueError, match="token"):
        src.api_token(None, "NO_SUCH_VARIABLE")


def test_schema_search(spark):
    t = ("T", "OBJECT", None, [("a", "Imputed value", []), ("b", None, None), ("c", "x", [("confidenceLevel", None)])])
    df = spark.createDataFrame([([t],)], SCHEMA)
    assert {r.field for r in matching_fields(df).collect()} == {"a", "c"} and all_fields(df).count() == 3


def test_sinks(spark, tmp_path):
    rows = reconstruct.reconstruct_last_value(series(spark, [20, 21, 21, None, 21, 5]))
    for _ in range(2):
        sinks.write(rows, "local_jsonl", str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 8 and lines[0].keys() == set(sinks.IMPUTED)
    assert {x["timestamp"] for x in lines} >= {"2026-01-01T00:10:00+00:00"} and any(x["raw_value"] is None for x in lines)
    with pytest.raises(NotImplementedError):
        sinks.write(rows, "graphql")
    with pytest.raises(ValueError, match="unknown sink"):
        sinks.write(rows, "other")
    nan = spark.createDataFrame([("p", "t", START.to_pydatetime(), float("nan"))], "point_id string, sensor string, ts timestamp, value double")
    assert sinks.message_json(nan).first().value == '{"point_id":"p","sensor":"t","timestamp":"2026-01-01T00:00:00+00:00","value":null}'
    two = rows.withColumn("write_seq", F.lit(1)).unionByName(rows.withColumn("imputation_confidence", F.lit("PROVISIONAL")).withColumn("write_seq", F.lit(2)))
    assert {r.write_seq for r in sinks.latest(two).collect()} == {1}


def test_batch_job(spark, tmp_path):
    values = [20 + (i % 5) * 0.1 for i in range(60)]
    values[30:36] = [21.0] * 6
    df = series(spark, values).unionByName(series(spark, values, point="q", sensor="h")).unionByName(series(spark, range(20), point="r"))
    n = {(r.point_id, r.sensor): r.n for r in run_job(df, str(tmp_path / "a"), min_hours=0.5, metrics=sinks.tracker(str(tmp_path / "m"), "test")).collect()}
    assert n == {("p", "t"): 6, ("q", "h"): 6}
    assert spark.read.json(str(tmp_path / "m")).filter("gap = 7").count() == 2
    csv = tmp_path / "x.csv"
    stamps = [(START + pd.Timedelta(minutes=10 * i)).isoformat() for i in range(60)]
    csv.write_text("timestamp,s__t\n" + "".join(f"{t},{v}\n" for t, v in zip(stamps, values, strict=True)))
    assert [r.n for r in run_csv_job(spark, str(csv), ["s__t"], "p", str(tmp_path / "b"), min_hours=0.5, backend="parquet").collect()] == [6]
    with pytest.raises(NotImplementedError):
        run_job(df, str(tmp_path / "c"), backend="graphql")


def test_buffers_and_replay(spark):
    df = series(spark, range(8))
    assert [r.value for r in buffers.newest(df, 5).orderBy("ts").collect()] == [3, 4, 5, 6, 7]
    twice = df.withColumn("seq", F.lit(1)).unionByName(df.withColumn("value", F.col("value") + 1).withColumn("seq", F.lit(2)))
    assert [r.value for r in buffers.last_arrival(twice, "seq").orderBy("ts").collect()] == list(range(1, 9))
    rows = buffers.replay(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 60, "2030-01-01").orderBy("ts").collect()
    assert [r.delay_seconds for r in rows[:-1]] == [10.0] * 7 and str(rows[1].replay_ts) == "2030-01-01 00:10:00"
    looped = buffers.replay(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 60, "2030-01-01", loops=2).orderBy("replay_ts").collect()
    assert [r.value for r in looped] == 2 * list(range(8)) and [r.delay_seconds for r in looped[:-1]] == [10.0] * 15
    assert [str(r.replay_ts) for r in looped[7:9]] == ["2030-01-01 01:10:00", "2030-01-01 01:20:00"]
    assert [r.value for r in first_messages(df, 3, "ts").collect()] == [0, 1, 2]


def test_a_run_counts_its_own_rows(spark, tmp_path):
    values = [20 + (i % 5) * 0.1 for i in range(60)]
    values[30:36] = [21.0] * 6
    df = series(spark, values)
    for _ in range(2):
        assert [r.n for r in run_job(df, str(tmp_path / "a"), min_hours=0.5).collect()] == [6]
    assert spark.read.json(str(tmp_path / "a")).count() == 12


def test_api_job(spark, tmp_path):
    stamps = [START + pd.Timedelta(minutes=10 * i) for i in range(40)]
    flat = [{"timestamp": t.isoformat() + "Z", "value": 21.0 if 20 <= i < 26 else 20 + (i % 5) * 0.1} for i, t in enumerate(stamps)]
    rising = [{"timestamp": t.isoformat() + "Z", "value": float(i)} for i, t in enumerate(stamps)]
    points = [{"id": "a", "type": "s", "attribute": "temp", "series": flat}, {"id": "b", "type": "s", "attribute": "temp", "series": rising}, {"id": "c", "type": "s", "attribute": "temp", "series": []}]
    asked = []

    def execute(variables):
        asked.append(variables)
        return json.dumps({"projects": [{"id": "1", "alias": "x", "equipment": [{"id": "e", "type": "m", "points": points}]}]})

    got = run_api_job(spark, execute, "x", ["temp"], str(tmp_path / "a"), days_back=2, now=(stamps[-1] + pd.Timedelta(hours=1)).to_pydatetime().replace(tzinfo=timezone.utc), min_hours=0.5)
    assert {r.point_id: r.n for r in got.collect()} == {"a": 6, "b": 0}
    assert asked[0]["alias"] == "x" and asked[0]["attributes"] == ["temp"]
    empty = run_api_job(spark, lambda v: json.dumps({"projects": []}), "x", ["temp"], str(tmp_path / "b"))
    assert empty.count() == 0


def test_api_client(monkeypatch):
    sent = []

    def answer(request, timeout):
        sent.append(json.loads(request.data))
        return io.BytesIO(json.dumps({"data": {"projects": []}} if len(sent) > 1 else {"errors": ["no"]}).encode())

    monkeypatch.setattr("tidemark.sources.readings.urlopen", answer)
    client = http_client("http://localhost/x", token="t")
    with pytest.raises(RuntimeError, match="rejected"):
        client({"alias": "a"})
    assert json.loads(client({"alias": "a"})) == {"projects": []} and sent[1]["variables"] == {"alias": "a"} and "series" in sent[1]["query"]

    def down(request, timeout):
        raise urllib.error.URLError("down")

    monkeypatch.setattr("tidemark.sources.readings.urlopen", down)
    with pytest.raises(ConnectionError):
        client({})


def test_rejected_periods_and_short_forecasts(spark):
    class Rejects(LastValue):
        def predict(self, context, steps):
            if context[-1] > 20:
                raise ValueError("no")
            return super().predict(context, steps)

    class Short(LastValue):
        def predict(self, context, steps):
            return super().predict(context, steps)[:-1]

    df = series(spark, [20, 5, 5, 5, 2, 30, 9, 9, 9, 3])
    assert {r.raw_value for r in reconstruct.reconstruct(df, Rejects()).collect()} == {5.0}
    assert reconstruct.reconstruct(df, Short()).count() == 0
    with pytest.raises(ValueError, match="values of"):
        forward(Short(), [1.0], 3)


def test_tracker_keeps_params_metrics_and_artifacts(spark, tmp_path):
    t = sinks.tracker(str(tmp_path / "m"), "r1")
    t.log_params({"model": "drift", "gaps": [7, 60]})
    for n in (3, 5):
        t.log_artifact("periods", spark.range(n))
    rows = {r["name"]: (r["value"], r["run"]) for r in spark.read.json(str(tmp_path / "m-params")).collect()}
    assert rows == {"model": ('"drift"', "r1"), "gaps": ("[7, 60]", "r1")}
    assert spark.read.parquet(str(tmp_path / "m-artifacts/r1/periods")).count() == 5
