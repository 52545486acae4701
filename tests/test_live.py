"""Live repair: messages one by one through a file stream."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import reconstruct
from tidemark.sources.readings import READING, file_messages, kafka_messages, parse_messages
from tidemark.operators.forecast import Drift, LastValue
from tidemark.streaming import live, run_buffer
from tidemark.streaming.live import find_periods, live_updates, newest_windows, rebuild, snapshot, snapshot_from_state, update_messages, write_updates

START = pd.Timestamp("2026-01-01")
_n = [0]


def play(spark, tmp_path, messages, per_batch=3, **parameters):
    """Updates of messages (position or time, value), in batches of files."""
    folder = tmp_path / f"in{_n[0]}"
    folder.mkdir()
    for b in range(0, len(messages), per_batch):
        lines = [
            {"point_id": m[2] if len(m) > 2 else "p", "sensor": "t", "timestamp": (START + pd.Timedelta(minutes=10 * m[0])).isoformat() + "Z", "value": m[1], "seq": b + i}
            for i, m in enumerate(messages[b : b + per_batch])
        ]
        file = folder / f"{b:05d}.json"
        file.write_text("\n".join(map(json.dumps, lines)))
        os.utime(file, (10**9 + b, 10**9 + b))  # files are taken in order of their time
    raw = spark.readStream.schema(T.StructType([*READING.fields, T.StructField("seq", T.LongType())])).option("maxFilesPerTrigger", 1).json(str(folder))
    stream = raw.select("point_id", "sensor", F.col("timestamp").cast("timestamp").alias("ts"), "value", "seq")
    name = f"live{_n[0]}"
    _n[0] += 1
    q = live_updates(stream, **{"min_hours": 0.25, "min_context": 3} | parameters).writeStream.format("memory").queryName(name).outputMode("update")
    q = q.option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def rebuilt(table):
    return [(r.seq, r.method, r.confidence, [round(v, 6) for v in r["values"]]) for r in table.filter("type = 'reconstruction'").orderBy("seq", "start_time").collect()]


def at(values):
    return list(enumerate(values))


def test_reconciles_once(spark, tmp_path):
    t = play(spark, tmp_path, at([20, 20.2, 20.4, 20, 20, 20, 20, 21, 21.2, 21.4, 22, 23, 24]))
    got = rebuilt(t)
    assert [g[1] for g in got[-1:]] == ["last-value-bidirectional"] and [g[2] for g in got] == ["PROVISIONAL"] * 2 + ["RECONCILED"]
    assert got[-1][0] == 7  # with the first reading after the period, and never again
    batch = spark.createDataFrame(
        [("p", "t", (START + pd.Timedelta(minutes=10 * i)).to_pydatetime(), float(v)) for i, v in at([20, 20.2, 20.4, 20, 20, 20, 20, 21, 21.2, 21.4, 22, 23, 24])],
        "point_id string, sensor string, ts timestamp, value double",
    )
    same = [round(r.imputed_value, 6) for r in reconstruct.reconstruct_last_value(batch).orderBy("timestamp").collect()]
    assert got[-1][3] == same
    assert newest_windows(t).count() == 1
    messages = [json.loads(r.message) for r in update_messages(t).orderBy("seq").collect()]
    assert sum(m["type"] == "point" for m in messages) == 13
    last = [m for m in messages if m["type"] == "reconstruction"][-1]
    assert last["confidence"] == "RECONCILED" and last["values"][0]["timestamp"] == "2026-01-01T00:30:00+00:00"


def test_gates(spark, tmp_path):
    frozen = at([20, 20.2, 20.4, 20, 20, 20, 20, 20, 20])
    assert rebuilt(play(spark, tmp_path, at([20, 20.5, 21, 21.5, 22]))) == []
    assert {g[2] for g in rebuilt(play(spark, tmp_path, frozen))} == {"PROVISIONAL"}
    assert len(rebuilt(play(spark, tmp_path, frozen, per_batch=9))) == len(rebuilt(play(spark, tmp_path, frozen, per_batch=1))) >= 2
    assert rebuilt(play(spark, tmp_path, frozen, open_ended=False)) == []
    assert rebuilt(play(spark, tmp_path, frozen, min_context=10)) == []


def test_late_repeated_null_and_trimmed(spark, tmp_path):
    late = [(0, 20), (1, 20.2), (2, 20.4), (4, 20), (5, 20), (7, 21), (3, 20)]
    got = rebuilt(play(spark, tmp_path, late))
    assert got and got[-1][0] == 6  # the late reading makes the period long enough
    twice = play(spark, tmp_path, [(0, 1), (0, 2), (1, None)])
    assert [r.value for r in twice.filter("type = 'point'").orderBy("seq").collect()] == [1, 2, None]
    cut = play(spark, tmp_path, at([20, 20.2, 20.4, 20, 20, 20, 20]), max_points=5)
    assert rebuilt(cut) == []  # the context has left the buffer
    two = play(spark, tmp_path, [(0, 1, "a"), (0, 2, "b"), (1, 1, "a")])
    assert two.select("point_id").distinct().count() == 2


def test_feed_parsing(spark, tmp_path):
    raw = spark.createDataFrame([('{"point_id":"p","sensor":"t","timestamp":"2026-01-01T00:00:00+00:00","value":null}',), ("broken",), ('{"point_id":"p","timestamp":"x"}',)], "value string")
    rows = parse_messages(raw).collect()
    assert rows[0].value is None and rows[0].ts is not None and rows[1].point_id is None and rows[2].ts is None
    assert file_messages(spark, str(tmp_path)).isStreaming
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_messages(spark, "localhost:1")


class Picky:
    """Rejects contexts that end with 7, fails on those that end with 8."""

    name, version, context = "picky", "1", 1

    def predict(self, context, steps):
        if context[-1] == 7:
            raise ValueError("not this one")
        if context[-1] == 8:
            raise RuntimeError("broken")
        return [context[-1]] * steps


def test_errors_cost_a_period_or_a_message(spark, tmp_path):
    t = play(spark, tmp_path, at([1, 2, 7, 7, 7, 3, 4, 5, 5, 5, 6]), model=Picky())
    assert {r[0] for r in rebuilt(t)} == {9, 10}  # the first period is skipped at each message, the second is not
    assert t.filter("type = 'point'").count() == 11 and t.filter("type = 'error'").count() == 0
    t = play(spark, tmp_path, at([1, 2, 8, 5, 5, 5, 6, 6.5]), model=Picky())
    failed = {r.seq: r.method for r in t.filter("type = 'error'").collect()}
    assert set(failed) == {5, 6, 7} and "broken" in failed[5]
    assert {r.seq for r in t.filter("type = 'point'").collect()} == {0, 1, 2, 3, 4}
    assert update_messages(t).count() == 5


def test_snapshot_of_a_series(spark, tmp_path):
    t = play(spark, tmp_path, [*at([20, 20.2, 20.4, 20, 20, 20, 20, 21, 21.2]), (3, 19.0), (0, 1.0, "q")])
    readings, windows = snapshot(t, "p", "t", points=5)
    assert [r.value for r in readings.collect()] == [20, 20, 20, 21, 21.2]
    readings, windows = snapshot(t, "p", "t")
    assert [r.value for r in readings.collect()][3] == 19.0 and windows.count() >= 1
    assert all(x.count() == 0 for x in snapshot(t, "nobody", "t"))


def test_batches_done_again_replace_themselves(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    lines = [{"point_id": "p", "sensor": "t", "timestamp": (START + pd.Timedelta(minutes=10 * i)).isoformat() + "Z", "value": float(i)} for i in range(6)]
    (folder / "a.json").write_text("\n".join(map(json.dumps, [*lines, {"point_id": None, "sensor": "t"}])))
    for checkpoint in ("c1", "c2"):  # a lost checkpoint: the same batches are done once more
        write_updates(live_updates(file_messages(spark, str(folder)), min_context=3), str(tmp_path / "out"), str(tmp_path / checkpoint), once=True).awaitTermination()
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == 6 and out.select("seq").distinct().count() == 6


def plain_updates(messages, model, min_hours=0.25, max_points=2000, min_context=3):
    """What each message gives, found anew in the whole buffer each time."""
    held, done, out = {}, set(), []
    for seq, (place, v, *_) in enumerate(messages):
        at = int((START + pd.Timedelta(minutes=10 * place)).value // 1000)
        held[at] = np.nan if v is None else float(v)
        for extra in sorted(held)[: max(0, len(held) - max_points)]:
            del held[extra]
        ts = sorted(held)
        value = np.array([held[t] for t in ts])
        out.append((seq, "point", None, None))
        for first, last in find_periods(np.array(ts), value, min_hours) if len(ts) > 1 else []:
            open_ended = bool(np.isnan(value[last + 1 :]).all())
            if ts[first] in done or (~np.isnan(value[:first])).sum() < min_context or first == 0:
                continue
            try:
                y = rebuild(model, value, first, last, open_ended)
            except ValueError:
                continue
            out.append((seq, f"{model.name}-{'forward-only' if open_ended else 'bidirectional'}", ts[first], [None if np.isnan(x) else round(float(x), 9) for x in y]))
            if not open_ended:
                done.add(ts[first])
    return out


def shuffled(seed, n):
    rng, at, rows = random.Random(seed), 0, []
    while len(rows) < n:
        for v in [rng.choice([None, 1.0, 2.0, 3.0, rng.random()])] * rng.choice([1, 1, 2, 4]):
            at += rng.choice([1, 1, 1, 3])
            rows.append((at, v))
    order = sorted(range(len(rows)), key=lambda i: i + rng.choice([0, 0, 0, 5, 15]))
    late = [rows[i] for i in order]
    return late + [(p, rng.choice([None, 1.0, 9.0])) for p, _ in rng.sample(rows, 12)]


@pytest.mark.parametrize(("seed", "model", "most"), [(1, LastValue(), 2000), (2, Drift(), 2000), (3, LastValue(), 25)])
def test_updates_are_those_of_a_scan_at_each_message(spark, tmp_path, monkeypatch, seed, model, most):
    messages = shuffled(seed, 110)
    t = play(spark, tmp_path, messages, per_batch=13, model=model, max_points=most)
    micros = lambda x: None if x is None else pd.Timestamp(x).value // 1000
    rows = [
        (r.seq, r.method or r.type, micros(r.start_time), None if r["values"] is None else [None if v is None else round(v, 9) for v in r["values"]])
        for r in t.filter("type <> 'error'").collect()
    ]
    want = plain_updates(messages, model, max_points=most)
    assert sorted(rows, key=str) == sorted(want, key=str) and sum(r[1] != "point" for r in want) > 20


@pytest.mark.parametrize("most", [5, 40])
def test_run_index_follows_every_message(monkeypatch, most):
    monkeypatch.setattr(run_buffer, "BLOCK", 4)
    for seed in range(40):
        rng, stored, held = random.Random(seed), {}, {}
        buffer = run_buffer.RunBuffer(stored.__getitem__, most, 600)
        for _ in range(70):
            t, v = rng.randint(0, 60) * 300, rng.choice([None, 1.0, 1.0, 2.0])
            buffer.add(t, v)
            held[t] = np.nan if v is None else v
            for extra in sorted(held)[: max(0, len(held) - most)]:
                del held[extra]
            ts = np.array(sorted(held))
            value = np.array([held[x] for x in ts])
            assert [x for x, _ in buffer.rows()] == ts.tolist()
            assert [buffer.span(x) for x in buffer.pending] == [(ts[a], ts[b]) for a, b in find_periods(ts, value, 600 / 3.6e9) if not buffer.is_done(ts[a])]
            if buffer.pending and rng.random() < 0.2:
                buffer.finish(rng.choice(buffer.pending))
            if rng.random() < 0.3:  # a batch ends: only what changed is stored
                for x in buffer.removed:
                    stored.pop(x, None)
                stored.update({x: run_buffer.Block([*buffer.blocks[x].ts], [*buffer.blocks[x].value], [*buffer.blocks[x].start]) for x in buffer.changed})
                buffer = run_buffer.RunBuffer(stored.__getitem__, most, 600, [dict(h) for h in buffer.header], buffer.pending, buffer.done, buffer.next_id)


def test_work_for_a_message_does_not_grow_with_the_buffer():
    most = {}
    for n in (300, 2000):
        rng = random.Random(1)
        stored = {}
        buffer = run_buffer.RunBuffer(stored.__getitem__, n, 600)
        for t in range(n):
            buffer.add(t * 300, rng.choice([None, 1.0, 1.0, 2.0]))
        for start in list(buffer.pending):
            buffer.finish(start)
        stored.update({i: b for i, b in buffer.blocks.items()})
        work, blocks = [], []
        for t in [*(rng.randrange(n) for _ in range(200)), *range(n, n + 200)]:
            fresh = run_buffer.RunBuffer(stored.__getitem__, n, 600, buffer.header, buffer.pending, buffer.done, buffer.next_id)
            fresh.add(t * 300 + rng.choice([0, 7]), rng.choice([None, 1.0, 2.0]))
            work.append(fresh.work)
            blocks.append(len(fresh.blocks))
            stored.update(fresh.blocks)
            buffer = fresh
        most[n] = max(work)
        assert max(blocks) <= 8
    assert most[2000] <= 12 * run_buffer.BLOCK and most[2000] <= 1.5 * most[300]


def test_snapshot_from_state_is_that_of_the_log(spark, tmp_path):
    messages = [(p, v, f"p{i % 2}") for i, (p, v) in enumerate(shuffled(5, 120))]
    t = play(spark, tmp_path, messages, per_batch=17, max_points=30)
    checkpoint = str(tmp_path / f"clive{_n[0] - 1}")
    for point in ("p0", "p1"):
        readings, windows = snapshot(t, point, "t", points=30)
        again, state_windows = snapshot_from_state(spark, checkpoint, point, "t")
        columns = ["point_id", "sensor", "ts", "value"]
        assert again.select(columns).orderBy("ts").collect() == readings.select(columns).collect()
        columns = ["start_time", "end_time", "seq", "method", "confidence", "times", "values"]
        assert state_windows.select(columns).orderBy("start_time").collect() == windows.select(columns).collect() and windows.count() > 3
    assert snapshot_from_state(spark, checkpoint)[0].select("point_id").distinct().count() == 2
    assert all(x.count() == 0 for x in snapshot_from_state(spark, checkpoint, "nobody", "t"))


class Counted(list):
    """Counts the elements that are looked at."""

    looked = 0

    def __iter__(self):
        for x in super().__iter__():
            self.looked += 1
            yield x

    def __reversed__(self):
        for x in super().__reversed__():
            self.looked += 1
            yield x

    def __getitem__(self, i):
        found = super().__getitem__(i)
        self.looked += len(found) if isinstance(i, slice) else 1
        return found


@pytest.mark.parametrize("most", [10**6, 500])
def test_a_message_looks_at_as_few_blocks_in_a_long_series(monkeypatch, most):
    monkeypatch.setattr(run_buffer, "BLOCK", 4)
    looked = {}
    for n in (500, 5000):
        rng, header = random.Random(1), Counted()
        buffer = run_buffer.RunBuffer({}.__getitem__, most, 600, header)
        for t in range(n):
            buffer.add(t * 300, rng.choice([None, 1.0, 1.0, 2.0]))
            for start in list(buffer.pending)[:-1]:
                buffer.finish(start)
        before = header.looked
        for t in range(n, n + 200):
            buffer.add(t * 300, rng.choice([None, 1.0, 2.0]))
            buffer.add((t - n // 4) * 300 + 7, rng.choice([None, 1.0, 2.0]))  # a late one
        looked[n] = header.looked - before
    assert looked[5000] <= 1.5 * looked[500] + 400


class State:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = tuple(list(x) if isinstance(x, list) else x for x in value)


class MapState(dict):
    """Values of one key; what is put in is copied, as by a real one."""

    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.__delitem__

    def updateValue(self, key, value):
        self[key] = tuple(list(x) if isinstance(x, list) else x for x in value)


@pytest.mark.parametrize("most", [40, 2000])
def test_updates_of_a_large_batch_leave_in_small_frames(monkeypatch, most):
    messages = pd.DataFrame([(seq, p * 600_000_000, np.nan if v is None else v) for seq, (p, v) in enumerate(shuffled(6, 700))], columns=["seq", "ts", "value"])
    got = []
    for size in (10**6, 50):
        monkeypatch.setattr(live, "MESSAGES", size, raising=False)
        r = live.Repair(LastValue(), min_context=3, max_points=most)
        r.index, r.blocks, r.windows = State(), MapState(), MapState()
        frames = []
        for some in (messages[:300], messages[300:]):
            frames += list(r.handleInputRows(("p", "t"), iter(some[i : i + 90] for i in range(0, len(some), 90)), None))
        assert size > 50 or len(frames) >= len(messages) // 50 and all((x["type"] == "point").sum() <= 50 for x in frames)
        rows = sorted((t, v) for b in r.blocks.values() for t, v in zip(b[0], b[1], strict=True))
        got.append((pd.concat(frames).astype(object).to_csv(), rows and str(rows), sorted(map(str, r.windows.items()))))
    drop = lambda text: [line.split(",", 1)[1] for line in text.splitlines()]
    assert drop(got[0][0]) == drop(got[1][0]) and got[0][1:] == got[1][1:]
    assert len(drop(got[0][0])) > len(messages) + 100


def test_all_newest_windows_without_a_limit(spark):
    rows = [("reconstruction", "p", "t", seq, START.to_pydatetime() + pd.Timedelta(hours=i), f"m{seq}") for i in range(300) for seq in (1, 2)]
    t = spark.createDataFrame(rows, "type string, point_id string, sensor string, seq long, start_time timestamp, method string")
    got = newest_windows(t, None)
    assert got.count() == 300 and {r.method for r in got.collect()} == {"m2"} and newest_windows(t).count() == 200
