"""The replay in real time."""

from __future__ import annotations

import time
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.streaming.paced import SLICE, release, replay_in_time, schedule, write_schedule

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "point_id string, sensor string, ts timestamp, value double"


def table(spark):
    rows = [("p", "a", START + timedelta(minutes=10 * i), float(i)) for i in range(6)] + [("q", None, START + timedelta(hours=5, minutes=4 * i), None) for i in range(4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_schedule(spark):
    got = schedule(table(spark), speed=600, loops=2, now="2026-05-01 00:00:00").orderBy("point_id", "due").collect()
    p = [(r.loop, r.due, r.replay_ts) for r in got if r.point_id == "p"]
    assert [d for _, d, _ in p] == [float(i) for i in range(12)] and [x for x, _, _ in p] == [0] * 6 + [1] * 6
    assert p[-1][2].replace(tzinfo=timezone.utc) == datetime(2026, 5, 1, 1, 50, tzinfo=timezone.utc)
    assert [r.due for r in got if r.point_id == "q"] == pytest.approx([0.4 * i for i in range(8)])
    assert schedule(table(spark).limit(0)).count() == 0
    with pytest.raises(ValueError, match="positive"):
        schedule(table(spark), speed=0)


def test_readings_come_when_they_are_due_and_once(spark, tmp_path):
    began, seen = time.time(), []

    def send(rows, number):
        for r in rows.collect():
            seen.append((r.point_id, r.value, r.due, time.time() - began, number))

    took = replay_in_time(spark, table(spark), send, f"file://{tmp_path}/r", speed=600)
    assert Counter((p, v) for p, v, *_ in seen) == Counter([("p", float(i)) for i in range(6)] + [("q", None)] * 4)
    assert took >= 4.5 and all(at >= due for _, _, due, at, _ in seen)
    assert [d for _, _, d, _, _ in seen] == sorted(d for _, _, d, _, _ in seen)
    assert len({n for *_, n in seen}) > 1


def test_a_replay_that_was_broken_off_goes_on(spark, tmp_path):
    path, batches = f"file://{tmp_path}/s", {}
    assert write_schedule(schedule(table(spark), speed=600), path) == 5.0
    # A batch that was not committed is done again under its number.
    send = lambda rows, number: batches.update({number: [(r.point_id, r.due) for r in rows.collect()]})
    for _ in range(30):
        q = release(spark, path, send, f"file://{tmp_path}/c")
        time.sleep(2.5)
        q.stop()
        seen = Counter(x for rows in batches.values() for x in rows)
        if sum(seen.values()) >= 10:
            break
    assert set(seen.values()) == {1} and len(seen) == 10
    assert SLICE > 5
