"""The API as a data source: slices, pushed filters, retries in tasks, and the polled stream."""

from __future__ import annotations

import json
import threading
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from tidemark.plans import served
from tidemark.plans.batch import run_job, run_source_job
from tidemark.plans.queries import feed, nested_payload
from tidemark.sources import api

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def answers(spark, sf, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('answers')}/a"
    served.write_answers(nested_payload(feed(spark, sf), "day"), path)
    return path


class Seen:
    """Counts requests by slice, and fails the first ones of some."""

    def __init__(self, failing=lambda v: 0):
        self.count, self.failing, self.lock = Counter(), failing, threading.Lock()

    def __call__(self, variables):
        key = (variables["equipment"], tuple(variables["attributes"] or ()), variables["start"])
        with self.lock:
            self.count[key] += 1
            return "flaky" if self.count[key] <= self.failing(variables) else None


def expected(spark, sf, where="true"):
    rows = feed(spark, sf).filter(where).select("point_id", "sensor", F.col("ts").cast("timestamp").alias("ts"), "value")
    return Counter((r.point_id, r.sensor, r.ts, r.value) for r in rows.collect())


def got(rows):
    return Counter((r.equipment_id, r.attribute, r.ts, r.value) for r in rows.collect())


OPTIONS = {"equipment": "dev-0,dev-1,dev-2", "attributes": "cart,click,error,purchase,signup,view", "slice_hours": 240, "token_variable": "", "backoff": 0.01}


def test_one_request_for_each_slice_and_a_failing_one_again(spark, sf, answers):
    bad = lambda v: 2 if v["equipment"] == "dev-1" and v["attributes"] == ["view"] and v["start"].startswith("2024-01-08") else 0
    seen = Seen(bad)
    with served.served(spark, answers, seen) as url:
        rows = api.read_api(spark, url, "plant", "2024-01-01", "2024-01-31", **OPTIONS)
        assert rows.rdd.getNumPartitions() == 3 * 6 * 4  # days 1 to 31 reach into four slices of ten days
        seen.count.clear()
        assert got(rows) == expected(spark, sf)
    assert len(seen.count) == 72 and Counter(seen.count.values()) == {1: 71, 3: 1}
    assert max(seen.count, key=seen.count.get) == ("dev-1", ("view",), "2024-01-08T00:00:00+00:00")


def test_filters_reach_the_requests(spark, sf, answers):
    seen = Seen()
    with served.served(spark, answers, seen) as url:
        rows = api.read_api(spark, url, "plant", "2024-01-01", "2024-01-31", **OPTIONS)
        some = rows.filter("equipment_id = 'dev-2' AND attribute IN ('cart', 'view') AND ts > timestamp'2024-01-05 12:00:00' AND ts <= timestamp'2024-01-06 12:00:00'")
        assert got(some) == expected(spark, sf, "point_id = 'dev-2' AND sensor IN ('cart', 'view') AND ts > '2024-01-05 12:00:00' AND ts <= '2024-01-06 12:00:00'")
    assert {k[:2] for k in seen.count} == {("dev-2", ("cart",)), ("dev-2", ("view",))} and all("2024-01-05T12:00:00.000001+00:00" <= k[2] < "2024-01-06T12:00:00.000001" for k in seen.count)
    reader = api.ApiReader({"url": "u", "alias": "a", "start": "2024-01-01", "end": "2024-02-01", "slice_hours": "24"})
    at = datetime(2024, 1, 3, tzinfo=timezone.utc)
    kept = list(reader.pushFilters([GreaterThan(("ts",), at), LessThanOrEqual(("ts",), at.replace(hour=5)), In(("attribute",), ("x", "y")), EqualTo(("value",), 1.0)]))
    assert len(kept) == 4 and [(p.attribute, p.end - p.start) for p in reader.partitions()] == [("x", 5 * HOUR), ("y", 5 * HOUR)]


def test_last_failure_is_raised_and_errors_are_checked(spark, answers):
    with served.served(spark, answers, Seen(lambda v: 99)) as url:
        with pytest.raises(Exception, match="flaky"):
            api.read_api(spark, url, "plant", "2024-01-01", "2024-01-02", retries=2, **{**OPTIONS, "attributes": "view"}).collect()
    with pytest.raises(Exception, match="API token"):
        api.read_api(spark, "http://127.0.0.1:9", "plant", "2024-01-01", "2024-01-02", token_variable="NO_SUCH_TOKEN").collect()
    with pytest.raises(ValueError, match="positive"):
        api.Settings({"url": "u", "alias": "a", "start": "2024-01-01", "slice_hours": "0"})
    s = api.Settings({"url": "u", "alias": "a", "start": "2024-01-01"})
    answer = {"projects": [{"alias": "a", "equipment": [{"id": "e", "type": "t", "points": [{"id": "p", "type": "s", "attribute": "x", "series": [
        {"timestamp": "2024-01-01T00:00:00Z", "value": None}, {"timestamp": "2024-01-01T01:00:00+01:00", "value": float("nan")}, {"timestamp": "2024-01-02T00:00:00", "value": 1}
    ]}, {"id": "q", "type": "s", "attribute": "x", "series": []}]}]}]}
    (batch,) = s.fetch(api.Slice(None, None, s.start, s.start + 24 * HOUR), lambda v: json.dumps(answer))
    assert batch.num_rows == 2 and batch.column("value").null_count == 2  # what begins the next slice isn't this one's
    (none,) = s.fetch(api.Slice(None, None, s.start, s.start + 1), lambda v: "{}")
    assert none.num_rows == 0


def test_polled_stream_goes_on_where_it_stopped(spark, sf, answers, tmp_path):
    seen, out, state = Seen(), f"file://{tmp_path}/out", f"file://{tmp_path}/state"

    def poll(url, until):
        rows = api.stream_api(spark, url, "plant", "2024-01-01", end=until, **{**OPTIONS, "attributes": "click,view"})
        q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out)

    where = "sensor IN ('click', 'view') AND ts < '{}'"
    with served.served(spark, answers, seen) as url:
        first = poll(url, "2024-01-05")
        assert got(first) == expected(spark, sf, where.format("2024-01-05"))
        asked = set(seen.count)
        for until in ("2024-01-13 07:00:00", "2024-01-13 07:00:00", "2024-01-31"):
            assert got(poll(url, until)) == expected(spark, sf, where.format(until))
    assert asked < set(seen.count) and set(seen.count.values()) == {1}  # nothing was asked for twice


def test_offsets_and_slices():
    stream = api.ApiStream({"url": "u", "alias": "a", "start": "2024-01-01", "end": "2024-01-10", "attributes": "x,y", "most_hours": "48", "slice_hours": "24"})
    start = stream.initialOffset()
    first = stream.latestOffset()
    assert {v - start[k] for k, v in first.items()} == {48 * HOUR}
    assert len(stream.partitions(start, first)) == 4
    stream.commit(first)
    # A series that is new in the options begins at the start, the others go on.
    more = api.ApiStream({"url": "u", "alias": "a", "start": "2024-01-01", "end": "2024-01-04", "attributes": "x,z", "slice_hours": "24"})
    parts = more.partitions(first, more.latestOffset())
    assert Counter(p.attribute for p in parts) == {"x": 1, "z": 3}


def test_job_over_the_source_requests_each_slice_once(spark, sf, answers, tmp_path):
    seen = Seen()
    with served.served(spark, answers, seen) as url:
        source = {**OPTIONS, "attributes": "click,view"}
        counts = run_source_job(spark, url, "plant", str(tmp_path / "out"), now=datetime(2024, 1, 31, tzinfo=timezone.utc), source=source)
        got_counts = {(r.point_id, r.sensor): r.n for r in counts.collect()}
    assert set(seen.count.values()) == {1}
    written = Counter((r.point_id, r.sensor) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert len(got_counts) == 6 and {k: n for k, n in got_counts.items() if n} == written


def test_counts_are_taken_while_rows_are_written(spark, sf, tmp_path):
    readings = feed(spark, sf).select("point_id", "sensor", F.col("ts").cast("timestamp").alias("ts"), "value")
    series = [(r.point_id, r.sensor) for r in readings.select("point_id", "sensor").distinct().collect()]
    jobs = {}
    for name, given in (("observed", series), ("counted", None)):
        spark.sparkContext.setJobGroup(name, name)
        counts = run_job(readings, str(tmp_path / name), series=given)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        result = {(r.point_id, r.sensor): r.n for r in counts.collect()}
        assert result == Counter((r.point_id, r.sensor) for r in spark.read.json(str(tmp_path / name)).collect())
        if name == "observed":
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) <= jobs[name] + 4  # reading the counts back runs no plan over the readings
    spark.sparkContext.setJobGroup("", "")
    assert jobs["observed"] <= jobs["counted"]
    with pytest.raises(ValueError, match="not named"):
        run_job(readings, str(tmp_path / "x"), series=series[:2])
