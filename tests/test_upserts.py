"""The latest-wins table and the watchdog."""

from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest

from tidemark.sources.sinks import latest
from tidemark.sources.upserts import LatestTable, files, upsert_stream
from tidemark.streaming.watchdog import Watchdog, read_progress, watched

SCHEMA = "point_id string, sensor string, timestamp timestamp, raw_value double, imputed_value double, imputation_method string, imputation_confidence string, imputation_model_version string, write_seq int"


def batch(rng, seq, days, n=30):
    at = lambda: datetime(2026, 1, rng.choice(days), rng.randrange(3), tzinfo=timezone.utc)
    rows = {}
    for _ in range(n):
        key = (rng.choice(["p", "q", None]), rng.choice("ab"), at())
        rows[key] = (*key, None, rng.random(), "m", rng.choice(["RECONCILED", "PROVISIONAL"]), "1", seq)
    return list(rows.values())


def content(df):
    return Counter(map(tuple, df.select([c.split()[0] for c in SCHEMA.split(", ")]).collect()))


def test_batches_in_any_order_give_the_latest(spark, tmp_path):
    rng = random.Random(1)
    batches = {i: batch(rng, i, [1, 2, 3]) for i in range(1, 6)}
    want = content(latest(spark.createDataFrame([r for b in batches.values() for r in b], SCHEMA)))
    for order in ([1, 2, 3, 4, 5], [5, 3, 3, 1, 4, 2, 5, 1]):
        table = LatestTable(spark, f"file://{tmp_path}/t{len(order)}", buckets=3)
        done = [table.upsert(spark.createDataFrame(batches[i], SCHEMA), i) for i in order]
        assert sum(done) == 5 and content(table.read()) == want
        assert table.vacuum() > 0 and content(table.read()) == want and table.vacuum() == 0
    with pytest.raises(ValueError, match="no table with rows"):
        LatestTable(spark, f"file://{tmp_path}/none").read()


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    rng = random.Random(2)
    table = LatestTable(spark, f"file://{tmp_path}/t", buckets=2)
    table.upsert(spark.createDataFrame([], SCHEMA), "empty")
    table.upsert(spark.createDataFrame(batch(rng, 1, [1, 2, 3, 4]), SCHEMA), "a")
    before = files(table)
    table.upsert(spark.createDataFrame(batch(rng, 2, [2], 5), SCHEMA), "b")
    after = files(table)
    assert {f for f in before if "day=2026-01-02" not in f} == {f for f in after if "day=2026-01-02" not in f}
    assert {f for f in after - before if "day=2026-01-02" not in f} == set() and after - before
    table.upsert(spark.createDataFrame([], SCHEMA), "c")
    assert files(table) == after and table.batches() == {"empty", "a", "b", "c"}


def test_a_batch_that_fails_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    table = LatestTable(spark, f"file://{tmp_path}/t", buckets=2)
    first, second = (spark.createDataFrame(batch(rng, i, [1, 2]), SCHEMA) for i in (1, 2))
    table.upsert(first, 1)
    before = content(table.read())
    # What a crash leaves behind: data of a version, and a manifest that isn't complete.
    second.withColumns({"day": second.timestamp.cast("date"), "bucket": second.write_seq}).write.partitionBy("day", "bucket").parquet(f"file://{tmp_path}/t/data/version=vlost")
    (tmp_path / "t" / "manifest" / "00000001-2").mkdir()
    assert content(table.read()) == before and table.batches() == {"1"}
    assert table.upsert(second, 2) and content(table.read()) == content(latest(first.unionByName(second)))


def test_stream_into_the_table(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(3):
        rows.append(batch(rng, i, [1, 2]))
        spark.createDataFrame(rows[-1], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    table = LatestTable(spark, f"file://{tmp_path}/t", buckets=2)
    for n in (1, 2):  # the second time with a lost checkpoint
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
        upsert_stream(stream, table, f"file://{tmp_path}/c{n}", once=True).awaitTermination()
        assert content(table.read()) == content(latest(spark.createDataFrame([r for b in rows for r in b], SCHEMA)))


def progress(rows, newest=None, batch=1):
    p = SimpleNamespace(id="1", name="feed", batchId=batch, numInputRows=rows, processedRowsPerSecond=2.0, durationMs={"triggerExecution": 1500}, eventTime={"max": newest} if newest else {})
    return SimpleNamespace(progress=p)


def test_silence_is_told_once(spark, tmp_path):
    now, told = [1000.0], []
    dog = Watchdog(lambda *x: told.append(x), clock=lambda: now[0])
    dog.onQueryStarted(SimpleNamespace(id="1", name="feed"))
    for at, event in ((1010, progress(5, "1970-01-01T00:16:00.000Z")), (1035, progress(0)), (1041, progress(0)), (1060, progress(0))):
        now[0] = at
        dog.onQueryProgress(event)
    assert told == [("feed", 31.0)]
    now[0] = 1061
    dog.onQueryProgress(progress(1))
    now[0] = 1092
    dog.onQueryIdle(SimpleNamespace(id="1"))
    assert told[1:] == [("feed", 31.0)] and dog.check() == []
    dog.onQueryTerminated(SimpleNamespace(id="1", exception=None))
    now[0] = 5000
    assert dog.check() == []
    rows = dog.progress(spark).collect()
    assert [r.kind for r in rows] == ["started", "progress", "progress", "progress", "silent", "progress", "progress", "silent", "ended"]
    assert rows[1].lag_seconds == 50.0 and rows[1].batch_seconds == 1.5
    dog.flush(spark, f"file://{tmp_path}/p")
    dog.flush(spark, f"file://{tmp_path}/p")
    assert read_progress(spark, f"file://{tmp_path}/p").count() == 9 and dog.progress(spark).count() == 0


def test_a_stalled_folder_raises_an_alert(spark, tmp_path):
    told = []
    dog = watched(spark, lambda *x: told.append(x), silence=2.0)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"file://{tmp_path}/in/a")
    stream = spark.readStream.schema("x int").option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    q = stream.writeStream.format("noop").queryName("stalled").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while not told and time.time() < until:
            time.sleep(0.2)
        assert [n for n, _ in told] == ["stalled"] and told[0][1] >= 2.0
        spark.createDataFrame([(2,)], "x int").write.parquet(f"file://{tmp_path}/in/b")
        while len(told) < 2 and time.time() < until:
            time.sleep(0.2)
        assert len(told) == 2  # rows came and went once more
    finally:
        q.stop()
        spark.streams.removeListener(dog)
        dog.stop()
    assert dog.progress(spark).filter("kind = 'progress' AND rows > 0").count() == 2


def test_a_long_history_in_wide_partitions(spark, tmp_path):
    at = lambda i: datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(days=i)
    rows = [[("p", s, at(i), None, float(i + seq), "m", "RECONCILED", "1", seq) for i in range(0, 1500, 7) for s in "ab"] for seq in (1, 2)]
    table = LatestTable(spark, f"file://{tmp_path}/t", buckets=1, days=300)
    first, second = (spark.createDataFrame(r, SCHEMA).coalesce(1) for r in rows)
    table.upsert(first, 1)
    assert len(files(table)) <= 2 * 6 and content(table.read()) == content(first)
    table.upsert(second.filter("timestamp < '2021-01-01'"), 2)
    table.upsert(second, 3)
    assert len(files(table)) <= 2 * 6 and content(table.read()) == content(second)
    # Nothing of versions that no partition is in is looked at.
    (tmp_path / "t" / "data" / "version=vlost" / "other=1").mkdir(parents=True)
    (tmp_path / "t" / "data" / "version=vlost" / "other=1" / "x.parquet").write_text("broken")
    assert content(table.read()) == content(second) and table.vacuum() > 0 and content(table.read()) == content(second)
