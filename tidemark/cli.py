"""Command line: ``python -m tidemark.cli offline|offline-live|simulate|live|columns``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.buffers import replay
from .plans.batch import run_csv_job, run_source_job
from .sources import sinks
from .sources.readings import file_messages, kafka_messages, matching_columns, read_wide_csv
from .streaming.live import live_updates, write_updates
from .streaming.paced import replay_in_time


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    jobs = parser.add_subparsers(dest="job", required=True)
    offline = jobs.add_parser("offline", help="repair columns of a wide export")
    offline.add_argument("--csv", required=True)
    offline.add_argument("--column", required=True, help="comma-separated")
    offline.add_argument("--point-id", required=True)
    offline.add_argument("--out", required=True)
    offline.add_argument("--min-stuck-hours", type=float, default=0.25)
    offline.add_argument("--backend", default="local_jsonl")
    api = jobs.add_parser("offline-live", help="repair the newest readings of the remote API")
    api.add_argument("--url", required=True)
    api.add_argument("--alias", required=True)
    api.add_argument("--attribute", required=True, help="comma-separated")
    api.add_argument("--equipment", default="", help="comma-separated; all if empty")
    api.add_argument("--slice-hours", type=float, default=24.0, help="time that one request covers")
    api.add_argument("--days-back", type=int, default=30)
    api.add_argument("--out", required=True)
    api.add_argument("--min-stuck-hours", type=float, default=0.25)
    api.add_argument("--backend", default="local_jsonl")
    simulate = jobs.add_parser("simulate", help="messages of a replay as JSON files, or to Kafka")
    simulate.add_argument("--csv", required=True)
    simulate.add_argument("--column", required=True)
    simulate.add_argument("--point-id", required=True)
    simulate.add_argument("--speed", type=float, default=60.0)
    simulate.add_argument("--loops", type=int, default=1)
    simulate.add_argument("--out", help="folder of JSON files")
    simulate.add_argument("--paced", help="folder that driver and executors share: messages come when they are due, and a replay that was broken off goes on")
    simulate.add_argument("--kafka", help="bootstrap servers")
    live = jobs.add_parser("live", help="repair a feed")
    live.add_argument("--in", dest="source", help="folder of JSON files")
    live.add_argument("--kafka", help="bootstrap servers")
    live.add_argument("--out", required=True)
    live.add_argument("--checkpoint", required=True)
    columns = jobs.add_parser("columns", help="columns of a wide export by keyword")
    columns.add_argument("--csv", required=True)
    columns.add_argument("--keywords", required=True)
    a = parser.parse_args(argv)

    names = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "offline":
        run_csv_job(spark, a.csv, names(a.column), a.point_id, a.out, backend=a.backend, min_hours=a.min_stuck_hours).show(truncate=False)
    elif a.job == "offline-live":
        source = {"attributes": a.attribute, "equipment": a.equipment, "slice_hours": a.slice_hours}
        run_source_job(spark, a.url, a.alias, a.out, a.days_back, source=source, backend=a.backend, min_hours=a.min_stuck_hours).show(truncate=False)
    elif a.job == "simulate":
        readings = read_wide_csv(spark, a.csv, names(a.column), point_id=a.point_id)
        if a.paced:

            def send(rows: DataFrame, number: int) -> None:
                if a.kafka:
                    sinks.write_kafka(rows, a.kafka)
                else:
                    rows.select("point_id", "sensor", F.col("ts").cast("string").alias("timestamp"), "value").write.mode("overwrite").json(f"{a.out}/batch={number}")

            replay_in_time(spark, readings, send, a.paced, a.speed, a.loops)
        elif a.kafka:
            sinks.write_kafka(replay(readings, a.speed, loops=a.loops), a.kafka)
        else:
            readings = replay(readings, a.speed, loops=a.loops)
            readings.repartitionByRange("ts").sortWithinPartitions("ts").select("point_id", "sensor", F.col("ts").cast("string").alias("timestamp"), "value").write.mode("append").json(a.out)
    elif a.job == "live":
        messages = kafka_messages(spark, a.kafka, starting="earliest") if a.kafka else file_messages(spark, a.source)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        write_updates(live_updates(messages), a.out, a.checkpoint).awaitTermination()
    else:
        print("\n".join(matching_columns(spark, a.csv, names(a.keywords))))


if __name__ == "__main__":
    main()
