"""Sources of readings: ``point_id, sensor, ts, value`` with null for "no reading"."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Sequence
from typing import Any
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import attribute, clean

READING = T.StructType(
    [T.StructField("point_id", T.StringType()), T.StructField("sensor", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("value", T.DoubleType())]
)
#: Nested answer of the remote API.
PAYLOAD = "struct<projects:array<struct<id:string,alias:string,equipment:array<struct<id:string,type:string,points:array<struct<id:string,type:string,attribute:string,series:array<struct<timestamp:string,value:double>>>>>>>>>"


def read_wide_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, time_column: str = "timestamp", point_id: str | None = None) -> DataFrame:
    """A wide export, one column for each sensor, as readings.

    The header gives the schema, so no pass is spent on inference; with ``columns`` the CSV
    reader parses only those. Times without a zone are UTC.
    """
    header = spark.read.option("header", True).csv(path).columns
    chosen = list(columns) if columns is not None else [c for c in header if c != time_column]
    missing = [c for c in chosen if c not in header]
    if missing:
        raise ValueError(f"no column {missing[0]!r}; available: {', '.join(header)}")
    schema = T.StructType([T.StructField(c, T.StringType() if c == time_column else T.DoubleType()) for c in header])
    wide = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path).select(time_column, *(f"`{c}`" for c in chosen))
    return unpivot(wide, chosen, time_column, point_id)


def unpivot(wide: DataFrame, columns: Sequence[str], time_column: str = "timestamp", point_id: str | None = None) -> DataFrame:
    long = wide.unpivot([time_column], [f"`{c}`" for c in columns], "column", "value")
    name = F.lit(point_id) if point_id is not None else F.element_at(F.split("column", "__"), 1)
    return long.select(name.alias("point_id"), attribute(F.col("column")).alias("sensor"), F.col(time_column).cast("timestamp").alias("ts"), clean(F.col("value").cast("double")).alias("value"))


def matching_columns(spark: SparkSession, path: str, keywords: Sequence[str], time_column: str = "timestamp") -> list[str]:
    """Columns of a wide export whose attribute contains a keyword, in header order."""
    header = spark.read.option("header", True).csv(path).columns
    return [c for c in header if c != time_column and any(k.lower() in c.split("__")[-1].lower() for k in keywords)]


def flatten_payload(payload: DataFrame) -> DataFrame:
    """Readings with their dimensions from the API's nested answer; points without a series are left out."""
    p = payload.select(F.explode("projects").alias("p")).select(F.col("p.alias").alias("alias"), F.explode("p.equipment").alias("e"))
    p = p.select("alias", F.col("e.id").alias("equipment_id"), F.col("e.type").alias("equipment_type"), F.explode("e.points").alias("q"))
    p = p.filter(F.size("q.series") > 0).select(
        "alias", "equipment_id", "equipment_type", F.col("q.id").alias("point_id"), F.col("q.type").alias("point_type"), F.col("q.attribute").alias("attribute"), F.explode("q.series").alias("s")
    )
    return p.select(
        "alias", "equipment_id", "equipment_type", "point_id", "point_type", "attribute", F.col("attribute").alias("sensor"),
        F.col("s.timestamp").cast("timestamp").alias("ts"), clean(F.col("s.value")).alias("value"),
    )


def fetch_payload(
    spark: SparkSession, execute: Callable[[dict[str, Any]], str], variables: dict[str, Any], retries: int = 3, backoff: float = 2.0,
    retry_on: type[Exception] = ConnectionError, sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """One request (``execute`` gives the JSON answer), tried again on ``retry_on``, as readings."""
    for attempt in range(1, retries + 1):
        try:
            text = execute(variables)
            break
        except retry_on:
            if attempt == retries:
                raise
            sleep(backoff)
    frame = spark.createDataFrame([(text,)], "body string").select(F.from_json("body", PAYLOAD).alias("b")).select("b.*")
    return flatten_payload(frame)


#: The request for the nested answer of the remote API.
REQUEST = """query Readings($alias: String!, $attributes: [String!], $start: String, $end: String) {
  projects(alias: $alias) { id alias equipment { id type points(attributes: $attributes) { id type attribute series(start: $start, end: $end) { timestamp value } } } }
}"""


def http_client(url: str, token: str | None = None, request: str = REQUEST, timeout: float = 60.0) -> Callable[[dict[str, Any]], str]:
    """``execute`` for :func:`fetch_payload`: posts the request and gives the answer's data as JSON; connection errors are tried again there."""

    def execute(variables: dict[str, Any]) -> str:
        body = json.dumps({"query": request, "variables": variables}).encode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {api_token(token)}"}
        try:
            with urlopen(Request(url, body, headers), timeout=timeout) as answer:
                got = json.loads(answer.read())
        except HTTPError:
            raise
        except (URLError, TimeoutError) as e:
            raise ConnectionError(str(e)) from e
        if got.get("errors"):
            raise RuntimeError(f"the API rejected the request: {got['errors']}")
        return json.dumps(got.get("data") or {})

    return execute


def api_token(token: str | None = None, variable: str = "READINGS_API_TOKEN") -> str:
    """The token given, or that of the environment; it never becomes part of a plan."""
    found = token or os.environ.get(variable)
    if not found:
        raise ValueError(f"no API token: pass one or set {variable}")
    return found


def recent(readings: DataFrame, now: Column, days_back: int = 30) -> DataFrame:
    """Readings of the ``days_back`` days up to ``now``."""
    return readings.filter((F.col("ts") >= now - F.make_dt_interval(F.lit(days_back))) & (F.col("ts") <= now))


def resample(readings: DataFrame, every: str = "10 minutes", fn: str = "mean") -> DataFrame:
    """One value for each bucket of time that has readings."""
    agg = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[fn]("value").cast("double")
    return readings.groupBy("point_id", "sensor", F.window("ts", every).alias("w")).agg(agg.alias("value")).select("point_id", "sensor", F.col("w.start").alias("ts"), "value")


def on_grid(readings: DataFrame, every: str = "10 minutes", fn: str = "mean") -> DataFrame:
    """:func:`resample` on a regular grid from each series' first bucket to its last; buckets without readings are null.

    A series' grid is made in ranges of buckets, so that no row holds all of a long one.
    """
    found = resample(readings, every, fn)
    ends = found.groupBy("point_id", "sensor").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    days = ends.select("point_id", "sensor", "first", "last", F.explode(F.sequence(F.date_trunc("day", "first"), F.date_trunc("day", "last"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    # Of each day the part of the grid that lies in it; the grid begins at the first bucket.
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    size = F.expr(f"CAST((unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {every})) AS BIGINT)")
    begin = micros("first") + F.ceil(F.greatest(micros("day") - micros("first"), F.lit(0)) / size) * size
    end = F.least(micros("last"), micros("day") + 86_400_000_000 - 1)
    at = days.withColumns({"a": begin, "z": end, "size": size}).filter("a <= z").select("point_id", "sensor", F.explode(F.sequence("a", "z", "size")).alias("us"))
    kind = found.schema["ts"].dataType
    grid = at.select("point_id", "sensor", F.timestamp_micros("us").cast(kind).alias("ts"))
    key = [grid[c].eqNullSafe(found[c]) for c in ("point_id", "sensor")] + [grid["ts"] == found["ts"]]
    return grid.join(found, key, "left").select(*(grid[c] for c in ("point_id", "sensor", "ts")), "value")


def distinct_times(readings: DataFrame, arrival: str) -> DataFrame:
    """One reading for each point, sensor and time: the one that arrived last."""
    others = [c for c in readings.columns if c not in ("point_id", "sensor", "ts", arrival)]
    kept = readings.groupBy("point_id", "sensor", "ts").agg(F.max_by(F.struct(*others), arrival).alias("r"))
    return kept.select("point_id", "sensor", "ts", *(F.col(f"r.{c}").alias(c) for c in others))


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages of the feed as readings, with partition and offset where they have any; malformed ones have no point or time."""
    m = raw.withColumn("m", F.from_json(F.col(column).cast("string"), READING))
    order = [F.col(c) for c in ("partition", "offset") if c in raw.columns]
    return m.select(F.col("m.point_id").alias("point_id"), F.col("m.sensor").alias("sensor"), F.try_to_timestamp("m.timestamp").alias("ts"), clean(F.col("m.value")).alias("value"), *order)


def kafka_messages(spark: SparkSession, servers: str, topic: str = "sensor-readings", starting: str = "latest", max_per_trigger: int | None = None) -> DataFrame:
    """The feed from Kafka as a stream; needs Spark's Kafka connector on the class path.

    ``seq`` is the offset: messages of a point share its key and so a partition, whose order is that of arrival.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return well_formed(parse_messages(reader.load()).withColumnRenamed("offset", "seq").drop("partition"))


def well_formed(messages: DataFrame) -> DataFrame:
    return messages.filter("point_id IS NOT NULL AND ts IS NOT NULL")


def kafka_range(spark: SparkSession, servers: str, topic: str = "sensor-readings", most: int | None = None) -> DataFrame:
    """What the topic holds now, as a table; with ``most`` the messages that arrived first."""
    raw = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    messages = well_formed(parse_messages(first_messages(raw, most, "timestamp", "partition", "offset") if most is not None else raw))
    return messages.withColumnRenamed("offset", "seq").drop("partition")


def first_messages(messages: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` messages by ``order``; each task keeps no more than that."""
    return messages.orderBy(*order).limit(most)


def file_messages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The feed from a folder of JSON files as a stream; with numbered files a replay is paced by trigger.

    Messages may carry ``seq``; a folder has no offsets, so without it a message counts by its time.
    """
    schema = T.StructType([*READING.fields, T.StructField("seq", T.LongType())])
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    ts = F.try_to_timestamp("timestamp")
    return well_formed(raw.select("point_id", "sensor", ts.alias("ts"), clean(F.col("value")).alias("value"), F.coalesce("seq", F.unix_micros(ts)).alias("seq")))
