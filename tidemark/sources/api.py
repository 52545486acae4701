"""The remote API as a data source: one partition, and so one request in a task, for each piece of equipment, attribute and slice of time.

Filters on time, equipment and attribute are pushed down: slices outside them are never asked
for. A request that fails is tried again in its task, alone. As a stream, the source keeps
the time up to which each piece of equipment and attribute has been read; a query that starts again from
its checkpoint goes on there. The token is read from the environment of the task and never
becomes part of a plan.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.ship import by_value, ship
from .readings import api_token, http_client

FORMAT = "readings_api"
SCHEMA = "alias string, equipment_id string, equipment_type string, point_id string, point_type string, attribute string, ts timestamp, value double"
#: The request for one piece of equipment (null: all) and one attribute (null: all) in one slice of time.
REQUEST = """query Slice($alias: String!, $equipment: String, $attributes: [String!], $start: String!, $end: String!, $every: String, $fn: String) {
  projects(alias: $alias) { id alias equipment(id: $equipment) { id type points(attributes: $attributes) {
    id type attribute series(start: $start, end: $end, every: $every, fn: $fn) { timestamp value } } } }
}"""
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(moment: datetime | str) -> int:
    """Microseconds since 1970; times without a zone are UTC."""
    at = datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    return (at.replace(tzinfo=at.tzinfo or timezone.utc) - EPOCH) // timedelta(microseconds=1)


def moment(us: int) -> str:
    return (EPOCH + timedelta(microseconds=us)).isoformat()


@dataclass
class Slice(InputPartition):
    """From ``start`` up to but without ``end``, in microseconds."""

    equipment: str | None
    attribute: str | None
    start: int
    end: int


class Settings:
    """What the options say."""

    def __init__(self, options: dict[str, str]):
        several = lambda name: [x.strip() for x in options.get(name, "").split(",") if x.strip()] or [None]
        self.url, self.alias = options["url"], options["alias"]
        self.equipment, self.attributes = several("equipment"), several("attributes")
        self.start = micros(options["start"])
        self.end = micros(options["end"]) if "end" in options else None
        self.step = int(float(options.get("slice_hours", 24)) * 3_600_000_000)
        self.most = int(float(options["most_hours"]) * 3_600_000_000) if "most_hours" in options else None
        self.every, self.fn = options.get("every", "10m"), options.get("fn", "mean")
        self.retries, self.backoff = int(options.get("retries", 3)), float(options.get("backoff", 2.0))
        #: The environment variable that holds the token; empty where the API asks for none.
        self.token_variable = options.get("token_variable", "READINGS_API_TOKEN")
        if self.step <= 0 or self.retries < 1:
            raise ValueError("slice_hours and retries must be positive")

    def cut(self, equipment: str | None, attribute: str | None, start: int, end: int) -> list[Slice]:
        """Slices of one series; their borders are multiples of the step, so a slice is the same in every query."""
        out, at = [], start
        while at < end:
            then = min(end, (at // self.step + 1) * self.step)
            out.append(Slice(equipment, attribute, at, then))
            at = then
        return out

    def fetch(self, part: Slice, execute: Callable[[dict[str, Any]], str] | None = None) -> Iterator[pa.RecordBatch]:
        """The slice's readings; a failed request is tried again after a pause, the last failure is raised."""
        execute = execute or http_client(self.url, api_token(None, self.token_variable) if self.token_variable else "anonymous", REQUEST)
        variables = {"alias": self.alias, "equipment": part.equipment, "attributes": None if part.attribute is None else [part.attribute]}
        variables |= {"start": moment(part.start), "end": moment(part.end), "every": self.every, "fn": self.fn}
        for attempt in range(1, self.retries + 1):
            try:
                answer = json.loads(execute(variables))
                break
            except (ConnectionError, RuntimeError):
                if attempt == self.retries:
                    raise
                time.sleep(self.backoff)
        rows = []
        for project in answer.get("projects") or []:
            for e in project.get("equipment") or []:
                for p in e.get("points") or []:
                    for s in p.get("series") or []:
                        at, value = micros(s["timestamp"]), s["value"]
                        # What an answer holds beyond its slice belongs to a neighbour.
                        if part.start <= at < part.end:
                            rows.append((project["alias"], e["id"], e["type"], p["id"], p["type"], p["attribute"], at, None if value is None or value != value else float(value)))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        types = [*[pa.string()] * 6, pa.timestamp("us", tz="UTC"), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) if t == types[6] else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


class ApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.settings = Settings(options)
        if self.settings.end is None:
            self.settings.end = micros(datetime.now(timezone.utc))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        s = self.settings
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "ts" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                s.start = max(s.start, micros(f.value) + isinstance(f, GreaterThan))
            if name == "ts" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                s.end = min(s.end, micros(f.value) + (not isinstance(f, LessThan)))
            if name in ("equipment_id", "attribute") and isinstance(f, (EqualTo, In)):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                field = "equipment" if name == "equipment_id" else "attributes"
                setattr(s, field, [x for x in getattr(s, field) if x in wanted] if getattr(s, field) != [None] else wanted)
            # Spark checks all of them again: names without a list of their own are only asked for by it.
            yield f

    def partitions(self) -> list[Slice]:
        s = self.settings
        return [p for e in s.equipment for a in s.attributes for p in s.cut(e, a, s.start, s.end)]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        return self.settings.fetch(partition) if partition is not None else iter(())


class ApiStream(DataSourceStreamReader):
    """Offsets: for each piece of equipment and attribute (as JSON) the time up to which it is read."""

    def __init__(self, options: dict[str, str]):
        self.settings = Settings(options)
        self.known: dict[str, int] = {}

    def _keys(self) -> Iterator[tuple[str, str | None, str | None]]:
        for e in self.settings.equipment:
            for a in self.settings.attributes:
                yield json.dumps([e, a]), e, a

    def initialOffset(self) -> dict[str, int]:
        self.known = {k: self.settings.start for k, _, _ in self._keys()}
        return self.known

    def latestOffset(self) -> dict[str, int]:
        """Now, or ``end``; with ``most_hours`` no further than so much after what is known to be read.

        The first batch after a restart doesn't know that yet and goes up to now, in slices as ever.
        """
        s = self.settings
        now = micros(datetime.now(timezone.utc))
        end = now if s.end is None else min(now, s.end)
        bounded = lambda k: end if s.most is None or k not in self.known else min(end, self.known[k] + s.most)
        return {k: max(bounded(k), self.known.get(k, s.start)) for k, _, _ in self._keys()}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Slice]:
        self.known = dict(end)
        return [p for k, e, a in self._keys() for p in self.settings.cut(e, a, start.get(k, self.settings.start), end.get(k, start.get(k, self.settings.start)))]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.settings.fetch(partition)

    def commit(self, end: dict[str, int]) -> None:
        self.known = dict(end)


class ReadingsApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> ApiReader:
        return ApiReader(dict(self.options))

    def streamReader(self, schema: Any) -> ApiStream:
        return ApiStream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    with by_value():
        spark.dataSource.register(ReadingsApi)


def read_api(spark: SparkSession, url: str, alias: str, start: str, end: str | None = None, **options: Any) -> DataFrame:
    """Readings of the remote API between two times; further options are those of :class:`Settings`."""
    register(spark)
    given = {"url": url, "alias": alias, "start": start} | ({"end": end} if end else {}) | {k: str(v) for k, v in options.items()}
    return spark.read.format(FORMAT).options(**given).load()


def stream_api(spark: SparkSession, url: str, alias: str, start: str, **options: Any) -> DataFrame:
    """Readings of the remote API from ``start`` on, polled by trigger."""
    register(spark)
    return spark.readStream.format(FORMAT).options(url=url, alias=alias, start=start, **{k: str(v) for k, v in options.items()}).load()
