"""Watches streaming queries: progress and lag as a table, and an alert when a feed falls silent.

Spark tells a listener of every batch, and of every trigger that found nothing. Rows that arrived
are kept by query; when none have come for ``silence`` seconds an alert is raised once, and
again only after new rows. Events are small and few (one for each trigger), so they are kept
in memory up to ``keep`` and appended to a folder of JSON lines on :meth:`flush`.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = "query string, name string, batch long, at timestamp, rows long, rows_per_second double, batch_seconds double, lag_seconds double, kind string"
SILENCE = 30.0


class Watchdog(StreamingQueryListener):
    """``alert`` is called with the query's name and the seconds since its last row."""

    def __init__(self, alert: Callable[[str, float], Any], silence: float = SILENCE, keep: int = 10_000, clock: Callable[[], float] = time.time):
        self.alert, self.silence, self.clock = alert, silence, clock
        self.events: deque[tuple] = deque(maxlen=keep)
        #: By query: name, time of the last row, and whether its silence has been told.
        self.seen: dict[str, list] = {}
        self.lock, self.stopped = threading.RLock(), threading.Event()

    def onQueryStarted(self, event: Any) -> None:
        with self.lock:
            self.seen[str(event.id)] = [event.name or str(event.id), self.clock(), False]
            self._note(str(event.id), "started")

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        with self.lock:
            state = self.seen.setdefault(str(p.id), [p.name or str(p.id), self.clock(), False])
            if p.numInputRows > 0:
                state[1:] = [self.clock(), False]
            newest = (p.eventTime or {}).get("max")
            lag = self.clock() - datetime.fromisoformat(newest.replace("Z", "+00:00")).timestamp() if newest else None
            self._note(str(p.id), "progress", p.batchId, p.numInputRows, p.processedRowsPerSecond, p.durationMs.get("triggerExecution", 0) / 1000, lag)
        self.check()

    def onQueryIdle(self, event: Any) -> None:
        self.check()

    def onQueryTerminated(self, event: Any) -> None:
        with self.lock:
            self._note(str(event.id), "failed" if event.exception else "ended")
            self.seen.pop(str(event.id), None)

    def _note(self, query: str, kind: str, batch: int | None = None, rows: int = 0, rate: float | None = None, seconds: float | None = None, lag: float | None = None) -> None:
        name = self.seen[query][0] if query in self.seen else query
        at = datetime.fromtimestamp(self.clock(), timezone.utc)
        self.events.append((query, name, batch, at, int(rows), None if rate is None or rate != rate else float(rate), seconds, None if lag is None else float(lag), kind))

    def check(self) -> list[str]:
        """Queries that have just been found silent; each is told once."""
        told = []
        with self.lock:
            for query, state in self.seen.items():
                quiet = self.clock() - state[1]
                if quiet >= self.silence and not state[2]:
                    state[2] = True
                    self._note(query, "silent", lag=quiet)
                    told.append((state[0], quiet))
        for name, quiet in told:
            self.alert(name, quiet)
        return [name for name, _ in told]

    def watch(self, every: float = 1.0) -> threading.Thread:
        """Checks from a thread of its own, so that a query that hangs in a batch is found too."""

        def run() -> None:
            while not self.stopped.wait(every):
                self.check()

        thread = threading.Thread(target=run, daemon=True)
        thread.start()
        return thread

    def stop(self) -> None:
        self.stopped.set()

    def progress(self, spark: SparkSession) -> DataFrame:
        """What has been seen since the last :meth:`flush`."""
        with self.lock:
            return spark.createDataFrame(list(self.events), PROGRESS)

    def flush(self, spark: SparkSession, path: str) -> None:
        """Appends the events to a folder of JSON lines, which :func:`read_progress` reads."""
        with self.lock:
            rows = list(self.events)
            self.events.clear()
        if rows:
            spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").json(path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(path)


def watched(spark: SparkSession, alert: Callable[[str, float], Any], silence: float = SILENCE) -> Watchdog:
    """A watchdog over all queries of the session."""
    dog = Watchdog(alert, silence)
    spark.streams.addListener(dog)
    dog.watch(min(1.0, silence / 2))
    return dog
