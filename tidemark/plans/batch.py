"""Batch jobs: load, validate, detect, reconstruct, write."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.forecast import Forecaster, LastValue
from ..operators.reconstruct import reconstruct, reconstruct_last_value
from ..operators.validate import validate
from ..sources import sinks
from ..sources.api import read_api
from ..sources.readings import distinct_times, fetch_payload, read_wide_csv, recent


def impute(readings: DataFrame, model: Forecaster | None = None, min_hours: float = 0.25, label_all_reconciled: bool = False) -> DataFrame:
    """Imputed rows; the last-value forecaster needs no Python."""
    if model is None or isinstance(model, LastValue):
        return reconstruct_last_value(readings, min_hours, label_all_reconciled=label_all_reconciled)
    return reconstruct(readings, model, min_hours, label_all_reconciled=label_all_reconciled)


#: Series whose counts are taken while the rows are written.
MOST_OBSERVED = 1000


def counted(imputed: DataFrame, write: Callable[[DataFrame], None], series: Sequence[tuple[str, str]]) -> DataFrame:
    """Writes the rows and gives their number by series, both in the one job of the write.

    ``series`` are all that may occur; those without a row are left out.
    """
    seen = Observation("imputed rows")
    of = lambda p, s: F.count_if(F.col("point_id").eqNullSafe(F.lit(p)) & F.col("sensor").eqNullSafe(F.lit(s)))
    write(imputed.observe(seen, F.count(F.lit(1)).alias("all"), *(of(p, s).alias(f"n{i}") for i, (p, s) in enumerate(series))))
    found = seen.get
    if sum(found[f"n{i}"] for i in range(len(series))) != found["all"]:
        raise ValueError("rows of a series that was not named")
    rows = [(p, s, found[f"n{i}"]) for i, (p, s) in enumerate(series) if found[f"n{i}"]]
    return imputed.sparkSession.createDataFrame(rows, "point_id string, sensor string, n long")


def run_job(
    readings: DataFrame, path: str, backend: str = "local_jsonl", model: Forecaster | None = None, min_hours: float = 0.25,
    metrics: sinks.Tracker | None = None, label_all_reconciled: bool = True, series: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Writes imputed rows of all series at once and gives the number of this run's rows by series.

    With ``series`` (up to ``MOST_OBSERVED`` points and sensors, all that there are) they are counted while
    they are written; without, the rows are kept on disk and counted when the result is read.
    """
    if backend not in ("local_jsonl", "parquet"):
        sinks.write(readings, backend, path)  # raises
    if metrics is not None:
        metrics.log_params({"backend": backend, "model": (model or LastValue()).name, "min_hours": min_hours})
        metrics.log_metrics(validate(readings, model or LastValue()))
    imputed = impute(readings, model, min_hours, label_all_reconciled)
    if series is not None and len(series) <= MOST_OBSERVED:
        return counted(imputed, lambda rows: sinks.write(rows, backend, path), series)
    imputed = imputed.persist(StorageLevel.DISK_ONLY)
    sinks.write(imputed, backend, path)
    return imputed.groupBy("point_id", "sensor").agg(F.count(F.lit(1)).alias("n"))


def _series(readings: DataFrame) -> list[tuple[str, str]] | None:
    """All series, or None where there are more than are counted while writing."""
    found = readings.select("point_id", "sensor").distinct().limit(MOST_OBSERVED + 1).collect()
    return [(r.point_id, r.sensor) for r in found] if len(found) <= MOST_OBSERVED else None


def run_source_job(
    spark: SparkSession, url: str, alias: str, path: str, days_back: int = 30, now: datetime | None = None, source: dict[str, Any] | None = None, **options,
) -> DataFrame:
    """:func:`run_job` on the newest readings of the remote API, requested slice by slice in tasks; one row for each series, 0 where nothing was imputed.

    ``source`` are options of :func:`read_api`. What was fetched is kept on disk until the job is done, so nothing is requested twice.
    """
    end = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    start = end - timedelta(days=days_back)
    rows = read_api(spark, url, alias, start.isoformat(), (end + timedelta(microseconds=1)).isoformat(), **(source or {}))
    rows = rows.select("point_id", F.col("attribute").alias("sensor"), "ts", "value", F.monotonically_increasing_id().alias("arrival")).persist(StorageLevel.DISK_ONLY)
    series = None
    try:
        series = _series(rows)
        done = run_job(distinct_times(rows, "arrival"), path, series=series, **options)
        if series is None:
            return rows.select("point_id", "sensor").distinct().join(done, ["point_id", "sensor"], "left").fillna(0, ["n"])
        n = {(r.point_id, r.sensor): r.n for r in done.collect()}
        return spark.createDataFrame([(*k, n.get(k, 0)) for k in series], "point_id string, sensor string, n long")
    finally:
        if series is not None:
            rows.unpersist()


def run_api_job(
    spark: SparkSession, execute: Callable[[dict[str, Any]], str], alias: str, attributes: Sequence[str], path: str, days_back: int = 30, now: datetime | None = None, **options,
) -> DataFrame:
    """:func:`run_job` on the newest readings that the remote API has; one row for each point, 0 where nothing was imputed."""
    end = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    variables = {"alias": alias, "attributes": list(attributes), "start": (end - timedelta(days=days_back)).isoformat(), "end": end.isoformat()}
    readings = fetch_payload(spark, execute, variables).select("point_id", "sensor", "ts", "value").withColumn("arrival", F.monotonically_increasing_id())
    readings = recent(distinct_times(readings, "arrival"), F.lit(end), days_back)
    done = run_job(readings, path, **options)
    return readings.select("point_id", "sensor").distinct().join(done, ["point_id", "sensor"], "left").fillna(0, ["n"])


def run_csv_job(spark: SparkSession, csv: str, columns: Sequence[str], point_id: str, path: str, **options) -> DataFrame:
    """:func:`run_job` on columns of a wide export; of rows with one time the last in the file counts."""
    readings = read_wide_csv(spark, csv, columns, point_id=point_id).withColumn("arrival", F.monotonically_increasing_id())
    return run_job(distinct_times(readings, "arrival"), path, series=[(point_id, c.split("__")[-1]) for c in columns], **options)
