"""Every registered query of the repair library against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tidemark.plans.queries import QUERIES, SQL, TABLES, entry, feed, nested_payload
from tidemark.sources.readings import flatten_payload


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        if isinstance(v, pd.Timestamp):
            return str(v)
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got) > 0
        return
    db = duckdb.connect()
    for table in (*TABLES, "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    expect = db.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expect.columns)
    assert rows(got, columns) == rows(expect, columns)


def test_entry(spark, sf):
    assert entry(spark, sf).count() > 0


def test_payload_of_the_whole_feed(spark, sf):
    readings = feed(spark, sf).selectExpr("point_id", "sensor", "ts", "value")
    nested = nested_payload(readings)
    flat = flatten_payload(nested).selectExpr("point_id", "sensor", "CAST(ts AS timestamp_ntz) AS ts", "value")
    assert rows(flat.toPandas(), flat.columns) == rows(readings.toPandas(), readings.columns)
    days = [{str(s.timestamp)[:10] for p in r.projects for e in p.equipment for q in e.points for s in q.series} for r in nested.collect()]
    assert all(len(d) == 1 for d in days) and len(days) == readings.selectExpr("point_id", "CAST(ts AS date)").distinct().count()
