"""Registered queries over the ``events`` table, each with the same query in SQL.

``events`` has no repeated values, so a feed is derived from it: three points, one sensor
for each event type, values in steps of 50, every seventeenth reading missing.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blend, confidence, feather, has_keyword, iso, split_list
from ..operators import buffers, catalog, reconstruct, runs, segments, validate
from ..operators.forecast import Drift, Forecaster, LastValue, SeasonalNaive
from ..operators.long_series import stuck_periods_long
from ..sources import api, sinks, upserts
from ..sources import readings as src
from ..streaming import live
from . import served

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SERIES = ["point_id", "sensor"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """A folder that is deleted at the end, and a function that writes a result beside it and reads it back."""
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{base}-result")
        return spark.read.schema(df.schema).parquet(f"{base}-result")

    try:
        yield base, keep
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.when(F.col("event_id") % 17 != 0, (F.floor(F.col("value") / 50) * 50).cast("double"))
    point = F.concat(F.lit("dev-"), (F.col("user_id") % 3).cast("string"))
    return e.select(point.alias("point_id"), F.col("event_type").alias("sensor"), "ts", src.clean(value).alias("value"), "event_id")


FEED = """feed AS (
  SELECT 'dev-' || (user_id % 3)::VARCHAR AS point_id, event_type AS sensor, ts,
         CASE WHEN event_id % 17 <> 0 THEN (floor(value / 50) * 50)::DOUBLE END AS value, event_id
  FROM events)"""
W = "PARTITION BY point_id, sensor ORDER BY ts"


def runs_sql(limit: int = 1, feed_sql: str = FEED) -> str:
    filled = f"last_value(value IGNORE NULLS) OVER ({W} ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)" if limit > 0 else "value"
    return f"""{feed_sql}, filled AS (SELECT *, {filled} AS filled FROM feed),
changed AS (SELECT *, CASE WHEN filled IS NULL OR lag(filled) OVER ({W}) IS NULL OR filled <> lag(filled) OVER ({W}) THEN 1 ELSE 0 END AS changed FROM filled),
runs AS (
  SELECT *, sum(changed) OVER ({W} ROWS UNBOUNDED PRECEDING)::BIGINT AS run, row_number() OVER ({W})::BIGINT AS rn,
    lag(value) OVER ({W}) AS prev_value, lead(value) OVER ({W}) AS next_value,
    count(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS valid_before
  FROM changed),
grouped AS (
  SELECT point_id, sensor, run, min(ts) AS start_time, max(ts) AS end_time, count(*)::BIGINT AS n_points, min(rn) AS first_rn, max(rn) AS last_rn,
    first(value ORDER BY ts) AS stuck_value, first(prev_value ORDER BY ts) AS before, last(next_value ORDER BY ts) AS after, min(valid_before) AS valid_before
  FROM runs GROUP BY ALL),
periods AS (
  SELECT *, date_diff('microsecond', start_time, end_time)::DOUBLE / 1000000 AS duration_seconds FROM grouped
  WHERE n_points > 1 AND date_diff('microsecond', start_time, end_time) >= 900000000),
ends AS (SELECT point_id, sensor, max(ts) AS last_reading FROM feed WHERE value IS NOT NULL GROUP BY ALL),
open_ AS (
  SELECT periods.*, coalesce(last_reading <= end_time, true) AS is_open_ended FROM periods LEFT JOIN ends USING (point_id, sensor))"""


IMPUTED = f"""{runs_sql()}, imputed AS (
  SELECT r.point_id, r.sensor, r.ts AS "timestamp", r.value AS raw_value,
    CASE WHEN is_open_ended THEN before ELSE before * (1 - (r.rn - first_rn)::DOUBLE / (n_points - 1)) + after * (1 - (1 - (r.rn - first_rn)::DOUBLE / (n_points - 1))) END AS imputed_value,
    CASE WHEN is_open_ended THEN 'last-value-forward-only' ELSE 'last-value-bidirectional' END AS imputation_method,
    CASE WHEN is_open_ended THEN 'PROVISIONAL' ELSE 'RECONCILED' END AS imputation_confidence, '1' AS imputation_model_version, start_time AS period_start
  FROM runs r JOIN open_ o USING (point_id, sensor, run) WHERE first_rn > 1)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("feed_normalise", f"WITH {FEED} SELECT * FROM feed")
def feed_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir)


SENSORS = ("cart", "click", "error", "purchase", "signup", "view")


@query(
    "wide_unpivot",
    f"""WITH {FEED}, wide AS (SELECT ts, {", ".join(f"max(CASE WHEN sensor = '{s}' THEN value END) AS {s}" for s in SENSORS)} FROM feed GROUP BY ts)
SELECT 'plant' AS point_id, sensor, ts, value FROM wide UNPIVOT INCLUDE NULLS (value FOR sensor IN ({", ".join(SENSORS)}))""",
)
def wide_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = feed(spark, sf_dir).groupBy("ts").agg(*(F.max(F.when(F.col("sensor") == s, F.col("value"))).alias(f"plant__meter__{s}") for s in SENSORS))
    long = src.unpivot(wide.withColumn("timestamp", F.col("ts").cast("string")), [f"plant__meter__{s}" for s in SENSORS])
    return long.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("column_match", f"WITH {FEED} SELECT DISTINCT sensor FROM feed WHERE contains(lower(sensor), 'ic') OR contains(lower(sensor), 'up')")
def column_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = [r for r in ("IC", "Up")]
    return feed(spark, sf_dir).select("sensor").distinct().filter(has_keyword(F.col("sensor"), keywords))


@query("name_list", "SELECT event_type, len(list_filter(list_transform(string_split(event_type || ', ,' || props, ','), lambda x: trim(x)), lambda x: x <> ''))::INTEGER AS n FROM events")
def name_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_type", F.size(split_list(F.concat("event_type", F.lit(", ,"), "props"))).alias("n"))


def nested_payload(rows: DataFrame, *keep: str) -> DataFrame:
    """Readings as nested answers of the API: one row for each point and day, so that none grows with the table."""
    rows = rows.withColumn("day", F.to_date("ts"))
    series = rows.groupBy(*SERIES, "day").agg(F.collect_list(F.struct(F.col("ts").cast("string").alias("timestamp"), "value")).alias("series"))
    points = series.groupBy("point_id", "day").agg(F.collect_list(F.struct(F.col("point_id").alias("id"), F.lit("sensor").alias("type"), F.col("sensor").alias("attribute"), "series")).alias("points"))
    equipment = points.select(F.struct(F.col("point_id").alias("id"), F.lit("meter").alias("type"), "points").alias("e"), *keep)
    return equipment.select(*keep, F.array(F.struct(F.lit("p").alias("id"), F.lit("plant").alias("alias"), F.array("e").alias("equipment"))).alias("projects"))


@query("payload_flatten", f"WITH {FEED} SELECT point_id, sensor, ts, value, 'meter' AS equipment_type FROM feed")
def payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.flatten_payload(nested_payload(feed(spark, sf_dir))).select("point_id", "sensor", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "equipment_type")


def api_feed(spark: SparkSession, where: str, sf_dir: str) -> str:
    """The feed as files that the stand-in for the API answers from."""
    served.write_answers(nested_payload(feed(spark, sf_dir), "day"), f"{where}/answers")
    return f"{where}/answers"


@query(
    "api_slices",
    f"WITH {FEED} SELECT point_id AS equipment_id, sensor, ts, value FROM feed WHERE ts >= TIMESTAMP '2024-01-03 05:00:00' AND ts < TIMESTAMP '2024-01-21' AND sensor <> 'view'",
)
def api_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed served over HTTP and read slice by slice, a request in a task for each point, attribute and three days."""
    with scratch(spark, "api") as (where, keep):
        with served.served(spark, api_feed(spark, where, sf_dir)) as url:
            rows = api.read_api(
                spark, url, "plant", "2024-01-01", "2024-03-01", equipment="dev-0,dev-1,dev-2", attributes=",".join(SENSORS), slice_hours=72, token_variable=""
            )
            wanted = rows.filter("ts >= timestamp'2024-01-03 05:00:00' AND ts < timestamp'2024-01-21'").filter(F.col("attribute").isin("cart", "click", "error", "purchase", "signup"))
            return keep(wanted.select("equipment_id", F.col("attribute").alias("sensor"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value"))


@query(
    "resample_mean",
    f"WITH {FEED} SELECT point_id, sensor, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round(avg(value), 6) AS value FROM feed GROUP BY ALL",
)
def resample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.resample(feed(spark, sf_dir), "6 hours"), "value")


@query("resample_max", f"WITH {FEED} SELECT point_id, sensor, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS ts, max(value) AS value FROM feed GROUP BY ALL")
def resample_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.resample(feed(spark, sf_dir), "1 day", "max")


@query(
    "regular_grid",
    f"""WITH {FEED}, r AS (SELECT point_id, sensor, time_bucket(INTERVAL 7 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, avg(value) AS value FROM feed GROUP BY ALL),
e AS (SELECT point_id, sensor, min(ts) AS a, max(ts) AS z FROM r GROUP BY ALL), g AS (SELECT point_id, sensor, unnest(generate_series(a, z, INTERVAL 7 HOUR)) AS ts FROM e)
SELECT point_id, sensor, ts, round(value, 6) AS value FROM g LEFT JOIN r USING (point_id, sensor, ts)""",
)
def regular_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each bucket between a series' first and last one, null where nothing was read."""
    return rounded(src.on_grid(feed(spark, sf_dir), "7 hours"), "value")


@query("recent_window", f"WITH {FEED} SELECT point_id, sensor, ts, value FROM feed WHERE ts BETWEEN TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20'")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.recent(feed(spark, sf_dir).drop("event_id"), F.lit("2024-01-20").cast("timestamp_ntz"), 7)


for _limit, _name in ((1, "ffill_limit1"), (3, "ffill_limit3"), (0, "ffill_disabled")):

    def _ffill(spark: SparkSession, sf_dir: str, limit: int = _limit) -> DataFrame:
        return runs.bridge_nulls(feed(spark, sf_dir), limit).select("event_id", "filled")

    query(_name, f"WITH {runs_sql(_limit)} SELECT event_id, filled FROM filled")(_ffill)


@query("run_ids", f"WITH {runs_sql()} SELECT event_id, run FROM runs")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.with_runs(feed(spark, sf_dir)).select("event_id", F.col("run").cast("long").alias("run"))


@query("stuck_periods", f"WITH {runs_sql()} SELECT point_id, sensor, run, stuck_value, start_time, end_time, n_points, duration_seconds FROM periods")
def stuck_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stuck_periods(feed(spark, sf_dir)).select(*SERIES, "run", "stuck_value", "start_time", "end_time", "n_points", "duration_seconds")


@query("stuck_periods_chunked", f"WITH {runs_sql()} SELECT point_id, sensor, stuck_value, start_time, end_time, n_points, duration_seconds FROM periods")
def stuck_periods_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuck_periods_long(feed(spark, sf_dir))


@query("run_ids_chunked", f"WITH {runs_sql()} SELECT event_id, run, rn, prev_value, next_value, valid_before FROM runs")
def run_ids_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, row numbers and neighbours in chunks of a day; no task needs a whole series."""
    rows = segments.with_runs_in_chunks(feed(spark, sf_dir))
    return rows.select("event_id", F.col("run").cast("long").alias("run"), F.col("rn").cast("long").alias("rn"), "prev_value", "next_value", "valid_before")


@query("stuck_periods_chunked_limit3", f"WITH {runs_sql(3)} SELECT point_id, sensor, run, stuck_value, start_time, end_time, n_points, duration_seconds FROM periods")
def stuck_periods_chunked_limit3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periods_of(segments.with_runs_in_chunks(feed(spark, sf_dir), 3, 12))
    return found.select(*SERIES, F.col("run").cast("long").alias("run"), "stuck_value", "start_time", "end_time", "n_points", "duration_seconds")


@query(
    "stuck_periods_display",
    f"""WITH {runs_sql()} SELECT sensor AS "Sensor/Metric", stuck_value AS "Stuck Value", strftime(start_time, '%Y-%m-%d %H:%M:%S') AS "Start Time",
strftime(end_time, '%Y-%m-%d %H:%M:%S') AS "End Time", round(duration_seconds / 3600, 2) AS "Duration (hours)" FROM periods""",
)
def stuck_periods_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.display_table(runs.stuck_periods(feed(spark, sf_dir)))


@query("open_ended_periods", f"WITH {runs_sql()} SELECT point_id, sensor, start_time, is_open_ended FROM open_")
def open_ended_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed(spark, sf_dir)
    return runs.with_open_end(runs.stuck_periods(f), f).select(*SERIES, "start_time", "is_open_ended")


@query("gap_context", f"WITH {runs_sql()} SELECT point_id, sensor, start_time, before, after, valid_before, n_points FROM open_ WHERE valid_before >= 5")
def gap_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = reconstruct.gap_contexts(feed(spark, sf_dir))
    return p.filter("valid_before >= 5").select(*SERIES, "start_time", "before", "after", "valid_before", "n_points")


@query("gap_context_chunked", f"WITH {runs_sql()} SELECT point_id, sensor, start_time, before, after, valid_before, n_points FROM open_ WHERE valid_before >= 5")
def gap_context_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = reconstruct.gap_contexts(feed(spark, sf_dir), chunk_hours=24)
    return p.filter("valid_before >= 5").select(*SERIES, "start_time", "before", "after", "valid_before", "n_points")


@query(
    "context_arrays",
    f"""WITH {runs_sql()} SELECT o.point_id, o.sensor, o.start_time,
  count(*) FILTER (r.rn < first_rn)::INTEGER AS n_before, count(*) FILTER (r.rn > last_rn)::INTEGER AS n_after,
  round(coalesce(sum(r.value) FILTER (r.rn < first_rn), 0), 6) AS sum_before, round(coalesce(sum(r.value) FILTER (r.rn > last_rn), 0), 6) AS sum_after
FROM open_ o JOIN runs r ON r.point_id = o.point_id AND r.sensor = o.sensor AND (r.rn BETWEEN first_rn - 32 AND first_rn - 1 OR r.rn BETWEEN last_rn + 1 AND last_rn + 32)
WHERE first_rn > 1 GROUP BY ALL""",
)
def context_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = reconstruct.gap_contexts(feed(spark, sf_dir))
    c = reconstruct.contexts(r, p, 32)
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), 6)
    return c.select(
        *SERIES, "start_time", F.size("context_before").alias("n_before"), F.size("context_after").alias("n_after"), total("context_before").alias("sum_before"), total("context_after").alias("sum_after")
    )


BASE_GAPS = f"""{FEED}, numbered AS (SELECT *, row_number() OVER ({W})::BIGINT AS rn FROM feed),
sizes AS (SELECT point_id, sensor, count(*)::BIGINT AS n FROM feed GROUP BY ALL),
fixed AS (
  SELECT point_id, sensor, gap, ((start - 11) // 37)::BIGINT AS trial, start
  FROM (SELECT point_id, sensor, gap, n, unnest(range(11, n + 1, 37))::BIGINT AS start FROM sizes, (SELECT unnest([3, 7, 20]) AS gap)) WHERE start + gap + 10 <= n),
hidden AS (
  SELECT f.*, n.ts, n.value, n.rn - f.start AS i, b.value AS before, a.value AS after
  FROM fixed f JOIN numbered n ON n.point_id = f.point_id AND n.sensor = f.sensor AND n.rn >= f.start AND n.rn < f.start + f.gap
  JOIN numbered b ON b.point_id = f.point_id AND b.sensor = f.sensor AND b.rn = f.start - 1
  JOIN numbered a ON a.point_id = f.point_id AND a.sensor = f.sensor AND a.rn = f.start + f.gap),
clean AS (
  SELECT h.* FROM hidden h JOIN (SELECT point_id, sensor, gap, trial FROM hidden GROUP BY ALL HAVING count(value) = count(*) AND count(before) > 0 AND count(after) > 0) USING (point_id, sensor, gap, trial)),
predicted AS (
  SELECT *, before AS forward_fill, before + (after - before) * (i + 1) / (gap + 1) AS linear_interp,
    before * (1 - i::DOUBLE / (gap - 1)) + after * (1 - (1 - i::DOUBLE / (gap - 1))) AS model FROM clean),
scored AS (
  SELECT point_id, sensor, gap, trial, {", ".join(f"avg(abs({c} - value)) AS {c}_mae, sqrt(avg(({c} - value) * ({c} - value))) AS {c}_rmse, avg(CASE WHEN value <> 0 THEN abs(({c} - value) / value) END) * 100 AS {c}_mape" for c in ("model", "forward_fill", "linear_interp"))}
  FROM predicted GROUP BY ALL)"""


def fixed_gaps(f: DataFrame) -> DataFrame:
    """Gaps at every 37th row of each whole series, kept where they and their neighbours have no nulls."""
    sizes = f.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    at = sizes.select("*", F.explode(F.array(*map(F.lit, (3, 7, 20)))).alias("gap"))
    at = at.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 37))).alias("trial"))
    at = at.withColumn("start", 11 + 37 * F.col("trial")).filter(F.col("start") + F.col("gap") + 10 <= F.col("n")).drop("n")
    return at.join(validate.null_free(validate.numbered(f), (3, 7, 20)), [*SERIES, "gap", "start"], "left_semi")


def hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = feed(spark, sf_dir)
    return validate.baselines(validate.hidden_rows(f, fixed_gaps(f)))


@query("baseline_ffill", f"WITH {BASE_GAPS} SELECT point_id, sensor, gap, trial, ts, value, forward_fill FROM predicted")
def baseline_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden(spark, sf_dir).select(*SERIES, "gap", "trial", "ts", "value", "forward_fill")


@query("baseline_linear", f"WITH {BASE_GAPS} SELECT point_id, sensor, gap, trial, ts, round(linear_interp, 6) AS linear_interp FROM predicted")
def baseline_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hidden(spark, sf_dir).select(*SERIES, "gap", "trial", "ts", "linear_interp"), "linear_interp")


def _window_sql(gap: int) -> str:
    around = f"({W} ROWS BETWEEN 1 PRECEDING AND {gap} FOLLOWING)"
    return f"""SELECT point_id, sensor, {gap} AS gap, rn AS start FROM (
  SELECT *, count(value) OVER {around} AS known, count(*) OVER {around} AS rows_, count(*) OVER (PARTITION BY point_id, sensor) AS n FROM numbered)
WHERE rn > 1 AND rn + {gap} - 1 <= n AND known = rows_"""


@query(
    "null_free_windows",
    f"WITH {FEED}, numbered AS (SELECT *, row_number() OVER ({W})::BIGINT AS rn FROM feed) {' UNION ALL '.join(map(_window_sql, (3, 7, 20)))}",
)
def null_free_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.null_free(validate.numbered(feed(spark, sf_dir)), (3, 7, 20))
    return rows.select(*SERIES, "gap", F.col("start").cast("long").alias("start"))


_SCORES = [f"{c}_{m}" for c in ("model", "forward_fill", "linear_interp") for m in ("mae", "rmse", "mape")]


@query("trial_scores", f"WITH {BASE_GAPS} SELECT point_id, sensor, gap, trial, {', '.join(f'round({c}, 6) AS {c}' for c in _SCORES)} FROM scored")
def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validate.scores(validate.predict_last_value(hidden(spark, sf_dir)))
    return rounded(s.select(*SERIES, "gap", "trial", *_SCORES), *_SCORES)


@query(
    "validation_summary",
    f"""WITH {BASE_GAPS} SELECT point_id, sensor, gap, round(avg(model_mae), 6) AS model_mae, round(avg(forward_fill_mae), 6) AS forward_fill_mae,
  round(avg(linear_interp_mae), 6) AS linear_interp_mae, round(avg((model_mae < forward_fill_mae)::INTEGER), 6) AS beats_forward_fill,
  round(avg((model_mae < linear_interp_mae)::INTEGER), 6) AS beats_linear_interp, count(*)::DOUBLE AS num_trials FROM scored GROUP BY ALL""",
)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = validate.summary(validate.scores(validate.predict_last_value(hidden(spark, sf_dir))))
    measures = ("model_mae", "forward_fill_mae", "linear_interp_mae", "beats_forward_fill", "beats_linear_interp")
    return rounded(s.select(*SERIES, "gap", *measures, "num_trials"), *measures)


@query("validation_random")
def validation_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded sweep with the drift forecaster; draws come from a generator that SQL lacks."""
    return validate.validate(feed(spark, sf_dir), Drift())


_I = "(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)"
_WINDOWED = f"""w AS (
  SELECT event_id, user_id, value AS f, value * 0.5 + 3 AS b, {_I} AS i, count(*) OVER (PARTITION BY user_id) AS n,
    first_value(value) OVER p AS f0, last_value(value) OVER p AS f1
  FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return e.select(
        "event_id", F.col("value").alias("f"), (F.col("value") * 0.5 + 3).alias("b"), (F.row_number().over(w) - 1).alias("i"),
        F.count(F.lit(1)).over(whole).alias("n"), F.first("value").over(whole).alias("f0"), F.last("value").over(whole).alias("f1"),
    )


@query("blend_ramp", f"WITH {_WINDOWED} SELECT event_id, round(CASE WHEN n > 1 THEN f * (1 - i::DOUBLE / (n - 1)) + b * (i::DOUBLE / (n - 1)) ELSE f END, 10) AS blended FROM w")
def blend_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark, sf_dir).select("event_id", F.round(blend(F.col("f"), F.col("b"), F.col("i"), F.col("n")), 10).alias("blended"))


@query(
    "feather_edges",
    f"""WITH {_WINDOWED}, s AS (SELECT *, f + (100 - f0) * greatest(0, 1 - i::DOUBLE / least(3, n)) AS y, f1 + (100 - f0) * greatest(0, 1 - (n - 1)::DOUBLE / least(3, n)) AS y1 FROM w)
SELECT event_id, round(y + (200 - y1) * greatest(0, 1 - (n - 1 - i)::DOUBLE / least(3, n)), 6) AS feathered FROM s""",
)
def feather_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windowed(spark, sf_dir)
    y = feather(F.col("f"), F.col("f0"), F.col("f1"), F.lit(100.0), F.lit(200.0), F.col("i"), F.col("n"), 3, F.lit(True), F.lit(True))
    return w.select("event_id", F.round(y, 6).alias("feathered"))


_OUT = 'point_id, sensor, "timestamp", raw_value, round(imputed_value, 6) AS imputed_value, imputation_method, imputation_confidence, imputation_model_version, period_start'


@query("reconstruct_lastvalue", f"WITH {IMPUTED} SELECT {_OUT} FROM imputed")
def reconstruct_lastvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconstruct.reconstruct_last_value(feed(spark, sf_dir)), "imputed_value")


KNOWN_AROUND = f"""{runs_sql()}, around AS (
  SELECT r.point_id, r.sensor, r.run, arg_max(b.value, b.rn) AS before FROM open_ r JOIN runs b ON b.point_id = r.point_id AND b.sensor = r.sensor AND b.rn < r.first_rn AND b.value IS NOT NULL GROUP BY ALL),
behind AS (
  SELECT r.point_id, r.sensor, r.run, arg_min(b.value, b.rn) AS after FROM open_ r JOIN runs b ON b.point_id = r.point_id AND b.sensor = r.sensor AND b.rn > r.last_rn AND b.value IS NOT NULL GROUP BY ALL),
o AS (SELECT open_.* EXCLUDE (before, after), around.before, behind.after FROM open_ LEFT JOIN around USING (point_id, sensor, run) LEFT JOIN behind USING (point_id, sensor, run))"""


@query(
    "reconstruct_known_neighbours",
    f"""WITH {KNOWN_AROUND} SELECT r.point_id, r.sensor, r.ts AS "timestamp", round(CASE WHEN is_open_ended THEN before
  ELSE before * (1 - (r.rn - first_rn)::DOUBLE / (n_points - 1)) + after * (1 - (1 - (r.rn - first_rn)::DOUBLE / (n_points - 1))) END, 6) AS imputed_value
FROM runs r JOIN o USING (point_id, sensor, run) WHERE first_rn > 1""",
)
def reconstruct_known_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last-value reconstruction between the nearest readings, where rows next to a period may be null."""
    rows = reconstruct.reconstruct_last_value(feed(spark, sf_dir), skip_null_neighbours=True)
    return rounded(rows.select(*SERIES, "timestamp", "imputed_value"), "imputed_value")


@query("reconstruct_forward_only", f"WITH {IMPUTED} SELECT {_OUT} FROM imputed WHERE imputation_method = 'last-value-forward-only'")
def reconstruct_forward_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct_lastvalue(spark, sf_dir).filter("imputation_method = 'last-value-forward-only'")


@query("reconstruct_pandas_path", f"WITH {IMPUTED} SELECT {_OUT} FROM imputed")
def reconstruct_pandas_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconstruct.reconstruct(feed(spark, sf_dir), LastValue()), "imputed_value")


#: The line through the first and the last of up to 512 values before a period, and of those after it read backwards.
DRIFT = f"""{runs_sql()}, known AS (SELECT point_id, sensor, rn, value FROM runs WHERE value IS NOT NULL),
p AS (SELECT * FROM open_ WHERE first_rn > 1),
b AS (
  SELECT p.point_id, p.sensor, run, first_rn - 1 - max(k.rn) AS gap_, arg_max(k.value, k.rn) AS near,
    CASE WHEN count(*) > 1 THEN (arg_max(k.value, k.rn) - arg_min(k.value, k.rn)) / (max(k.rn) - min(k.rn)) ELSE 0 END AS slope
  FROM p JOIN known k ON k.point_id = p.point_id AND k.sensor = p.sensor AND k.rn BETWEEN first_rn - 512 AND first_rn - 1 GROUP BY p.point_id, p.sensor, run, first_rn),
a AS (
  SELECT p.point_id, p.sensor, run, min(k.rn) - 1 - last_rn AS gap_, arg_min(k.value, k.rn) AS near,
    CASE WHEN count(*) > 1 THEN (arg_min(k.value, k.rn) - arg_max(k.value, k.rn)) / (max(k.rn) - min(k.rn)) ELSE 0 END AS slope
  FROM p JOIN known k ON k.point_id = p.point_id AND k.sensor = p.sensor AND k.rn BETWEEN last_rn + 1 AND last_rn + 512 GROUP BY p.point_id, p.sensor, run, last_rn),
line AS (
  SELECT r.point_id, r.sensor, r.ts, r.value, r.rn - first_rn AS i, n_points AS n, before, after, is_open_ended, start_time, b.near + b.slope * (b.gap_ + r.rn - first_rn + 1) AS f,
    a.near + a.slope * (a.gap_ + last_rn - r.rn + 1) AS k, b.near + b.slope * (b.gap_ + 1) AS f0, b.near + b.slope * (b.gap_ + n_points) AS f1,
    a.near + a.slope * (a.gap_ + n_points) AS k0, a.near + a.slope * (a.gap_ + 1) AS k1
  FROM runs r JOIN p USING (point_id, sensor, run) LEFT JOIN b USING (point_id, sensor, run) LEFT JOIN a USING (point_id, sensor, run)),
blended AS (
  SELECT *, CASE WHEN is_open_ended THEN f ELSE f * (1 - i::DOUBLE / (n - 1)) + k * (i::DOUBLE / (n - 1)) END AS y,
    f0 AS first_, CASE WHEN is_open_ended THEN f1 ELSE k1 END AS last_, least(3, n)::DOUBLE AS w FROM line),
started AS (SELECT *, y + (before - first_) * greatest(0, 1 - i / w) AS s, last_ + (before - first_) * greatest(0, 1 - (n - 1) / w) AS e FROM blended)"""


DRIFT_ROWS = f"""WITH {DRIFT} SELECT point_id, sensor, ts AS "timestamp", value AS raw_value,
  round(CASE WHEN is_open_ended THEN s ELSE s + (after - e) * greatest(0, 1 - (n - 1 - i) / w) END, 6) AS imputed_value,
  CASE WHEN is_open_ended THEN 'drift-forward-only' ELSE 'drift-bidirectional' END AS imputation_method,
  CASE WHEN is_open_ended THEN 'PROVISIONAL' ELSE 'RECONCILED' END AS imputation_confidence, '1' AS imputation_model_version, start_time AS period_start FROM started"""


@query("reconstruct_drift", DRIFT_ROWS)
def reconstruct_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecaster over up to 512 values of context, in chunks of 64 steps (its SQL holds for periods of one chunk)."""
    return rounded(reconstruct.reconstruct(feed(spark, sf_dir), Drift()), "imputed_value")


@query("reconstruct_drift_chunked", DRIFT_ROWS)
def reconstruct_drift_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for series of any length: runs and contexts by chunks of a day."""
    return rounded(reconstruct.reconstruct(feed(spark, sf_dir), Drift(), chunk_hours=24), "imputed_value")


#: A feed that stands still for four days of eight, so that periods are longer than a chunk of forecasts.
SLOW = """feed AS (
  SELECT 'dev-' || (user_id % 3)::VARCHAR AS point_id, event_type AS sensor, ts, event_id, CASE WHEN event_id % 17 <> 0 THEN
    CASE WHEN epoch_us(ts) // 345600000000 % 2 = 0 THEN (epoch_us(ts) // 345600000000)::DOUBLE ELSE (floor(value / 50) * 50)::DOUBLE END END AS value
  FROM events)"""


def slow_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 345_600_000_000)
    rows = feed(spark, sf_dir)
    return rows.withColumn("value", F.when(F.col("value").isNotNull(), F.when(block % 2 == 0, block.cast("double")).otherwise(F.col("value"))))


_KNOWN = "list_filter(range(1, len(seen) + 1), lambda j: seen[j] IS NOT NULL)"
DRIFT_STEP = f"""(SELECT list_transform(range(1, 65), lambda i: seen[k[-1]] + CASE WHEN len(k) > 1 THEN (seen[k[-1]] - seen[k[1]]) / (k[-1] - k[1]) ELSE 0 END * (len(seen) - k[-1] + i))
  FROM (SELECT {_KNOWN} AS k))"""
SEASON_STEP = "list_transform(range(0, 64), lambda i: seen[greatest(len(seen) - 24, 0) + 1 + i % least(24, len(seen))])"


def folded_sql(step: str, context: int, name: str) -> str:
    """Reconstruction by a forecaster in chunks of 64: the recurrence over chunks is a recursive query."""
    key = "point_id, sensor, run"
    near = lambda between, order: f"SELECT p.point_id, p.sensor, p.run, list(r.value ORDER BY r.rn {order}) AS x FROM p JOIN runs r ON r.point_id = p.point_id AND r.sensor = p.sensor AND r.rn BETWEEN {between} GROUP BY ALL"
    return f"""WITH RECURSIVE {runs_sql(1, SLOW)}, p AS (SELECT * FROM open_ WHERE first_rn > 1),
c AS (SELECT 'f' AS way, * FROM ({near(f"first_rn - {context} AND first_rn - 1", "")}) UNION ALL SELECT 'b', * FROM ({near(f"last_rn + 1 AND last_rn + {context}", "DESC")})),
fold AS (
  SELECT way, {key}, n_points AS n, x AS seen, []::DOUBLE[] AS made FROM c JOIN p USING ({key})
  UNION ALL
  SELECT way, {key}, n, list_slice(seen || y, greatest(1, len(seen) + 64 - {context - 1}), len(seen) + 64), made || y
  FROM (SELECT *, {step} AS y FROM fold WHERE len(made) < n)),
done AS (SELECT * FROM fold WHERE len(made) >= n),
line AS (
  SELECT r.point_id, r.sensor, r.ts, r.value, r.rn - first_rn AS i, n_points AS n, before, after, is_open_ended, start_time,
    f.made[r.rn - first_rn + 1] AS f, b.made[last_rn - r.rn + 1] AS k, f.made[1] AS f0_, f.made[n_points] AS f1, b.made[n_points] AS k0, b.made[1] AS k1
  FROM runs r JOIN p USING ({key}) LEFT JOIN (SELECT {key}, made FROM done WHERE way = 'f') f USING ({key}) LEFT JOIN (SELECT {key}, made FROM done WHERE way = 'b') b USING ({key})),
blended AS (
  SELECT *, CASE WHEN is_open_ended THEN f ELSE f * (1 - i::DOUBLE / (n - 1)) + k * (i::DOUBLE / (n - 1)) END AS y,
    CASE WHEN is_open_ended THEN f0_ ELSE f0_ + 0 * k0 END AS f0, CASE WHEN is_open_ended THEN f1 ELSE 0 * f1 + k1 END AS last_, least(3, n)::DOUBLE AS w FROM line),
started AS (SELECT *, y + (before - f0) * greatest(0, 1 - i / w) AS s, last_ + (before - f0) * greatest(0, 1 - (n - 1) / w) AS e FROM blended)
SELECT point_id, sensor, ts AS "timestamp", n AS n_points, round(CASE WHEN is_open_ended THEN s ELSE s + (after - e) * greatest(0, 1 - (n - 1 - i) / w) END, 5) + 0::DOUBLE AS imputed_value,
  '{name}-' || CASE WHEN is_open_ended THEN 'forward-only' ELSE 'bidirectional' END AS imputation_method FROM started"""


def long_periods(spark: SparkSession, sf_dir: str, model: Forecaster) -> DataFrame:
    rows = reconstruct.reconstruct(slow_feed(spark, sf_dir), model)
    sizes = rows.groupBy(*SERIES, "period_start").agg(F.count(F.lit(1)).alias("n_points"))
    return rows.join(sizes, [*SERIES, "period_start"]).select(*SERIES, "timestamp", "n_points", (F.round("imputed_value", 5) + 0.0).alias("imputed_value"), "imputation_method")


@query("reconstruct_drift_long", folded_sql(DRIFT_STEP, 512, "drift"))
def reconstruct_drift_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of several chunks: the fold over arrays in the JVM, a recursive query in SQL."""
    return long_periods(spark, sf_dir, Drift())


@query("reconstruct_seasonal_long", folded_sql(SEASON_STEP, 24, "seasonal-naive-24"))
def reconstruct_seasonal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_periods(spark, sf_dir, SeasonalNaive(24))


@query(
    "imputed_latest",
    f"""WITH {IMPUTED}, twice AS (SELECT *, 1 AS write_seq, imputed_value AS v FROM imputed UNION ALL SELECT *, 2, imputed_value + 1 FROM imputed WHERE raw_value IS NOT NULL)
SELECT point_id, sensor, "timestamp", round(v, 6) AS v, write_seq FROM twice
QUALIFY row_number() OVER (PARTITION BY point_id, sensor, "timestamp" ORDER BY imputation_confidence = 'RECONCILED' DESC, write_seq DESC) = 1""",
)
def imputed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = reconstruct.reconstruct_last_value(feed(spark, sf_dir)).withColumn("write_seq", F.lit(1)).withColumn("v", F.col("imputed_value"))
    again = once.filter("raw_value IS NOT NULL").withColumn("write_seq", F.lit(2)).withColumn("v", F.col("imputed_value") + 1)
    return rounded(sinks.latest(once.unionByName(again)).select(*SERIES, "timestamp", "v", "write_seq"), "v")


@query("upserted_latest", SQL["imputed_latest"])
def upserted_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a table that rewrites touched partitions: batches out of order, one of them twice."""
    early, late = "timestamp < '2024-01-16'", "timestamp >= '2024-01-16'"
    with scratch(spark, "upserts") as (where, keep):
        reconstruct.reconstruct_last_value(feed(spark, sf_dir)).write.parquet(f"{where}/imputed")  # each batch reads its rows more than once
        once = spark.read.parquet(f"{where}/imputed").withColumn("write_seq", F.lit(1)).withColumn("v", F.col("imputed_value"))
        again = once.filter("raw_value IS NOT NULL").withColumn("write_seq", F.lit(2)).withColumn("v", F.col("imputed_value") + 1)
        table = upserts.LatestTable(spark, f"{where}/table", buckets=4, days=30)
        for batch, rows in ((3, again.filter(late)), (1, once.filter(early)), (2, once.filter(late)), (3, again.filter(late)), (4, again.filter(early)), (1, once.filter(early))):
            table.upsert(rows, batch)
        return keep(rounded(table.read().select(*SERIES, "timestamp", "v", "write_seq"), "v"))


@query("confidence_by_method", f"WITH {IMPUTED} SELECT imputation_method, imputation_confidence, count(*)::BIGINT AS n FROM imputed GROUP BY ALL")
def confidence_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reconstruct.reconstruct_last_value(feed(spark, sf_dir))
    return rows.groupBy("imputation_method", confidence(F.col("imputation_method")).alias("imputation_confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("buffer_tail", f"WITH {FEED} SELECT point_id, sensor, ts, value FROM feed QUALIFY row_number() OVER (PARTITION BY point_id, sensor ORDER BY ts DESC) <= 50")
def buffer_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.newest(feed(spark, sf_dir), 50).select(*SERIES, "ts", "value")


_HOURS = "h AS (SELECT point_id, sensor, date_trunc('hour', ts) AS ts, value, event_id FROM feed)"


@query("buffer_dedup_last", f"WITH {FEED}, {_HOURS} SELECT point_id, sensor, ts, value, event_id FROM h QUALIFY row_number() OVER (PARTITION BY point_id, sensor, ts ORDER BY event_id DESC) = 1")
def buffer_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return buffers.last_arrival(rows, "event_id").select(*SERIES, "ts", "value", "event_id")


@query("ingest_dedup", f"WITH {FEED}, {_HOURS} SELECT point_id, sensor, ts, value FROM h QUALIFY row_number() OVER (PARTITION BY point_id, sensor, ts ORDER BY event_id DESC) = 1")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return src.distinct_times(rows, "event_id")


def live_run(spark: SparkSession, sf_dir: str, where: str, **parameters: int) -> None:
    """A live run over the whole feed, message by message in order of time: updates in ``out``, state in ``state``."""
    messages = feed(spark, sf_dir).select(*SERIES, F.col("ts").cast("timestamp").alias("ts"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"))
    messages.write.parquet(f"{where}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(messages.schema).parquet(f"{where}/in")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    updates = live.live_updates(stream, **parameters)
    q = updates.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()


@query(
    "live_final_state",
    f"""WITH {IMPUTED}, p AS (SELECT point_id, sensor, start_time AS period_start, valid_before FROM open_)
SELECT point_id, sensor, "timestamp", round(imputed_value, 6) AS imputed_value, imputation_method AS method, imputation_confidence AS confidence
FROM imputed JOIN p USING (point_id, sensor, period_start) WHERE valid_before >= 5""",
)
def live_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each window, with a buffer far longer than any period and its context: a longer series only loses what is final."""
    with scratch(spark, "live") as (where, keep):
        live_run(spark, sf_dir, where, max_points=1_000_000)
        newest = live.newest_windows(spark.read.schema(live.UPDATE).parquet(f"{where}/out"), None)
        rows = newest.select(*SERIES, "method", "confidence", F.explode(F.arrays_zip("times", "values")).alias("x"))
        return keep(rows.select(*SERIES, F.col("x.times").cast("timestamp_ntz").alias("timestamp"), F.round("x.values", 6).alias("imputed_value"), "method", "confidence"))


@query("snapshot_state", f"WITH {FEED} SELECT point_id, sensor, ts, value FROM feed QUALIFY row_number() OVER (PARTITION BY point_id, sensor ORDER BY ts DESC) <= 50")
def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 readings of every series out of the state of a live run, without its log."""
    with scratch(spark, "snapshot") as (where, keep):
        live_run(spark, sf_dir, where, max_points=50)
        readings, _ = live.snapshot_from_state(spark, f"{where}/state")
        return keep(readings.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("first_messages", f"WITH {FEED} SELECT point_id, sensor, ts, value, event_id FROM feed ORDER BY ts, event_id LIMIT 500")
def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is a bounded number of messages."""
    return src.first_messages(feed(spark, sf_dir), 500, "ts", "event_id")


@query("series_keys", f"WITH {FEED} SELECT DISTINCT point_id, sensor FROM feed")
def series_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.series_keys(feed(spark, sf_dir))


@query("counts_per_point", f"WITH {IMPUTED} SELECT point_id, count(*)::BIGINT AS n FROM imputed GROUP BY ALL")
def counts_per_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.reconstruct_last_value(feed(spark, sf_dir)).groupBy("point_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "replay_delays",
    f"WITH {FEED} SELECT event_id, round(greatest(date_diff('microsecond', ts, lead(ts) OVER ({W}))::DOUBLE / 1000000 / 60, 0), 9) AS delay_seconds FROM feed QUALIFY lead(ts) OVER ({W}) IS NOT NULL",
)
def replay_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = buffers.replay(feed(spark, sf_dir)).withColumn("last", F.lead("ts").over(buffers.Window.partitionBy(*SERIES).orderBy("ts")).isNull())
    return gap.filter("NOT last").select("event_id", F.round("delay_seconds", 9).alias("delay_seconds"))


@query("replay_remap", f"WITH {FEED} SELECT event_id, TIMESTAMP '2025-06-01 12:00:00' + (ts - min(ts) OVER (PARTITION BY point_id, sensor)) AS replay_ts FROM feed")
def replay_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buffers.replay(feed(spark, sf_dir), now="2025-06-01 12:00:00").select("event_id", "replay_ts")


_ISO = "CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'"


@query(
    "message_json",
    f"""WITH {FEED} SELECT point_id AS key, '{{"point_id":"' || point_id || '","sensor":"' || sensor || '","timestamp":"' || {_ISO} || '","value":' ||
  coalesce(value::BIGINT::VARCHAR || '.0', 'null') || '}}' AS value FROM feed""",
)
def message_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.message_json(feed(spark, sf_dir))


_POINT = f"""'{{"type":"point","point_id":"' || point_id || '","sensor":"' || sensor || '","timestamp":"' || {_ISO} || '","value":' || coalesce(value::BIGINT::VARCHAR || '.0', 'null') || '}}'"""
_ISO_OF = lambda c: re.sub(r"\bts\b", c, _ISO)


@query(
    "feed_messages",
    f"""WITH {runs_sql()}, w AS (
  SELECT o.point_id, o.sensor, o.start_time, o.end_time, o.is_open_ended, list(r.ts ORDER BY r.rn) AS times
  FROM open_ o JOIN runs r USING (point_id, sensor, run) WHERE o.valid_before >= 5 GROUP BY ALL)
SELECT point_id, sensor, {_POINT} AS message FROM feed
UNION ALL SELECT point_id, sensor, '{{"type":"reconstruction","point_id":"' || point_id || '","sensor":"' || sensor || '","start_time":"' || {_ISO_OF("start_time")} || '","end_time":"' || {_ISO_OF("end_time")} ||
  '","method":"last-value-' || CASE WHEN is_open_ended THEN 'forward-only","confidence":"PROVISIONAL' ELSE 'bidirectional","confidence":"RECONCILED' END || '","values":[' ||
  array_to_string(list_transform(times, lambda t: '{{"timestamp":"' || {_ISO_OF("t")} || '","value":null}}'), ',') || ']}}' FROM w""",
)
def feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading, and the last version of every window of a live run, as messages of the feed; windows' values, which are numbers, are left out to compare texts."""
    rows = feed(spark, sf_dir).select(F.lit("point").alias("type"), *SERIES, F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "value")
    given = set(rows.columns)
    points = rows.select(*(F.col(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in live.UPDATE.fields))
    with scratch(spark, "messages") as (where, keep):
        live_run(spark, sf_dir, where, max_points=1_000_000)
        windows = live.newest_windows(spark.read.schema(live.UPDATE).parquet(f"{where}/out"), None)
        windows = windows.withColumn("values", F.transform("values", lambda _: F.lit(None).cast("double")))
        return keep(live.update_messages(points.unionByName(windows.select(*points.columns))).drop("seq"))


@query("iso_times", f"SELECT event_id, {_ISO} AS iso FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", iso(F.col("ts")).alias("iso"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_IN_TABLES = " OR ".join(f"table_name = '{t}'" for t in TABLES)


@query(
    "schema_keyword_search",
    f"""WITH f AS (SELECT table_name AS type, column_name AS field FROM information_schema.columns WHERE {_IN_TABLES})
SELECT type, field, CAST(NULL AS VARCHAR) AS description FROM f WHERE contains(lower(type || ' ' || field), 'key') OR contains(lower(type || ' ' || field), 'event')""",
)
def schema_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over the schemas of the given tables: each table is a type, its columns are the fields."""
    types = [(t, "OBJECT", None, [(c, None, None) for c in spark.read.parquet(f"{sf_dir}/{t}.parquet").columns]) for t in TABLES]
    return catalog.matching_fields(spark.createDataFrame([(types,)], catalog.SCHEMA), ("KEY", "event"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection and reconstruction over the whole feed."""
    return reconstruct.reconstruct_last_value(feed(spark, sf_dir))
