"""Series queries (T1-T2, W1-W3, D10, energy) over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series, stats
from ..sources.tables import series_events, table
from .registry import query, rounded

SERIES_COLS = ["key", "seq", "ts", "x"]


@query("resample_mean", sql="""
WITH b AS (
  SELECT event_type, ts, event_id, user_id, value,
         CAST(CAST(MIN(ts) OVER (PARTITION BY event_type) AS DATE) AS TIMESTAMP) AS origin
  FROM events WHERE ts IS NOT NULL),
g AS (
  SELECT event_type, origin, CAST(FLOOR((epoch_us(ts) - epoch_us(origin)) / 420000000) AS BIGINT) AS bin,
         AVG(event_id) AS event_id, AVG(user_id) AS user_id, AVG(value) AS value
  FROM b GROUP BY ALL),
s AS (SELECT event_type, origin, MIN(bin) AS b0, MAX(bin) AS b1 FROM g GROUP BY event_type, origin),
sp AS (SELECT event_type, origin, UNNEST(generate_series(b0, b1)) AS bin FROM s)
SELECT sp.event_type, sp.origin + to_microseconds(sp.bin * 420000000) AS ts,
       ROUND(g.event_id, 6) AS event_id, ROUND(g.user_id, 6) AS user_id, ROUND(g.value, 6) AS value
FROM sp LEFT JOIN g ON sp.event_type = g.event_type AND sp.bin = g.bin""")
def q_resample_mean(spark, d):
    e = table(spark, d, "events").select("event_type", "ts", "event_id", "user_id", "value")
    return rounded(series.resample_mean(e, ts="ts", freq="7min", keys=["event_type"]))


@query("parse_timestamps", sql="""
SELECT event_id,
       CASE event_type WHEN 'error' THEN 'n/a' WHEN 'click' THEN strftime(ts, '%Y/%-m/%-d %-H:%-M:%-S')
            ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts_text,
       CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN date_trunc('second', ts) ELSE ts END AS ts_parsed
FROM events""")
def q_parse_timestamps(spark, d):
    e = table(spark, d, "events")
    et = F.col("event_type")
    text = (F.when(et == "error", F.lit("n/a")).when(et == "click", F.date_format("ts", "yyyy/M/d H:m:s"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    t = e.select("event_id", text.alias("ts_text"))
    return series.parse_timestamps(t, "ts_text", out="ts_parsed")


_WIN = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query("filter_moving_average", sql=f"""
SELECT user_id AS key, event_id AS seq, ts, value AS x,
       ROUND(CASE WHEN COUNT(value) OVER w = 5 THEN AVG(value) OVER w ELSE value END, 6) AS x_filtered
FROM events {_WIN}""")
def q_filter_moving_average(spark, d):
    s = series_events(spark, d).select(*SERIES_COLS)
    return rounded(series.filter_data(s, "x", "moving_average", 5, keys=["key"], order=["ts", "seq"]))


@query("filter_median", sql=f"""
SELECT user_id AS key, event_id AS seq, ts, value AS x,
       ROUND(CASE WHEN COUNT(value) OVER w = 5 THEN MEDIAN(value) OVER w ELSE value END, 6) AS x_filtered
FROM events {_WIN}""")
def q_filter_median(spark, d):
    s = series_events(spark, d).select(*SERIES_COLS)
    return rounded(series.filter_data(s, "x", "median", 5, keys=["key"], order=["ts", "seq"]))


def _exponential_sql(key: str, span: int) -> str:
    """The recursion row by row; error events are missing values."""
    a = f"(2.0 / {span + 1})"
    return f"""
WITH RECURSIVE s AS (
  SELECT {key} AS key, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x,
         ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn
  FROM events),
r AS (
  SELECT key, rn, x AS y, CASE WHEN x IS NULL THEN NULL ELSE 0 END AS gap FROM s WHERE rn = 1
  UNION ALL
  SELECT s.key, s.rn,
         CASE WHEN s.x IS NULL THEN r.y WHEN r.y IS NULL THEN s.x
              ELSE (POW(1 - {a}, r.gap + 1) * r.y + {a} * s.x) / (POW(1 - {a}, r.gap + 1) + {a}) END,
         CASE WHEN s.x IS NULL THEN r.gap + 1 ELSE 0 END
  FROM r JOIN s ON s.key = r.key AND s.rn = r.rn + 1)
SELECT s.key, s.event_id AS seq, s.ts, s.x, ROUND(COALESCE(r.y, s.x), 6) AS x_filtered
FROM s JOIN r ON s.key = r.key AND s.rn = r.rn"""


def _gappy(spark, d, key):
    s = series_events(spark, d).withColumn("key", key)
    return s.select("key", "seq", "ts", F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
                    .otherwise(F.col("x")).alias("x"))


@query("filter_exponential", sql=_exponential_sql("user_id", 5))
def q_filter_exponential(spark, d):
    s = _gappy(spark, d, F.col("key"))
    return rounded(series.filter_data(s, "x", "exponential", 5, keys=["key"], order=["ts", "seq"]))


@query("filter_exponential_span", sql=_exponential_sql("user_id", 1000))
def q_filter_exponential_span(spark, d):
    """W3 with a span far beyond the rows of a key."""
    s = _gappy(spark, d, F.col("key"))
    return rounded(series.filter_data(s, "x", "exponential", 1000, keys=["key"], order=["ts", "seq"]))


@query("filter_exponential_unkeyed", sql=_exponential_sql("0", 5))
def q_filter_exponential_unkeyed(spark, d):
    """W3 over one series holding the whole table."""
    s = _gappy(spark, d, F.lit(0))
    out = series.filter_data(s.drop("key"), "x", "exponential", 5, keys=[], order=["ts", "seq"])
    return rounded(out.withColumn("key", F.lit(0)))


@query("filter_exponential_blocked", sql=_exponential_sql("CASE WHEN event_type = 'click' THEN 1 ELSE 2 END", 50))
def q_filter_exponential_blocked(spark, d):
    """W3 over two hot keys, each spread over many blocks."""
    s = _gappy(spark, d, F.when(F.col("event_type") == "click", 1).otherwise(2))
    return rounded(series.filter_data(s, "x", "exponential", 50, keys=["key"], order=["ts", "seq"]))


@query("downsample_minmax", sql="""
WITH r AS (SELECT user_id, ts, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
                  COUNT(*) OVER (PARTITION BY user_id) AS nk FROM events)
SELECT user_id, CAST(FLOOR((rn - 1) * 10 / nk) AS BIGINT) AS bucket, COUNT(*) AS n_points,
       MIN(ts) AS ts_first, MAX(ts) AS ts_last,
       ROUND(MIN(value), 6) AS value_min, FIRST(ts ORDER BY value, rn) AS ts_min,
       ROUND(MAX(value), 6) AS value_max, FIRST(ts ORDER BY value DESC, rn) AS ts_max
FROM r GROUP BY ALL""")
def q_downsample_minmax(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return rounded(series.downsample_minmax(e, ["user_id"], ["ts", "event_id"], "ts", "value", buckets=10))


@query("energy_kwh", sql="""
WITH r AS (
  SELECT user_id, value,
         (epoch_us(ts) - epoch_us(LAG(ts) OVER w)) / 1e6 AS back,
         (epoch_us(LEAD(ts) OVER w) - epoch_us(ts)) / 1e6 AS fwd
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, ROUND(SUM(value * COALESCE(back, fwd, 1.0)) / 3.6e6, 6) AS energy_kwh
FROM r GROUP BY user_id""")
def q_energy_kwh(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    dt = series.interval_seconds(e, ["user_id"], ["ts", "event_id"], "ts")
    return rounded(stats.energy_kwh(dt, ["user_id"], power="value"))


@query("filter_moving_average_unkeyed", sql="""
SELECT event_id AS seq, ts, value AS x,
       ROUND(CASE WHEN COUNT(value) OVER w = 5 THEN AVG(value) OVER w ELSE value END, 6) AS x_filtered
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q_filter_moving_average_unkeyed(spark, d):
    """W1 over one series holding the whole table (no key): the case of one giant experiment."""
    s = series_events(spark, d).select("seq", "ts", "x")
    return rounded(series.filter_data(s, "x", "moving_average", 5, keys=[], order=["ts", "seq"]))


@query("filter_median_unkeyed", sql="""
SELECT event_id AS seq, ts, value AS x,
       ROUND(CASE WHEN COUNT(value) OVER w = 5 THEN MEDIAN(value) OVER w ELSE value END, 6) AS x_filtered
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def q_filter_median_unkeyed(spark, d):
    s = series_events(spark, d).select("seq", "ts", "x")
    return rounded(series.filter_data(s, "x", "median", 5, keys=[], order=["ts", "seq"]))


@query("filter_moving_average_blocked", sql="""
SELECT event_type AS key, event_id AS seq, ts, value AS x,
       ROUND(CASE WHEN COUNT(value) OVER w = 301 THEN AVG(value) OVER w ELSE value END, 6) AS x_filtered
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 150 PRECEDING AND 150 FOLLOWING)""")
def q_filter_moving_average_blocked(spark, d):
    """W1 over five hot keys with a frame of 301 rows that reaches over block borders."""
    s = series_events(spark, d).withColumn("key", F.col("event_type")).select(*SERIES_COLS)
    return rounded(series.filter_data(s, "x", "moving_average", 301, keys=["key"], order=["ts", "seq"]))


@query("resample_hourly", sql="""
WITH g AS (
  SELECT user_id, CAST(FLOOR(epoch_us(ts) / 3600000000) AS BIGINT) AS bin, AVG(event_id) AS event_id,
         AVG(value) AS value
  FROM events WHERE ts IS NOT NULL GROUP BY ALL),
s AS (SELECT user_id, MIN(bin) AS b0, MAX(bin) AS b1 FROM g GROUP BY user_id),
sp AS (SELECT user_id, UNNEST(generate_series(b0, b1)) AS bin FROM s)
SELECT sp.user_id, TIMESTAMP '1970-01-01 00:00:00' + to_microseconds(sp.bin * 3600000000) AS ts,
       ROUND(g.event_id, 6) AS event_id, ROUND(g.value, 6) AS value
FROM sp LEFT JOIN g ON sp.user_id = g.user_id AND sp.bin = g.bin""")
def q_resample_hourly(spark, d):
    """T1 keyed by user with a step that divides a day (epoch-aligned bins, no per-reading origin join)."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return rounded(series.resample_mean(e, ts="ts", freq="1h", keys=["user_id"]))


def _downsample_sql(key: str, buckets: int) -> str:
    return f"""
WITH r AS (SELECT {key} AS key, ts, value, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn,
                  COUNT(*) OVER (PARTITION BY {key}) AS nk FROM events)
SELECT key, CAST((rn - 1) * {buckets} // nk AS BIGINT) AS bucket, COUNT(*) AS n_points,
       MIN(ts) AS ts_first, MAX(ts) AS ts_last,
       ROUND(MIN(value), 6) AS value_min, FIRST(ts ORDER BY value, rn) AS ts_min,
       ROUND(MAX(value), 6) AS value_max, FIRST(ts ORDER BY value DESC, rn) AS ts_max
FROM r GROUP BY ALL"""


@query("downsample_minmax_blocked", sql=_downsample_sql("event_type", 1000))
def q_downsample_minmax_blocked(spark, d):
    """D10 over five hot keys with the default 1000 buckets."""
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), "ts", "event_id", "value")
    return rounded(series.downsample_minmax(e, ["key"], ["ts", "event_id"], "ts", "value"))


@query("downsample_minmax_100k", sql=_downsample_sql("0", 100_000))
def q_downsample_minmax_100k(spark, d):
    """D10 at its target: the whole table as one series, 100,000 buckets."""
    e = table(spark, d, "events").select("ts", "event_id", "value")
    out = series.downsample_minmax(e, [], ["ts", "event_id"], "ts", "value", buckets=100_000)
    return rounded(out.withColumn("key", F.lit(0)))
