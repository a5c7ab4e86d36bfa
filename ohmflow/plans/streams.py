"""Streaming queries (D8-D9): the events table read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table
from ..streaming import live
from .registry import query, rounded

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events_stream(spark, d):
    return live.file_stream(spark, d, EVENTS_SCHEMA, glob="events.parquet")


@query("stream_alerts", sql="""
SELECT event_id, ts, user_id, value, 'danger' AS status FROM events WHERE value > 250""")
def q_stream_alerts(spark, d):
    # the table arrives twice (two sources): every event has a copy to remove
    s = _events_stream(spark, d).unionByName(_events_stream(spark, d))
    a = live.alarms(s.select("event_id", "ts", "user_id", "value"), "ts", ["event_id"], "value", 250.0,
                    delay="1 hour")
    root = scratch_path(spark, "alerts")
    live.run_available_now(a, f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


@query("stream_resample", sql="""
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, COUNT(*) AS n,
                  AVG(value) AS mean_value FROM events GROUP BY ALL)
SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, n, ROUND(mean_value, 6) AS mean_value
FROM w""")
def q_stream_resample(spark, d):
    """D9 over the whole table: the stream's closed windows and a batch pass for those still open."""
    root = scratch_path(spark, "resample")
    s = _events_stream(spark, d).select("ts", "event_type", "value")
    m = live.tumbling_mean(s, "ts", ["event_type"], "value", window="1 hour", delay="10 minutes")
    mark = live.run_available_now(m, f"{root}/out", f"{root}/ckpt")
    events = table(spark, d, "events").select("ts", "event_type", "value")
    return rounded(live.windows_so_far(spark, events, f"{root}/out", "ts", ["event_type"], "value", "1 hour", mark))


@query("device_state", sql="""
WITH n AS (SELECT user_id, MAX((ts, event_id, value)) AS x FROM events GROUP BY user_id)
SELECT user_id, x[1] AS ts, x[2] AS event_id, x[3] AS value, CASE WHEN x[3] > 250 THEN 'danger' ELSE 'success' END AS status
FROM n""")
def q_device_state(spark, d):
    """Newest reading and status per device, kept up to date by the stream."""
    root = scratch_path(spark, "device-state")
    s = _events_stream(spark, d).select("user_id", "ts", "event_id", "value")
    live.run_updates(live.device_state(s, "user_id", "ts", "event_id", "value", 250.0), f"{root}/out", f"{root}/ckpt")
    return live.current_state(spark, f"{root}/out", "user_id")
