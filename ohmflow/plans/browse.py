"""Browsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import browse, quality, relate
from ..sources.tables import (READINGS_ORDER, devices_customer, experiments_orders, readings_lineitem,
                              table)
from . import roles
from .registry import query

@query("recent_experiments", sql="WITH " + roles.EXPERIMENTS + """
SELECT experiment_name, experiment_type, status, result, start_time, device_id FROM experiments
ORDER BY created_at DESC NULLS FIRST, id LIMIT 5""")
def q_recent_experiments(spark, d):
    return browse.home_cards(browse.newest(experiments_orders(spark, d), "created_at", "id", n=5))


@query("recent_experiments_no_device", sql="WITH " + roles.EXPERIMENTS + f"""
SELECT experiment_name, experiment_type, status, '' AS result, start_time, '{schemas.UNKNOWN_DEVICE_LABEL}' AS device_id
FROM experiments ORDER BY created_at DESC NULLS FIRST, id LIMIT 5""")
def q_recent_experiments_no_device(spark, d):
    """P12 where the table has no device and no result column."""
    e = experiments_orders(spark, d).drop("device_id", "result")
    return browse.home_cards(browse.newest(e, "created_at", "id", n=5))


@query("recent_experiments_offset", sql="WITH " + roles.EXPERIMENTS + """
SELECT * FROM experiments ORDER BY created_at DESC NULLS FIRST, id LIMIT 5 OFFSET 2""")
def q_recent_experiments_offset(spark, d):
    return browse.newest(experiments_orders(spark, d), "created_at", "id", n=5, offset=2)


@query("experiment_readings", sql="WITH " + roles.READINGS_LI + """
SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, current, voltage, timestamp,
       CAST(ROW_NUMBER() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS sequence_number
FROM rl WHERE experiment_id = 1 ORDER BY l_linenumber, l_partkey, l_suppkey LIMIT 1000""")
def q_experiment_readings(spark, d):
    r = readings_lineitem(spark, d).select("experiment_id", *READINGS_ORDER, "current", "voltage", "timestamp")
    return browse.readings_page(r, "experiment_id", 1, READINGS_ORDER, n=1000)


@query("event_readings_page", sql="""
SELECT event_type, ts, event_id, value, CAST(ROW_NUMBER() OVER (ORDER BY ts, event_id) AS INTEGER) AS sequence_number
FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 1000""")
def q_event_readings_page(spark, d):
    """Q2 where the page is full: a key of more than a thousand readings."""
    e = table(spark, d, "events").select("event_type", "ts", "event_id", "value")
    return browse.readings_page(e, "event_type", "click", ["ts", "event_id"])


@query("device_list", sql="WITH " + roles.DEVICES + " SELECT * FROM devices ORDER BY device_serial NULLS LAST")
def q_device_list(spark, d):
    return browse.sorted_list(devices_customer(spark, d), "device_serial")


@query("standards_by_type", sql="WITH " + roles.EXPERIMENTS + ", " + roles.standards_values() + """
SELECT e.id, e.experiment_type, s.standard_code FROM experiments e JOIN std s ON e.experiment_type = s.test_type
WHERE s.test_type = 'dielectric'""")
def q_standards_by_type(spark, d):
    std = quality.filter_eq(relate.standards_frame(spark), test_type="dielectric")
    e = experiments_orders(spark, d).select("id", "experiment_type")
    # the seed standards table has four rows: a proven bound for the broadcast
    return e.join(F.broadcast(std.select("standard_code", "test_type")),
                  F.col("experiment_type") == F.col("test_type")).select("id", "experiment_type", "standard_code")


@query("single_row", sql="""
SELECT * FROM orders WHERE o_orderkey = 42 AND (SELECT COUNT(*) FROM orders WHERE o_orderkey = 42) = 1""")
def q_single_row(spark, d):
    return browse.single_row(table(spark, d, "orders"), F.col("o_orderkey") == 42)


@query("preview_head", sql="""
SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100""")
def q_preview_head(spark, d):
    return browse.preview_head(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("history_range", sql="""
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 23:59:59.999999'""")
def q_history_range(spark, d):
    return browse.history_range(table(spark, d, "events"), "ts", "2024-01-10 00:00:00", "2024-01-12 23:59:59.999999")
