"""Quality queries (P1-P15) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import normalize_columns
from .. import schemas
from ..operators import quality, relate
from ..sources.tables import (READINGS_ORDER, devices_customer, experiments_orders, files_documents,
                              profiles_customer, readings_dirty, readings_ivp, readings_lineitem, series_events, table)
from . import roles
from .registry import query, rounded

KEY = ["experiment_id"]
ROW_ID = ["experiment_id", "l_linenumber", "l_partkey", "l_suppkey"]

_RULES_SQL = [
    ("current_not_numeric", "COUNT(*) FILTER (WHERE current IS NULL)"),
    ("voltage_not_numeric", "COUNT(*) FILTER (WHERE voltage IS NULL)"),
    ("power_not_numeric", "COUNT(*) FILTER (WHERE power IS NULL)"),
    ("current_negative", "COUNT(*) FILTER (WHERE current < 0)"),
    ("current_above_max", "COUNT(*) FILTER (WHERE current > 1000)"),
    ("voltage_negative", "COUNT(*) FILTER (WHERE voltage < 0)"),
    ("voltage_above_max", "COUNT(*) FILTER (WHERE voltage > 10000)"),
    ("power_mismatch", "COUNT(*) FILTER (WHERE COALESCE(ABS(power - current * voltage) > 0.05 * (current * voltage), false))"),
]
_VALIDATE_SQL = (
    "WITH " + roles.DIRTY + ", c AS (SELECT experiment_id, "
    + ", ".join(f"{e} AS r{i}" for i, (_, e) in enumerate(_RULES_SQL))
    + " FROM dirty GROUP BY experiment_id), l AS ("
    + " UNION ALL ".join(f"SELECT experiment_id, {i + 1} AS rule_no, '{n}' AS rule, r{i} AS violations FROM c"
                         for i, (n, _) in enumerate(_RULES_SQL))
    + ") SELECT *, SUM(violations) OVER (PARTITION BY experiment_id) = 0 AS valid FROM l")


@query("validate_report", sql=_VALIDATE_SQL)
def q_validate_report(spark, d):
    r = readings_dirty(spark, d).select(*KEY, "current", "voltage", "power")
    return quality.validation_report(r, keys=KEY)


@query("normalize_columns", sql="WITH " + roles.IVP + """
SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, current, voltage, power FROM ivp""")
def q_normalize_columns(spark, d):
    r = readings_ivp(spark, d).select(*ROW_ID, F.col("current").alias("电流 (A)"),
                                      F.col("voltage").alias("Voltage"), F.col("power").alias("P"))
    return normalize_columns(r)


@query("coerce_numeric", sql="WITH " + roles.DIRTY + """
SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, current, voltage, power FROM dirty""")
def q_coerce_numeric(spark, d):
    r = readings_dirty(spark, d).select(*ROW_ID, "current", "voltage", "power")
    return quality.coerce_numeric(r)


@query("range_violations", sql="WITH " + roles.READINGS_LI + """
SELECT experiment_id, COUNT(*) FILTER (WHERE current < 0) AS current_negative, COUNT(*) FILTER (WHERE current > 1000) AS current_above_max,
       COUNT(*) FILTER (WHERE voltage < 0) AS voltage_negative, COUNT(*) FILTER (WHERE voltage > 10000) AS voltage_above_max
FROM rl GROUP BY experiment_id""")
def q_range_violations(spark, d):
    return quality.range_violations(readings_lineitem(spark, d), keys=KEY)


@query("power_consistency", sql="WITH " + roles.IVP + """
SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, current, voltage, power,
       ROUND(ABS(power - current * voltage), 6) AS deviation
FROM ivp WHERE COALESCE(ABS(power - current * voltage) > 0.05 * (current * voltage), false)""")
def q_power_consistency(spark, d):
    r = readings_ivp(spark, d)
    flag = quality.power_mismatch(F.col("current"), F.col("voltage"), F.col("power"))
    out = r.where(flag).select(*ROW_ID, "current", "voltage", "power",
                               F.abs(F.col("power") - F.col("current") * F.col("voltage")).alias("deviation"))
    return rounded(out)


@query("drop_empty_rows", sql="""
WITH e AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE event_id END AS event_id,
                  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
                  CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type FROM events)
SELECT * FROM e WHERE NOT (event_id IS NULL AND value IS NULL AND event_type IS NULL)""")
def q_drop_empty_rows(spark, d):
    e = table(spark, d, "events")
    err = F.col("event_type") == "error"
    blanked = e.select(*[F.when(err, F.lit(None)).otherwise(F.col(c)).alias(c)
                         for c in ("event_id", "value", "event_type")])
    return quality.drop_empty_rows(blanked)


@query("sequence_number", sql="""
SELECT l_orderkey AS experiment_id, l_linenumber, l_partkey, l_suppkey,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS sequence_number
FROM lineitem""")
def q_sequence_number(spark, d):
    r = readings_lineitem(spark, d).select(*ROW_ID)
    return quality.sequence_numbers(r, KEY, READINGS_ORDER)


@query("shape_records", sql="""
SELECT CAST(user_id AS VARCHAR) AS experiment_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sequence_number,
       CAST(0.0 AS DOUBLE) AS current, CAST(0.0 AS DOUBLE) AS voltage, value AS power,
       1 AS device_address, '未知' AS device_type, ts AS timestamp
FROM events""")
def q_shape_records(spark, d):
    e = series_events(spark, d).select("key", "seq", F.col("ts").alias("timestamp"), F.col("x").alias("power"))
    return quality.shape_records(e, experiment_id="key", keys=[], order=["timestamp", "seq"])


@query("filter_eq", sql="SELECT * FROM orders WHERE o_orderstatus = 'F'")
def q_filter_eq(spark, d):
    return quality.filter_eq(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None)


def _checks_sql(tbl: str, columns: list[str]) -> str:
    """The constraints of the fixed lists, for the columns the role has."""
    rules = [(c, "check_in", f"{c} NOT IN ({', '.join(repr(v) for v in allowed)})")
             for c, allowed in schemas.CHECKS.get(tbl, {}).items()]
    rules += [(c, "not_null", f"{c} IS NULL") for c in schemas.NOT_NULL.get(tbl, [])]
    rules += [(c, f"varchar_{n}", f"LENGTH({c}) > {n}") for c, n in schemas.VARCHAR_LIMITS.get(tbl, {}).items()]
    return " UNION ALL ".join(
        f"SELECT '{tbl}' AS table_name, '{c}' AS column_name, '{r}' AS rule, COUNT(*) FILTER (WHERE {e}) AS violations "
        f"FROM {tbl}" for c, r, e in rules if c in columns)


# the stored tables as the test tables give them: (frame, its columns)
_STORED = {
    "devices": (lambda s, d: devices_customer(s, d), ["device_serial", "device_model", "status"]),
    "experiments": (lambda s, d: experiments_orders(s, d), ["experiment_name", "experiment_type", "status", "result"]),
    "experiment_data": (lambda s, d: readings_lineitem(s, d).withColumn("device_type", F.col("l_returnflag")),
                        ["device_type"]),
    "test_standards": (lambda s, d: relate.standards_frame(s), ["standard_code", "standard_name", "test_type"]),
    "files": (lambda s, d: files_documents(s, d), ["file_name", "file_type"]),
    "user_profiles": (lambda s, d: profiles_customer(s, d), ["full_name", "role"]),
    "operation_logs": (lambda s, d: table(s, d, "orders").select(F.col("o_orderstatus").alias("operation_type")),
                       ["operation_type"]),
}
_STD_SQL = "test_standards(standard_code, standard_name, test_type) AS (VALUES " + ", ".join(
    f"('{c}', '{n}', '{t}')" for c, n, t, _, _ in schemas.SEED_STANDARDS) + ")"
_STORED_SQL = ("WITH " + roles.EXPERIMENTS + ", " + roles.DEVICES + ", " + roles.FILES + ", "
               + roles.PROFILES.replace("profiles AS", "user_profiles AS", 1) + ", " + _STD_SQL
               + ", experiment_data AS (SELECT l_returnflag AS device_type FROM lineitem)"
               + ", operation_logs AS (SELECT o_orderstatus AS operation_type FROM orders) ")


@query("check_constraints", sql=_STORED_SQL + " UNION ALL ".join(_checks_sql(t, c) for t, (_, c) in _STORED.items()))
def q_check_constraints(spark, d):
    """P13-P14 over all seven stored tables."""
    out = None
    for t, (frame, _) in _STORED.items():
        part = quality.check_constraints(frame(spark, d), t)
        out = part if out is None else out.unionByName(part)
    return out


@query("unique_violations", sql="""
SELECT 'devices' AS table_name, 'device_serial' AS column_name, c_mktsegment || '-' || c_nationkey AS value,
       COUNT(*) AS row_count FROM customer
WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL GROUP BY 3 HAVING COUNT(*) > 1""")
def q_unique_violations(spark, d):
    """Serial numbers made of segment and nation, which many customers share."""
    c = table(spark, d, "customer")
    serial = F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"))
    return quality.unique_violations(c.select(serial.alias("device_serial")), "devices")


@query("duplicate_keys", sql="""
SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def q_duplicate_keys(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def _msg(rule: str) -> str:
    return quality._message(rule).replace("'", "''")


@query("validation_messages", sql="WITH v AS (" + _VALIDATE_SQL + "), m AS (SELECT * FROM (VALUES "
       + ", ".join(f"('{k}', '{_msg(k)}')" for k, _ in _RULES_SQL) + """) AS t(rule, message))
SELECT experiment_id, BOOL_AND(valid) AS valid,
       COALESCE(STRING_AGG(CASE WHEN violations > 0 THEN message END, '; ' ORDER BY rule_no), '') AS messages
FROM v JOIN m ON v.rule = m.rule GROUP BY experiment_id""")
def q_validation_messages(spark, d):
    r = readings_dirty(spark, d).select(*KEY, "current", "voltage", "power")
    return quality.validation_summary(r, keys=KEY)


@query("validation_missing", sql=f"""
SELECT l_orderkey AS experiment_id, false AS valid,
       '{schemas.MSG_MISSING.format(cols=', '.join(schemas.ORIGINAL_NAMES[c] for c in ('voltage', 'power')))}'
       || CASE WHEN COUNT(*) FILTER (WHERE l_quantity > 1000) > 0 THEN '; {schemas.MSG_CURRENT_ABOVE_MAX}' ELSE '' END
         AS messages
FROM lineitem GROUP BY l_orderkey""")
def q_validation_missing(spark, d):
    """Two of the three required columns are absent: one message names both."""
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("experiment_id"), F.col("l_quantity").alias("I"))
    return quality.validation_summary(r, keys=KEY)


@query("sequence_number_blocked", sql="""
SELECT l_returnflag AS experiment_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
       ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)
         AS sequence_number
FROM lineitem""")
def q_sequence_number_blocked(spark, d):
    """P9 over three hot keys."""
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("experiment_id"), "l_orderkey", *READINGS_ORDER)
    return quality.sequence_numbers(li, KEY, ["l_orderkey", *READINGS_ORDER])


@query("sequence_number_unkeyed", sql="""
SELECT event_id, ts, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS sequence_number FROM events""")
def q_sequence_number_unkeyed(spark, d):
    return quality.sequence_numbers(table(spark, d, "events").select("event_id", "ts"), [], ["ts", "event_id"])
