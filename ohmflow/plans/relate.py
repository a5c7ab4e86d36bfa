"""Relation queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import relate
from ..session import shuffle_partitions
from ..sources.tables import (READINGS_ORDER, devices_customer, experiments_orders, files_documents,
                              profiles_customer, readings_ivp, readings_lineitem, table)
from . import roles
from .registry import query, rounded

ROW_ID = ["experiment_id", "l_linenumber", "l_partkey", "l_suppkey"]


@query("role_semi_join", sql="WITH " + roles.PROFILES + """
SELECT * FROM orders WHERE o_custkey IN (SELECT id FROM profiles WHERE role IN ('engineer', 'admin'))""")
def q_role_semi_join(spark, d):
    return relate.writers_only(table(spark, d, "orders"), "o_custkey", profiles_customer(spark, d))


@query("experiment_detail", sql="WITH " + roles.READINGS_LI + ", " + roles.EXPERIMENTS + ", " + roles.DEVICES + """
SELECT r.experiment_id, r.l_linenumber, r.l_partkey, r.l_suppkey, r.current,
       e.experiment_name, e.status, v.device_serial, v.status AS device_status
FROM rl r LEFT JOIN experiments e ON r.experiment_id = e.id LEFT JOIN devices v ON e.device_id = v.id""")
def q_experiment_detail(spark, d):
    r = readings_lineitem(spark, d).select(*ROW_ID, "current")
    e = experiments_orders(spark, d).select("id", "experiment_name", "status", "device_id")
    v = devices_customer(spark, d).select("id", "device_serial", "status")
    j = relate.detail(relate.detail(r, e, "experiment_id", "id", "e_"), v, "e_device_id", "id", "d_")
    return j.select(*ROW_ID, "current", F.col("e_experiment_name").alias("experiment_name"),
                    F.col("e_status").alias("status"), F.col("d_device_serial").alias("device_serial"),
                    F.col("d_status").alias("device_status"))


def _tagged_files(df):
    return df.select(F.lit("files").alias("table_name"), F.col("id").cast("string").alias("row_id"), "experiment_id")


def _tagged_readings(df):
    rid = F.concat_ws("-", *[F.col(c).cast("string") for c in ROW_ID])
    return df.select(F.lit("experiment_data").alias("table_name"), rid.alias("row_id"), "experiment_id")


_TAG_SQL_R = "SELECT 'experiment_data' AS table_name, concat_ws('-', experiment_id, l_linenumber, l_partkey, l_suppkey) AS row_id, experiment_id FROM rl"
_TAG_SQL_F = "SELECT 'files' AS table_name, CAST(id AS VARCHAR) AS row_id, experiment_id FROM files"


@query("orphan_rows", sql="WITH " + roles.READINGS_LI + ", " + roles.FILES + ", " + roles.EXPERIMENTS + " "
       + _TAG_SQL_F + " WHERE experiment_id IS NOT NULL AND experiment_id NOT IN (SELECT id FROM experiments)"
       + " UNION ALL " + _TAG_SQL_R
       + " WHERE experiment_id IS NOT NULL AND experiment_id NOT IN (SELECT id FROM experiments)")
def q_orphan_rows(spark, d):
    e = experiments_orders(spark, d)
    f = relate.orphans(files_documents(spark, d), e, "experiment_id", "id")
    r = relate.orphans(readings_lineitem(spark, d), e, "experiment_id", "id")
    return _tagged_files(f).unionByName(_tagged_readings(r))


@query("cascade_delete", sql="WITH " + roles.READINGS_LI + ", " + roles.FILES + ", " + roles.EXPERIMENTS + ", "
       + "gone AS (SELECT id FROM experiments WHERE status = 'cancelled') "
       + _TAG_SQL_F + " WHERE experiment_id NOT IN (SELECT id FROM gone)"
       + " UNION ALL " + _TAG_SQL_R + " WHERE experiment_id NOT IN (SELECT id FROM gone)")
def q_cascade_delete(spark, d):
    gone = experiments_orders(spark, d).where(F.col("status") == "cancelled")
    f = relate.cascade_delete(files_documents(spark, d), gone, "experiment_id", "id")
    r = relate.cascade_delete(readings_lineitem(spark, d), gone, "experiment_id", "id")
    return _tagged_files(f).unionByName(_tagged_readings(r))


# measures that the criteria name, derived from an order's lines (measure, SQL, kind of value);
# orders with an even key have no measure of damage
_MEASURES = [
    ("leakage_current", "MAX(l_tax) * 70"), ("breakdown", "CAST(MAX(l_quantity) > 49 AS VARCHAR)"),
    ("leakage_25C", "MAX(l_discount) * 50"), ("leakage_60C", "MAX(l_tax) * 90"), ("shutdown_time", "MIN(l_quantity)"),
    ("function_test", "CASE WHEN MIN(l_linestatus) = 'F' THEN 'pass' ELSE 'fail' END"),
    ("protection_triggered", "CAST(MAX(l_quantity) > 20 AS VARCHAR)"),
    ("no_damage", "CASE WHEN l_orderkey % 2 = 1 THEN 'true' END"),
]


# as flags: a minimum of texts would make Spark sort all lines
_LEAST_F = "bool_or(l_linestatus = 'F') AND NOT bool_or(l_linestatus < 'F')"
#: lines whose orders one task judges
JUDGED_LINES = 1 << 20


def _measures(spark, d):
    li = table(spark, d, "lineitem")
    wide = li.groupBy("l_orderkey").agg(*[
        F.expr(sql.replace("VARCHAR", "STRING").replace("MIN(l_linestatus) = 'F'", _LEAST_F)
               .replace("l_orderkey %", "any_value(l_orderkey) %"))
        .cast("string").alias(m) for m, sql in _MEASURES])
    tasks = math.ceil(li.count() / JUDGED_LINES)
    if tasks > shuffle_partitions(spark):
        wide = wide.repartition(tasks, "l_orderkey")
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m, _ in _MEASURES])
    return wide.select(F.col("l_orderkey").alias("id"), F.inline(rows)).where("value is not null")


def _verdict_sql() -> str:
    import json

    from ..schemas import SEED_STANDARDS
    wide = ", ".join(f"{sql} AS {m}" for m, sql in _MEASURES)
    cases = []
    for code, _, kind, _, crit in SEED_STANDARDS:
        oks = []
        for k, v in json.loads(crit).items():
            if k.startswith("max_"):
                oks.append(f"({k[4:]} <= {v})")
            else:
                oks.append(f"({k} = '{str(v).lower() if isinstance(v, bool) else v}')")
        bad = " OR ".join(f"{o} = false" for o in oks)
        known = " + ".join(f"CAST({o} IS NOT NULL AS BIGINT)" for o in oks)
        cases.append(f"""SELECT e.id, e.experiment_type, '{code}' AS standard_code, CAST({len(oks)} AS BIGINT) AS criteria,
       {known} AS criteria_checked,
       CASE WHEN {bad} THEN 'fail' WHEN {' AND '.join(oks)} THEN 'pass' END AS verdict
FROM experiments e LEFT JOIN m ON e.id = m.mid WHERE e.experiment_type = '{kind}'""")
    kinds = ", ".join(f"'{s[2]}'" for s in SEED_STANDARDS)
    cases.append("SELECT id, experiment_type, NULL, 0, 0, NULL FROM experiments "
                 f"WHERE experiment_type IS NULL OR experiment_type NOT IN ({kinds})")
    return ("WITH " + roles.EXPERIMENTS + f", m AS (SELECT l_orderkey AS mid, {wide} FROM lineitem GROUP BY l_orderkey) "
            + " UNION ALL ".join(cases))


@query("verdict", sql=_verdict_sql())
def q_verdict(spark, d):
    return relate.verdict(experiments_orders(spark, d), _measures(spark, d), relate.standards_frame(spark))


@query("breakdown_point", sql="WITH " + roles.READINGS_LI + """,
o AS (SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, current,
             ROW_NUMBER() OVER (PARTITION BY experiment_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
      FROM rl WHERE current > 45)
SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, current FROM o WHERE rn = 1""")
def q_breakdown_point(spark, d):
    r = readings_lineitem(spark, d)
    return relate.breakdown_point(r, "experiment_id", READINGS_ORDER, "current", 45.0)


@query("deviation", sql="""
SELECT l.l_orderkey AS experiment_id, COUNT(*) AS n_points,
       ROUND(AVG(ABS(l.l_quantity - l.l_extendedprice / p.p_retailprice)), 6) AS mean_abs_deviation,
       ROUND(MAX(ABS(l.l_quantity - l.l_extendedprice / p.p_retailprice)), 6) AS max_abs_deviation
FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey""")
def q_deviation(spark, d):
    # readings are paired by (experiment, sequence number); both sides are numbered in the same full
    # order (line, part, supplier, quantity, price), so pairs are well defined
    m = readings_lineitem(spark, d).select("experiment_id", *READINGS_ORDER, F.col("current").alias("quantity"),
                                           F.col("voltage").alias("price"), "current")
    s = readings_ivp(spark, d).select("experiment_id", *READINGS_ORDER, F.col("current").alias("quantity"),
                                      F.col("power").alias("price"),
                                      F.try_divide(F.col("power"), F.col("voltage")).alias("current"))
    return rounded(relate.numbered_deviation(m, s, "experiment_id", [*READINGS_ORDER, "quantity", "price"], "current"))
