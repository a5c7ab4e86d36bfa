"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi
from ..sources.tables import experiments_orders, files_documents
from . import roles
from .registry import query, rounded


@query("daily_tests", sql="WITH " + roles.EXPERIMENTS + """,
d AS (SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS tests FROM experiments GROUP BY 1),
s AS (SELECT CAST(UNNEST(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d),
f AS (SELECT s.day, COALESCE(d.tests, 0) AS tests FROM s LEFT JOIN d ON s.day = d.day)
SELECT day, tests, tests - LAG(tests) OVER (ORDER BY day) AS change FROM f
UNION ALL SELECT day, tests, NULL FROM d WHERE day IS NULL""")
def q_daily_tests(spark, d):
    return kpi.daily_tests(experiments_orders(spark, d), "created_at")


@query("pass_rate", sql="WITH " + roles.EXPERIMENTS + """
SELECT CAST(created_at AS DATE) AS day, experiment_type,
       COUNT(CASE result WHEN 'pass' THEN 1.0 WHEN 'fail' THEN 0.0 END) AS judged,
       ROUND(AVG(CASE result WHEN 'pass' THEN 1.0 WHEN 'fail' THEN 0.0 END), 6) AS pass_rate
FROM experiments GROUP BY 1, 2""")
def q_pass_rate(spark, d):
    e = experiments_orders(spark, d).withColumn("day", F.to_date("created_at"))
    return rounded(kpi.pass_rate(e, ["day", "experiment_type"]))


@query("activity_counts", sql="WITH " + roles.EXPERIMENTS + """
SELECT COUNT(DISTINCT CASE WHEN status = 'running' THEN device_id END) AS active_devices,
       COUNT(*) AS experiments, (SELECT COUNT(*) FROM documents) AS files
FROM experiments""")
def q_activity_counts(spark, d):
    return kpi.activity_counts(experiments_orders(spark, d), files_documents(spark, d))


@query("fault_distribution", sql="WITH " + roles.EXPERIMENTS + """
SELECT experiment_type, COUNT(*) AS failures,
       ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
FROM experiments WHERE result = 'fail' GROUP BY experiment_type""")
def q_fault_distribution(spark, d):
    return rounded(kpi.fault_distribution(experiments_orders(spark, d)))


@query("device_trend", sql="""
SELECT o_custkey, COUNT(*) AS n,
       ROUND(REGR_SLOPE(o_totalprice, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE)), 6)
         AS slope_per_day
FROM orders GROUP BY o_custkey""")
def q_device_trend(spark, d):
    from ..sources.tables import table
    return rounded(kpi.device_trend(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_totalprice"))
