"""Chart-shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes
from ..sources.tables import readings_ivp, table
from . import roles
from .registry import query, rounded

ROW_ID = ["experiment_id", "l_linenumber", "l_partkey", "l_suppkey"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("series_long", sql="WITH " + roles.IVP + " " + " UNION ALL ".join(
    f"SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, timestamp, '{c}' AS series, {a} AS axis, "
    f"CAST({c} AS DOUBLE) AS value FROM ivp" for c, a in [("current", 1), ("voltage", 1), ("power", 2)]))
def q_series_long(spark, d):
    r = readings_ivp(spark, d)
    return shapes.series_long(r, ROW_ID + ["timestamp"], ["current", "voltage"], ["power"])


@query("threshold_status", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax * 500 AS threshold,
       CASE WHEN l_tax * 500 IS NULL OR l_tax * 500 = 0 THEN 'neutral'
            WHEN l_quantity > l_tax * 500 THEN 'danger' ELSE 'success' END AS status
FROM lineitem""")
def q_threshold_status(spark, d):
    li = table(spark, d, "lineitem")
    th = F.col("l_tax") * 500
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", th.alias("threshold"),
                     shapes.threshold_status(F.col("l_quantity"), th).alias("status"))


@query("matrix_pivot", sql="SELECT c_nationkey, " + ", ".join(
    f"ROUND(AVG(c_acctbal) FILTER (WHERE c_mktsegment = '{s}'), 6) AS \"{s}\"" for s in SEGMENTS)
    + " FROM customer GROUP BY c_nationkey")
def q_matrix_pivot(spark, d):
    c = table(spark, d, "customer")
    return rounded(shapes.matrix_pivot(c, "c_nationkey", "c_mktsegment", "c_acctbal", SEGMENTS))


@query("bar_totals", sql="""
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 6) AS l_quantity_total
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_bar_totals(spark, d):
    return rounded(shapes.bar_totals(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus"))


@query("share_of_total", sql="""
SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS total,
       ROUND(SUM(o_totalprice) / (SELECT SUM(o_totalprice) FROM orders), 6) AS share
FROM orders GROUP BY o_orderpriority""")
def q_share_of_total(spark, d):
    out = shapes.share_of_total(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(out, overrides={"total": 2})


@query("scatter_pairs", sql=" UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{x}' AS x_dim, '{y}' AS y_dim, "
    f"CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM lineitem"
    for x, y in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"),
                 ("l_extendedprice", "l_discount")]))
def q_scatter_pairs(spark, d):
    li = table(spark, d, "lineitem")
    return shapes.scatter_pairs(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                                ["l_quantity", "l_extendedprice", "l_discount"])


@query("metric_cards", sql="""
WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, SUM(o_totalprice) AS revenue,
                  CAST(COUNT(*) AS DOUBLE) AS orders FROM orders GROUP BY 1),
l AS (SELECT period, 'revenue' AS metric, 'USD' AS unit, revenue AS v,
             revenue - LAG(revenue) OVER (ORDER BY period) AS d FROM p
      UNION ALL
      SELECT period, 'orders', 'orders', orders, orders - LAG(orders) OVER (ORDER BY period) FROM p)
SELECT period, metric, ROUND(v, 2) AS value, unit, ROUND(d, 2) AS delta,
       CASE WHEN d > 0 THEN 'normal' ELSE 'inverse' END AS delta_color,
       printf('%.2f', v) || ' ' || unit AS value_text,
       CASE WHEN d <> 0 THEN printf('%.2f', d) || ' ' || unit END AS delta_text
FROM l""")
def q_metric_cards(spark, d):
    o = table(spark, d, "orders")
    per = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).cast("double").alias("orders"))
    return shapes.metric_cards(per, "period", {"revenue": "USD", "orders": "orders"})
