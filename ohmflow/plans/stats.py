"""Statistics queries (A1-A7) over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, shapes, stats
from ..session import scratch_path
from ..sources.tables import readings_ivp, series_events, table
from .registry import query, rounded


@query("signal_statistics", sql="""
SELECT event_type,
       ROUND(AVG(value), 6) AS power_mean, ROUND(MAX(value), 6) AS power_max,
       ROUND(MIN(value), 6) AS power_min, ROUND(STDDEV_SAMP(value), 6) AS power_std,
       ROUND(QUANTILE_CONT(value, 0.5), 6) AS power_median,
       ROUND(SUM(value) * 0.001, 6) AS total_energy, CAST(0.0 AS DOUBLE) AS power_factor
FROM events GROUP BY event_type
""")
def q_signal_statistics(spark, d):
    e = series_events(spark, d).select("event_type", F.col("x").alias("power"))
    return rounded(stats.signal_statistics(e, keys=["event_type"]))


@query("signal_statistics_ivp", sql="""
SELECT l_returnflag, l_linestatus,
  ROUND(AVG(l_quantity), 6) AS current_mean, ROUND(MAX(l_quantity), 6) AS current_max,
  ROUND(MIN(l_quantity), 6) AS current_min, ROUND(STDDEV_SAMP(l_quantity), 6) AS current_std,
  ROUND(QUANTILE_CONT(l_quantity, 0.5), 6) AS current_median,
  ROUND(AVG(p_retailprice), 6) AS voltage_mean, ROUND(MAX(p_retailprice), 6) AS voltage_max,
  ROUND(MIN(p_retailprice), 6) AS voltage_min, ROUND(STDDEV_SAMP(p_retailprice), 6) AS voltage_std,
  ROUND(QUANTILE_CONT(p_retailprice, 0.5), 6) AS voltage_median,
  ROUND(AVG(l_extendedprice), 4) AS power_mean, ROUND(MAX(l_extendedprice), 6) AS power_max,
  ROUND(MIN(l_extendedprice), 6) AS power_min, ROUND(STDDEV_SAMP(l_extendedprice), 4) AS power_std,
  ROUND(QUANTILE_CONT(l_extendedprice, 0.5), 6) AS power_median,
  ROUND(SUM(l_extendedprice) * 0.001, 3) AS total_energy,
  ROUND(AVG(l_extendedprice) / (AVG(l_quantity) * AVG(p_retailprice)), 6) AS power_factor
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
GROUP BY l_returnflag, l_linestatus
""")
def q_signal_statistics_ivp(spark, d):
    r = readings_ivp(spark, d)
    out = stats.signal_statistics(r, keys=["l_returnflag", "l_linestatus"])
    return rounded(out, overrides={"power_mean": 4, "power_std": 4, "total_energy": 3})


@query("anomaly_iqr", sql="""
WITH q AS (SELECT event_type, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.75) AS q3
           FROM events GROUP BY event_type)
SELECT e.event_id, e.event_type, e.value,
       COALESCE(e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1), false) AS is_anomaly
FROM events e JOIN q ON e.event_type = q.event_type""")
def q_anomaly_iqr(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return stats.anomaly_iqr(e, "value", keys=["event_type"])


@query("anomaly_zscore", sql="""
WITH m AS (SELECT event_type, AVG(value) AS mu, STDDEV_SAMP(value) AS sd FROM events GROUP BY event_type)
SELECT e.event_id, e.event_type, e.value,
       COALESCE(ABS((e.value - mu) / NULLIF(sd, 0)) > 3, false) AS is_anomaly
FROM events e JOIN m ON e.event_type = m.event_type""")
def q_anomaly_zscore(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return stats.anomaly_zscore(e, "value", keys=["event_type"])


# fixed values: lineitem columns and their Spark type names, in table order
LINEITEM_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]


@query("column_profile", sql=" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, COUNT({c}) AS non_null_count, "
    f"COUNT(DISTINCT {c}) AS distinct_count, COUNT(*) - COUNT({c}) AS null_count FROM lineitem"
    for i, (c, t) in enumerate(LINEITEM_TYPES)))
def q_column_profile(spark, d):
    return stats.column_profile(table(spark, d, "lineitem"))


@query("column_profile_stored", sql=" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, COUNT({c}) AS non_null_count, "
    f"COUNT(*) - COUNT({c}) AS null_count, true AS estimate_within_4_sigma FROM lineitem"
    for i, (c, t) in enumerate(LINEITEM_TYPES)))
def q_column_profile_stored(spark, d):
    """A6 from stored sketches of files that arrive in two loads; the estimates beside the exact counts."""
    li, root = table(spark, d, "lineitem"), scratch_path(spark, "profile")
    for early in (True, False):
        part = li.where(F.coalesce(F.col("l_linenumber") <= 3, F.lit(False)) == early)
        part.write.mode("append").parquet(f"{root}/files")
        profile.refresh_profile(spark, f"{root}/files", f"{root}/store")
    got = profile.stored_profile(spark, f"{root}/store")
    exact = stats.column_profile(li).select("position", F.col("distinct_count").alias("exact"))
    off = F.abs(F.col("distinct_count") - F.col("exact"))
    close = off <= F.ceil(F.col("exact") * 4 * profile.relative_error())
    # both sides have one row per column
    return got.join(F.broadcast(exact), "position").select(
        "position", "column_name", "dtype", "non_null_count", "null_count", close.alias("estimate_within_4_sigma"))


@query("frame_totals", sql="SELECT COUNT(*) AS row_count, 11 AS column_count, CAST("
       + " + ".join(f"(COUNT(*) - COUNT({c}))" for c, _ in LINEITEM_TYPES)
       + " AS BIGINT) AS null_cells, format('{:,}', COUNT(*)) AS row_count_text FROM lineitem")
def q_frame_totals(spark, d):
    """A7, with the row count as the page shows it."""
    return stats.frame_totals(table(spark, d, "lineitem")).withColumn(
        "row_count_text", shapes.count_text(F.col("row_count")))


def _power_sql(key: str, value: str, tbl: str) -> str:
    return f"""
SELECT {key}, ROUND(AVG({value}), 6) AS power_mean, ROUND(MAX({value}), 6) AS power_max,
       ROUND(MIN({value}), 6) AS power_min, ROUND(STDDEV_SAMP({value}), 6) AS power_std,
       ROUND(QUANTILE_CONT({value}, 0.5), 6) AS power_median,
       ROUND(SUM({value}) * 0.001, 6) AS total_energy, CAST(0.0 AS DOUBLE) AS power_factor
FROM {tbl} GROUP BY {key}"""


@query("signal_statistics_sorted", sql=_power_sql("event_type", "value", "events"))
def q_signal_statistics_sorted(spark, d):
    """A1 over a few groups of nearly unique values."""
    e = table(spark, d, "events").select("event_type", F.col("value").alias("power"))
    return rounded(stats.signal_statistics(e, keys=["event_type"]))


@query("signal_statistics_quantity", sql=_power_sql("l_returnflag", "l_quantity", "lineitem"))
def q_signal_statistics_quantity(spark, d):
    """A1 over hot groups of few distinct values."""
    li = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("power"))
    return rounded(stats.signal_statistics(li, keys=["l_returnflag"]))


@query("anomaly_iqr_sorted", sql="""
WITH q AS (SELECT l_returnflag, QUANTILE_CONT(l_extendedprice, 0.25) AS q1, QUANTILE_CONT(l_extendedprice, 0.75) AS q3
           FROM lineitem GROUP BY l_returnflag)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_extendedprice,
       COALESCE(l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1), false) AS is_anomaly
FROM lineitem l JOIN q USING (l_returnflag)""")
def q_anomaly_iqr_sorted(spark, d):
    """A4 over three hot groups."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
                                            "l_extendedprice")
    return stats.anomaly_iqr(li, "l_extendedprice", keys=["l_returnflag"])
