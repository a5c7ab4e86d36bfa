"""Dashboard figures (D1-D4): daily tests, pass rate, activity, failure
distribution, device trend.  All are partial aggregates; the only ordered
windows run over the aggregated daily table, never over experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import attach_one_row

__all__ = ["daily_tests", "pass_rate", "activity_counts", "fault_distribution", "device_trend"]


def daily_tests(experiments: DataFrame, ts: str = "created_at") -> DataFrame:
    """Experiments per day and the change against the day before.

    Every day from the first to the last has a row (0 tests where there were
    none); the first day has no change.  Experiments without a time form one
    row with a NULL day and no change.
    """
    daily = experiments.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("tests"))
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    known = days.join(daily, "day", "left").select("day", F.coalesce("tests", F.lit(0)).alias("tests"))
    w = Window.orderBy("day")        # one row per day
    known = known.withColumn("change", F.col("tests") - F.lag("tests").over(w))
    return known.unionByName(daily.where("day is null").withColumn("change", F.lit(None).cast("long")))


def pass_rate(experiments: DataFrame, keys: list, result: str = "result") -> DataFrame:
    """Pass / judged (pass or fail) per key; pending and NULL are not judged."""
    judged = F.when(F.col(result) == "pass", 1.0).when(F.col(result) == "fail", 0.0)
    return experiments.groupBy(*keys).agg(F.count(judged).alias("judged"), F.avg(judged).alias("pass_rate"))


def activity_counts(experiments: DataFrame, files: DataFrame, device: str = "device_id",
                    status: str = "status", active: str = "running") -> DataFrame:
    """D3: devices with a running experiment, experiments, files (one row)."""
    e = experiments.agg(F.count_distinct(F.when(F.col(status) == active, F.col(device))).alias("active_devices"),
                        F.count(F.lit(1)).alias("experiments"))
    f = files.agg(F.count(F.lit(1)).alias("files"))
    return attach_one_row(e, f)   # two one-row aggregates


def fault_distribution(experiments: DataFrame, kind: str = "experiment_type", result: str = "result") -> DataFrame:
    """Failed experiments per kind and their share of all failures."""
    fails = experiments.where(F.col(result) == "fail")
    per = fails.groupBy(kind).agg(F.count(F.lit(1)).alias("failures"))
    everything = F.sum("failures").over(Window.partitionBy())    # over one row per kind
    return per.select(kind, "failures", (F.col("failures") / everything).alias("share"))


def device_trend(experiments: DataFrame, device: str, ts: str, y: str) -> DataFrame:
    """Least-squares slope of ``y`` per day over time, per device."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double")
    return experiments.groupBy(device).agg(F.count(F.lit(1)).alias("n"),
                                           F.regr_slope(F.col(y).cast("double"), days).alias("slope_per_day"))
