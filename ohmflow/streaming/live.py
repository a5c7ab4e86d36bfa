"""Structured Streaming: threshold alarms with duplicate removal (D8), newest state per
device (D8), tumbling-window means with a watermark (D9), and file ingest (K4).

Event time must be a TIMESTAMP for ``withWatermark``; wall-clock
TIMESTAMP_NTZ input is turned into the instant it names in UTC by
microsecond arithmetic (not a cast, which would depend on the session time
zone) and back the same way, so watermarks and window bounds do not depend on
the session time zone.  State is
bounded by the watermark: duplicates are remembered only within the delay,
and a window's state is emitted and dropped once the watermark passes its
end.  Rows are never dropped while newer than the watermark; a row older than
the watermark of the previous micro-batch is dropped as late.  The state of
``device_state`` has one row per device.

A run that ends (``trigger(availableNow=True)``) leaves the windows within
``delay`` of the newest event open.  ``windows_so_far`` adds them from a batch
pass over the rows behind the watermark's windows; neither the source nor the
checkpoint is touched, so the next run goes on from the stored state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shapes import threshold_status

__all__ = ["file_stream", "alarms", "tumbling_mean", "windows_so_far", "device_state", "run_updates", "current_state",
           "ingest_new_files", "run_available_now", "event_time", "wall_clock"]


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def event_time(c: Column) -> Column:
    """Wall-clock TIMESTAMP_NTZ (or TIMESTAMP) -> TIMESTAMP instant, independent of the session zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch_ntz(), c.cast("timestamp_ntz")))


def wall_clock(c: Column) -> Column:
    """Inverse of ``event_time``: TIMESTAMP instant -> TIMESTAMP_NTZ wall clock in UTC."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), _epoch_ntz())


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file source with an explicit schema (no inference on a stream)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def alarms(stream: DataFrame, ts: str, dedup_keys: list[str], value: str, threshold: Column | float,
           delay: str = "1 hour") -> DataFrame:
    """Keep readings above the threshold, then drop duplicates within the watermark.

    Only alarms enter the state.  Copies of one reading have its value, so
    the order of the two steps does not change the result."""
    th = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    s = stream.withColumn("status", threshold_status(F.col(value), th)).where(F.col("status") == "danger")
    s = s.withColumn("_evt", event_time(F.col(ts))).withWatermark("_evt", delay)
    return s.dropDuplicatesWithinWatermark(dedup_keys).drop("_evt")


def _windows(df: DataFrame, keys: list[str], value: str, window: str) -> DataFrame:
    agg = df.groupBy(F.window("_evt", window).alias("_w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias(f"mean_{value}"))
    return agg.select(*keys, wall_clock(F.col("_w.start")).alias("window_start"),
                      wall_clock(F.col("_w.end")).alias("window_end"), "n", f"mean_{value}")


def tumbling_mean(stream: DataFrame, ts: str, keys: list[str], value: str, window: str = "1 hour",
                  delay: str = "10 minutes") -> DataFrame:
    """Per key and tumbling window: count and mean; append mode."""
    return _windows(stream.withColumn("_evt", event_time(F.col(ts))).withWatermark("_evt", delay), keys, value, window)


def windows_so_far(spark: SparkSession, batch: DataFrame, out_path: str, ts: str, keys: list[str], value: str,
                   window: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """D9 after a run: the windows that the stream has written to ``out_path``, and those it still holds open.

    ``batch`` is the stream's source read as a table.  Open windows end after the
    ``watermark`` (UTC text, as ``run_available_now`` returns it; without one,
    after the last window written); only rows that can lie in one are read.
    """
    schema = _windows(batch.limit(0).withColumn("_evt", event_time(F.col(ts))), keys, value, window).schema
    closed = spark.read.schema(schema).parquet(out_path)
    if watermark is None:                                    # one value
        end = closed.agg(F.max("window_end")).collect()[0][0]
        bound = F.lit(end).cast("timestamp_ntz") if end is not None else None
    else:
        bound = F.lit(watermark.rstrip("Z").replace("T", " ")).cast("timestamp_ntz")
    if bound is not None:
        batch = batch.where(F.col(ts).cast("timestamp_ntz") > bound - F.expr(f"INTERVAL {window}"))
    open_ = _windows(batch.withColumn("_evt", event_time(F.col(ts))), keys, value, window)
    if bound is not None:
        open_ = open_.where(F.col("window_end") > bound)
    done = closed.select(*[F.col(c).alias(f"_d_{c}") for c in [*keys, "window_start"]])
    same = F.lit(True)
    for c in [*keys, "window_start"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return closed.unionByName(open_.join(done, same, "left_anti"))


def device_state(stream: DataFrame, key: str, ts: str, tie: str, value: str, threshold: Column | float) -> DataFrame:
    """Newest reading of each device (``tie`` decides among equal times) and its status; update mode."""
    newest = stream.groupBy(key).agg(F.max(F.struct(F.col(ts), F.col(tie), F.col(value))).alias("_n"))
    th = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return newest.select(key, F.col(f"_n.{ts}").alias(ts), F.col(f"_n.{tie}").alias(tie), F.col(f"_n.{value}").alias(value),
                         threshold_status(F.col(f"_n.{value}"), th).alias("status"))


def write_updates(batch: DataFrame, batch_id: int, path: str) -> None:
    """One folder per micro-batch, replaced as a whole: a batch that is replayed changes nothing."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_updates(result: DataFrame, path: str, checkpoint: str) -> str:
    """Write an update-mode result through ``foreachBatch`` until the available input is used up."""
    q = (result.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, i: write_updates(df, i, path)).trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def current_state(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest update of each device."""
    u = spark.read.parquet(path)
    rest = [c for c in u.columns if c not in (key, "batch")]
    newest = u.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_s"))
    return newest.select(key, *[F.col(f"_s.{c}").alias(c) for c in rest])


def ingest_new_files(spark: SparkSession, path: str, schema, out_path: str, checkpoint: str, ts: str = "timestamp",
                     fmt: str = "parquet", glob: str | None = None, max_files_per_trigger: int | None = None) -> str:
    """K4/S3: append the files that no earlier run has taken, partitioned by month of ``ts``.

    The checkpoint remembers which files were taken and the sink which batches
    were written, so a run that is repeated or lost neither skips a file nor
    appends one twice.
    """
    rows = file_stream(spark, path, schema, fmt, glob, max_files_per_trigger)
    rows = rows.withColumn("reading_month", F.trunc(F.to_date(ts), "month"))
    q = (rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .partitionBy("reading_month").trigger(availableNow=True).start(out_path))
    q.awaitTermination()
    return out_path


def run_available_now(result: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet") -> str | None:
    """Process everything available, then stop; the sink is an exactly-once file sink.  Returns the
    watermark of the last batch (None where there was nothing to do)."""
    q = (result.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out_path))
    q.awaitTermination()
    last = q.lastProgress
    return (last["eventTime"] or {}).get("watermark") if last else None
