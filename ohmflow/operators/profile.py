"""Column profile of a growing folder of files from stored sketches.

``refresh_profile`` reads each file once, however often it runs, and stores one
row per file and column: row counts and a mergeable HyperLogLog sketch of a
fixed size.  ``stored_profile`` merges the sketches of any set of files, so the
profile of the whole folder costs a scan of the sketches alone.  Only
sketches are shuffled; exact counts are ``stats.column_profile``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import _slot

__all__ = ["LG_K", "relative_error", "file_sketches", "merged_profile", "refresh_profile", "stored_profile"]

#: a sketch has 2 ** LG_K registers (16 KB)
LG_K = 14
SOURCE_FILE = "_source_file"


def relative_error(lg_k: int = LG_K) -> float:
    """Standard error of a merged distinct count, as a share of the count."""
    return 1.04 / 2 ** (lg_k / 2)


def file_sketches(df: DataFrame, lg_k: int = LG_K, source: str = SOURCE_FILE) -> DataFrame:
    """(source, position, column_name, dtype, row_count, non_null_count, sketch) of each file and column.

    ``source`` is the column that names a row's file; it is not profiled.  NULL
    and NaN are not counted; equal values of one type are one value (0.0 and
    -0.0 too).  Tasks send one sketch per file and column.  A frame without
    rows gives no row.
    """
    cols = [(c, t) for c, t in df.dtypes if c != source]
    aggs, entries = [], []
    for i, (c, t) in enumerate(cols):
        kind, x = _slot(f"`{c}`", t)
        x = x + F.lit(0.0) if kind == 1 else x
        aggs += [F.count(x).alias(f"_n{i}"),
                 F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), F.lit(lg_k)).alias(f"_s{i}")]
        entries.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("dtype"),
                                F.col("_rows").alias("row_count"), F.col(f"_n{i}").alias("non_null_count"),
                                F.col(f"_s{i}").alias("sketch")))
    per = df.groupBy(F.col(source).alias(source)).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    return per.select(source, F.inline(F.array(*entries)))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """The profile of all files in ``sketches``: position, column_name, dtype, non_null_count,
    distinct_count (estimate, see ``relative_error``), null_count.

    A column that has different types in different files has a row for each.
    """
    per = sketches.groupBy("column_name", "dtype").agg(
        F.min("position").alias("position"), F.sum("non_null_count").alias("non_null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"),
        (F.sum("row_count") - F.sum("non_null_count")).alias("null_count"))
    return per.select("position", "column_name", "dtype", "non_null_count", "distinct_count", "null_count")


def refresh_profile(spark: SparkSession, path: str, store: str, lg_k: int = LG_K) -> None:
    """Add the sketches of Parquet files under ``path`` that ``store`` has not seen.

    The files are a stream whose checkpoint in ``store`` knows the ones done;
    a batch that is run again after a loss overwrites its own sketches.
    """
    def add(batch: DataFrame, number: int) -> None:
        file_sketches(batch, lg_k).write.mode("overwrite").parquet(f"{store}/sketches/batch={number}")

    files = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    (files.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE)).writeStream.foreachBatch(add)
     .option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination())


def stored_profile(spark: SparkSession, store: str, files: DataFrame | None = None) -> DataFrame:
    """``merged_profile`` of the stored files; with ``files`` (column ``_source_file``) of those among them only."""
    sketches = spark.read.parquet(f"{store}/sketches")
    if files is not None:
        sketches = sketches.join(files.select(SOURCE_FILE).distinct(), SOURCE_FILE, "left_semi")
    return merged_profile(sketches)
