"""Stored sketches, scratch folders with an owner, lookups by bloom filter."""

from __future__ import annotations

import os
import pathlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ohmflow.operators import browse, profile, stats
from ohmflow.session import local_path, materialize, scratch_scope
from ohmflow.sinks import writers


def _values(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi, numPartitions=3).select(
        i, (i % 1000).cast("double").alias("x"), F.md5(i.cast("string")).alias("name"),
        F.when(i % 4 == 0, i.cast("timestamp")).alias("ts"), F.lit(None).cast("int").alias("none"))


def test_stored_profile_is_close_and_reads_each_file_once(spark, tmp_path):
    files, store = str(tmp_path / "files"), str(tmp_path / "store")
    _values(spark, 0, 60_000).write.parquet(files)
    profile.refresh_profile(spark, files, store)
    first = rows(spark.read.parquet(f"{store}/sketches").select("_source_file", "batch"))
    profile.refresh_profile(spark, files, store)                            # nothing new
    assert rows(spark.read.parquet(f"{store}/sketches").select("_source_file", "batch")) == first
    _values(spark, 40_000, 100_000).write.mode("append").parquet(files)     # 20,000 values once more
    profile.refresh_profile(spark, files, store)
    sketches = spark.read.parquet(f"{store}/sketches")
    assert sketches.select("_source_file").distinct().count() == 6
    assert set(first) < set(rows(sketches.select("_source_file", "batch")))
    got = {r.column_name: r for r in profile.stored_profile(spark, store).collect()}
    want = {r.column_name: r for r in stats.column_profile(spark.read.parquet(files)).collect()}
    assert set(got) == set(want)
    for c, w in want.items():
        g = got[c]
        assert (g.position, g.dtype, g.non_null_count, g.null_count) == (
            w.position, w.dtype, w.non_null_count, w.null_count)
        assert abs(g.distinct_count - w.distinct_count) <= 4 * profile.relative_error() * w.distinct_count
    # any set of files: the first load alone
    some = sketches.where("batch = 0").select("_source_file")
    part = {r.column_name: r for r in profile.stored_profile(spark, store, some).collect()}
    assert part["id"].non_null_count == 60_000
    assert abs(part["name"].distinct_count - 60_000) <= 4 * profile.relative_error() * 60_000


def test_sketches_of_odd_values(spark):
    df = spark.createDataFrame([("f", 0.0, "", b"a"), ("f", -0.0, None, b"a"), ("f", float("nan"), "", None),
                                (None, 1.5, "y", b"b")], "_source_file string, x double, `a.b` string, raw binary")
    got = {r.column_name: (r.non_null_count, r.distinct_count, r.null_count)
           for r in profile.merged_profile(profile.file_sketches(df)).collect()}
    assert got == {"x": (3, 2, 1), "a.b": (3, 2, 1), "raw": (3, 2, 1)}
    assert profile.merged_profile(profile.file_sketches(df.limit(0))).count() == 0
    mixed = profile.file_sketches(df.select("_source_file", "x"), 12).unionByName(
        profile.file_sketches(df.select("_source_file", "x"), 13))
    with pytest.raises(Exception):                                          # sketches of different sizes do not merge
        profile.merged_profile(mixed).collect()


def test_only_sketches_are_shuffled(spark):
    df = _values(spark, 0, 1000).withColumn("_source_file", (F.col("id") % 3).cast("string"))
    plan = profile.merged_profile(profile.file_sketches(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2          # per file, then per column
    assert "partial_hll_sketch_agg" in plan and "partial_hll_union_agg" in plan


def test_scratch_scope_removes_its_own_folders(spark):
    df = spark.range(100)
    outside = materialize(df, "outside")
    with scratch_scope(spark) as outer:
        materialize(df, "outer")
        with scratch_scope(spark) as inner:
            kept = materialize(df, "kept")
            keep = inner.pop()
            materialize(df, "inner")
            assert len(inner) == 1 and os.path.isdir(local_path(inner[0]))
        assert not os.path.exists(local_path(inner[0]))
        assert len(outer) == 1 and os.path.isdir(local_path(outer[0]))
    assert not os.path.exists(local_path(outer[0]))
    assert kept.count() == 100 and os.path.isdir(local_path(keep)) and outside.count() == 100
    with pytest.raises(ZeroDivisionError):
        with scratch_scope(spark) as failed:
            materialize(df, "failed")
            1 / 0
    assert not os.path.exists(local_path(failed[0]))


def test_scratch_scope_around_an_operator(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    with scratch_scope(spark) as made:
        stats.exact_quantiles(df, ["k"], ["x"], [0.5]).write.parquet(str(tmp_path / "out"))
    assert made and not any(os.path.exists(local_path(p)) for p in made)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def _rows_read(df):
    """Rows that the scan of ``df`` handed on, before the filter."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookup_skips_row_groups(spark, tmp_path):
    n = 40_000
    readings = spark.range(n, numPartitions=4).select(
        F.md5(F.col("id").cast("string")).alias("reading_id"), (F.col("id") % 7).alias("experiment_id"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("timestamp"))
    one = F.md5(F.lit("123"))
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        plain = writers.append_readings(readings, str(tmp_path / "plain"))
        fast = writers.append_readings(readings, str(tmp_path / "fast"), lookup=("reading_id",))
    finally:
        spark.conf.unset("parquet.block.size")
    find = lambda p: spark.read.parquet(p).where(F.col("reading_id") == one)
    few, all_ = _rows_read(find(fast)), _rows_read(find(plain))
    assert few < all_ / 4, (few, all_)
    size = lambda p: sum(f.stat().st_size for f in pathlib.Path(p).rglob("*.parquet"))
    assert size(fast) < 4 * size(plain)              # filters of 1 MB would be far more than the tiny row groups
    assert browse.single_row(spark.read.parquet(fast), F.col("reading_id") == one).count() == 1
