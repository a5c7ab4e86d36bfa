"""Fixture tests for filters, resampling, ordering primitives (FIXTURES 3)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import approx
from ohmflow.operators import series
from ohmflow.operators.ordering import IDX, blocked, global_index, ordered, row_number_in_key


def frame(spark, values, key="a"):
    data = [(key, i + 1, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "key string, seq int, x double")


def filtered(df, method, w):
    out = series.filter_data(df, "x", method, w, keys=["key"], order=["seq"])
    return [r.x_filtered for r in out.orderBy("key", "seq").collect()]


@pytest.mark.parametrize("method,w,inp,exp", [
    ("moving_average", 3, [1, 2, 6, 4], [1, 3, 4, 4]),
    ("moving_average", 4, [1, 2, 3, 6, 8], [1, 2, 3, 4.75, 8]),
    ("moving_average", 3, [1, 2, None, 4, 5, 6], [1, 2, None, 4, 5, 6]),
    ("median", 3, [9, 1, 5, 7], [9, 5, 5, 7]),
    ("exponential", 3, [4, 8, 0], [4, 6, 3]),
    ("exponential", 5, [1, None, 3, 4], [1, 1, 1.8571428571428572, 2.5714285714285716]),
    ("exponential", 5, [None, 1, 3], [None, 1, 1.6666666666666667]),
])
def test_filters(spark, method, w, inp, exp):
    got = filtered(frame(spark, inp), method, w)
    assert all(approx(g, e) for g, e in zip(got, exp)), got


def test_unknown_filter_method(spark):
    with pytest.raises(ValueError):
        series.filter_data(frame(spark, [1, 2]), "x", "kalman", 3, keys=["key"], order=["seq"])


def test_filters_per_key_and_input_order(spark):
    a = frame(spark, [1, 2, 6, 4], "a")
    b = frame(spark, [9, 1, 5, 7], "b")
    one = frame(spark, [7], "c")
    df = a.unionByName(b).unionByName(one).orderBy(F.rand(3))
    got = series.filter_data(df, "x", "moving_average", 3, keys=["key"], order=["seq"])
    res = {(r.key, r.seq): r.x_filtered for r in got.collect()}
    assert [res[("a", i)] for i in range(1, 5)] == [1, 3, 4, 4]
    assert all(approx(g, e) for g, e in zip([res[("b", i)] for i in range(1, 5)], [9, 5, 13 / 3, 7]))
    assert res[("c", 1)] == 7


def test_exponential_matches_pandas_with_gaps(spark):
    pd = pytest.importorskip("pandas")
    import numpy as np
    rng = np.random.default_rng(7)
    x = rng.normal(size=400)
    x[rng.random(400) < 0.3] = np.nan
    x[:3] = np.nan
    exp = pd.Series(x).ewm(span=5, adjust=False).mean()
    exp = exp.fillna(pd.Series(x))
    df = spark.createDataFrame([("k", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)],
                               "key string, seq int, x double")
    got = series.exponential(df, ["key"], ["seq"], "x", span=5)
    got = [r.x_filtered for r in got.orderBy("seq").collect()]
    for g, e in zip(got, exp):
        assert (g is None and np.isnan(e)) or approx(g, e, 1e-9)


def test_resample_one_second_keeps_empty_bins(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [(t0 + dt.timedelta(milliseconds=200), 1.0), (t0 + dt.timedelta(milliseconds=800), 3.0),
            (t0 + dt.timedelta(seconds=3), 5.0)]
    df = spark.createDataFrame(data, "timestamp timestamp_ntz, x double")
    out = series.resample_mean(df, "timestamp", "1S")
    got = [(r.timestamp, r.x) for r in out.orderBy("timestamp").collect()]
    assert got == [(t0, 2.0), (t0 + dt.timedelta(seconds=1), None), (t0 + dt.timedelta(seconds=2), None),
                   (t0 + dt.timedelta(seconds=3), 5.0)]


def test_resample_seven_minutes_aligned_to_first_midnight(spark):
    data = [(dt.datetime(2024, 1, 1, 0, 3), 1.0), (dt.datetime(2024, 1, 1, 0, 25), 2.0),
            (dt.datetime(2024, 1, 2, 0, 1), 3.0)]
    df = spark.createDataFrame(data, "timestamp timestamp_ntz, x double")
    out = series.resample_mean(df, "timestamp", "7min").orderBy("timestamp").collect()
    assert len(out) == 206
    assert out[0].timestamp == dt.datetime(2024, 1, 1, 0, 0) and out[0].x == 1.0
    filled = [(r.timestamp, r.x) for r in out if r.x is not None]
    assert filled == [(dt.datetime(2024, 1, 1, 0, 0), 1.0), (dt.datetime(2024, 1, 1, 0, 21), 2.0),
                      (dt.datetime(2024, 1, 1, 23, 55), 3.0)]


def test_global_index_dense_under_one_hot_key(spark):
    # one key holds most rows; the index must still be dense and ordered
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 < 8, F.lit(0)).otherwise(F.col("id") % 7).alias("key"),
                                     F.col("id").alias("seq"))
    ix = global_index(df, ["key"], ["seq"])
    w = Window.orderBy("key", "seq")
    chk = ix.withColumn("rn", F.row_number().over(w) - 1).where(F.col("rn") != F.col(IDX))
    assert chk.count() == 0
    rn = row_number_in_key(ix, ["key"], "n")
    w2 = Window.partitionBy("key").orderBy("seq")
    assert rn.withColumn("m", F.row_number().over(w2)).where(F.col("m") != F.col("n")).count() == 0


@pytest.mark.parametrize("distinct", [1, 50])
def test_ranges_stay_even_on_equal_values(spark, distinct):
    """Neither one key nor a few order values make a large range."""
    df = spark.range(0, 20_000).select(F.lit("k").alias("key"), (F.col("id") % distinct).alias("v"),
                                       F.col("id").alias("other"))
    sizes = [r["count"] for r in ordered(df, ["key"], ["v"]).frame.groupBy("_range").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_ranges_stay_even_on_equal_rows(spark):
    """400,000 equal rows are spread over all ranges and still get every index once."""
    df = spark.range(0, 400_000, 1, 16).select(F.lit("k").alias("key"), F.lit(1.0).alias("v"))
    got = ordered(df, ["key"], ["v"])
    sizes = [r["count"] for r in got.frame.groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    r = got.frame.agg(F.countDistinct(IDX), F.min(IDX), F.max(IDX)).collect()[0]
    assert tuple(r) == (400_000, 0, 399_999)


def test_map_columns_can_be_ordered(spark):
    df = spark.createDataFrame([(i % 3, {"a": i, "b": 2}, [{"c": i}]) for i in range(9)],
                               "k int, m map<string,int>, l array<map<string,int>>")
    assert sorted(r[IDX] for r in global_index(df, [], ["k"]).collect()) == list(range(9))


@pytest.mark.parametrize("block,keyed", [(4, False), (4, True), (7, False)])
def test_exponential_over_several_levels(spark, block, keyed):
    """Blocks of few rows force three and more levels; long gaps empty whole blocks and blocks of blocks."""
    pd = pytest.importorskip("pandas")
    import numpy as np
    rng = np.random.default_rng(11)
    n = 500
    x = rng.normal(size=n)
    x[rng.random(n) < 0.4] = np.nan
    x[:9], x[100:190], x[300:420] = np.nan, np.nan, np.nan
    key = np.sort(rng.integers(0, 3, n)) if keyed else np.zeros(n, dtype=int)
    exp = pd.Series(x).groupby(key).transform(lambda s: s.ewm(span=5, adjust=False).mean()).fillna(pd.Series(x))
    df = spark.createDataFrame([(int(k), i, None if np.isnan(v) else float(v)) for i, (k, v) in enumerate(zip(key, x))],
                               "k int, seq int, x double")
    got = series.exponential(df, ["k"] if keyed else [], ["seq"], "x", span=5, block=block)
    got = [r.x_filtered for r in got.orderBy("seq").collect()]
    assert len(got) == n
    assert all((g is None and np.isnan(e)) or approx(g, e, 1e-9) for g, e in zip(got, exp))


def test_blocked_window_equals_plain_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("key"), F.col("id").alias("seq"),
                                     F.sin(F.col("id")).alias("x"))

    def compute(frame, w):
        return frame.withColumn("m", F.avg("x").over(w.rowsBetween(-2, 3)))
    got = blocked(ordered(df, ["key"], ["seq"]), ["key"], 2, 3, compute)
    plain = df.withColumn("p", F.avg("x").over(Window.partitionBy("key").orderBy("seq").rowsBetween(-2, 3)))
    j = got.join(plain, ["key", "seq"])
    assert j.count() == 3000
    assert j.where(F.abs(F.col("m") - F.col("p")) > 1e-12).count() == 0


@pytest.mark.parametrize("span,n,missing", [(100_000, 5000, 0.2), (7, 5000, 0.995), (1, 300, 0.5)])
def test_exponential_any_span_and_long_gaps(spark, span, n, missing):
    """Gaps over several blocks and spans far beyond the rows, against pandas."""
    pd = pytest.importorskip("pandas")
    import numpy as np
    rng = np.random.default_rng(3)
    x = rng.normal(size=n)
    x[rng.random(n) < missing] = np.nan
    exp = pd.Series(x).ewm(span=span, adjust=False).mean().fillna(pd.Series(x))
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "seq int, x double")
    got = [r.x_filtered for r in series.exponential(df, [], ["seq"], "x", span=span).orderBy("seq").collect()]
    assert all((g is None and np.isnan(e)) or approx(g, e, 1e-9) for g, e in zip(got, exp))


def test_per_key_tables_never_shuffle_the_readings(spark):
    """A written per-key table below the session's threshold is broadcast; above it the join is split."""
    from ohmflow.operators import stats
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for f in (stats.anomaly_zscore, stats.anomaly_iqr):
        out = f(df, "value", ["event_type"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            other = f(df, "value", ["event_type"])
            assert "SortMergeJoin" in other._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, other.collect())) == sorted(map(str, out.collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_downsample_keeps_extremes(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([5, 1, 9, 3, 3, 8])],
                               "key string, seq int, x double").withColumn("ts", F.col("seq").cast("timestamp"))
    out = series.downsample_minmax(df, ["key"], ["seq"], "ts", "x", buckets=2).orderBy("bucket").collect()
    assert [(r.n_points, r.x_min, r.x_max) for r in out] == [(3, 1.0, 9.0), (3, 3.0, 8.0)]


def test_parse_timestamps(spark):
    df = spark.createDataFrame([("2025/5/2",), ("2024-01-02 03:04:05",), ("abc",)], "t string")
    got = [r.t for r in series.parse_timestamps(df, "t").collect()]
    assert got == [dt.datetime(2025, 5, 2), dt.datetime(2024, 1, 2, 3, 4, 5), None]


def test_resample_guard(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 2), 2.0)],
                               "timestamp timestamp_ntz, x double")
    with pytest.raises(ValueError):
        series.resample_mean(df, "timestamp", "1S", max_bins=1000)


def test_resample_without_time_column_is_unchanged(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.warns(UserWarning):
        assert series.resample_mean(df, "timestamp", "1S") is df
