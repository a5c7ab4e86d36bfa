"""Empty inputs: every main operator returns an empty (or one-row global) result, no error."""

from __future__ import annotations

import pytest

from ohmflow.operators import quality, series, stats
from ohmflow.operators.ordering import global_index

SCHEMA = "key string, seq int, ts timestamp_ntz, current double, voltage double, power double"


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("method", ["moving_average", "median", "exponential"])
def test_filters_on_empty(empty, method):
    out = series.filter_data(empty, "current", method, 5, keys=["key"], order=["seq"])
    assert out.count() == 0 and "current_filtered" in out.columns


def test_index_resample_stats_report_on_empty(empty):
    assert global_index(empty, ["key"], ["seq"]).count() == 0
    assert series.resample_mean(empty, "ts", "1S", keys=["key"]).count() == 0
    assert stats.signal_statistics(empty, keys=["key"]).count() == 0
    assert stats.exact_quantiles(empty, ["key"], ["current"], [0.5]).count() == 0
    assert quality.validation_report(empty, keys=["key"]).count() == 0
    g = stats.signal_statistics(empty).collect()
    assert len(g) == 1 and g[0].current_mean is None


def test_null_key_is_its_own_group(spark):
    rows = [(None, 1, 1.0), (None, 2, 2.0), (None, 3, 6.0), ("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 60.0)]
    df = spark.createDataFrame(rows, "key string, seq int, x double")
    out = series.filter_data(df, "x", "moving_average", 3, keys=["key"], order=["seq"])
    got = {(r.key, r.seq): r.x_filtered for r in out.collect()}
    assert got[(None, 2)] == 3.0 and got[("a", 2)] == 30.0 and got[(None, 1)] == 1.0
    seq = quality.sequence_numbers(df, ["key"], ["seq"])
    assert sorted((r.key or "", r.seq, r.sequence_number) for r in seq.collect()) == [
        ("", 1, 1), ("", 2, 2), ("", 3, 3), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3)]
