"""Fixture tests for rules and statistics (FIXTURES 1, 2, 4)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import approx
from ohmflow.functions.columns import canonical_names, strict_double
from ohmflow.operators import quality, stats

RULE_CASES = [  # current, voltage, power, expected violated rules
    ("0", "0", "0", set()),
    ("0", "5", "0.01", {"power_mismatch"}),
    ("1000", "1", "1000", set()),
    ("1000.1", "1", "1000.1", {"current_above_max"}),
    ("1", "10000", "10000", set()),
    ("1", "10001", "10001", {"voltage_above_max"}),
    ("-1", "10", "-10", {"current_negative", "power_mismatch"}),
    ("1", "-10", "-10", {"voltage_negative", "power_mismatch"}),
    ("2", "10", "20.5", set()),
    ("2", "10", "21.5", {"power_mismatch"}),
    ("abc", "10", "20", {"current_not_numeric"}),
    (None, "10", "20", {"current_not_numeric"}),
    ("2", "10", "nan", {"power_not_numeric"}),
    ("1d", "10", "10", {"current_not_numeric"}),
]


@pytest.mark.parametrize("i", range(len(RULE_CASES)))
def test_rule_boundaries(spark, i):
    c, v, p, exp = RULE_CASES[i]
    df = spark.createDataFrame([(c, v, p)], "current string, voltage string, power string")
    rep = quality.validation_report(df)
    got = {r.rule for r in rep.collect() if r.violations > 0}
    assert got == exp
    assert all(r.valid == (not exp) for r in rep.collect())


def test_report_lists_missing_columns(spark):
    df = spark.createDataFrame([("1", "2")], "`电流 (A)` string, x string")
    rep = quality.validation_report(df, strict_names=True).collect()
    assert [(r.rule, r.violations) for r in rep] == [("missing: current, voltage, power", 3)]
    rep2 = quality.validation_report(df)             # unit suffix stripped: current found
    assert [r.rule for r in rep2.collect() if r.rule.startswith("missing")] == ["missing: voltage, power"]
    assert quality.validation_messages(rep2).collect()[0].messages == "缺少必需列: 电压, 功率"


def test_alias_normalisation():
    assert canonical_names(["I", "V", "P", "i"]) == ["current", "voltage", "power", "i"]
    assert canonical_names(["电流 (A)", "电压 (V)", "功率 (W)", "时间戳"]) == ["current", "voltage", "power", "timestamp"]
    assert canonical_names(["电流 (A)"], strict=True) == ["电流 (A)"]
    assert canonical_names(["current", "电流", "Current"]) == ["current_other", "current", "Current"]


def test_strict_double(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("1d",), ("1f",), ("inf",), ("nan",), ("1,000",), ("",), (None,)], "s string")
    got = [r.x for r in df.select(strict_double(F.col("s")).alias("x")).collect()]
    assert got[:1] == [1.5] and got[1:3] == [None, None] and got[3] == float("inf") and got[4:] == [None] * 4


def test_shape_records_defaults(spark):
    df = spark.createDataFrame([("e1", 2, 5.0), ("e1", 1, 4.0)], "eid string, seq int, `功率` double")
    out = quality.shape_records(df, "eid", [], ["seq"], now=F.lit("2024-01-01").cast("timestamp_ntz"))
    got = [tuple(r) for r in out.orderBy("sequence_number").collect()]
    assert [g[:7] for g in got] == [("e1", 1, 0.0, 0.0, 4.0, 1, "未知"), ("e1", 2, 0.0, 0.0, 5.0, 1, "未知")]
    assert "temperature" not in out.columns


def test_check_constraints_null_passes(spark):
    df = spark.createDataFrame([("s1", "m", "normal"), ("s2", "m", None), ("s3", None, "broken")],
                               "device_serial string, device_model string, status string")
    got = {(r.column_name, r.rule): r.violations for r in quality.check_constraints(df, "devices").collect()}
    assert got[("status", "check_in")] == 1 and got[("device_model", "not_null")] == 1


def test_duplicate_keys_nulls_do_not_collide(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert [(r.k, r.row_count) for r in quality.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]


def test_iqr_and_zscore(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    flags = {r.x: r.is_anomaly for r in stats.anomaly_iqr(df, "x").collect()}
    assert flags == {1.0: False, 2.0: False, 3.0: False, 4.0: False, 100.0: True}
    z = spark.createDataFrame([(0.0,)] * 19 + [(100.0,)], "x double")
    zf = stats.anomaly_zscore(z, "x").groupBy("is_anomaly").count().collect()
    assert {r.is_anomaly: r["count"] for r in zf} == {False: 19, True: 1}
    const = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert stats.anomaly_zscore(const, "x").where("is_anomaly").count() == 0
    with pytest.raises(ValueError):
        stats.detect_anomalies(df, "x", "isolation")


def test_statistics_edge_cases(spark):
    one = spark.createDataFrame([(7.0,)], "current double")
    r = stats.signal_statistics(one).collect()[0]
    assert (r.current_mean, r.current_max, r.current_min, r.current_median, r.current_std) == (7.0, 7.0, 7.0, 7.0, None)
    miss = spark.createDataFrame([(1.0,), (None,), (3.0,)], "current double")
    r = stats.signal_statistics(miss).collect()[0]
    assert (r.current_mean, r.current_median) == (2.0, 2.0)
    e = spark.createDataFrame([(1000.0,), (2000.0,)], "power double")
    r = stats.signal_statistics(e).collect()[0]
    assert approx(r.total_energy, 3.0) and r.power_factor == 0.0
    z = spark.createDataFrame([(0.0, 0.0, 1.0)], "current double, voltage double, power double")
    assert stats.signal_statistics(z).collect()[0].power_factor is None


def test_quantiles_match_pandas(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    vals = rng.normal(size=501).round(3)
    keys = rng.integers(0, 4, size=501)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, vals)], "k int, x double")
    got = {r.k: (r.x_q1, r.x_median, r.x_q3)
           for r in stats.exact_quantiles(df, ["k"], ["x"], [0.25, 0.5, 0.75]).collect()}
    for k in range(4):
        sel = vals[keys == k]
        exp = np.quantile(sel, [0.25, 0.5, 0.75])
        assert all(approx(g, e, 1e-12) for g, e in zip(got[k], exp))


@pytest.mark.parametrize("band_rows", [None, 20, 1])
def test_quantiles_from_narrowed_bands(spark, band_rows):
    """Several narrowing passes, ties that fill a band, infinite values, groups of all sizes."""
    import numpy as np
    rng = np.random.default_rng(5)
    cols = {"a": rng.normal(size=20_000), "b": np.repeat([1.0, 2.0, 3.0], 4000), "c": rng.normal(size=7).round(1),
            "d": np.array([4.0]), "e": np.concatenate([rng.lognormal(size=999), [np.inf, -np.inf]])}
    df = spark.createDataFrame([(k, float(v), None) for k, x in cols.items() for v in x] + [("f", None, None)],
                               "k string, x double, y double").repartition(6)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = {r[0]: r for r in stats._selected(df, ["k"], ["x", "y"], probs, [], band_rows).collect()}
    for k, x in cols.items():
        want = [x.min(), *np.quantile(x, probs[1:-1]), x.max()]
        assert [got[k][f"_q{i}"] for i in range(6)] == pytest.approx(want, abs=1e-12)
        assert got[k]["_q6"] is None
    assert got["f"]["_q3"] is None
    whole = stats._selected(df.select("x"), [], ["x"], [0.5], [], band_rows).collect()[0]["_q0"]
    assert whole == pytest.approx(np.median(np.concatenate(list(cols.values()))))


def test_quantiles_shuffle_sketches_and_bands_only(spark):
    """The rows exchanged for the selection are the band's few values, not the column's."""
    df = spark.range(0, 50_000, 1, 4).select((F.col("id") % 2).alias("k"), F.rand(1).alias("x"))
    bands = stats._bands(df, ["k"], ["x"], [0.5], [])
    rows = stats._up_to_bands(df, ["k"], ["x"], [0.5], bands)
    inside = rows.where("_x is not null").count()
    assert 0 < inside <= 50_000 * 7 / stats.GRID


def test_column_profile_and_totals(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (1, None, 2.0), (None, "b", 2.0)], "a int, b string, c double")
    prof = {r.column_name: (r.non_null_count, r.distinct_count, r.null_count) for r in stats.column_profile(df).collect()}
    assert prof == {"a": (2, 1, 1), "b": (2, 2, 1), "c": (2, 1, 1)}
    t = stats.frame_totals(df).collect()[0]
    assert (t.row_count, t.column_count, t.null_cells) == (3, 3, 3)


def test_sequence_numbers(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 5), ("a", 2)], "k string, t int")
    got = sorted((r.k, r.t, r.sequence_number) for r in quality.sequence_numbers(df, ["k"], ["t"]).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 5, 1)]


def test_approx_quantiles_close(spark):
    df = spark.range(0, 10001).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"))
    got = {r.k: r.x_median for r in stats.exact_quantiles(df, ["k"], ["x"], [0.5], method="approx").collect()}
    assert abs(got[0] - 5000) <= 2 and abs(got[1] - 5000) <= 2


def test_validation_messages_original_text(spark):
    df = spark.createDataFrame([("e", "abc", "10", "20"), ("e", "-1", "10", "-10"), ("f", "2", "10", "20")],
                               "k string, current string, voltage string, power string")
    rep = quality.validation_report(df, keys=["k"])
    got = {r.k: (r.valid, r.messages) for r in quality.validation_messages(rep, ["k"]).collect()}
    assert got["f"] == (True, "")
    assert got["e"] == (False, "列 '电流' 包含非数值数据; 电流值不能为负数; 功率值与电流电压计算值偏差过大")


def test_quantiles_all_null_group(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", 3.0)], "k string, x double")
    got = {r.k: r.x_median for r in stats.exact_quantiles(df, ["k"], ["x"], [0.5]).collect()}
    assert got.get("a") is None and got["b"] == 2.0


def test_statistics_of_an_all_missing_group_and_equal_values(spark):
    rows = [("a", None)] * 3 + [("b", 2.0)] * 50 + [("b", 4.0)] * 50 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, current double")
    got = {r.k: tuple(r)[1:] for r in stats.signal_statistics(df, keys=["k"]).collect()}
    assert got["a"] == (None,) * 5
    assert got["b"][:3] == (3.0, 4.0, 2.0) and got["b"][4] == 3.0 and approx(got["b"][3], (100 / 99) ** 0.5)
    assert got[None] == (1.0, 1.0, 1.0, None, 1.0)


def test_unique_violations_and_all_tables(spark):
    from ohmflow import schemas
    df = spark.createDataFrame([("s1",), ("s1",), (None,), (None,)], "device_serial string")
    assert [tuple(r) for r in quality.unique_violations(df, "devices").collect()] == [
        ("devices", "device_serial", "s1", 2)]
    for name, schema in schemas.TABLES.items():
        empty = spark.createDataFrame([], schema)
        assert all(r.violations == 0 for r in quality.check_constraints(empty, name).collect())
