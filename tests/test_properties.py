"""Property tests: filters agree with pandas on random, skewed, gappy series."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ohmflow.operators import series

values = st.one_of(st.none(), st.floats(min_value=-1e3, max_value=1e3, allow_nan=False, allow_infinity=False))
series_data = st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", "c"]), values), min_size=1, max_size=60)


def _frame(spark, data):
    rows = [(k, i, v) for i, (k, v) in enumerate(data)]
    return spark.createDataFrame(rows, "key string, seq int, x double")


def _same(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=series_data, method=st.sampled_from(["mean", "median"]), w=st.integers(min_value=1, max_value=6))
def test_centred_matches_pandas(spark, data, method, w):
    pd = pytest.importorskip("pandas")
    got = {r.seq: r.x_filtered for r in series.filter_data(
        _frame(spark, data), "x", "moving_average" if method == "mean" else method, w, keys=["key"],
        order=["seq"]).collect()}
    frame = pd.DataFrame([(k, i, v) for i, (k, v) in enumerate(data)], columns=["key", "seq", "x"])
    for _, g in frame.groupby("key"):
        x = g["x"].astype(float)
        exp = getattr(x.rolling(w, center=True), method)().fillna(x)
        for seq, e in zip(g["seq"], exp):
            assert _same(got[seq], None if pd.isna(e) else float(e)), (seq, got[seq], e)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=series_data, span=st.integers(min_value=1, max_value=9))
def test_exponential_matches_pandas(spark, data, span):
    pd = pytest.importorskip("pandas")
    df = _frame(spark, data)
    got = {r.seq: r.x_filtered for r in series.exponential(df, ["key"], ["seq"], "x", span=span).collect()}
    frame = pd.DataFrame([(k, i, v) for i, (k, v) in enumerate(data)], columns=["key", "seq", "x"])
    for _, g in frame.groupby("key"):
        x = g["x"].astype(float)
        exp = x.ewm(span=span, adjust=False).mean().fillna(x)
        for seq, e in zip(g["seq"], exp):
            e = None if pd.isna(e) else float(e)
            assert _same(got[seq], e), (seq, got[seq], e)
