"""Statistics and outliers.

Every function takes ``keys``: with ``keys=[]`` the whole frame is one group,
which is the original behaviour; with keys each group gets its own answer.

Exact quantiles (median, quartiles) are selected from bands.  The first pass
gathers moments and a mergeable quantile sketch of bounded error per group;
the sketch gives two values between which a wanted rank must lie.  The next pass
counts the values below the band and gathers, as value counts, only those
inside it.  A band that may still hold more than ``BAND_ROWS`` rows is narrowed by
a sketch of its own values first.  So sketches and bands are all that is
shuffled, and no group is ever held in one task, whatever its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import nan_to_null
from ..session import materialize
from .ordering import attach, join_on_keys

SIGNALS = ["current", "voltage", "power"]
APPROX_ACCURACY = 100_000
#: quantiles taken from a sketch, and the sketch's accuracy (rank error at most 1 / SKETCH_ACCURACY, well below a grid step)
GRID, SKETCH_ACCURACY = 200, 2000
#: rows of a band that one task may sort
BAND_ROWS = 1 << 20


def _label(p: float) -> str:
    return {0.25: "q1", 0.5: "median", 0.75: "q3"}.get(p, f"p{int(round(p * 100)):02d}")


def _x(c: str) -> Column:
    return nan_to_null(F.col(c).cast("double"))


def _grid(c: Column) -> Column:
    return F.percentile_approx(c, [i / GRID for i in range(GRID + 1)], SKETCH_ACCURACY)


def _edges(grid: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Values that enclose the ranks ``low`` to ``high`` (as shares of all), a grid step of slack on either side."""
    i, j = F.floor(low * GRID).cast("int") - 2, F.ceil(high * GRID).cast("int") + 2
    return (F.when(i >= 0, F.get(grid, i)).otherwise(F.lit(float("-inf"))),
            F.when(j <= GRID, F.get(grid, j)).otherwise(F.lit(float("inf"))))


def _bands(df: DataFrame, keys: list[str], values: list[str], probs: list[float], extra: list[Column]) -> DataFrame:
    """One row per key: ``extra`` aggregates, and for each (value, probability) its band: an array of
    (c number, n values, at0 and at1 wanted ranks, frac between them, lo, hi)."""
    per = df.groupBy(*keys).agg(*[F.count(_x(v)).alias(f"_n{i}") for i, v in enumerate(values)],
                                *[_grid(_x(v)).alias(f"_g{i}") for i, v in enumerate(values)], *extra)
    bands = []
    for i in range(len(values)):
        n = F.col(f"_n{i}")
        for p in probs:
            pos = F.lit(float(p)) * (n - 1)
            lo, hi = _edges(F.col(f"_g{i}"), F.try_divide(F.floor(pos), n), F.try_divide(F.ceil(pos) + 1, n))
            bands.append(F.struct(F.lit(len(bands)).alias("c"), n.alias("n"), F.floor(pos).cast("long").alias("at0"),
                                  F.ceil(pos).cast("long").alias("at1"), (pos - F.floor(pos)).alias("frac"),
                                  lo.alias("lo"), hi.alias("hi")))
    return materialize(per.withColumn("_b", F.array(*bands)).drop(
        *[f"_{x}{i}" for i in range(len(values)) for x in "ng"]), "bands")


def _up_to_bands(df: DataFrame, keys: list[str], values: list[str], probs: list[float], bands: DataFrame) -> DataFrame:
    """(keys, band's fields, _x): every value up to the end of each of its column's bands; those below it as NULL."""
    slim = join_on_keys(df.select(*keys, *values), bands.select(*keys, "_b"), keys)
    rows = slim.select(*keys, F.inline(F.array(*[
        F.struct(F.get("_b", F.lit(i * len(probs) + j)).alias("_band"), _x(v).alias("_x"))
        for i, v in enumerate(values) for j in range(len(probs))]))).where(F.col("_x") <= F.col("_band.hi"))
    return rows.select(*keys, "_band", F.when(F.col("_x") >= F.col("_band.lo"), F.col("_x")).alias("_x"))


def _narrowed(df: DataFrame, keys: list[str], values: list[str], probs: list[float], bands: DataFrame) -> DataFrame:
    """``bands`` with edges taken from sketches of the values inside them."""
    rows = _up_to_bands(df, keys, values, probs, bands)
    per = rows.groupBy(*keys, "_band").agg(F.count_if(F.col("_x").isNull()).alias("_below"),
                                           F.count("_x").alias("_in"), _grid(F.col("_x")).alias("_g"))
    b = F.col("_band")
    lo, hi = _edges(F.col("_g"), F.try_divide(b.at0 - F.col("_below"), F.col("_in")),
                    F.try_divide(b.at1 + 1 - F.col("_below"), F.col("_in")))
    new = F.struct(b.c.alias("c"), b.n.alias("n"), b.at0.alias("at0"), b.at1.alias("at1"), b.frac.alias("frac"),
                   F.greatest(lo, b.lo).alias("lo"), F.least(hi, b.hi).alias("hi"))
    per = per.select(*keys, "_below", new.alias("_new")).groupBy(*keys).agg(F.collect_list("_new").alias("_news"))
    # every band keeps its place; one without a value stays as it is
    old = join_on_keys(bands, per, keys, "left")
    found = F.transform("_b", lambda band: F.coalesce(
        F.get(F.filter("_news", lambda x: x.c == band.c), F.lit(0)), band))
    return materialize(old.withColumn("_b", found).drop("_news"), "bands")


def _selected(df: DataFrame, keys: list[str], values: list[str], probs: list[float], extra: list[Column],
              band_rows: int | None = None) -> DataFrame:
    """One row per key: ``extra`` aggregates and ``_q{c}``, the quantile of each (value, probability)."""
    bands = _bands(df, keys, values, probs, extra)
    # one number: the largest group's values
    most = bands.select(F.inline("_b")).agg(F.max("n")).collect()[0][0] or 0
    share = 7 / GRID
    most *= share
    while most > (band_rows or BAND_ROWS):
        bands = _narrowed(df, keys, values, probs, bands)
        most *= share
    counted = _up_to_bands(df, keys, values, probs, bands).groupBy(*keys, "_band", "_x").agg(
        F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys, "_band").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    cum = counted.select(*keys, "_band", "_x", F.sum("_n").over(upto).alias("_cum"))
    at = lambda w: F.min(F.when(F.col("_cum") > F.col(f"_band.{w}"), F.col("_x")))
    found = cum.groupBy(*keys, "_band").agg(at("at0").alias("_lo"), at("at1").alias("_hi"))
    q = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_band.frac"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_band.c") == c, q)).alias(f"_q{c}")
                                      for c in range(len(values) * len(probs))])
    return join_on_keys(bands.drop("_b"), wide, keys, "left")


def exact_quantiles(df: DataFrame, keys: list[str], values: list[str], probs: list[float],
                    method: str = "exact") -> DataFrame:
    """One row per key with ``{value}_{label}`` columns (linear interpolation).

    NULL and NaN are ignored; a group without values gets NULL.  ``approx`` is
    Spark's bounded sketch (relative rank error 1 / APPROX_ACCURACY).
    """
    if method == "approx":
        aggs = []
        for v in values:
            arr = F.percentile_approx(nan_to_null(F.col(v).cast("double")), [float(p) for p in probs], APPROX_ACCURACY)
            aggs += [arr[i].alias(f"{v}_{_label(p)}") for i, p in enumerate(probs)]
        return df.groupBy(*keys).agg(*aggs)
    if method != "exact":
        raise ValueError(f"unknown quantile method {method!r} (exact, approx)")
    got = _selected(df, keys, values, probs, [])
    return got.select(*keys, *[F.col(f"_q{i * len(probs) + j}").alias(f"{v}_{_label(p)}")
                               for i, v in enumerate(values) for j, p in enumerate(probs)])


def signal_statistics(df: DataFrame, keys: list[str] | None = None, signals: list[str] | None = None) -> DataFrame:
    """A1-A3: mean, max, min, sample std, median per signal; energy and power factor.

    Signals absent from ``df`` are skipped.  ``total_energy`` = sum(power) * 0.001
    (the original's factor); ``power_factor`` = mean(P) / (mean(I) * mean(V)),
    NULL where the denominator is 0 and 0.0 when current or voltage is absent.
    The moments come with the sketches of the medians, in one pass.
    """
    keys = list(keys or [])
    present = [s for s in (signals or SIGNALS) if s in df.columns]
    if not present:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    aggs = [f(_x(s)).alias(f"{s}_{what}") for s in present
            for what, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_samp))]
    if "power" in present:
        aggs.append((F.sum(_x("power")) * F.lit(schemas.ENERGY_FACTOR)).alias("total_energy"))
    out = _selected(df, keys, present, [0.5], aggs)
    cols = [F.col(f"_q{i}").alias(f"{s}_median") if what == "median" else F.col(f"{s}_{what}")
            for i, s in enumerate(present) for what in ("mean", "max", "min", "std", "median")]
    if "power" in present:
        cols.append(F.col("total_energy"))
        if "current" in present and "voltage" in present:
            cols.append(F.try_divide("power_mean", F.col("current_mean") * F.col("voltage_mean")).alias("power_factor"))
        else:
            cols.append(F.lit(0.0).alias("power_factor"))
    return out.select(*keys, *cols)


def anomaly_iqr(df: DataFrame, column: str, keys: list[str] | None = None,
                quantile_method: str = "exact", flag: str = schemas.ANOMALY_FLAG) -> DataFrame:
    """A4: flag x < Q1 - 1.5 IQR or x > Q3 + 1.5 IQR; missing values never flagged."""
    keys = list(keys or [])
    q = exact_quantiles(df, keys, [column], [0.25, 0.75], method=quantile_method)
    q = q.select(*keys, F.col(f"{column}_q1").alias("_q1"), F.col(f"{column}_q3").alias("_q3"))
    x = nan_to_null(F.col(column).cast("double"))
    iqr = F.col("_q3") - F.col("_q1")
    cond = (x < F.col("_q1") - F.lit(schemas.IQR_FENCE) * iqr) | (x > F.col("_q3") + F.lit(schemas.IQR_FENCE) * iqr)
    return attach(df, q, keys).withColumn(flag, F.coalesce(cond, F.lit(False))).drop("_q1", "_q3")


def anomaly_zscore(df: DataFrame, column: str, keys: list[str] | None = None,
                   flag: str = schemas.ANOMALY_FLAG) -> DataFrame:
    """A5: |x - mean| / sample std > 3; std 0 or undefined -> not flagged."""
    keys = list(keys or [])
    x = nan_to_null(F.col(column).cast("double"))
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"))
    z = F.abs(F.try_divide(x - F.col("_mu"), F.col("_sd")))
    return (attach(df, m, keys)
            .withColumn(flag, F.coalesce(z > F.lit(schemas.ZSCORE_LIMIT), F.lit(False))).drop("_mu", "_sd"))


def detect_anomalies(df: DataFrame, column: str, method: str = "iqr", keys: list[str] | None = None) -> DataFrame:
    if method == "iqr":
        return anomaly_iqr(df, column, keys)
    if method == "zscore":
        return anomaly_zscore(df, column, keys)
    raise ValueError(f"unknown anomaly method {method!r} (iqr, zscore)")


def _is_float(dtype: str) -> bool:
    return dtype in ("double", "float")


_INTEGRAL = ("tinyint", "smallint", "int", "bigint", "boolean")
_TIME = ("timestamp", "timestamp_ntz", "date")


def _slot(c: str, t: str) -> tuple[int, Column]:
    """Value type for the distinct count: 0 long, 1 double, 2 timestamp, 3 string (exact in each)."""
    x = F.col(c)
    if t in _INTEGRAL:
        return 0, x.cast("long")
    if _is_float(t):
        return 1, nan_to_null(x.cast("double"))
    if t in _TIME:
        return 2, x.cast("timestamp_ntz")
    return 3, x.cast("string")


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column dtype, non-null count, distinct count (nulls excluded), null count.

    One scan: every cell becomes (position, typed value), equal cells are
    counted map-side, and the counts of a position give all three numbers.
    Values keep their type (long / double / timestamp / string), so none
    changes identity.  Each distinct value is shuffled once, which stays
    costly for near-unique columns; ``approx=True`` counts with HyperLogLog.
    """
    dtypes = df.dtypes
    meta = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(dtypes)],
                                           "position int, column_name string, dtype string")
    if approx:
        aggs = []
        for i, (c, t) in enumerate(dtypes):
            x = nan_to_null(F.col(c)) if _is_float(t) else F.col(c)
            aggs.append(F.struct(F.lit(i).alias("position"), F.count(x).alias("non_null_count"),
                                 F.approx_count_distinct(x).alias("distinct_count"),
                                 F.count_if(x.isNull()).alias("null_count")))
        out = df.agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))
    else:
        kinds = ("long", "double", "timestamp_ntz", "string")
        entries = []
        for i, (c, t) in enumerate(dtypes):
            k, v = _slot(c, t)
            entries.append(F.struct(F.lit(i).alias("position"), *[
                (v if j == k else F.lit(None).cast(kind)).alias(f"_{kind}") for j, kind in enumerate(kinds)]))
        slots = [f"_{kind}" for kind in kinds]
        counted = df.select(F.inline(F.array(*entries))).groupBy("position", *slots).agg(
            F.count(F.lit(1)).alias("_n"))
        known = sum((F.col(x).isNotNull().cast("int") for x in slots), F.lit(0))
        out = counted.groupBy("position").agg(
            F.sum(F.when(known > 0, F.col("_n")).otherwise(0)).alias("non_null_count"),
            F.count_if(known > 0).alias("distinct_count"),
            F.sum(F.when(known > 0, 0).otherwise(F.col("_n"))).alias("null_count"))
    # one row per column; an empty frame has counts of zero
    out = F.broadcast(meta).join(out, "position", "left")
    return out.select("position", "column_name", "dtype", *[
        F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("non_null_count", "distinct_count", "null_count")])


def frame_totals(df: DataFrame) -> DataFrame:
    """Rows, columns and total missing cells."""
    nulls = [F.count_if((F.isnan(F.col(c)) | F.col(c).isNull()) if _is_float(t) else F.col(c).isNull())
             for c, t in df.dtypes]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
                  total.cast("long").alias("null_cells"))


def energy_kwh(indexed_with_dt: DataFrame, keys: list[str], power: str = "power", dt: str = "_dt") -> DataFrame:
    """A2 (corrected unit): sum(P * dt seconds) / 3.6e6 per key."""
    return indexed_with_dt.groupBy(*keys).agg(
        (F.sum(nan_to_null(F.col(power).cast("double")) * F.col(dt)) / F.lit(3.6e6)).alias("energy_kwh"))


__all__ = ["exact_quantiles", "signal_statistics", "anomaly_iqr", "anomaly_zscore", "detect_anomalies",
           "column_profile", "frame_totals", "energy_kwh"]
