"""Time series: resampling, centred / exponential filters, thinning.

Ordered work goes through ``ordering``: rows get a dense index from one range
partitioning, and windows run over bounded blocks of it with halo rows, so a
key holding a third of all rows, or a table that is one series, is spread
over as many tasks as any other.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, parse_timestamp
from ..session import materialize, shuffle_partitions
from .ordering import BLK, IDX, attach, blocked, global_index, join_on_keys, ordered, row_number_in_key

US = 1_000_000
DAY_US = 86_400 * US


SPINE_CHUNK = 4096

__all__ = ["resample_mean", "parse_timestamps", "filter_data", "moving_average", "moving_median",
           "exponential", "downsample_minmax", "interval_seconds", "parse_timestamp"]


def _freq_us(freq: str | int | float) -> int:
    """'1S', '7min', '1h', '1D' or seconds -> microseconds."""
    if isinstance(freq, (int, float)):
        return int(round(freq * US))
    s = freq.strip().lower()
    units = [("ms", 1000), ("us", 1), ("min", 60 * US), ("t", 60 * US), ("s", US), ("h", 3600 * US),
             ("d", 86400 * US)]
    for u, mult in units:
        if s.endswith(u):
            num = s[: -len(u)] or "1"
            return int(round(float(num) * mult))
    raise ValueError(f"unsupported frequency {freq!r}")


def resample_mean(df: DataFrame, ts: str = "timestamp", freq: str | int | float = "1S",
                  keys: list[str] | None = None, values: list[str] | None = None,
                  ts_out: str | None = None, max_bins: int | None = None) -> DataFrame:
    """Mean of every numeric column per fixed bin; empty bins kept as NULL.

    Bins start at midnight of the first day of each key, are left-closed and
    left-labelled.  Averages come from one partial aggregate per (key, bin);
    the spine of all bins between the first and last is generated in chunks
    of ``SPINE_CHUNK`` bins that are spread over tasks before the second
    explode, so a long span never sits in one task.
    """
    keys = list(keys or [])
    step = _freq_us(freq)
    ts_out = ts_out or ts
    if ts not in df.columns:
        warnings.warn(f"no time column {ts!r}: frame returned unchanged", stacklevel=2)
        return df
    if values is None:
        numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
        values = [c for c, t in df.dtypes if t in numeric and c not in keys and c != ts]
        values += [c for c, t in df.dtypes if t.startswith("decimal") and c not in keys and c != ts]
    t = F.col(ts).cast("timestamp_ntz")
    base = df.select(*keys, t.alias("_t"), *[nan_to_null(F.col(v).cast("double")).alias(v) for v in values])
    base = base.where(F.col("_t").isNotNull())
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    if DAY_US % step == 0:
        # the step divides a day: bins from the first midnight are epoch-aligned bins, so every
        # reading gets its bin without looking up its key's first day (no join of the readings)
        binned = base.withColumn("_bin", F.floor(F.timestamp_diff("MICROSECOND", epoch, F.col("_t"))
                                                 / F.lit(step)).cast("long"))
        agg = binned.groupBy(*keys, "_bin").agg(*[F.avg(v).alias(v) for v in values])
        sp = agg.groupBy(*keys).agg(F.min("_bin").alias("_b0"), F.max("_bin").alias("_b1"))
        sp = sp.withColumn("_origin", epoch)
    else:
        spans = base.groupBy(*keys).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        spans = spans.withColumn("_origin", F.to_date("_lo").cast("timestamp_ntz"))
        binned = attach(base, spans.select(*keys, "_origin"), keys, "inner")
        binned = binned.withColumn("_bin", F.floor(F.timestamp_diff("MICROSECOND", F.col("_origin"), F.col("_t"))
                                                   / F.lit(step)).cast("long"))
        agg = binned.groupBy(*keys, "_bin").agg(*[F.avg(v).alias(v) for v in values])
        last_bin = F.floor(F.timestamp_diff("MICROSECOND", F.col("_origin"), F.col("_hi")) / F.lit(step))
        first_bin = F.floor(F.timestamp_diff("MICROSECOND", F.col("_origin"), F.col("_lo")) / F.lit(step))
        sp = spans.select(*keys, "_origin", first_bin.cast("long").alias("_b0"), last_bin.cast("long").alias("_b1"))
    if max_bins is not None:
        # optional guard: estimate the spine (one aggregate over the per-key spans) before building it
        total = sp.agg(F.sum(F.col("_b1") - F.col("_b0") + 1)).collect()[0][0] or 0
        if total > max_bins:
            raise ValueError(f"resampling would produce {total} bins (> max_bins={max_bins})")
    nchunks = F.floor((F.col("_b1") - F.col("_b0")) / F.lit(SPINE_CHUNK)).cast("long")
    chunks = sp.select(*keys, "_origin", "_b0", "_b1",
                       F.explode(F.sequence(F.lit(0).cast("long"), nchunks)).alias("_c"))
    # by number: without one, adaptive execution merges partitions by the bytes they have before the second explode
    chunks = chunks.repartition(shuffle_partitions(df.sparkSession), *keys, "_c")
    lo = F.col("_b0") + F.col("_c") * F.lit(SPINE_CHUNK)
    hi = F.least(F.col("_b1"), lo + F.lit(SPINE_CHUNK - 1))
    spine = chunks.select(*keys, "_origin", F.explode(F.sequence(lo, hi)).alias("_bin"))
    out = join_on_keys(spine, agg, keys + ["_bin"], "left")
    label = F.timestamp_add("MICROSECOND", F.col("_bin") * F.lit(step), F.col("_origin"))
    return out.select(*keys, label.alias(ts_out), *values)


def parse_timestamps(df: DataFrame, column: str, out: str | None = None, formats: list[str] | None = None) -> DataFrame:
    """Text -> TIMESTAMP_NTZ trying several patterns; unparseable -> NULL."""
    return df.withColumn(out or column, parse_timestamp(F.col(column), formats))


def interval_seconds(df: DataFrame, keys: list[str], order: list[str], ts: str, out: str = "_dt") -> DataFrame:
    """Seconds since the previous reading of the key (the first reading takes
    the interval to the next one; a lone reading counts 1 s)."""
    def compute(frame, w):
        prev = F.lag(ts, 1).over(w)
        nxt = F.lead(ts, 1).over(w)
        back = F.timestamp_diff("MICROSECOND", prev, F.col(ts)) / F.lit(float(US))
        fwd = F.timestamp_diff("MICROSECOND", F.col(ts), nxt) / F.lit(float(US))
        return frame.withColumn(out, F.coalesce(back, fwd, F.lit(1.0)))
    return blocked(ordered(df, keys, order), keys, 1, 1, compute)


def _centred(df: DataFrame, keys: list[str], order: list[str], column: str, window_size: int, out: str,
             agg: str) -> DataFrame:
    if window_size < 1:
        raise ValueError("window_size must be >= 1")
    before, after = window_size // 2, (window_size - 1) // 2

    def compute(frame, w):
        f = w.rowsBetween(-before, after)
        x = nan_to_null(F.col(column).cast("double"))
        full = F.count(x).over(f) == F.lit(window_size)
        stat = F.avg(x).over(f) if agg == "mean" else F.percentile(x, F.lit(0.5)).over(f)
        return frame.withColumn(out, F.when(full, stat).otherwise(x))
    return blocked(ordered(df, keys, order), keys, before, after, compute)


def moving_average(df, keys, order, column, window_size=5, out=None):
    """Centred mean over ``window_size`` rows, full window required, else raw value."""
    return _centred(df, keys, order, column, window_size, out or f"{column}_filtered", "mean")


def moving_median(df, keys, order, column, window_size=5, out=None):
    """Centred median, same frame and edge rule as W1."""
    return _centred(df, keys, order, column, window_size, out or f"{column}_filtered", "median")


SCAN_ROWS = 1 << 10


def _composed(df: DataFrame, w: Window, rows: int) -> DataFrame:
    """Compose the maps y -> _a y + _b of all rows up to each row of a window partition of
    at most ``rows`` rows: at distances 1, 2, 4, ... a row takes in the rows before it."""
    reach = 1
    while reach < rows:
        df = df.withColumns({"_pa": F.lag("_a", reach, 1.0).over(w), "_pb": F.lag("_b", reach, 0.0).over(w)})
        df = df.withColumns({"_b": F.col("_a") * F.col("_pb") + F.col("_b"), "_a": F.col("_a") * F.col("_pa")})
        reach *= 2
    return df.drop("_pa", "_pb") if rows > 1 else df


def _decay(alpha: float, distance: Column) -> Column:
    return F.pow(F.lit(1.0 - alpha), distance.cast("double"))


def _summed_up(parts: DataFrame, group: list[str], place: str) -> DataFrame:
    """One row per group of consecutive parts: first valid value, its place and the last one's, and the
    map from the first valid value to the value at the end (of composed parts)."""
    return parts.groupBy(*group).agg(
        F.min_by("_fx", "_fg").alias("_fx"), F.min("_fg").alias("_fg"), F.max("_lg").alias("_lg"),
        F.max_by("_a", place).alias("_ea"), F.max_by("_b", place).alias("_eb"))


def _level(parts: DataFrame, keys: list[str], alpha: float, size: int, most: int) -> DataFrame:
    """Blocks of ``size`` parts: for each part, how the value that enters it (_pa y + _pb, y the block's
    first valid value) and its own first valid value (_ia in + _ib) come about."""
    parts = parts.withColumn("_up", F.floor(F.col(BLK) / F.lit(size)).cast("long"))
    w = Window.partitionBy(*keys, "_up").orderBy(BLK)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_r", _decay(alpha, F.col("_fg") - F.last("_lg", ignorenulls=True).over(past)))
    parts = parts.withColumn("_begun", F.count("_fg").over(past) > 0)
    a, r = F.lit(alpha), F.col("_r")
    parts = parts.withColumns({"_ia": r / (r + a), "_ib": a * F.col("_fx") / (r + a)})
    first = F.col("_fg").isNotNull() & ~F.col("_begun")      # takes the block's first valid value itself
    none = F.col("_fg").isNull()                             # nothing valid: what enters it leaves it
    parts = parts.withColumns({
        "_a": F.when(none, 1.0).when(first, F.col("_ea")).otherwise(F.col("_ea") * F.col("_ia")),
        "_b": F.when(none, 0.0).when(first, F.col("_eb")).otherwise(F.col("_ea") * F.col("_ib") + F.col("_eb"))})
    parts = _composed(parts.drop("_r"), w, min(size, most))
    return parts.withColumns({"_pa": F.lag("_a").over(w), "_pb": F.lag("_b").over(w)})


def exponential(df: DataFrame, keys: list[str], order: list[str], column: str, span: float = 5,
                out: str | None = None, block: int = SCAN_ROWS) -> DataFrame:
    """y0 = x0, y = ((1-a)^g y' + a x) / ((1-a)^g + a), a = 2/(span+1).

    g is the row distance to the previous valid value (1 when adjacent);
    missing rows carry the last y; leading missing rows stay missing.

    Every row is a map y -> A y + B of the value before it (missing rows: the
    identity), and maps compose, so any span is exact.  A tree scan does it:
    blocks of ``block`` rows are composed in log2 steps relative to their first
    valid value, then blocks of ``block`` such blocks in the same way, until a
    level has one block left; then back down, each block hands its parts the
    value that enters them.  No window holds more than ``block`` rows, whatever
    the length of a key; a level has one row for ``block`` rows of the one below.
    """
    out = out or f"{column}_filtered"
    alpha = 2.0 / (span + 1.0)
    rows = ordered(df.withColumn("_x", nan_to_null(F.col(column).cast("double"))), keys, order)
    g, x, a = F.col(IDX), F.col("_x"), F.lit(alpha)

    w = Window.partitionBy(*keys, BLK).orderBy(IDX)
    upto, past = (w.rowsBetween(Window.unboundedPreceding, n) for n in (0, -1))
    d = rows.frame.drop("_range").withColumn(BLK, F.floor(g / F.lit(block)).cast("long"))
    d = d.withColumns({"_prev": F.last(F.when(x.isNotNull(), g), ignorenulls=True).over(past),
                       "_started": F.count("_x").over(upto) > 0})
    r = _decay(alpha, g - F.col("_prev"))
    own = x.isNotNull() & F.col("_prev").isNotNull()        # a block's first valid value is its y
    d = d.withColumns({"_a": F.when(own, r / (r + a)).otherwise(1.0), "_b": F.when(own, a * x / (r + a)).otherwise(0.0)})
    d = materialize(_composed(d, w, min(block, max(rows.rows, 1))).drop("_prev"), "ewm-rows")

    valid = F.when(x.isNotNull(), g)
    parts = _summed_up(d.select(*keys, BLK, IDX, F.col("_x").alias("_fx"), valid.alias("_fg"), valid.alias("_lg"),
                                "_a", "_b"), [*keys, BLK], IDX)
    levels, most = [], math.ceil(rows.rows / block)
    while True:
        levels.append(materialize(_level(parts, keys, alpha, block, most + 1), "ewm-level"))
        most = math.ceil(most / block)
        if most <= 1:
            break
        parts = _summed_up(levels[-1].withColumnRenamed(BLK, "_at"), [*keys, "_up"], "_at")
        parts = parts.withColumnRenamed("_up", BLK)
    # the last level's blocks begin their series: first valid value as it is, nothing enters
    top = Window.partitionBy(*keys, "_up").orderBy(BLK).rowsBetween(Window.unboundedPreceding,
                                                                   Window.unboundedFollowing)
    level = levels.pop().withColumns({"_y": F.first("_fx", ignorenulls=True).over(top),
                                      "_in": F.lit(None).cast("double")})
    while True:
        enters = F.when(F.col("_begun"), F.col("_pa") * F.col("_y") + F.col("_pb")).otherwise(F.col("_in"))
        level = level.select(*keys, BLK, "_begun", "_ia", "_ib", "_y", enters.alias("_in"))
        level = level.select(*keys, BLK, "_in", F.when(F.col("_begun"), F.col("_ia") * F.col("_in") + F.col("_ib"))
                             .otherwise(F.col("_y")).alias("_y"))
        if not levels:
            break
        level = attach(levels.pop(), level.withColumnRenamed(BLK, "_up"), [*keys, "_up"])
    y = F.when(F.col("_started"), F.col("_a") * F.col("_y") + F.col("_b")).otherwise(F.col("_in"))
    return (attach(d, level, [*keys, BLK]).withColumn(out, F.coalesce(y, x))
            .drop("_x", "_started", "_a", "_b", "_y", "_in", BLK, IDX))


def filter_data(df: DataFrame, column: str, method: str = "moving_average", window_size: int = 5,
                keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """W1-W3 entry point: ``{column}_filtered`` with edge fill from the raw value."""
    keys, order = list(keys or []), list(order or [])
    if method == "moving_average":
        return moving_average(df, keys, order, column, window_size)
    if method == "median":
        return moving_median(df, keys, order, column, window_size)
    if method == "exponential":
        return exponential(df, keys, order, column, span=window_size)
    raise ValueError(f"unknown filter method {method!r} (moving_average, median, exponential)")


def downsample_minmax(df: DataFrame, keys: list[str], order: list[str], ts: str, column: str,
                      buckets: int = 1000) -> DataFrame:
    """Thin each key to ``buckets`` buckets of consecutive readings,
    keeping first/last time and the minimum and maximum readings with their
    times (earliest reading wins ties)."""
    rn = row_number_in_key(global_index(df, keys, order), keys, "_rn", size="_nk")
    x = nan_to_null(F.col(column).cast("double"))
    t = rn.select(*keys, F.expr(f"((_rn - 1) * {int(buckets)}L) div _nk").alias("bucket"), F.col(ts).alias("_ts"),
                  x.alias("_v"), F.col("_rn"))
    lo = F.min(F.when(F.col("_v").isNotNull(), F.struct(F.col("_v"), F.col("_rn"), F.col("_ts"))))
    hi = F.max(F.when(F.col("_v").isNotNull(), F.struct(F.col("_v"), (-F.col("_rn")).alias("_nrn"), F.col("_ts"))))
    agg = t.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("_ts").alias("ts_first"), F.max("_ts").alias("ts_last"),
        lo.alias("_lo"), hi.alias("_hi"))
    return agg.select(*keys, "bucket", "n_points", "ts_first", "ts_last",
                      F.col("_lo._v").alias(f"{column}_min"), F.col("_lo._ts").alias("ts_min"),
                      F.col("_hi._v").alias(f"{column}_max"), F.col("_hi._ts").alias("ts_max"))
