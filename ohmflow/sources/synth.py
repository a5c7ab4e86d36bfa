"""Synthetic readings (S5) as a scalable source.

One series per row of a driving frame (an experiment, a device, ...); each
row explodes into ``duration * rate`` points, so the work grows with the
driving table and every series is generated inside Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import shuffle_partitions

__all__ = ["synth_readings", "normal_pair"]

CHUNK = 1 << 12


def _num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


#: a prime below 2**31, so that a product of two residues fits a long
PRIME = (1 << 31) - 1
#: factors of the seed, the series and the point, and of the two mixing rounds
PLACE, ROUNDS = (1_000_003, 7_919, 104_729), (48_271, 69_621)


def _mixed(x: Column) -> Column:
    """A residue whose neighbours have little in common: quadratic maps modulo PRIME."""
    for c in ROUNDS:
        x = (x * (x + F.lit(c)) + F.lit(c)) % F.lit(PRIME)
    return x


def normal_pair(seed: int, series: Column, point: Column) -> tuple[Column, Column]:
    """Two standard normal values that depend on the arguments alone (Box-Muller on two residues mixed
    from them in long arithmetic), so reruns, retries and any partitioning give the same numbers."""
    a, b, c = PLACE
    at = (F.lit(seed % PRIME * a % PRIME).cast("long") + F.pmod(series.cast("long"), F.lit(PRIME)) * F.lit(b)
          + F.pmod(point.cast("long"), F.lit(PRIME)) * F.lit(c))
    first = _mixed(at % F.lit(PRIME))
    second = _mixed((first + at + F.lit(c)) % F.lit(PRIME))
    u1, u2 = ((x + F.lit(0.5)) / F.lit(float(PRIME)) for x in (first, second))
    radius, angle = F.sqrt(-2 * F.ln(u1)), 2 * math.pi * u2
    return radius * F.cos(angle), radius * F.sin(angle)


def synth_readings(drivers: DataFrame, series_id: str, start, duration: int = schemas.SYNTH_POINTS_SECONDS,
                   rate: int = 1, voltage_nominal=20.0, current_nominal=1.0, noise=0.05,
                   seed: int = 42) -> DataFrame:
    """n = duration * rate points per series, t = linspace(0, duration, n) (end inclusive),

    V = Vn (1 + noise N(0,1) + 0.1 sin(2 pi 0.1 t)), I = In (1 + 0.5 sin(2 pi 0.05 t) + noise N(0,1)),
    P = V I, sequence 1..n, timestamps start + k / rate seconds (µs arithmetic, so
    any rate works), address 1, type '测试设备'.  Nominal values may be columns
    of ``drivers``; ``start`` is explicit and noise is mixed from (seed, series, k;
    an id that is no number by its hash), so reruns are identical.  Points are made in chunks of
    ``CHUNK`` that are spread over tasks, so a long series never sits in one.
    """
    n = int(duration * rate)
    if n < 1:
        raise ValueError("duration * rate must be >= 1")
    step = float(duration) / (n - 1) if n > 1 else 0.0
    base = drivers.select(F.col(series_id).alias("series_id"), _num(voltage_nominal).alias("_vn"),
                          _num(current_nominal).alias("_in"))
    base = base.select("*", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CHUNK))).alias("_c"))
    # by number: without one, adaptive execution merges partitions by the bytes they have before the points are made
    base = base.repartition(shuffle_partitions(drivers.sparkSession), "series_id", "_c")
    lo = F.col("_c").cast("long") * F.lit(CHUNK)
    pts = base.select("series_id", "_vn", "_in",
                      F.explode(F.sequence(lo, F.least(lo + F.lit(CHUNK - 1), F.lit(n - 1)))).alias("_k"))
    t = F.col("_k") * F.lit(step)
    if noise:
        number = dict(drivers.dtypes)[series_id] in ("tinyint", "smallint", "int", "bigint")
        sid = F.col("series_id") if number else F.xxhash64("series_id")
        nv, ni = (z * F.lit(float(noise)) for z in normal_pair(seed, sid, F.col("_k")))
    else:
        nv = ni = F.lit(0.0)
    (va, vf), (ia, if_) = schemas.SYNTH_VOLTAGE_WAVE, schemas.SYNTH_CURRENT_WAVE
    v = F.col("_vn") * (F.lit(1.0) + nv + F.lit(va) * F.sin(F.lit(2 * math.pi * vf) * t))
    i = F.col("_in") * (F.lit(1.0) + F.lit(ia) * F.sin(F.lit(2 * math.pi * if_) * t) + ni)
    ts = F.timestamp_add("MICROSECOND", F.expr(f"(_k * 1000000L) div {int(rate)}"),
                         F.lit(start).cast("timestamp_ntz"))
    out = pts.select("series_id", (F.col("_k") + 1).cast("int").alias("sequence_number"), i.alias("current"),
                     v.alias("voltage"), ts.alias("timestamp"))
    return out.select("series_id", "sequence_number", "current", "voltage",
                      (F.col("current") * F.col("voltage")).alias("power"), "timestamp",
                      F.lit(schemas.DEFAULT_DEVICE_ADDRESS).alias("device_address"),
                      F.lit(schemas.SYNTH_DEVICE_TYPE).alias("device_type"))
