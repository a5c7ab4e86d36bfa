"""Ordered work without a task per key.

``ordered``
    range-partitions the rows on (keys, order, a hash of the row, the input
    partition), sorts the ranges, writes them once and gives every row a dense
    0-based index in that order: its place in its range plus the sizes of the
    ranges before it (a table of one row per range).  The hash lets a range
    end between rows that tie in the order, the input partition between
    fully equal rows (which may change places), so a hot key, a repeated value
    or a repeated row makes no range larger than what one input task holds of
    it; the number of ranges follows the number of rows.

``blocked``
    cuts the index into equal blocks, copies the ``before`` last rows of each
    block into the next one and the ``after`` first rows into the previous
    one, and lets a window run over ``partitionBy(keys, block)``.  Halo copies
    are dropped afterwards.

``attach``
    joins a table of one row per key back to its rows; the table is written
    first, so Spark knows its size and broadcasts it below the session's
    ``spark.sql.autoBroadcastJoinThreshold``, else splits the rows of hot keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, shuffle_partitions

IDX = "_g"
BLK = "_blk"
HOME = "_home"
RANGE_ROWS = 1 << 20
_IN_RANGE = (1 << 33) - 1         # monotonically_increasing_id: range number above, place in it below


@dataclass
class Ordered:
    """Rows with their index ``_g`` and range ``_range``; how many there are of both."""
    frame: DataFrame
    rows: int
    ranges: int

    def block_rows(self, halo: int = 1) -> int:
        return max(math.ceil(self.rows / self.ranges), halo, 1)


def attach_one_row(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The row is packed into one struct and read as a scalar subquery (computed
    once, shipped as a value): no join at all, so neither a nested-loop nor a
    cartesian plan.  A second row would fail the subquery, which is the
    contract of a global aggregate.
    """
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_s")).scalar()
    return left.select(*[F.col(c) for c in left.columns],
                       *[packed[c].alias(c) for c in one_row.columns])


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL keys match each other (group semantics)."""
    if not keys:
        return attach_one_row(left, right)
    ren = right.select(*[F.col(k).alias(f"_rk_{i}") for i, k in enumerate(keys)],
                       *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(ren[f"_rk_{i}"])
        cond = c if cond is None else cond & c
    return left.join(ren, cond, how).drop(*[f"_rk_{i}" for i in range(len(keys))])


def attach(left: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the columns of ``per_key`` (one row per key; one row in all without keys).

    The table is written first: its size is known to the join, which Spark
    plans by it, and the hot keys of a join of stored tables can be split.
    """
    if not keys:
        return attach_one_row(left, per_key)
    return join_on_keys(left, materialize(per_key, "per-key"), keys, how)


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, T.MapType) or (isinstance(t, T.ArrayType) and _has_map(t.elementType))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row's content; a map counts by its sorted entries, maps inside other types not at all."""
    parts = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.MapType) and not _has_map(t.keyType) and not _has_map(t.valueType):
            parts.append(F.array_sort(F.map_entries(c)))
        elif not _has_map(t):
            parts.append(c)
    return F.xxhash64(*parts) if parts else F.lit(0).cast("long")


def ordered(df: DataFrame, keys: list[str], order: list[str], name: str = IDX) -> Ordered:
    """Rows with a dense 0-based index in (keys, order); ties in ``order`` fall by the rows' hashes.

    The input partition only tells equal rows apart.  It is the same when a task
    is run again, unlike a row's place in it, so a lost executor costs no row.
    """
    by = list(dict.fromkeys([*keys, *order]))
    rows = df.count()
    ranges = max(shuffle_partitions(df.sparkSession), math.ceil(rows / RANGE_ROWS))
    placed = materialize(
        df.withColumns({"_tie": row_hash(df), "_part": F.spark_partition_id()})
        .repartitionByRange(ranges, *by, "_tie", "_part").sortWithinPartitions(*by, "_tie")
        .drop("_tie", "_part").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rng = F.shiftright("_at", 33).cast("int")
    sizes = placed.groupBy(rng.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0))
    # one row per range: bounded by the number of ranges
    offsets = F.broadcast(sizes.select(F.col("_range").alias("_r"), before.alias("_off")))
    out = placed.withColumn("_range", rng).join(offsets, F.col("_range") == F.col("_r"))
    out = out.withColumn(name, F.col("_off") + F.col("_at").bitwiseAND(F.lit(_IN_RANGE)))
    return Ordered(out.drop("_at", "_off", "_r"), rows, ranges)


def global_index(df: DataFrame, keys: list[str], order: list[str], name: str = IDX) -> DataFrame:
    """``ordered`` as a frame with the index alone."""
    return ordered(df, keys, order, name).frame.drop("_range")


def _halo_copies(before: int, after: int, block_rows: int) -> Column:
    g = F.col(IDX)
    blk = F.floor(g / F.lit(block_rows)).cast("long")
    pos = g - blk * F.lit(block_rows)
    none = F.array().cast("array<struct<_blk:bigint,_home:boolean>>")
    parts = [F.array(F.struct(blk.alias(BLK), F.lit(True).alias(HOME)))]
    if before > 0:   # my tail is the next block's look-back
        parts.append(F.when(pos >= F.lit(block_rows - before),
                            F.array(F.struct((blk + 1).alias(BLK), F.lit(False).alias(HOME)))).otherwise(none))
    if after > 0:    # my head is the previous block's look-ahead
        parts.append(F.when((pos < F.lit(after)) & (blk > 0),
                            F.array(F.struct((blk - 1).alias(BLK), F.lit(False).alias(HOME)))).otherwise(none))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def blocked(rows: Ordered, keys: list[str], before: int, after: int,
            compute: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """Run ``compute(frame, window)`` over bounded (keys, block) window partitions.

    ``window`` is ``partitionBy(keys, _blk).orderBy(_g)``; ``compute`` adds columns
    using row frames no wider than ``before`` rows back and ``after`` ahead.
    """
    size = rows.block_rows(max(before, after))
    frame = rows.frame.drop("_range")
    cols = frame.columns
    copies = frame.select("*", F.explode(_halo_copies(before, after, size)).alias("_c")).select(
        *cols, F.col("_c." + BLK).alias(BLK), F.col("_c." + HOME).alias(HOME))
    out = compute(copies, Window.partitionBy(*keys, BLK).orderBy(IDX))
    return out.where(F.col(HOME)).drop(BLK, HOME, IDX)


def row_number_in_key(indexed: DataFrame, keys: list[str], name: str = "sequence_number",
                      size: str | None = None) -> DataFrame:
    """1-based position inside each key from an index; with ``size`` also the key's number of rows."""
    if not keys and size is None:
        return indexed.withColumn(name, F.col(IDX) + 1)
    per = indexed.groupBy(*keys).agg(F.min(IDX).alias("_g0"), F.count(F.lit(1)).alias(size or "_nk"))
    out = attach(indexed, per, keys, "inner").withColumn(name, F.col(IDX) - F.col("_g0") + 1).drop("_g0")
    return out if size else out.drop("_nk")
