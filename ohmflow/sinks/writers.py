"""Sinks and table writes (K1-K7).

Writes go to a caller-given path (on a cluster: shared storage).  Appends
lay readings out by day with rows sorted by experiment and time inside each
file, so range and experiment filters skip row groups.  Updates without a
table format are a left join of changes onto the base: ``upsert`` returns the new
rows (the caller writes them), ``upsert_partitions`` rewrites the touched
partitions of a stored table in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# full microsecond precision on the way out (the writers' defaults stop at ms)
TS_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
              "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

__all__ = ["write_csv", "write_json", "write_multi", "default_export_name", "append_readings", "apply_defaults",
           "append_rows", "upsert", "upsert_partitions", "row_id", "export_name", "column_widths"]


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", mode: str = "overwrite") -> str:
    """K1: header row, no index column, chosen encoding; quotes inside a cell are doubled."""
    if encoding.upper() not in ("UTF-8", "UTF8"):
        from ..session import enable_legacy_charsets
        enable_legacy_charsets(df.sparkSession)
    (df.write.mode(mode).options(**TS_OPTIONS).option("header", "true").option("escape", '"')
     .option("encoding", encoding).csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """K2: JSON Lines, UTF-8 kept as is, every column in every line (missing ones null)."""
    df.write.mode(mode).options(**TS_OPTIONS).option("ignoreNullFields", "false").json(path)
    return path


# fixed values: default export name pattern (prefix + local time stamp)
EXPORT_PREFIX = "export"
EXPORT_STAMP = "%Y%m%d_%H%M%S"


def default_export_name(now=None) -> str:
    """``export_<yyyyMMdd_HHmmss>`` for an artefact without a given name."""
    import datetime as _dt
    return f"{EXPORT_PREFIX}_{(now or _dt.datetime.now()).strftime(EXPORT_STAMP)}"


def export_name(stamp: Column) -> Column:
    """The same name as a column, from a time stamp column."""
    return F.concat(F.lit(f"{EXPORT_PREFIX}_"), F.date_format(stamp, "yyyyMMdd_HHmmss"))


def column_widths(df: DataFrame) -> DataFrame:
    """Per column the width a sheet gives it: its longest cell or its name, and 2 more (empty cells count 0)."""
    wide = df.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(f"_w{i}") for i, c in enumerate(df.columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 (F.greatest(F.coalesce(F.col(f"_w{i}"), F.lit(0)), F.lit(len(c))) + 2).alias("width"))
        for i, c in enumerate(df.columns)])))


def write_multi(frames: dict[str, DataFrame], root: str | None = None, fmt: str = "parquet",
                spark=None) -> dict[str, str]:
    """K3: several named frames as one artefact: ``{root}/{name}/`` each.

    Without ``root`` the artefact goes to ``export_<stamp>`` under the shared
    checkpoint folder."""
    if root is None:
        from ..session import ensure_checkpoint_dir
        sess = spark or next(iter(frames.values())).sparkSession
        root = f"{ensure_checkpoint_dir(sess).rstrip('/')}/{default_export_name()}"
    out = {}
    for name, df in frames.items():
        p = f"{root.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).option("header", "true").save(p)
        out[name] = p
    return out


def append_readings(df: DataFrame, path: str, ts: str = "timestamp", key: str = "experiment_id",
                    period: str = "month", lookup: tuple[str, ...] = ()) -> str:
    """K4 / K7: append partitioned by ``reading_{period}`` (first day of the
    month or the day itself), rows sorted by (key, ts) inside each file so
    that experiment and time filters skip row groups.  The shuffle is a range
    partitioning on (period, key, ts): a busy month or a hot experiment is
    cut into many tasks, and files hold non-overlapping (key, ts) ranges.
    ``lookup`` columns get Parquet bloom filters, so that a search for one of
    their values skips the row groups without it; each filter has the size its
    row group's number of values asks for (a fixed one would be 1 MB)."""
    col = f"reading_{period}"
    part = F.trunc(F.to_date(ts), "month") if period == "month" else F.to_date(ts)
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in lookup}
    if lookup:
        blooms["parquet.bloom.filter.adaptive.enabled"] = "true"
    (df.withColumn(col, part)
       .repartitionByRange(col, key, ts)
       .sortWithinPartitions(col, key, ts)
       .write.mode("append").options(**blooms)
       .partitionBy(col).parquet(path))
    return path


def append_rows(df: DataFrame, path: str) -> str:
    """K7: plain append (audit rows keep the given user id)."""
    df.write.mode("append").parquet(path)
    return path


def row_id(table: str) -> Column:
    """Id of a row from its natural key, in UUID form; the same row gets the same id on every rerun."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schemas.NATURAL_KEYS[table]]
    h = F.md5(F.concat_ws("\x1f", F.lit(table), *parts))
    return F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def apply_defaults(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """K5: column defaults of the table by ``coalesce``: id, status, role, time stamps.

    A missing id is the hash of the row's natural key (where its columns are
    there); time stamps default to ``now``, the time of the query if not given.
    """
    now = now if now is not None else F.current_timestamp()
    kinds = dict(df.dtypes)
    cols = {}
    if "id" in kinds and set(schemas.NATURAL_KEYS.get(table, ["id"])) <= set(kinds) and table in schemas.NATURAL_KEYS:
        cols["id"] = F.coalesce(F.col("id").cast("string"), row_id(table))
    for c, v in schemas.DEFAULTS.get(table, {}).items():
        if c in kinds:
            cols[c] = F.coalesce(F.col(c), F.lit(v))
    for c in ("created_at", "updated_at", "upload_time", "start_time"):
        if c in kinds:
            cols[c] = F.coalesce(F.col(c), now.cast(kinds[c]))
    return df.withColumns(cols) if cols else df


def upsert(base: DataFrame, changes: DataFrame, key: str, now: Column,
           stamp: str | None = "updated_at", order: str | None = None) -> DataFrame:
    """K6: base rows with the non-null values of ``changes`` applied by key.

    Every row that a change names gets ``stamp`` = ``now``, whether or not a value
    differs (the trigger fires on each update).  Several changes of one key
    apply in ``order``: per column the last non-null value holds; without
    ``order`` they raise.  Keys absent from ``base`` are not inserted.
    """
    cols = [c for c in changes.columns if c != key and c in base.columns and c not in (stamp, order)]
    if order is not None:
        last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}") for c in cols]
        ch = changes.groupBy(F.col(key).alias("_ck")).agg(F.lit(True).alias("_hit"), *last)
    else:
        once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(
            F.lit(f"several changes of one {key} and no order: "), F.first(F.col(key).cast("string")))))
        ch = changes.groupBy(F.col(key).alias("_ck")).agg(
            F.coalesce(once.cast("boolean"), F.lit(True)).alias("_hit"),
            *[F.first(c).alias(f"_new_{c}") for c in cols])
    j = base.join(ch, F.col(key) == F.col("_ck"), "left")
    out = []
    for c in base.columns:
        if c in cols:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
        elif c == stamp:
            out.append(F.when(F.col("_hit"), now.cast(dict(base.dtypes)[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def upsert_partitions(spark: SparkSession, path: str, changes: DataFrame, key: str, partitions: list[str],
                      now: Column, stamp: str | None = "updated_at", order: str | None = None) -> int:
    """K6 on a stored, partitioned Parquet table: only partitions with a changed row are written again.

    A semi-join on the ids finds them (only ids and partition columns are read);
    their new rows go to the shared scratch folder first, then replace the
    partitions by dynamic overwrite.  All other files stay as they are.  A job
    that is lost between the two steps is simply run again: an update sets
    values, so doing it twice changes nothing.  Returns the number of partitions.
    """
    from ..session import materialize
    base = spark.read.parquet(path)
    changes = materialize(changes, "changes")
    ids = changes.select(F.col(key).alias("_ck")).distinct()
    touched = materialize(base.join(ids, F.col(key) == F.col("_ck"), "left_semi").select(*partitions).distinct(),
                          "touched-partitions")
    values = touched.collect()                               # one row per partition folder
    if not values:
        return 0

    def among(rows) -> Column:                               # a filter on literals prunes the folders
        out = F.lit(False)
        for r in rows:
            same = F.lit(True)
            for c in partitions:
                same = same & F.col(c).eqNullSafe(F.lit(r[c]))
            out = out | same
        return out
    new = materialize(upsert(base.where(among(values)), changes, key, now, stamp, order), "upserted")
    (new.select(*base.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))
    return len(values)
