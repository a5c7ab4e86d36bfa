"""Relations between tables: row policy semi-join, FK joins, orphans, cascade,
verdicts against standards, breakdown points, simulated vs measured (J1-J4, D5-D7).

Join strategy: only the seed standards table (four rows, fixed) is broadcast
explicitly.  Every other side grows with the data, so the plain join is left
to AQE, which broadcasts at run time when a side is measured small and splits
skewed partitions otherwise.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.columns import nan_to_null
from ..session import shuffle_partitions
from .ordering import global_index, row_number_in_key

__all__ = ["writers_only", "detail", "orphans", "cascade_delete", "standards_frame", "criteria", "verdict",
           "breakdown_point", "deviation", "numbered_deviation"]


def writers_only(df: DataFrame, user_col: str, profiles: DataFrame, roles: list[str] | None = None,
                 profile_id: str = "id", role_col: str = "role") -> DataFrame:
    """Rows whose user holds a writer role (``IN (SELECT ...)`` as a left semi join)."""
    allowed = profiles.where(F.col(role_col).isin(*(roles or schemas.WRITER_ROLES))).select(
        F.col(profile_id).alias("_uid"))
    return df.join(allowed, F.col(user_col) == F.col("_uid"), "left_semi")


def detail(child: DataFrame, parent: DataFrame, fk: str, pk: str, prefix: str = "") -> DataFrame:
    """Child rows with their parent's columns (left join: a missing parent gives NULLs)."""
    p = parent.select(*[F.col(c).alias(prefix + c) for c in parent.columns])
    return child.join(p, F.col(fk) == F.col(prefix + pk), "left")


#: parents beyond which their keys are a table of hashes, and children are not sorted
HASHED_PARENTS = 1 << 20


def _without(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose FK is no parent's.

    Many parents: each task holds its share of their keys in a table of hashes,
    about HASHED_PARENTS at most, and the children stream past it, however many
    they are (a sort would hold them all).  Few: left to AQE, which broadcasts them.
    """
    keys = parent.select(F.col(pk).alias("_pk"))
    shares = math.ceil(keys.count() / HASHED_PARENTS)
    if shares > shuffle_partitions(child.sparkSession):
        keys = keys.repartition(shares, "_pk")
    if shares > 1:
        keys = keys.hint("shuffle_hash")
    return child.join(keys, F.col(fk) == F.col("_pk"), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-null FK has no parent (what the FK would refuse)."""
    return _without(child.where(F.col(fk).isNotNull()), parent, fk, pk)


def cascade_delete(child: DataFrame, deleted_parents: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children remaining after their parents are deleted (ON DELETE CASCADE)."""
    return _without(child, deleted_parents, fk, pk)


def standards_frame(spark: SparkSession) -> DataFrame:
    """The four seed test standards (code, name, type, parameters, pass_criteria JSON)."""
    return spark.createDataFrame(schemas.SEED_STANDARDS,
                                 "standard_code string, standard_name string, test_type string, "
                                 "parameters string, pass_criteria string")


def criteria(standards: DataFrame) -> DataFrame:
    """One row per pass criterion: standard_code, test_type, measure, upper (limit of a ``max_*``
    criterion) or wanted (text the measure must equal)."""
    c = standards.select("standard_code", "test_type",
                         F.explode(F.from_json("pass_criteria", "map<string,string>")).alias("_k", "_v"))
    limit = F.when(F.col("_k").startswith("max_"), F.col("_v").try_cast("double"))
    return c.select("standard_code", "test_type",
                    F.when(limit.isNotNull(), F.substr("_k", F.lit(5))).otherwise(F.col("_k")).alias("measure"),
                    limit.alias("upper"), F.when(limit.isNull(), F.col("_v")).alias("wanted"))


def verdict(experiments: DataFrame, measured: DataFrame, standards: DataFrame, exp_id: str = "id",
            exp_type: str = "experiment_type") -> DataFrame:
    """Each criterion of the experiment's standard against the measure of its name.

    ``measured`` has rows (``exp_id``, measure, value as text).  A ``max_x``
    criterion holds if measure x is at most its limit, any other if the measure
    equals it.  One criterion that does not hold: fail; else one whose measure
    is missing, or no criterion at all: NULL (pending); else pass.  A measure
    given several times counts with its worst outcome; an experiment given
    several times (same id and type) is one.  The criteria are the fixed seed's,
    at most two a type (one row each reaches the driver), so every criterion is
    one flag of an aggregate per experiment.
    """
    c = criteria(standards)
    per_type = c.groupBy(F.col("test_type").alias("_ctype")).agg(
        F.max("standard_code").alias("standard_code"), F.count("measure").alias("_criteria"))
    named = c.where("measure is not null").distinct().orderBy("test_type", "standard_code", "measure").collect()
    value = F.col("value")

    def held(r):
        ok = F.col("value") == r.wanted if r.upper is None else value.try_cast("double") <= r.upper
        return F.bool_and(F.when((F.col("measure") == r.measure) & value.isNotNull(), F.coalesce(ok, F.lit(False))))
    met = measured.groupBy(F.col(exp_id).alias("_mid")).agg(
        F.lit(0).alias("_none"), *[held(r).alias(f"_c{i}") for i, r in enumerate(named)]).drop("_none")
    e = experiments.select(F.col(exp_id).alias("_eid"), F.col(exp_type).alias("_etype")).distinct()
    # the fixed seed standards: four rows
    j = e.join(F.broadcast(per_type), F.col("_etype") == F.col("_ctype"), "left").join(
        met, F.col("_eid") == F.col("_mid"), "left")
    # of each type its own criteria: how many were measured, whether one did not hold
    checked, failed = F.lit(0).cast("long"), F.lit(False)
    for kind in dict.fromkeys(r.test_type for r in named):
        own = [F.col(f"_c{i}") for i, r in enumerate(named) if r.test_type == kind]
        this = F.col("_etype") == kind
        checked = F.when(this, sum((x.isNotNull().cast("long") for x in own), F.lit(0).cast("long"))).otherwise(checked)
        failed = F.when(this, functools.reduce(lambda x, y: x | y, [F.coalesce(~x, F.lit(False)) for x in own])).otherwise(failed)
    count = F.coalesce(F.col("_criteria"), F.lit(0)).alias("criteria")
    result = F.when(failed, F.lit("fail")).when((checked > 0) & (F.col("_criteria") == checked), F.lit("pass"))
    return j.select(F.col("_eid").alias(exp_id), F.col("_etype").alias(exp_type), "standard_code", count,
                    checked.alias("criteria_checked"), result.alias("verdict"))


def breakdown_point(df: DataFrame, key: str, order: list[str], column: str, limit: float) -> DataFrame:
    """Per key, the first reading (in ``order``) whose ``column`` exceeds ``limit``.

    A filtered partial aggregate of min(struct(order, value)): skew-safe."""
    x = nan_to_null(F.col(column).cast("double"))
    over = df.where(x > F.lit(limit))
    first = F.min(F.struct(*[F.col(c) for c in order], x.alias("_v")))
    out = over.groupBy(key).agg(first.alias("_f"))
    return out.select(key, *[F.col(f"_f.{c}").alias(c) for c in order], F.col("_f._v").alias(column))


def deviation(measured: DataFrame, simulated: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """|measured - simulated| per reading (equi-join on ``keys``), mean and max per ``group``."""
    s = simulated.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col(value).alias("_sim"))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_s_{k}")
        cond = c if cond is None else cond & c
    j = measured.join(s, cond, "inner")
    d = F.abs(nan_to_null(F.col(value).cast("double")) - F.col("_sim"))
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("n_points"), F.avg(d).alias("mean_abs_deviation"),
                                F.max(d).alias("max_abs_deviation"))


def numbered_deviation(measured: DataFrame, simulated: DataFrame, group: str, order: list[str],
                       value: str) -> DataFrame:
    """D7 with both sides paired by their place in ``order`` inside each ``group``.

    Both sides are numbered by one range partitioning and meet in an aggregate
    on (group, number); places that only one side has count nothing.
    """
    cols = [group, *order, value]
    both = measured.select(*cols, F.lit(0).alias("_side")).unionByName(
        simulated.select(*cols, F.lit(1).alias("_side")))
    numbered = row_number_in_key(global_index(both, [group, "_side"], order), [group, "_side"], "_seq")
    side = [F.struct(nan_to_null(F.col(value).cast("double")).alias("v")) for _ in range(2)]
    pairs = numbered.groupBy(group, "_seq").agg(*[
        F.max(F.when(F.col("_side") == i, side[i])).alias(f"_{i}") for i in range(2)])
    d = F.abs(F.col("_0.v") - F.col("_1.v"))
    return pairs.where("_0 is not null and _1 is not null").groupBy(group).agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(d).alias("mean_abs_deviation"), F.max(d).alias("max_abs_deviation"))
