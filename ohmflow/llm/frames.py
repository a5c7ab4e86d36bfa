"""DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: rows that Spark hands to Python at once; its default of 10,000 whole texts is 30 MB and more on either side
BATCH_ROWS = 1000


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and get texts in small batches.

    On a cluster whose nodes lack that folder, give the package by --py-files.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that were running on it,
    not the plan behind the table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: ``maybe_in`` gives each key so many bits, in slots of the size that ``bitmap_construct_agg`` has; it
#: broadcasts 32 MB of slots at most, and with more keys lets more other rows pass
BITS_PER_KEY, SLOT_BITS, MOST_SLOTS = 32, 32768, 8192


def maybe_in(df: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``df`` and the boolean ``name``: false only where ``key``, a 64-bit hash, is not in the column ``key`` of ``keys``.

    A broadcast bitmap of the hashes, so no row of ``df`` is shuffled.  ``keys`` is read
    twice and should be stored.  At 32 bits a key 3 % of the other rows are true as
    well; whoever asks has to look again.
    """
    slots = min(MOST_SLOTS, keys.count() * BITS_PER_KEY // SLOT_BITS + 1)
    place = [F.expr(f"pmod(`{key}`, {slots * SLOT_BITS}L) div {SLOT_BITS}").alias("_slot"),
             F.expr(f"pmod(`{key}`, {slots * SLOT_BITS}L) % {SLOT_BITS}").alias("_bit")]
    bits = (keys.select(*place).repartition("_slot").groupBy("_slot")
            .agg(F.bitmap_construct_agg("_bit").alias("_bits")))
    byte = "cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return (df.select("*", *place).join(F.broadcast(bits), "_slot", "left")
            .withColumn(name, F.expr(f"coalesce(getbit({byte}, cast(_bit % 8 as int)) = 1, false)"))
            .drop("_slot", "_bit", "_bits"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``links``: (node, comp), comp the smallest node.

    Every round each node takes the smallest label among its neighbours and
    itself, then jumps to its label's label; the label table is written to the
    shared folder each round, and rounds stop when no label moves.  Hot nodes
    are pre-aggregated by the map-side minimum.
    """
    both = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                  .unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(
        F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = (both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node"))
                .agg(F.min("comp").alias("near")))
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("comp").alias("jump"))
        nxt = stored(low.join(up, "new", "left").select(
            "node", F.col("comp").alias("was"), F.least("new", F.coalesce("jump", "new")).alias("comp")), "labels")
        moved = nxt.where("comp <> was").limit(1).count()
        labels = nxt.select("node", "comp")
        if not moved:
            return labels
