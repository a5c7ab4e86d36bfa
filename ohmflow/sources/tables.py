"""Parquet table access and the role mapping of the driver's test tables.

The test tables are a star schema, not readings; each role below renames
columns so that the library operators see readings, experiments, devices, ...
(mapping documented in SURVEY 7.3).  Projections are explicit so that the
Parquet scan reads only the columns a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain scan of one Parquet table (column pruning and filter pushdown by Catalyst)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def series_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a keyed series: key=user_id, ts, seq tie-break=event_id, x=value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"),
                    F.col("value").alias("x"), "event_type", "props")


def readings_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as stored readings: experiment_id=l_orderkey, I=l_quantity,
    V=l_extendedprice (crosses the 10 kV bound), P=l_extendedprice * (1 - l_discount)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("experiment_id"), "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("l_quantity").alias("current"), F.col("l_extendedprice").alias("voltage"),
                     "l_discount", "l_returnflag", "l_linestatus", F.col("l_shipdate").alias("timestamp"))


def readings_ivp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to part: I=l_quantity, V=p_retailprice, P=l_extendedprice.

    part is joined on its key; AQE broadcasts it when it is small at run time
    and keeps a shuffle join otherwise (part grows with the scale factor).
    """
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return (li.join(p, "l_partkey", "left")
            .select(F.col("l_orderkey").alias("experiment_id"), "l_linenumber", "l_partkey", "l_suppkey",
                    "l_returnflag", "l_linestatus",
                    F.col("l_quantity").alias("current"), F.col("p_retailprice").alias("voltage"),
                    F.col("l_extendedprice").alias("power"), F.col("l_shipdate").alias("timestamp")))


READINGS_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def readings_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """readings_ivp with text-typed signals and derived dirty cells:
    current is 'abc' on line 7 and '<n>d' on line 6, power is 'nan' on line 5
    of returned ('R') items.  Every row of the table is kept."""
    r = readings_ivp(spark, sf_dir)
    ln = F.col("l_linenumber")
    cur = (F.when(ln == 7, F.lit("abc")).when(ln == 6, F.concat(F.col("current").cast("string"), F.lit("d")))
           .otherwise(F.col("current").cast("string")))
    pw = (F.when((ln == 5) & (F.col("l_returnflag") == "R"), F.lit("nan"))
          .otherwise(F.col("power").cast("string")))
    return r.withColumns({"current": cur, "power": pw})


def experiments_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as experiments: id=o_orderkey, name=o_orderpriority, type from the
    priority digit ('5' maps outside the allowed set), device=o_custkey,
    created/start=o_orderdate, status and result from o_orderstatus."""
    o = table(spark, sf_dir, "orders")
    d = F.substring("o_orderpriority", 1, 1)
    etype = (F.when(d == "1", "dielectric").when(d == "2", "leakage").when(d == "3", "normal")
             .when(d == "4", "abnormal").otherwise("overload"))
    st = F.col("o_orderstatus")
    status = F.when(st == "F", "completed").when(st == "O", "running").otherwise("cancelled")
    result = F.when(st == "F", "pass").when(st == "O", "fail").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("experiment_name"),
                    etype.alias("experiment_type"), F.col("o_custkey").alias("device_id"),
                    F.col("o_orderdate").alias("start_time"), status.alias("status"), result.alias("result"),
                    F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created_at"))


def devices_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as devices: serial=c_name, model=c_mktsegment, rated_power=c_acctbal,
    status from the segment (FURNITURE maps outside the allowed set, BUILDING to NULL)."""
    c = table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    status = (F.when(seg == "HOUSEHOLD", "retired").when(seg == "MACHINERY", "maintenance")
              .when(seg == "BUILDING", F.lit(None).cast("string")).when(seg == "FURNITURE", "broken")
              .otherwise("normal"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("device_serial"),
                    seg.alias("device_model"), F.col("c_nationkey").alias("device_address"),
                    F.col("c_acctbal").alias("rated_power"), status.alias("status"))


def files_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as stored files: size=n_chars, type=source, experiment=doc_id * 20
    (documents grow 15x slower than orders, so about a quarter point past the
    last experiment: orphans for the FK check at every scale)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"),
                    F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
                    F.col("n_chars").alias("file_size"), F.col("source").alias("file_type"),
                    (F.col("doc_id") * 20).alias("experiment_id"))


def profiles_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as user profiles: AUTOMOBILE -> admin, BUILDING -> engineer, else viewer."""
    c = table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    role = F.when(seg == "AUTOMOBILE", "admin").when(seg == "BUILDING", "engineer").otherwise("viewer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), role.alias("role"))
