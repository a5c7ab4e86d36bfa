"""Source and sink queries.

Each query first writes files that Spark derives from a test table into a
fresh folder under the session's checkpoint folder (shared storage on a
cluster), then runs the source or sink under test and returns what it
reads back, so the oracle compares the round trip with the table itself.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.columns import strict_double
from ..operators import quality
from ..session import enable_legacy_charsets, scratch_path, shuffle_partitions
from ..sinks import writers
from ..sources import files as fsrc
from ..sources.synth import PLACE, PRIME, ROUNDS, synth_readings
from ..sources.tables import devices_customer, readings_lineitem, table
from ..streaming import live
from . import roles
from .registry import query, rounded

LABEL_SQL = "CASE l_returnflag WHEN 'A' THEN '验收' WHEN 'N' THEN '正常' ELSE '退回' END"


def _label():
    rf = F.col("l_returnflag")
    return F.when(rf == "A", "验收").when(rf == "N", "正常").otherwise("退回")


EXTS_SQL = "['csv', 'xlsx', 'json', 'txt', 'CSV', 'xls', 'parquet']"
EXTS = ["csv", "xlsx", "json", "txt", "CSV", "xls", "parquet"]


@query("admit_files", sql=f"""
WITH f AS (SELECT doc_id AS id, 'doc_' || CAST(doc_id AS VARCHAR) || '.' || {EXTS_SQL}[(doc_id % 7) + 1] AS file_name,
                  n_chars * 2500 AS length FROM documents),
g AS (SELECT id, file_name, lower(split_part(file_name, '.', -1)) AS extension, length FROM f)
SELECT id, file_name, extension, length,
       CASE WHEN extension NOT IN ('xlsx', 'xls', 'csv', 'json') THEN 'unsupported type'
            WHEN length > 52428800 THEN 'too large' END AS reason,
       extension IN ('xlsx', 'xls', 'csv', 'json') AND length <= 52428800 AS admitted
FROM g""")
def q_admit_files(spark, d):
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("doc_id") % 7 + 1).cast("int"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    listing = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("/files/"), name).alias("path"),
                          name.alias("file_name"), (F.col("n_chars") * 2500).alias("length"))
    listing = listing.withColumn("extension", F.lower(F.element_at(F.split("file_name", r"\."), -1)))
    return fsrc.admit_files(listing).select("id", "file_name", "extension", "length", "reason", "admitted")


@query("scan_csv", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {LABEL_SQL} AS label FROM lineitem""")
def q_scan_csv(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                            "l_returnflag", _label().alias("label"))
    root = scratch_path(spark, "scan-csv")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "label"]
    writers.write_csv(li.where(F.col("l_returnflag") != "R").select(*cols), f"{root}/utf8", "UTF-8")
    writers.write_csv(li.where(F.col("l_returnflag") == "R").select(*cols), f"{root}/gbk", "GBK")
    back = fsrc.scan_csv(spark, root, glob="*.csv")
    return back.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"),
                       F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"),
                       strict_double(F.col("l_quantity")).alias("l_quantity"), "label")


PREAMBLE_HEADER = ["序号", "电流 (A)", "电压 (V)", "功率 (W)", "时间戳", "设备地址", "设备类型", "order_key", "part_key"]


_PREAMBLE_SQL = """
SELECT l_orderkey AS order_key, l_partkey AS part_key, {seq} AS sequence_number, l_quantity AS current,
       l_extendedprice AS voltage, l_tax AS power, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS timestamp,
       CAST(l_suppkey AS INTEGER) AS device_address, {kind} AS device_type
FROM lineitem"""


def _preamble_lines(spark, d, sequence):
    """Per thousand orders one file: a line about the data, a blank line, the header, the readings."""
    li = table(spark, d, "lineitem")
    data = li.select(F.floor(F.col("l_orderkey") / 1000).cast("long").alias("grp"), F.lit(3).alias("_o"), *[
        c.cast("string") for c in (sequence, F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"),
                                   F.date_format("l_shipdate", "yyyy/M/d"), F.col("l_suppkey"),
                                   F.col("l_returnflag"), F.col("l_orderkey"), F.col("l_partkey"))])
    cells = [f"c{i}" for i in range(len(PREAMBLE_HEADER))]
    data = data.toDF("grp", "_o", *cells)
    per = data.groupBy("grp").agg(F.count(F.lit(1)).cast("string").alias("n"))
    none = F.lit(None).cast("string")
    meta = per.select("grp", F.lit(0).alias("_o"), F.lit("数据信息").alias("c0"),
                      F.concat(F.lit("数据点数: "), F.col("n")).alias("c1"), *[none.alias(c) for c in cells[2:]])
    blank = per.select("grp", F.lit(1).alias("_o"), *[none.alias(c) for c in cells])
    head = per.select("grp", F.lit(2).alias("_o"), *[F.lit(h).alias(c) for h, c in zip(PREAMBLE_HEADER, cells)])
    return data.unionByName(meta).unionByName(blank).unionByName(head), cells


def _write_lines(lines, cells, path, encoding="UTF-8"):
    if encoding != "UTF-8":
        enable_legacy_charsets(lines.sparkSession)
    (lines.repartition("grp").sortWithinPartitions("grp", "_o", *cells).drop("_o")
     .write.option("sep", "\t").option("encoding", encoding).partitionBy("grp").csv(path))


def _preamble_typed(raw):
    typed = quality.coerce_numeric(raw)
    return typed.select(F.col("order_key").cast("long"), F.col("part_key").cast("long"),
                        F.col("sequence_number").cast("int"), "current", "voltage", "power",
                        F.try_to_timestamp("timestamp", F.lit("yyyy/M/d")).cast("timestamp_ntz").alias("timestamp"),
                        F.col("device_address").cast("int"), "device_type")


@query("scan_preamble", sql=_PREAMBLE_SQL.format(seq="l_linenumber", kind="l_returnflag"))
def q_scan_preamble(spark, d):
    root = scratch_path(spark, "preamble")
    lines, cells = _preamble_lines(spark, d, F.col("l_linenumber"))
    _write_lines(lines, cells, root)
    return _preamble_typed(fsrc.scan_preamble(spark, root))


@query("scan_preamble_mixed", sql=_PREAMBLE_SQL.format(
    seq="CASE WHEN l_orderkey // 1000 % 3 <> 2 AND l_linenumber = 5 THEN NULL ELSE l_linenumber END",
    kind="CASE WHEN l_orderkey // 1000 % 3 = 2 AND l_linenumber = 5 THEN '见序号5' ELSE l_returnflag END"))
def q_scan_preamble_mixed(spark, d):
    """S2 over UTF-8 files, GBK files and files without the marker in their first lines (their first line
    is the header, although later cells mention the marker); readings with an empty sequence number stay."""
    root = scratch_path(spark, "preamble-mixed")
    third = F.floor(F.col("l_orderkey") / 1000) % 3
    seq = F.when(~((third != 2) & (F.col("l_linenumber") == 5)), F.col("l_linenumber"))
    lines, cells = _preamble_lines(spark, d, seq)
    mention = F.when((F.col("grp") % 3 == 2) & (F.col("c0") == "5") & (F.col("_o") == 3), F.lit("见序号5"))
    lines = lines.withColumn("c6", F.coalesce(mention, "c6"))
    _write_lines(lines.where("grp % 3 = 0"), cells, f"{root}/utf8")
    _write_lines(lines.where("grp % 3 = 1"), cells, f"{root}/gbk", "GBK")
    plain = ["sequence_number", "I", "V", "P", "timestamp", "device_address", "device_type", "order_key", "part_key"]
    head = F.create_map(*[x for c, n in zip(cells, plain) for x in (F.lit(c), F.lit(n))])
    named = lines.where("grp % 3 = 2 and _o >= 2").select("grp", "_o", *[
        F.when(F.col("_o") == 2, head[F.lit(c)]).otherwise(F.col(c)).alias(c) for c in cells])
    _write_lines(named, cells, f"{root}/plain")
    return _preamble_typed(fsrc.scan_preamble(spark, root))


CSV_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "label"]


def _csv_rows(spark, d):
    return table(spark, d, "lineitem").withColumn("label", _label()).select(*CSV_COLS, "l_returnflag")


def _csv_typed(back):
    return back.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"),
                       F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"),
                       strict_double(F.col("l_quantity")).alias("l_quantity"), "label")


@query("scan_csv_layouts", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS l_quantity,
       {LABEL_SQL} AS label FROM lineitem""")
def q_scan_csv_layouts(spark, d):
    """S1 over files with their columns in different orders, one kind without a column."""
    rows, root = _csv_rows(spark, d), scratch_path(spark, "layouts")
    for flag, cols in (("A", CSV_COLS), ("R", CSV_COLS[::-1]), ("N", [c for c in CSV_COLS if c != "l_quantity"])):
        writers.write_csv(rows.where(F.col("l_returnflag") == flag).select(*cols), f"{root}/{flag}")
    return _csv_typed(fsrc.scan_csv(spark, root))


REMARK_SQL = ("'say \"' || l_returnflag || '\", then' || chr(10) || CASE WHEN l_linenumber % 3 = 0 "
              "THEN chr(10) || '\"\"' ELSE 'go, ' || l_suppkey END")


@query("scan_csv_quoted", sql=f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_shipdate::DATE AS ship_date, l_shipdate AS ship_time,
       l_linestatus = 'O' AS is_open, {REMARK_SQL} AS remark, l_partkey FROM lineitem""")
def q_scan_csv_quoted(spark, d):
    """Types inferred from the cells, and quoted cells with separators, line breaks and quotes."""
    li, root = table(spark, d, "lineitem"), scratch_path(spark, "quoted")
    remark = F.concat(F.lit('say "'), "l_returnflag", F.lit('", then\n'), F.when(
        F.col("l_linenumber") % 3 == 0, F.lit('\n""')).otherwise(F.concat(F.lit("go, "), F.col("l_suppkey").cast("string"))))
    writers.write_csv(li.select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("ship_date"),
                                F.col("l_shipdate").cast("timestamp_ntz").alias("ship_time"),
                                (F.col("l_linestatus") == "O").alias("is_open"), remark.alias("remark"), "l_partkey"), root)
    return fsrc.scan_csv(spark, root).drop("source_file")


#: lines of a file with quotes that do not fit
QUOTE_LINES = 1 << 20


@query("scan_quote_rejects", sql="""
SELECT reason, COUNT(*) AS n FROM (
    SELECT CASE WHEN l_linenumber = 7 THEN 'misplaced quote' ELSE 'unclosed quote' END AS reason FROM lineitem
    WHERE l_linenumber >= 6) GROUP BY reason""")
def q_scan_quote_rejects(spark, d):
    """S3: records whose quotes do not fit are refused one by one, the others of their files loaded.

    One file per item number and million lines: of the seventh items every cell has a stray quote in
    it; the sixth items' first cell opens a quote that never ends."""
    li, root = table(spark, d, "lineitem"), scratch_path(spark, "quotes")
    n, many = F.col("l_linenumber"), li.groupBy("l_linenumber").count()
    files = many.select(F.max("count")).collect()[0][0] or 0             # lines of the longest
    files = math.ceil(files / QUOTE_LINES) or 1
    li = li.withColumn("part", F.pmod(F.xxhash64("l_orderkey", "l_partkey"), F.lit(files)))
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit(","), F.when(n == 7, F.lit('"a" b"c, "d""')).otherwise("l_returnflag"))
    header = li.select("l_linenumber", "part").distinct().select(
        n, "part", F.lit(0).alias("_o"), F.lit("key,flag").alias("value"))
    start = header.where(n == 6).select(n, "part", F.lit(1).alias("_o"), F.lit('"never').alias("value"))
    body = li.select(n, "part", F.lit(2).alias("_o"), line.alias("value"))
    every = header.unionByName(start).unionByName(body)
    (every.repartition(max(shuffle_partitions(spark), 7 * files), "l_linenumber", "part")
     .sortWithinPartitions("l_linenumber", "part", "_o", "value").drop("_o")
     .write.partitionBy("l_linenumber", "part").text(root))
    _, rejected = fsrc.scan_batch(spark, root, accept=".txt")
    return rejected.where("line <> '\"never'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


BATCH_SCHEMA = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
BATCH_COLS = CSV_COLS[:5]


def _batch_dir(spark, d):
    """CSV files; lines of the seventh item with a bad quantity; the nations as JSON."""
    root = scratch_path(spark, "batch")
    rows = _csv_rows(spark, d).select(*BATCH_COLS)
    broken = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    writers.write_csv(rows.withColumn("l_quantity", broken), f"{root}/lines")
    writers.write_json(table(spark, d, "nation").coalesce(1), f"{root}/nations")     # 25 rows, one file
    return root


@query("scan_batch", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_linenumber <> 7""")
def q_scan_batch(spark, d):
    rows, _ = fsrc.scan_batch(spark, _batch_dir(spark, d), schema=BATCH_SCHEMA)
    return rows.select(*BATCH_COLS)


@query("scan_batch_gbk", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {LABEL_SQL} AS label FROM lineitem""")
def q_scan_batch_gbk(spark, d):
    """S3 over UTF-8 and GBK files with different column orders."""
    rows, root = _csv_rows(spark, d), scratch_path(spark, "batch-gbk")
    writers.write_csv(rows.where("l_returnflag <> 'R'").select(*CSV_COLS), f"{root}/utf8")
    writers.write_csv(rows.where("l_returnflag = 'R'").select(*CSV_COLS[::-1]), f"{root}/gbk", "GBK")
    back, _ = fsrc.scan_batch(spark, root, schema=BATCH_SCHEMA + ", label string")
    return back.select(*CSV_COLS)


@query("scan_rejects", sql="""
SELECT 'lines' AS folder, concat_ws(',', l_orderkey, l_linenumber, l_partkey, l_suppkey, 'n/a') AS line,
       'unparsable: l_quantity' AS reason FROM lineitem WHERE l_linenumber = 7
UNION ALL SELECT 'nations', NULL, 'unsupported type'""")
def q_scan_rejects(spark, d):
    """S3: one reject for every file and line that was not loaded; the writer names the files, so by folder."""
    _, rejected = fsrc.scan_batch(spark, _batch_dir(spark, d), schema=BATCH_SCHEMA)
    return rejected.select(F.element_at(F.split("source_file", "/"), -2).alias("folder"), "line", "reason")


_NOISE_SQL = f"""a AS (SELECT c_custkey, c_nationkey, k,
       {42 * PLACE[0] % PRIME} + c_custkey % {PRIME} * {PLACE[1]} + k % {PRIME} * {PLACE[2]} AS place
       FROM customer, range(0, 300) r(k)),
m0 AS (SELECT *, place % {PRIME} AS x FROM a),
m1 AS (SELECT * EXCLUDE (x), (x * x + x * {ROUNDS[0]} + {ROUNDS[0]}) % {PRIME} AS x FROM m0),
m2 AS (SELECT * EXCLUDE (x), (x * x + x * {ROUNDS[1]} + {ROUNDS[1]}) % {PRIME} AS x1 FROM m1),
m3 AS (SELECT *, (x1 + place + {PLACE[2]}) % {PRIME} AS x FROM m2),
m4 AS (SELECT * EXCLUDE (x), (x * x + x * {ROUNDS[0]} + {ROUNDS[0]}) % {PRIME} AS x FROM m3),
u AS (SELECT c_custkey, c_nationkey, k, (x1 + 0.5::DOUBLE) / {PRIME} AS u1,
             ((x * x + x * {ROUNDS[1]} + {ROUNDS[1]}) % {PRIME} + 0.5::DOUBLE) / {PRIME} AS u2 FROM m4),
z AS (SELECT c_custkey, c_nationkey, k, sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) AS zv,
             sqrt(-2 * ln(u1)) * sin(2 * pi() * u2) AS zi, k * 300.0 / 299 AS t FROM u)"""


@query("synth_readings", sql=f"""
WITH {_NOISE_SQL},
v AS (SELECT c_custkey, k, (1 + c_nationkey / 10) * (1 + 0.5 * sin(2 * pi() * 0.05 * t) + 0.05 * zi) AS current,
             20.0 * (1 + 0.05 * zv + 0.1 * sin(2 * pi() * 0.1 * t)) AS voltage FROM z)
SELECT c_custkey AS series_id, CAST(k + 1 AS INTEGER) AS sequence_number, ROUND(current, 6) AS current,
       ROUND(voltage, 6) AS voltage, ROUND(current * voltage, 6) AS power,
       TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(k * 1000000) AS timestamp,
       1 AS device_address, '测试设备' AS device_type
FROM v""")
def q_synth_readings(spark, d):
    """S5 with its defaults: 300 points a series, noise 0.05."""
    c = table(spark, d, "customer")
    return rounded(synth_readings(c, "c_custkey", "2024-01-01 00:00:00",
                                  current_nominal=F.lit(1.0) + F.col("c_nationkey") / 10))


EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("scan_json", sql="SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_scan_json(spark, d):
    root = scratch_path(spark, "json")
    writers.write_json(table(spark, d, "events"), root)
    return fsrc.scan_json(spark, root, EVENTS_SCHEMA).drop("source_file")


@query("sink_csv", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, {LABEL_SQL} AS label FROM lineitem""")
def q_sink_csv(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                            "l_shipdate", _label().alias("label"))
    path = writers.write_csv(li, scratch_path(spark, "sink-csv"), encoding="GBK")
    schema = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
              "l_shipdate timestamp_ntz, label string")
    return spark.read.option("header", "true").option("encoding", "GBK").schema(schema).csv(path)


@query("sink_json", sql="SELECT * FROM orders")
def q_sink_json(spark, d):
    o = table(spark, d, "orders")
    path = writers.write_json(o, scratch_path(spark, "sink-json"))
    return spark.read.schema(o.schema).json(path)


@query("sink_multi", sql="""
SELECT 'customer' AS sheet, c_custkey AS k, c_name AS name FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def q_sink_multi(spark, d):
    frames = {"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")),
              "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))}
    paths = writers.write_multi(frames, scratch_path(spark, "multi"))
    parts = [spark.read.parquet(p).select(F.lit(n).alias("sheet"), "k", "name") for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("append_readings", sql="WITH " + roles.READINGS_LI + """
SELECT experiment_id, l_linenumber, l_partkey, l_suppkey, current, voltage, timestamp,
       CAST(date_trunc('month', timestamp) AS DATE) AS reading_month FROM rl""")
def q_append_readings(spark, d):
    r = readings_lineitem(spark, d).select("experiment_id", "l_linenumber", "l_partkey", "l_suppkey", "current",
                                           "voltage", "timestamp")
    path = scratch_path(spark, "readings")
    writers.append_readings(r.where(F.col("l_linenumber") <= 3), path)     # two appends: all rows in total
    writers.append_readings(r.where(~(F.col("l_linenumber") <= 3) | F.col("l_linenumber").isNull()), path)
    back = spark.read.parquet(path)
    return back.select("experiment_id", "l_linenumber", "l_partkey", "l_suppkey", "current", "voltage", "timestamp",
                       "reading_month")


@query("lookup_readings", sql="WITH " + roles.READINGS_LI + """
SELECT md5(CAST(experiment_id AS VARCHAR)) AS experiment_code, l_linenumber, l_partkey, l_suppkey, current, timestamp
FROM rl WHERE md5(CAST(experiment_id AS VARCHAR)) = md5('42')""")
def q_lookup_readings(spark, d):
    """Q2/Q5: readings of one code, which is not the sort order; its bloom filters leave most row groups unread."""
    r = readings_lineitem(spark, d).withColumn("experiment_code", F.md5(F.col("experiment_id").cast("string")))
    cols = ["experiment_code", "l_linenumber", "l_partkey", "l_suppkey", "current", "timestamp"]
    path = writers.append_readings(r.select(*cols), scratch_path(spark, "lookup"), key="l_linenumber",
                                   lookup=("experiment_code",))
    return spark.read.parquet(path).where(F.col("experiment_code") == F.md5(F.lit("42"))).select(*cols)


@query("append_defaults", sql="WITH " + roles.DEVICES + """,
h AS (SELECT *, md5('devices' || chr(31) || device_serial) AS m FROM devices)
SELECT CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE concat_ws('-', substr(m, 1, 8), substr(m, 9, 4),
            substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) END AS id, device_serial, device_model, COALESCE(status, 'normal') AS status,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at, true AS updated_now FROM h""")
def q_append_defaults(spark, d):
    """K5: every second id and all creation times are given; the rest is filled in, ``updated_at`` by the clock."""
    dev = devices_customer(spark, d).select(
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("id"), "device_serial", "device_model", "status",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"))
    path = writers.append_rows(writers.apply_defaults(dev, "devices"), scratch_path(spark, "devices"))
    back = spark.read.parquet(path)
    recent = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("updated_at")) < 3600
    return back.withColumn("updated_now", F.coalesce(recent, F.lit(False))).drop("updated_at")


@query("upsert_devices", sql="WITH " + roles.DEVICES + """,
ch AS (SELECT c_custkey AS id, 'maintenance' AS status, 'old model' AS device_model, c_acctbal < 5000 AS twice
       FROM customer WHERE c_acctbal < 9000)
SELECT d.id, d.device_serial, CASE WHEN ch.id IS NULL THEN d.device_model ELSE 'old model' END AS device_model,
       CASE WHEN ch.id IS NULL THEN d.status WHEN twice THEN 'retired' ELSE 'maintenance' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at,
       CASE WHEN ch.id IS NOT NULL THEN TIMESTAMP '2024-06-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END
         AS updated_at
FROM devices d LEFT JOIN ch ON d.id = ch.id""")
def q_upsert_devices(spark, d):
    """K6 with changes that repeat a device, leave a value alone or set what is already there."""
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    base = devices_customer(spark, d).select("id", "device_serial", "device_model", "status",
                                             t0.alias("created_at"), t0.alias("updated_at"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    one = c.where("c_acctbal < 9000").select("id", F.lit("maintenance").alias("status"),
                                             F.lit("old model").alias("device_model"), F.lit(1).alias("at"))
    two = c.where("c_acctbal < 5000").select("id", F.lit("retired").alias("status"),
                                             F.lit(None).cast("string").alias("device_model"), F.lit(2).alias("at"))
    new = writers.upsert(base, two.unionByName(one), "id", now=F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"),
                         order="at")
    path = scratch_path(spark, "devices-v2")
    new.write.parquet(path)
    return spark.read.parquet(path)


@query("export_names", sql="""
SELECT o_orderkey, 'export_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS name FROM orders""")
def q_export_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", writers.export_name(F.col("o_orderdate")).alias("name"))


@query("column_widths", sql=" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, GREATEST(COALESCE(MAX(LENGTH({c})), 0), {len(c)}) + 2 AS width "
    "FROM customer" for i, c in enumerate(("c_name", "c_mktsegment"))))
def q_column_widths(spark, d):
    return writers.column_widths(table(spark, d, "customer").select("c_name", "c_mktsegment"))


@query("log_operation", sql="""
SELECT CAST(o_custkey AS VARCHAR) AS user_id, 'create_experiment' AS operation_type,
       'experiment ' || CAST(o_orderkey AS VARCHAR) AS operation_detail, o_orderdate AS created_at
FROM orders""")
def q_log_operation(spark, d):
    """K7: audit rows appended with the given user id kept (never dropped when no one is signed in)."""
    o = table(spark, d, "orders")
    logs = o.select(F.col("o_custkey").cast("string").alias("user_id"), F.lit("create_experiment").alias("operation_type"),
                    F.concat(F.lit("experiment "), F.col("o_orderkey").cast("string")).alias("operation_detail"),
                    F.col("o_orderdate").alias("created_at"))
    path = scratch_path(spark, "oplog")
    writers.append_rows(logs.where(F.col("o_orderstatus") == "F"), path)
    writers.append_rows(logs.where(~(F.col("o_orderstatus") == "F") | F.col("o_orderstatus").isNull()), path)
    return spark.read.parquet(path)


@query("history_export", sql="""
SELECT event_id, ts, user_id, event_type, value FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 23:59:59.999999'""")
def q_history_export(spark, d):
    """D11 export: the range query written as CSV (pushed-down scan) and read back."""
    from ..operators import browse
    h = browse.history_range(table(spark, d, "events"), "ts", "2024-01-10 00:00:00", "2024-01-12 23:59:59.999999")
    path = writers.write_csv(h.select("event_id", "ts", "user_id", "event_type", "value"), scratch_path(spark, "hist"))
    return (spark.read.option("header", "true")
            .schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double").csv(path))


@query("upsert_partitions", sql="""
SELECT event_id, ts, user_id, event_type, CASE WHEN event_type = 'click' AND event_id % 97 = 5 THEN -1.0 ELSE value END AS value,
       props FROM events""")
def q_upsert_partitions(spark, d):
    """K6 on a stored table: only the partitions that hold a changed row are written again."""
    path = scratch_path(spark, "upsert-partitions")
    events = table(spark, d, "events")
    events.withColumn("kind", F.col("event_type")).write.partitionBy("kind").parquet(path)
    hit = events.where((F.col("event_type") == "click") & (F.col("event_id") % 97 == 5))
    changes = hit.select("event_id", F.lit(-1.0).alias("value"))
    writers.upsert_partitions(spark, path, changes, "event_id", ["kind"], now=F.lit(None), stamp=None)
    return spark.read.parquet(path).drop("kind")


@query("ingest_new_files", sql="SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_ingest_new_files(spark, d):
    """K4/S3: each file is appended once, however often the job runs; a file that comes later is added."""
    root = scratch_path(spark, "ingest")
    events = table(spark, d, "events")
    first = F.col("event_id") % 3 != 0
    for part in (first, None, ~first):                       # the second run finds nothing new
        if part is not None:
            events.where(part).write.mode("append").parquet(f"{root}/in")
        live.ingest_new_files(spark, f"{root}/in", EVENTS_SCHEMA, f"{root}/out", f"{root}/ckpt", ts="ts")
    return spark.read.parquet(f"{root}/out").select("event_id", "ts", "user_id", "event_type", "value", "props")
