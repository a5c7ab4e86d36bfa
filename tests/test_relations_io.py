"""Relations, browsing, shapes, sources, sinks and streams (FIXTURES 1, 5, 6)."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from ohmflow.operators import browse, relate, series, shapes
from ohmflow.session import local_path, scratch_path, scratch_scope
from ohmflow.sinks import writers
from ohmflow.sources import files as fsrc
from ohmflow.sources.synth import synth_readings
from ohmflow.streaming import live


def test_single_row_zero_one_many(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    assert browse.single_row(df, F.col("id") == 1).count() == 1
    assert browse.single_row(df, F.col("id") == 2).count() == 0
    assert browse.single_row(df, F.col("id") == 3).count() == 0


def test_newest_ties_and_offset(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t if i % 2 else t + dt.timedelta(days=1)) for i in range(10)],
                               "id int, created_at timestamp_ntz")
    got = [r.id for r in browse.newest(df, "created_at", "id", n=5, offset=2).collect()]
    assert got == [4, 6, 8, 1, 3]


def test_semi_join_roles(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "user_id int, v string")
    prof = spark.createDataFrame([(1, "engineer"), (2, "viewer"), (3, "admin")], "id int, role string")
    assert sorted(r.user_id for r in relate.writers_only(rows, "user_id", prof).collect()) == [1, 3]


def test_cascade_and_orphans(spark):
    exp = spark.createDataFrame([(1,), (2,)], "id int")
    readings = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (None, 1)], "experiment_id int, seq int")
    assert relate.orphans(readings, exp, "experiment_id", "id").count() == 1
    gone = exp.where("id = 1")
    left = relate.cascade_delete(readings, gone, "experiment_id", "id")
    assert sorted((r.experiment_id or 0, r.seq) for r in left.collect()) == [(0, 1), (2, 1), (3, 1)]


def test_many_parents_are_hashed_not_sorted(spark, monkeypatch):
    """Children stream past their parents' keys; repeated and null keys change nothing."""
    kids = spark.createDataFrame([(i, None if i % 7 == 0 else i % 90) for i in range(500)], "id long, fk long")
    parents = spark.createDataFrame([(i % 80,) for i in range(200)] + [(None,)], "pk long")
    want = sorted(i for i in range(500) if i % 7 and i % 90 >= 80)
    for most in (relate.HASHED_PARENTS, 100, 5):            # broadcast, hashed, hashed in more shares
        monkeypatch.setattr(relate, "HASHED_PARENTS", most)
        out = relate.orphans(kids, parents, "fk", "pk")
        assert sorted(r.id for r in out.collect()) == want
        left = relate.cascade_delete(kids, parents, "fk", "pk")
        assert left.count() == len(want) + sum(i % 7 == 0 for i in range(500))
        plan = plan_text(out)
        assert most > 200 or ("ShuffledHashJoin" in plan and "SortMergeJoin" not in plan)
    assert "REPARTITION_BY_NUM" in plan


def plan_text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_verdict_groups_experiments_once(spark):
    """One group per experiment, of flags alone: no group per measure, no sort for a minimum of texts."""
    from ohmflow.plans import relate as plans
    exp = spark.createDataFrame([("a", "leakage")], "id string, experiment_type string")
    meas = spark.createDataFrame([("a", "leakage_25C", "1")], "id string, measure string, value string")
    plan = plan_text(relate.verdict(exp, meas, relate.standards_frame(spark)))
    assert "keys=[id" in plan and "measure" not in "".join(x for x in plan.split("keys=[")[1:] if x.startswith("_mid"))
    assert "upper" not in plan and "SortAggregate" not in plan_text(plans._measures(spark, SF_SMALL))


def test_verdict_against_seed_standards(spark):
    kinds = ["dielectric"] * 4 + ["leakage", "normal", "normal", "abnormal", "simulation"]
    exp = spark.createDataFrame(list(enumerate(kinds, 1)), "id int, experiment_type string")
    meas = spark.createDataFrame([
        (1, "leakage_current", "4.0"), (1, "breakdown", "false"), (2, "leakage_current", "4"), (2, "breakdown", "true"),
        (3, "leakage_current", "5"), (4, "leakage_current", "6"), (5, "leakage_25C", "3.5"), (5, "leakage_60C", "5.0"),
        (6, "shutdown_time", "30"), (6, "function_test", "pass"), (7, "shutdown_time", "31"),
        (7, "function_test", "pass"), (8, "protection_triggered", "true"), (8, "no_damage", "true"),
        (8, "no_damage", "false"), (1, "unasked", "9"), (2, None, "1"), (3, "breakdown", None)],
        "id int, measure string, value string")
    out = relate.verdict(exp.unionByName(exp), meas, relate.standards_frame(spark)).collect()     # repeated rows are one
    assert len(out) == len(kinds)
    assert {r.id: (r.criteria, r.criteria_checked) for r in out if r.id in (1, 3, 9)} == {1: (2, 2), 3: (2, 1), 9: (0, 0)}
    got = {r.id: r.verdict for r in out}
    assert got == {1: "pass", 2: "fail", 3: None, 4: "fail", 5: "pass", 6: "pass", 7: "fail", 8: "fail", 9: None}


def test_shapes(spark):
    df = spark.createDataFrame([(1.0, 5.0), (20.0, 5.0), (3.0, 0.0), (3.0, None)], "v double, t double")
    st = [r.s for r in df.select(shapes.threshold_status(F.col("v"), F.col("t")).alias("s")).collect()]
    assert st == ["success", "danger", "neutral", "neutral"]
    pairs = shapes.scatter_pairs(spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "id int, a double, b double, c double"),
                                 ["id"], ["a", "b", "c"])
    assert sorted((r.x_dim, r.y_dim) for r in pairs.collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_synth_noise_free(spark):
    drivers = spark.createDataFrame([(1,)], "sid int")
    out = synth_readings(drivers, "sid", "2024-01-01 00:00:00", duration=300, rate=1, noise=0.0)
    rows = out.orderBy("sequence_number").collect()
    assert len(rows) == 300
    assert (rows[0].voltage, rows[0].current, rows[0].power) == (20.0, 1.0, 20.0)
    assert rows[-1].timestamp == dt.datetime(2024, 1, 1, 0, 4, 59)
    for rate in (3, 7):
        r = synth_readings(drivers, "sid", "2024-01-01", duration=2, rate=rate, noise=0.0)
        assert r.count() == 2 * rate
    from ohmflow.sources import synth
    long = synth_readings(drivers, "sid", "2024-01-01", duration=synth.CHUNK * 2 + 5, rate=1, noise=0.0)
    agg = long.agg(F.count(F.lit(1)), F.min("sequence_number"), F.max("sequence_number")).collect()[0]
    assert tuple(agg) == (synth.CHUNK * 2 + 5, 1, synth.CHUNK * 2 + 5)


def test_admission_limits(spark):
    listing = spark.createDataFrame([("a.CSV", "csv", 52428800), ("b.csv", "csv", 52428801), ("c.txt", "txt", 1),
                                     ("d", None, 1)], "path string, extension string, length long")
    got = {r.path: (r.admitted, r.reason) for r in fsrc.admit_files(listing).collect()}
    assert got == {"a.CSV": (True, None), "b.csv": (False, "too large"), "c.txt": (False, "unsupported type"),
                   "d": (False, "unsupported type")}


SAMPLE = ("序号\t电流 (A)\t电压 (V)\t功率 (W)\t时间戳\t设备地址\t设备类型\n"
          "数据信息\t记录时间: x\t设备地址: 1\t设备类型: 未知\t数据点数: 100\t\t\n"
          "\t\t\t\t\t\t\n"
          "1\t0.11000\t20.35500\t2.23905\t2025/5/2\t1\t未知\n"
          "2\t0.26000\t20.68100\t5.37706\t2025/5/2\t1\t未知\n")


def put(root, name, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
    with open(f"{root}/{name}", "wb") as f:
        f.write(text.encode(encoding))


def test_preamble(spark):
    root = local_path(scratch_path(spark, "t-pre"))
    put(root, "data.txt", SAMPLE)
    put(root, "gbk.txt", "记录\n\n" + SAMPLE.replace("0.11000", ""), "gbk")
    put(root, "plain.txt", "I\tV\r\n\t5\r\n\r\n7\t\r\n")
    got = sorted((r.source_file.rsplit("/", 1)[1], r.sequence_number or "", r.current or "", r.voltage or "")
                 for r in fsrc.scan_preamble(spark, root).collect())
    kept = [("数据信息", "记录时间: x", "设备地址: 1"), ("1", "0.11000", "20.35500"), ("2", "0.26000", "20.68100")]
    want = [("data.txt", *k) for k in kept]
    want += [("gbk.txt", a, "" if b == "0.11000" else b, c) for a, b, c in kept]
    assert got == sorted(want + [("plain.txt", "", "", "5"), ("plain.txt", "", "7", "")])


def test_csv_encodings_and_layouts(spark):
    root = local_path(scratch_path(spark, "t-csv"))
    put(root, "u.csv", "\ufeffname,v\n正常,1\n")
    put(root, "g.csv", "v,name\n2,退回\n", "gbk")
    put(root, "x/u.csv", 'w,name\n3,"a,b"\n')
    put(root, "other.txt", "nothing,to,see\n")
    got = sorted((r.name, r.v, r.w, r.source_file) for r in fsrc.scan_csv(spark, root).collect())
    assert got == [("a,b", None, 3, "u.csv"), ("正常", 1, None, "u.csv"), ("退回", 2, None, "g.csv")]


def test_preamble_marker_counts_in_the_first_lines_only(spark):
    root = local_path(scratch_path(spark, "t-gate"))
    body = "".join(f"{i}\t{i / 2}\t{'见序号5' if i == 31 else 'ok'}\n" for i in range(1, 41))
    put(root, "late.txt", "no\tI\tremark\n" + body)
    put(root, "cell.txt", "no\tI\tremark\n" + body.replace("见序号5", "序号"))
    put(root, "sixth.txt", "a\nb\nc\nd\ne\n序号\tI\tremark\n" + body)
    put(root, "seventh.txt", "no\tI\tremark\nb\nc\nd\ne\nf\n序号\tI\tremark\n" + body)
    got = fsrc.scan_preamble(spark, root)
    n = {r[0].rsplit("/", 1)[1]: r[1] for r in got.groupBy("source_file").count().collect()}
    assert n == {"late.txt": 40, "cell.txt": 40, "sixth.txt": 40, "seventh.txt": 46}
    assert got.where("remark = '见序号5'").count() == 3 and got.where("sequence_number = '31'").count() == 1


QUOTED = [("1", "x\ny", "a,b"), ("2", 'say ""hi""\n\n, then ""go""', ""), ("3", "plain", "z"),
          ("4", "\n" * 40 + "end", "tail, with\nbreak"), ("5", "last", "q")]


@pytest.mark.parametrize("split", ["134217728", "100"])
def test_csv_quoted_records_over_lines_and_splits(spark, split):
    """Line breaks, separators and doubled quotes round-trip, wherever a split begins."""
    root = local_path(scratch_path(spark, "t-quoted"))
    lines = "".join(f'{a},"{b}","{c}"\n' if a != "3" else f"{a},{b},{c}\n" for a, b, c in QUOTED)
    put(root, "a.csv", "k,b,c\n" + lines * 3)
    put(root, "b.csv", "k,b,c\n" + "".join(f"{i},v{i},w\n" for i in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = [(r.k, r.b, r.c) for r in fsrc.scan_csv(spark, root, infer=False).where("source_file = 'a.csv'").collect()]
        assert fsrc.scan_csv(spark, root).where("source_file = 'b.csv'").count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(a, b.replace('""', '"'), c or None) for a, b, c in QUOTED] * 3
    assert sorted((a, b, c or None) for a, b, c in got) == sorted(want, key=lambda r: (r[0], r[1], r[2] or ""))


def test_quoted_records_are_joined_where_they_lie(spark):
    """Of lines in quoted cells only the edges of splits are stored or shuffled; records may run over Arrow batches."""
    root = local_path(scratch_path(spark, "t-edges"))
    put(root, "a.csv", "k,b\n" + "".join(f'{i},"x\n""{i}\n"\n' for i in range(2000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, ("5000", "7")):
            spark.conf.set(k, v)
        with scratch_scope(spark) as folders:
            got = sorted((r.k, r.b) for r in fsrc.scan_csv(spark, root).collect())
            kept = sum(spark.read.parquet(f).count() for f in folders if "-torn-" in f)
            splits = sum(spark.read.parquet(f).count() for f in folders if "-splits-" in f)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == [(i, f'x\n"{i}\n') for i in range(2000)]
    assert splits > 3 and kept <= 4 * splits


@pytest.mark.parametrize("plain", [3, 5000])
def test_quoted_lines_are_scanned_once_for_the_rows(spark, monkeypatch, plain):
    """Lines of quoted cells are found without a pass of their own, cut into cells in one scan and read back for
    types and rows; splits without such lines take another scan only where they hold most lines."""
    root = local_path(scratch_path(spark, "t-once"))
    put(root, "a.csv", "k,b\n" + "".join(f'{i},"x\n""{i}\n"\n' for i in range(200)))
    put(root, "b.csv", "k,b\n" + "".join(f"{i},y\n" for i in range(1000, 1000 + plain)))
    plans, store = {}, fsrc.materialize
    monkeypatch.setattr(fsrc, "materialize", lambda df, name="stage": (plans.update({name: plan_text(df)}), store(df, name))[1])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        out = fsrc.scan_csv(spark, root)
        got = sorted((r.k, r.b) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, f'x\n"{i}\n') for i in range(200)] + [(i, "y") for i in range(1000, 1000 + plain)]
    scans = {name: text.count("FileScan text") for name, text in plans.items()}
    assert "FileScan text" not in plan_text(out)
    assert {n: k for n, k in scans.items() if k} == {"splits": 1, "torn-edges": 1, "csv-cells": 2 if plain > 1000 else 1}
    assert "MapInArrow" in plans["csv-cells"]


def test_types_of_odd_cells(spark):
    """Cells are cast only to types that they look like, and none is missed for it."""
    cells = {"long": ["0", "-0", "12\n", "-9223372036854775808"], "double": ["9223372036854775808", "1.5", ".5", "5.", "1e5",
             "inf", "-Infinity", "0x1p3", "\t1.5", "17.0\n", "9" * 400], "string": ["007", "+5", "1d", "nan", "1e", "infd", "--5",
             "2020-02-30", "2020-01-01x", "2020-01-01T", "2020-01-01 25:00", "say", "1,5", "true\n"], "boolean": ["true", "FALSE"],
             "date": ["2020-01-01", "2020-1-1"], "timestamp_ntz": ["2020-01-01 10:00", "2020-01-01T10:00:00.5"]}
    odd = [(kind, c) for kind, values in cells.items() for c in values]
    df = spark.createDataFrame([(f" {c} ",) * 2 for _, c in odd], "a string, b string").select(
        *[F.when(F.col("a") == f" {c} ", F.col("a")).alias(f"c{j}") for j, (_, c) in enumerate(odd)],
        F.lit(" ").alias("blank"), F.lit(None).cast("string").alias("none"))
    got = fsrc.column_types(df, df.columns)
    want = [(kind, c) for kind, c in odd] + [("string", "blank"), ("string", "none")]
    assert [(f.dataType.simpleString().replace("bigint", "long"), c) for f, (_, c) in zip(got, want)] == want


def test_lines_are_neither_sorted_nor_shuffled(spark, monkeypatch):
    """Splits are summed up in a map, and files of several layouts join their lines without a shuffle of these."""
    root = local_path(scratch_path(spark, "t-layouts"))
    for i, head in enumerate(("a,b", "b,a", "a,c")):
        put(root, f"{i}.csv", f"{head}\n" + "x,y\n" * 50)
    plans, store = {}, fsrc.materialize
    monkeypatch.setattr(fsrc, "materialize", lambda df, name="stage": (plans.update({name: plan_text(df)}), store(df, name))[1])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
        out = fsrc.scan_csv(spark, root, infer=False)
        assert "SortMergeJoin" not in plan_text(out) and "Exchange hash" not in plan_text(out)
        assert {(r.a, r.b, r.c): r["count"] for r in out.groupBy("a", "b", "c").count().collect()} == {
            ("x", "y", None): 50, ("y", "x", None): 50, ("x", None, "y"): 50}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ObjectHashAggregate" in plans["splits"] and " SortAggregate" not in plans["splits"]


def test_quote_rejects_in_files_of_bounded_length(spark, monkeypatch):
    """However many lines an item number has, a file (and the task that sorts it) holds about QUOTE_LINES of them."""
    from ohmflow.plans import io as plans
    want = rows(plans.q_scan_quote_rejects(spark, SF_SMALL))
    monkeypatch.setattr(plans, "QUOTE_LINES", 100)
    with scratch_scope(spark) as folders:
        got = rows(plans.q_scan_quote_rejects(spark, SF_SMALL))
        top = next(f for f in folders if "-quotes-" in f)
        longest = spark.read.option("recursiveFileLookup", "true").text(top).groupBy(F.input_file_name()).count()
        most = longest.agg(F.max("count")).collect()[0][0]
    assert got == want and most < 300


def test_torn_records_are_rejected_or_raise(spark):
    root = local_path(scratch_path(spark, "t-torn"))
    put(root, "open.csv", 'k,b\n1,ok\n2,"fine\nhere"\n3,"never ends\n4,x\n5,y\n')
    put(root, "stray.csv", 'k,b\n1,5" pipe\n2,x\n3,6" pipe\n4,y\n')
    put(root, "mid.csv", 'k,b\n1,5" by 6"\n')
    rows, rejects = fsrc.scan_batch(spark, root, schema="k int, b string")
    assert sorted(((r.k, r.b, r.file_name) for r in rows.collect())) == [
        (1, '5" by 6"', "mid.csv"), (1, "ok", "open.csv"), (2, "fine\nhere", "open.csv"), (4, "y", "stray.csv")]
    assert sorted((r.file_name, r.reason, r.line) for r in rejects.collect()) == [
        ("open.csv", "unclosed quote", '3,"never ends'), ("open.csv", "unclosed quote", "4,x"),
        ("open.csv", "unclosed quote", "5,y"), ("stray.csv", "misplaced quote", '1,5" pipe\n2,x\n3,6" pipe')]
    for name in ("open.csv", "stray.csv"):
        with pytest.raises(Exception, match="quote"):
            fsrc.scan_csv(spark, root, glob=name, infer=False).collect()


def test_csv_types_are_those_that_duckdb_finds(spark):
    import duckdb
    root = local_path(scratch_path(spark, "t-types"))
    put(root, "t.csv", "i,neg,d,mix,flag,day,time,text,none,big,half,zip,plus\n"
        "1,-5,1.5,1,true,2024-01-31,2024-01-31 10:00:00,a,,9223372036854775807,,007,+1\n"
        "2,7,2e3,2.25,false,2024-02-01,2024-02-01 11:30:15.25,1,,1,,1,2\n"
        "0,0,-0.5,3,TRUE,2023-12-31,2024-02-01 00:00:00,,,2,4,22,3\n")
    got = fsrc.scan_csv(spark, root).drop("source_file")
    con = duckdb.connect()
    rel = con.sql(f"SELECT * FROM read_csv('{root}/t.csv')")
    names = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
             "string": "VARCHAR"}
    assert {c: names[t] for c, t in got.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rel.fetchall()))


def test_upsert_stamps_every_hit(spark):
    t0 = dt.datetime(2024, 1, 1)
    base = spark.createDataFrame([(1, "normal", t0), (2, "normal", t0), (3, "retired", t0)],
                                 "id int, status string, updated_at timestamp_ntz")
    ch = spark.createDataFrame([(1, "maintenance"), (2, "normal"), (9, "retired")], "id int, status string")
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    t1 = dt.datetime(2024, 6, 1)
    got = {r.id: (r.status, r.updated_at) for r in writers.upsert(base, ch, "id", now).collect()}
    assert got == {1: ("maintenance", t1), 2: ("normal", t1), 3: ("retired", t0)}
    twice = spark.createDataFrame([(1, "retired", 2), (1, None, 3), (1, "normal", 1)], "id int, status string, at int")
    got = writers.upsert(base, twice, "id", now, order="at")
    assert sorted((r.id, r.status) for r in got.collect()) == [(1, "retired"), (2, "normal"), (3, "retired")]
    with pytest.raises(Exception, match="several changes"):
        writers.upsert(base, twice.drop("at"), "id", now).collect()


def test_json_keeps_null_columns(spark):
    path = scratch_path(spark, "t-json")
    writers.write_json(spark.createDataFrame([(1, None)], "id int, s string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"id":1,"s":null}']


def test_row_ids_follow_the_natural_key(spark):
    df = spark.createDataFrame([(None, "a", None), (None, "b", None), ("given", "c", "retired")],
                               "id string, device_serial string, status string")
    one, two = ({r.device_serial: (r.id, r.status) for r in writers.apply_defaults(df, "devices").collect()}
                for _ in range(2))
    assert one == two and one["c"] == ("given", "retired") and one["a"][1] == "normal"
    assert one["a"][0] != one["b"][0] and len(one["a"][0]) == 36


def test_home_cards_defaults(spark):
    df = spark.createDataFrame([("n", None)], "experiment_name string, device_id string")
    assert tuple(browse.home_cards(df).collect()[0]) == ("n", "", "", "", "", None)
    assert browse.home_cards(df.drop("device_id")).collect()[0].device_id == "未知设备"


def test_metric_cards_text_and_colour(spark):
    df = spark.createDataFrame([("1", 1234.5), ("2", 1234.5), ("3", 1300.0), ("4", 1.0)], "p string, m double")
    got = [(r.delta, r.delta_color, r.value_text, r.delta_text)
           for r in shapes.metric_cards(df, "p", {"m": "kWh"}).orderBy("p").collect()]
    assert got == [(None, "inverse", "1234.50 kWh", None), (0.0, "inverse", "1234.50 kWh", None),
                   (65.5, "normal", "1300.00 kWh", "65.50 kWh"), (-1299.0, "inverse", "1.00 kWh", "-1299.00 kWh")]
    text = spark.range(1).select(shapes.count_text(F.lit(1234567)).alias("t")).collect()[0].t
    assert text == "1,234,567"


def test_daily_tests_fill_empty_days(spark):
    from ohmflow.operators import kpi
    rows = [(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 4),), (None,)]
    got = sorted(((r.day, r.tests, r.change) for r in kpi.daily_tests(
        spark.createDataFrame(rows, "created_at timestamp_ntz")).collect()), key=str)
    d = dt.date
    assert got == sorted([
        (d(2024, 1, 1), 2, None), (d(2024, 1, 2), 0, -2), (d(2024, 1, 3), 0, 0), (d(2024, 1, 4), 1, 1),
        (None, 1, None)], key=str)


def test_checkpoint_folder_is_required_off_local(spark):
    from ohmflow import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    assert session.is_single_process("local[4]") and not session.is_single_process("local-cluster[2,1,1024]")


def test_synth_noise_ignores_partitioning(spark):
    drivers = spark.range(20).select(F.col("id").alias("sid"))
    sums = set()
    for n in (1, 4, 50):
        out = synth_readings(drivers.repartition(n), "sid", "2024-01-01", noise=0.05)
        r = out.agg(F.count(F.lit(1)), F.sum(F.round("voltage", 9)), F.stddev("voltage")).collect()[0]
        sums.add((r[0], round(r[1], 6)))
        assert 1.5 < r[2] < 2.0                     # 20 V * sqrt(0.05 ** 2 + 0.1 ** 2 / 2)
    assert len(sums) == 1 and next(iter(sums))[0] == 6000


def test_points_and_bins_are_spread(spark):
    """Few small rows make many: adaptive execution must not merge their partitions by the bytes before."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = synth_readings(spark.range(200).select(F.col("id").alias("sid")), "sid", "2024-01-01")
    assert out.select(F.spark_partition_id()).distinct().count() == n
    ends = spark.sql("select id as k, timestampadd(HOUR, id % 2 * 20, timestamp_ntz '2024-01-01') as ts, 1.0D as v "
                     "from range(200)").withColumn("k", F.col("k") - F.col("k") % 2)
    bins = series.resample_mean(ends, "ts", "1S", keys=["k"], values=["v"])
    assert bins.count() == 100 * (20 * 3600 + 1)
    assert "REPARTITION_BY_NUM" in bins._jdf.queryExecution().toString()


def _stream_run(spark, root, schema, delay, per_trigger=None):
    s = live.file_stream(spark, root + "/in", schema, max_files_per_trigger=per_trigger)
    m = live.tumbling_mean(s, "ts", ["k"], "value", delay=delay)
    mark = live.run_available_now(m, root + "/out", root + "/ckpt")
    got = live.windows_so_far(spark, spark.read.schema(schema).parquet(root + "/in"), root + "/out", "ts", ["k"], "value",
                              watermark=mark)
    return sorted((r.k, r.window_start, r.n, round(r.mean_value, 9)) for r in got.collect())


def _hourly(df):
    want = df.groupBy("k", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return sorted((r.k, r.w, r.n, round(r.m, 9)) for r in want.collect())


@pytest.mark.parametrize("delay", ["3 days", "10 minutes"])
def test_stream_goes_on_after_its_end(spark, delay):
    """Run, add files, run again, run once more on nothing new: all windows there once each time; neither
    the source nor the checkpoint has a row that was not in the data."""
    root = local_path(scratch_path(spark, "t-resume"))
    schema = "ts timestamp_ntz, k string, value double"
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=17 * i), "ab"[i % 2], float(i)) for i in range(120)]
    first, second = (spark.createDataFrame(x, schema) for x in (rows[:70], rows[70:]))
    first.coalesce(1).write.mode("append").parquet(root + "/in")
    assert _stream_run(spark, root, schema, delay) == _hourly(first)
    second.coalesce(1).write.mode("append").parquet(root + "/in")
    whole = _hourly(first.unionByName(second))
    assert _stream_run(spark, root, schema, delay) == whole
    assert _stream_run(spark, root, schema, delay) == whole
    assert spark.read.parquet(root + "/in").count() == 120


def test_stream_over_unsorted_files(spark):
    """Rows of all times in every file, one file a batch: with a delay as long as the disorder nothing is late."""
    import time
    root = local_path(scratch_path(spark, "t-unsorted"))
    schema = "ts timestamp_ntz, k string, value double"
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t + dt.timedelta(minutes=17 * i), "ab"[i % 2], float(i)) for i in range(120)], schema)
    for part in range(3):
        df.where(F.col("value") % 3 == part).coalesce(1).write.mode("append").parquet(root + "/in")
        time.sleep(1.1)
    assert _stream_run(spark, root, schema, "3 days", 1) == _hourly(df)


def test_device_state_survives_a_replayed_batch(spark):
    root = local_path(scratch_path(spark, "t-state"))
    schema = "dev string, ts timestamp_ntz, id long, value double"
    t = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([("a", t, 1, 5.0), ("a", t, 2, 300.0), ("b", t, 3, 1.0)], schema)
    two = spark.createDataFrame([("b", t - dt.timedelta(days=1), 4, 400.0), ("a", t + dt.timedelta(days=1), 5, 7.0)], schema)
    state = lambda: sorted((r.dev, r.id, r.value, r.status) for r in
                           live.current_state(spark, root + "/out", "dev").collect())
    for batch in (one, two):
        batch.coalesce(1).write.mode("append").parquet(root + "/in")
        s = live.file_stream(spark, root + "/in", schema)
        live.run_updates(live.device_state(s, "dev", "ts", "id", "value", 250.0), root + "/out", root + "/ckpt")
    want = [("a", 5, 7.0, "success"), ("b", 3, 1.0, "success")]
    assert state() == want
    batches = sorted(os.listdir(root + "/out"))
    last = spark.read.parquet(f"{root}/out/{batches[-1]}").collect()
    live.write_updates(spark.createDataFrame(last), int(batches[-1].split("=")[1]), root + "/out")
    assert state() == want and sorted(os.listdir(root + "/out")) == batches


def test_ingest_takes_each_file_once(spark):
    root = local_path(scratch_path(spark, "t-ingest"))
    schema = "id long, timestamp timestamp_ntz"
    t = dt.datetime(2024, 1, 31)
    rows = lambda a, b: spark.createDataFrame(
        [(i, t + dt.timedelta(days=i)) for i in range(a, b)], schema).coalesce(1)
    n = []
    for a, b in ((0, 5), (None, None), (5, 8)):
        if a is not None:
            rows(a, b).write.mode("append").parquet(root + "/in")
        live.ingest_new_files(spark, root + "/in", schema, root + "/out", root + "/ckpt")
        n.append(spark.read.parquet(root + "/out").count())
    assert n == [5, 5, 8]
    assert {d for d in os.listdir(root + "/out") if "=" in d} == {"reading_month=2024-01-01", "reading_month=2024-02-01"}


def test_upsert_leaves_other_partitions_files_alone(spark):
    path = local_path(scratch_path(spark, "t-upsert"))
    df = spark.createDataFrame([(i, f"k{i % 4}", float(i), None) for i in range(40)],
                               "id int, kind string, v double, updated_at timestamp_ntz")
    df.write.partitionBy("kind").parquet(path)
    files = lambda: {(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    changes = spark.createDataFrame([(5, -1.0), (9, None), (999, 7.0)], "id int, v double")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    want = sorted(map(repr, writers.upsert(df, changes, "id", now).select("id", "kind", "v", "updated_at").collect()))
    assert writers.upsert_partitions(spark, path, changes, "id", ["kind"], now) == 1
    got = spark.read.parquet(path).select("id", "kind", "v", "updated_at")
    assert sorted(map(repr, got.collect())) == want
    kept = {x for x in before if not x[0].endswith("kind=k1")}
    assert kept <= files() and not (before - kept) & files()
    assert writers.upsert_partitions(spark, path, changes.where("id = 999"), "id", ["kind"], now) == 0


def test_stream_drops_late_rows(spark):
    import time
    root = local_path(scratch_path(spark, "t-stream"))
    schema = "ts timestamp_ntz, k string, value double"
    t = dt.datetime(2024, 1, 1)
    batches = [[(t + dt.timedelta(minutes=m), "a", 1.0) for m in (0, 10, 70, 130)],
               [(t + dt.timedelta(minutes=200), "a", 3.0)],
               [(t + dt.timedelta(minutes=5), "a", 100.0)]]          # late: its window closed two batches ago
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(root + "/in")
        time.sleep(1.1)                                              # file order = modification time
    s = live.file_stream(spark, root + "/in", schema, max_files_per_trigger=1)
    m = live.tumbling_mean(s, "ts", ["k"], "value", window="1 hour", delay="10 minutes")
    live.run_available_now(m, root + "/out", root + "/ckpt")
    got = sorted((r.window_start, r.n, r.mean_value) for r in spark.read.parquet(root + "/out").collect())
    assert got[0] == (t, 2, 1.0)
    assert [g[0].hour for g in got] == [0, 1, 2]                    # 03:00 window never closes (availableNow)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 1
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["validate_report", "filter_exponential", "resample_mean", "verdict",
                                  "filter_exponential_blocked", "sequence_number_blocked", "anomaly_iqr_sorted"])
def test_queries_stable_across_partitions(spark, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = sorted(map(tuple, q(spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_batch_reports_everything_not_loaded(spark):
    root = local_path(scratch_path(spark, "t-batch"))
    put(root, "a/x.csv", "a,b\n1,2.5\n2,x\n3,4,5\n6\n")
    put(root, "b/x.csv", "b,a\nfoo,bar\n7.5,8\n")
    put(root, "r.json", '{"a": 1}\n')
    put(root, "UP.CSV", "a,b\n1,1\n")
    rows, rej = fsrc.scan_batch(spark, root, schema="a int, b double")
    assert sorted(((r.a, r.b, r.file_name) for r in rows.collect()), key=repr) == [
        (1, 2.5, "x.csv"), (6, None, "x.csv"), (8, 7.5, "x.csv")]
    assert sorted(((r.source_file.split("t-batch")[1].split("/", 1)[1], r.line, r.reason)
                   for r in rej.collect()), key=repr) == sorted([
        ("a/x.csv", "2,x", "unparsable: b"), ("a/x.csv", "3,4,5", "too many cells"),
        ("b/x.csv", "foo,bar", "unparsable: a"), ("r.json", None, "unsupported type"),
        ("UP.CSV", None, "unsupported type")], key=repr)


def test_stream_windows_ignore_session_zone(spark):
    root = local_path(scratch_path(spark, "t-zone"))
    schema = "ts timestamp_ntz, k string, value double"
    t = dt.datetime(2024, 1, 1, 5, 30)
    spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(hours=3), "a", 2.0)], schema).write.parquet(root + "/in")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        s = live.file_stream(spark, root + "/in", schema)
        m = live.tumbling_mean(s, "ts", ["k"], "value", window="1 hour", delay="10 minutes")
        live.run_available_now(m, root + "/out", root + "/ckpt")
        got = [(r.window_start, r.window_end) for r in spark.read.parquet(root + "/out").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [(dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 1, 6))]


def test_default_export_name():
    assert writers.default_export_name(dt.datetime(2025, 5, 2, 14, 22, 56)) == "export_20250502_142256"
