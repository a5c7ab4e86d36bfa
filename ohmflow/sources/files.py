"""File sources: admission, encoding-aware CSV, preamble files, batch, JSON.

Delimited files are read as raw lines, so large files are split over tasks.
A first pass gives one row per split: its first line, number of lines and of
quotes, whether it is UTF-8, its first line with the header marker, and its
first and last line with an odd number of quotes.  From these (a prefix sum over
each file's splits) follow the file's encoding, its header, whether a split
begins inside a quoted cell, and which of its lines belong to records that run
over its edges.

A second pass reads the records by their own file's header.  Where no line of
a split has an odd number of quotes, every line is a record.  The lines of other
splits get their state from a running count of quotes, and lines inside a
quoted cell join the record before them, across splits too (lost line ends
come back as ``\\n``).  A record whose quotes do not fit, or that never ends, is
refused, never torn.

The driver sees the distinct header lines, whose names it needs, and three counts.
"""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.columns import canonical_names, strict_double
from ..session import enable_legacy_charsets, materialize

__all__ = ["list_files", "admit_files", "scan_csv", "column_types", "scan_preamble", "scan_batch", "scan_json"]

#: the header marker counts in a file's first line and this many after it
MARKER_LINES = 5


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, file_name, extension, length, modificationTime (content not read)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))
    return df.select("path", name.alias("file_name"), ext.alias("extension"), "length", "modificationTime")


def admit_files(listing: DataFrame, allowed: list[str] | None = None,
                max_bytes: int = schemas.MAX_FILE_BYTES) -> DataFrame:
    """Admitted flag and refusal reason per listed file.

    Extension = text after the last dot, lower-cased, must be allowed; size
    must be <= max_bytes (one byte more is refused).
    """
    allowed = allowed or schemas.ALLOWED_EXTENSIONS
    reason = (F.when(F.col("path").isNull(), F.lit("no file"))
              .when(F.col("extension").isNull() | ~F.col("extension").isin(*allowed), F.lit("unsupported type"))
              .when(F.col("length") > F.lit(max_bytes), F.lit("too large")))
    return listing.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def _text(c: Column, utf8: Column, fallback: str) -> Column:
    """A raw line as text: its bytes are UTF-8, or else ``fallback``."""
    return F.when(utf8, c).otherwise(F.decode(c.cast("binary"), fallback))


def _raw_lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """Every line of every file: source_file, block (start of its split), n (rises with the lines of a
    split), raw.  The text source keeps a line's bytes as they are."""
    r = spark.read.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("raw"))


def _quotes(raw: Column) -> Column:
    return F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit('"'), F.lit("")))


def _has_cell(line: Column, sep: str, marker: str) -> Column:
    """True if a cell of the line is the marker (spaces and quotes around it do not count)."""
    bare = F.transform(F.split(line, re.escape(sep)), lambda c: F.regexp_replace(c, r'^[\s"\ufeff]+|[\s"]+$', ""))
    return F.array_contains(bare, marker)


def _splits(raw: DataFrame, sep: str, fallback: str, marker: str | None) -> DataFrame:
    """One row per split: n0, lines, quotes, first and last line with an odd number of quotes, utf8, first
    line, first line with the marker as a cell (read as UTF-8 and as ``fallback``), and from the splits before
    it: lines, quotes and the last odd line (there begins a record that runs into the split).  ``endless``:
    where the record begins that never ends, the last odd line of a file with an odd number of quotes."""
    here = F.struct("n", "raw")

    def marked(encoding: str, text: Column) -> Column:
        if not marker:
            return F.lit(None).cast("struct<n:long,raw:string>")
        seen = F.contains(F.col("raw").cast("binary"), F.lit(marker.encode(encoding)))
        return F.min(F.when(F.when(seen, _has_cell(text, sep, marker)), here))
    q = _quotes(F.col("raw"))
    odd = F.when(q % 2 == 1, F.col("n"))
    # collect_set (two values at most) makes Spark aggregate in a map of splits; with minima of texts alone it
    # would sort all lines of a task first
    per = raw.groupBy("source_file", "block").agg(
        F.min("n").alias("n0"), F.count(F.lit(1)).alias("lines"), F.sum(q).alias("quotes"),
        F.min(odd).alias("odd_first"), F.max(odd).alias("odd_last"),
        (~F.array_contains(F.collect_set(F.is_valid_utf8("raw")), False)).alias("utf8"),
        F.min(here).alias("first"), marked("utf-8", F.col("raw")).alias("m_utf8"),
        marked(fallback, F.decode(F.col("raw").cast("binary"), fallback)).alias("m_other"))
    whole = Window.partitionBy("source_file")
    past = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("odd_last").isNotNull(), F.struct("block", F.col("odd_last").alias("n")))
    return materialize(per.select(
        "*", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}_before") for c in ("lines", "quotes")],
        F.last(own, ignorenulls=True).over(past).alias("runs_in"),
        F.when(F.sum("quotes").over(whole) % 2 == 1, F.max(own).over(whole)).alias("endless")), "splits")


def _headers(splits: DataFrame, fallback: str) -> DataFrame:
    """One row per file: utf8, place (block, n) and text of its header line, total of its quotes.

    The header is the first line with the marker if that is among the first
    1 + MARKER_LINES lines, else the first line.
    """
    def line(c: str) -> Column:
        at = F.col("lines_before") + F.col(f"{c}.n") - F.col("n0")
        return F.struct("block", F.col(f"{c}.n").alias("n"), F.col(f"{c}.raw").alias("raw"), at.alias("at"))
    per = splits.groupBy(F.col("source_file").alias("_f")).agg(
        F.bool_and("utf8").alias("utf8"), F.sum("quotes").alias("_quotes"), F.min(line("first")).alias("first"),
        *[F.min(F.when(F.col(c).isNotNull(), line(c))).alias(c) for c in ("m_utf8", "m_other")])
    m = F.when(F.col("utf8"), F.col("m_utf8")).otherwise(F.col("m_other"))
    h = F.when(m["at"] <= MARKER_LINES, m).otherwise(F.col("first"))
    per = per.select("_f", "utf8", "_quotes", h.alias("h"))
    return per.select("_f", "utf8", "_quotes", F.struct("h.block", "h.n").alias("_hpos"),
                      F.regexp_replace(_text(F.col("h.raw"), F.col("utf8"), fallback), "^\ufeff", "").alias("_header"))


def _joiners():
    """Functions for ``mapInArrow`` over the lines of torn splits, which come in their order.

    ``inner``: the records inside the splits; ``edges``: per split what it holds of the record that runs into it
    (``n`` NULL) or on past its end.  Nested, so that workers need not import this package.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def rows(n0, n, raw):
        return pa.RecordBatch.from_arrays([pa.array(n0, pa.int64()), pa.array(n, pa.int64()), raw.cast(pa.binary())],
                                          ["n0", "n", "raw"])

    def one(n0, n, lines):
        return rows([n0], [n], pa.array([b"\n".join(lines)], pa.binary()))

    def inner(batches):
        # the record that was begun last, and its lines so far; no record runs from one split into the next
        at, lines = None, []
        for batch in batches:
            raw = batch["raw"]
            if not len(raw):
                continue
            odd = pc.count_substring(raw, '"').to_numpy() % 2
            after = (np.cumsum(odd) + bool(lines)) % 2
            begins = np.flatnonzero(after == odd)
            head = int(begins[0]) if begins.size else len(raw)
            lines += raw.slice(0, head).to_pylist()
            if not begins.size:
                if lines and not after[-1]:
                    yield one(*at, lines)
                    at, lines = None, []
                continue
            if lines:
                yield one(*at, lines)
                at, lines = None, []
            if after[-1]:
                last = int(begins[-1])
                at, lines = (batch["n0"][last].as_py(), batch["n"][last].as_py()), raw.slice(last).to_pylist()
                begins, ends = begins[:-1], last
            else:
                ends = len(raw)
            if begins.size:
                places = pa.array(np.append(begins, ends) - head, pa.int32())
                each = pa.ListArray.from_arrays(places, raw.slice(head, ends - head))
                begins = pa.array(begins)
                yield rows(batch["n0"].take(begins), batch["n"].take(begins), pc.binary_join(each, b"\n"))

    def edges(batches):
        at, lines = None, []
        for batch in batches:
            n0, n = batch["n0"].to_numpy(), batch["n"].fill_null(-1).to_numpy()
            cuts = np.flatnonzero((np.diff(n0) != 0) | (np.diff(n) != 0)) + 1
            cuts = [0, *cuts.tolist(), len(n)] if len(n) else []
            for i, j in zip(cuts, cuts[1:]):
                here = (int(n0[i]), int(n[i]) if n[i] >= 0 else None)
                if here != at:
                    if lines:
                        yield one(*at, lines)
                    at, lines = here, []
                lines += batch["raw"].slice(i, j - i).to_pylist()
        if lines:
            yield one(*at, lines)
    return inner, edges


def _records(raw: DataFrame, splits: DataFrame) -> DataFrame:
    """(source_file, pos, raw, open): whole records; ``open`` ones are the lines of one that never ends.

    A split's lines are read in their order by one task, which joins the records
    inside it; only the two edges of a split meet in a shuffle.  Lines of splits
    without odd lines pass as they are where they are most of all, since that
    takes a scan of its own.
    """
    inside = F.col("quotes_before") % 2
    torn = F.col("odd_last").isNotNull() | (inside == 1)
    pos = F.struct("block", "n").alias("pos")
    some = splits.agg(F.sum(F.when(torn, F.col("lines"))).alias("torn"), F.sum(F.when(~torn, F.col("lines"))).alias("whole"),
                      F.count("endless").alias("endless")).collect()[0]
    if not some["torn"]:
        return raw.select("source_file", pos, "raw", F.lit(False).alias("open"))
    inner, joined_edges = _joiners()
    split = ["source_file", "block"]
    parts = []
    if (some["whole"] or 0) > some["torn"]:
        parts.append(raw.join(F.broadcast(splits.where(torn).select(*split)), split, "left_anti").select(
            "source_file", pos, "raw", F.lit(False).alias("open")))
        splits = splits.where(torn)
    # broadcasts of one row per split: the lines stay in the order of their split
    known = F.broadcast(splits.select(
        *split, "n0", "odd_first", "odd_last", "endless", (inside == 1).alias("entered"),
        ((inside + F.col("quotes")) % 2 == 1).alias("left")))
    lines = raw.join(known, split)
    if some["endless"]:
        never = F.coalesce(F.struct("block", "n") >= F.col("endless"), F.lit(False))
        parts.append(lines.where(never).select("source_file", pos, "raw", F.lit(True).alias("open")))
        lines = lines.where(~never)
    begun = F.col("left") & F.coalesce(F.col("n") >= F.col("odd_last"), F.lit(False))
    edge = begun | (F.col("entered") & F.coalesce(F.col("n") <= F.col("odd_first"), F.lit(True)))
    bytes_ = F.col("raw").cast("binary").alias("raw")
    fields = "n0 long, n long, raw binary"
    places = F.broadcast(splits.select("n0", *split, "runs_in"))
    parts.append(lines.where(~edge).select("n0", "n", bytes_).mapInArrow(inner, fields).join(places, "n0").select(
        "source_file", pos, F.col("raw").cast("string").alias("raw"), F.lit(False).alias("open")))
    edges = materialize(lines.where(edge).select("n0", F.when(begun, F.col("odd_last")).alias("n"), bytes_).mapInArrow(
        joined_edges, fields), "torn-edges")
    rec = F.coalesce(F.when(F.col("n").isNotNull(), F.struct("block", "n")), F.col("runs_in"))
    joined = (edges.join(places, "n0").groupBy("source_file", rec.alias("pos"))
              .agg(F.array_sort(F.collect_list(F.struct("block", F.col("raw").cast("string").alias("raw")))).alias("_l")))
    parts.append(joined.select("source_file", "pos", F.array_join("_l.raw", "\n").alias("raw"), F.lit(False).alias("open")))
    return reduce(DataFrame.unionByName, parts)


def _misquoted(line: Column, sep: str) -> Column:
    """True for a record with a line break outside its quoted cells, or a cell whose quote does not end."""
    s = re.escape(sep)
    # most records need one look: cells without a quote or line break, or quoted as a whole (no group loops back)
    plain = F.lit(False) if len(sep) != 1 else line.rlike(
        rf'^(?:"[^"]*+(?:""[^"]*+)*+"|[^"\n{s}]*+)(?:{s}(?:"[^"]*+(?:""[^"]*+)*+"|[^"\n{s}]*+))*+\z')
    bare = F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), rf'(^|{s})[ ]*"[^"]*+"', "$1")
    return F.contains(line, F.lit('"')) & ~plain & (F.contains(bare, F.lit("\n")) | bare.rlike(rf'(^|{s})[ ]*"'))


def _delimited(spark: SparkSession, path: str, glob: str | None, sep: str, fallback: str,
               marker: str | None, rename) -> tuple[DataFrame, list[str]]:
    """(source_file, line, _extra, _torn, one column per name) and the names, after ``rename`` of each header.

    Each file is decoded and read by its own header (``_headers``).  Records up
    to the header and blank ones are left out.  ``_extra``: it has more cells than
    its header; ``_torn``: why it is no whole record, NULL for one that is.
    """
    raw = _raw_lines(spark, path, glob)
    splits = _splits(raw, sep, fallback, marker)
    files = materialize(_headers(splits, fallback), "file-headers")
    # one row per layout, not per file
    layouts = sorted(r[0] for r in files.select("_header").distinct().collect())
    heads = [rename([c.strip() for c in next(csv.reader([h], delimiter=sep), [])]) for h in layouts]
    width = max(map(len, heads), default=1)
    names = list(dict.fromkeys(c for head in heads for c in head if c))
    places = [[head.index(c) if c in head else -1 for c in names] for head in heads]
    known = spark.createDataFrame(list(zip(layouts, places, map(len, heads))),
                                  "_layout string, _at array<int>, _width int")
    # one row per file, of a size that Spark knows: small ones are broadcast, no line is shuffled for them
    files = files.select("_f", "utf8", "_hpos") if len(heads) <= 1 else materialize(
        files.join(F.broadcast(known), F.col("_header") == F.col("_layout")).select(
            "_f", "utf8", "_hpos", "_at", "_width"), "file-layouts")
    body = _records(raw, splits).join(files, F.col("source_file") == F.col("_f"))
    line = _text(F.col("raw"), F.col("utf8"), fallback)
    body = body.where(F.col("pos") > F.col("_hpos")).drop("_f", "pos", "_hpos").withColumn("line", line)
    body = body.where(F.trim(F.replace("line", F.lit(sep), F.lit(" "))) != "")
    torn = F.when(F.col("open"), F.lit("unclosed quote")).when(_misquoted(F.col("line"), sep), F.lit("misplaced quote"))
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(width + 1)),
                       {"sep": sep, "escape": '"', "multiLine": "true", "maxColumns": str(max(20480, width + 2))})
    body = body.select("*", torn.alias("_torn"), cells.alias("_c"))
    if len(heads) <= 1:                                      # cells by fixed place
        out = [F.col(f"_c.c{i}").alias(c) for c, i in zip(names, places[0] if places else [])]
        extra = F.col(f"_c.c{width}").isNotNull()
    else:
        body = body.withColumn("_cells", F.array(*[F.col(f"_c.c{i}") for i in range(width + 1)]))
        out = [F.when(F.get("_at", F.lit(j)) >= 0, F.get("_cells", F.get("_at", F.lit(j)))).alias(c)
               for j, c in enumerate(names)]
        extra = F.get("_cells", F.col("_width")).isNotNull()
    return body.select("source_file", "line", extra.alias("_extra"), "_torn", *out), names


def _file_name(path: str | Column = "source_file") -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def scan_csv(spark: SparkSession, path: str, glob: str | None = "*.csv", fallback: str = "GBK",
             sep: str = ",", schema: T.StructType | str | None = None, infer: bool = True) -> DataFrame:
    """CSV with header; files that are not UTF-8 are read as ``fallback``.

    Columns are matched by name, whatever their order in each file; a column
    that a file lacks is NULL there.  Without a schema each column takes the
    narrowest type that all its cells have (``column_types``; the cells are stored for it), or
    stays text with ``infer=False``; with a schema, cells that do not parse are
    NULL (``scan_batch`` reports them).  Quoted cells may hold separators, line
    breaks and doubled quotes; a record that is torn raises when it is read.
    ``source_file`` holds the file's name.
    """
    enable_legacy_charsets(spark)
    df, names = _delimited(spark, path, glob, sep, fallback, None, lambda n: n)
    if not names:
        raise FileNotFoundError(f"no CSV files under {path}")
    df = _whole(df)
    if schema is None and infer:
        # read and cut into cells once; types and rows both come from the result
        cells = materialize(df.select("source_file", *[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(names)]), "csv-cells")
        df = cells.toDF("source_file", *names)
        schema = column_types(df, names)
    cols = [F.col(f"`{c}`") for c in names]
    if schema is not None:
        cols = [c for c, _ in _typed(names, _struct(spark, schema))]
    return df.select(*cols, _file_name().alias("source_file"))


def _whole(df: DataFrame) -> DataFrame:
    """The records; one that is torn raises."""
    why = F.concat(F.col("_torn"), F.lit(" in "), F.col("source_file"), F.lit(": "), F.substring("line", 1, 200))
    return df.where(F.when(F.col("_torn").isNull(), F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))


#: types of cells, narrowest first
_LATTICE: list[T.DataType] = [T.BooleanType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampNTZType()]

#: whatever casts to a double, and little else
_LIKE_A_DOUBLE = (r"(?i)^[\x00-\x20]*[+-]?(?:nan|inf|infinity|0x[0-9a-f.]+p[+-]?[0-9]+|"
                  r"(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:e[+-]?[0-9]++)?)[fd]?[\x00-\x20]*$")


def _fits(x: Column) -> Column:
    """Places in _LATTICE of the types that a trimmed cell has, as bits; NULL for an empty cell.

    A cast that fails costs an exception, so only cells that look like a type are cast to it.
    """
    boolean, long, double, date, stamp = (1 << i for i in range(len(_LATTICE)))
    first = F.ascii(x)
    numeric = (first <= 32) | first.between(48, 57) | first.isin(*[ord(c) for c in "+-.iInN"])

    def bit(test: Column, value: int) -> Column:
        return F.when(test, F.lit(value)).otherwise(F.lit(0))
    day = (F.substring(x, 5, 1) == "-") & x.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:.*)?$")
    decimal = numeric & x.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$")
    any_double = numeric & x.rlike(_LIKE_A_DOUBLE)
    return F.when(x != "", F.when(
        day, bit(~F.contains(x, F.lit(":")) & x.try_cast("date").isNotNull(), date)
        + bit(x.try_cast("timestamp_ntz").isNotNull(), stamp)).when(
        decimal, F.lit(double) + bit(~F.contains(x, F.lit(".")) & (
            (F.length(x) <= 18) | x.try_cast("long").isNotNull()), long)).when(
        any_double, bit(~x.rlike(r"^(\+|-?0[0-9])") & strict_double(x).isNotNull(), double)).otherwise(
        bit(F.lower(x).isin("true", "false"), boolean)))


def column_types(df: DataFrame, names: list[str]) -> T.StructType:
    """The narrowest type of each text column: boolean, long, double, date, timestamp, else text.

    A long fits a double column and a date a timestamp column; a plus sign or a
    leading zero (007) makes a text.  Empty cells fit all, and a column without
    any other is text.  One partial aggregate of a number per column; a row per
    cell, since code for all columns of a row at once is too long for the JVM to compile.
    """
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in names])).alias("j", "c"))
    fits = cells.select("j", F.trim("c").alias("x")).select("j", _fits(F.col("x")).alias("fits"))
    got = dict(fits.groupBy("j").agg(F.bit_and("fits")).collect())      # one row per column

    def kind(fits: int | None) -> T.DataType:
        return next((t for i, t in enumerate(_LATTICE) if (fits or 0) >> i & 1), T.StringType())
    return T.StructType([T.StructField(c, kind(got.get(j))) for j, c in enumerate(names)])


def _struct(spark: SparkSession, schema: T.StructType | str) -> T.StructType:
    return spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema


def _typed(names: list[str], schema: T.StructType) -> list[tuple[Column, Column]]:
    """(typed column, true where the cell does not parse) per field of the schema."""
    out = []
    for f in schema.fields:
        if f.name not in names:
            out.append((F.lit(None).cast(f.dataType).alias(f.name), F.lit(False)))
            continue
        c = F.col(f"`{f.name}`")
        value = c if isinstance(f.dataType, T.StringType) else (
            strict_double(c) if isinstance(f.dataType, T.DoubleType) else F.trim(c).try_cast(f.dataType))
        out.append((value.alias(f.name), c.isNotNull() & (F.trim(c) != "") & value.isNull()))
    return out


def scan_preamble(spark: SparkSession, path: str, marker: str = schemas.HEADER_MARKER, sep: str = "\t",
                  glob: str | None = None, strict_names: bool = False, fallback: str = "GBK") -> DataFrame:
    """Delimited text whose real header is the first line that has ``marker`` as a cell.

    It counts in the first line and the MARKER_LINES lines after it; lines
    before it are skipped.  A file without it there is read with its first line
    as header, whatever later cells say.  Every later record that is not blank
    is a row; one that is torn raises.  Columns: normalised header names
    (texts), plus ``source_file``.  Files may be of any size: no file is held
    whole, and lines are shuffled only where quoted cells run over several.
    """
    enable_legacy_charsets(spark)
    df, names = _delimited(spark, path, glob, sep, fallback, marker,
                           lambda n: canonical_names(n, strict=strict_names))
    return _whole(df).select("source_file", *[F.trim(F.col(f"`{c}`")).alias(c) for c in names])


def scan_batch(spark: SparkSession, path: str, accept: str = ".csv", schema: T.StructType | str | None = None,
               fallback: str = "GBK") -> tuple[DataFrame, DataFrame]:
    """S3: (rows of the accepted files tagged with file_name, rejects).

    Batch loading accepts names that end in ``accept`` (case-sensitive).  Every
    file or record that is not loaded is one row of rejects: source_file,
    file_name, line (NULL for a whole file), reason.  A record is rejected if it
    has more cells than its header, a cell that does not parse as the schema's
    type, or quotes that do not fit; of one that never ends, each line is.  Without a schema every column is text.  Files without a
    byte hold nothing to load and are not listed.
    """
    enable_legacy_charsets(spark)
    listing = list_files(spark, path).select(F.col("path").alias("source_file"), "file_name")
    wanted = F.col("file_name").endswith(accept)
    refused = listing.where(~wanted).select("source_file", "file_name", F.lit(None).cast("string").alias("line"),
                                            F.lit("unsupported type").alias("reason"))
    if not listing.where(wanted).limit(1).count():
        return spark.createDataFrame([], "file_name string"), refused
    df, names = _delimited(spark, path, f"*{accept}", ",", fallback, None, lambda n: n)
    typed = _typed(names, _struct(spark, schema)) if schema is not None else [
        (F.col(f"`{c}`"), F.lit(False)) for c in names]
    fields = [f.name for f in _struct(spark, schema).fields] if schema is not None else names
    reason = F.coalesce(
        F.col("_torn"), F.when(F.col("_extra"), F.lit("too many cells")),
        *[F.when(bad, F.lit(f"unparsable: {n}")) for n, (_, bad) in zip(fields, typed)])
    # parsed once; rows and rejects both read the result
    parsed = materialize(df.select(*[v for v, _ in typed], "source_file", _file_name().alias("file_name"),
                                   F.col("line").alias("_line"), reason.alias("_reason")), "batch-parsed")
    bad = parsed.where("_reason is not null").select("source_file", "file_name", F.col("_line").alias("line"),
                                                     F.col("_reason").alias("reason"))
    return parsed.where("_reason is null").drop("_line", "_reason", "source_file"), refused.unionByName(bad)


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path).withColumn("source_file", F.col("_metadata.file_name"))
