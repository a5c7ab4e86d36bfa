"""Line dedup over content-defined chunks (DataFrame functions only).

A document's lines are cut into chunks: a chunk ends after a line where the
rolling hash of the last two line hashes is 0 modulo ``MODULUS``.  The cut depends
on those lines alone, so a passage shared by two documents is cut alike in
both, however many lines stand before it.  A chunk of two or more lines, not
all blank, that stands more than once in the corpus is kept at its first place
(smallest doc_id, then place in the document) and removed everywhere else.

Chunks are found by their hash, and only those whose hash repeats are compared
byte by byte: they are grouped by (hash, text), so different chunks with one
hash never meet.  Counts and first places are combined before the shuffle; the
chunks of one group are never gathered.

Texts of other chunks, and documents that lose no chunk, are never shuffled:
broadcast bitmaps of bounded size (``frames.maybe_in``) tell them apart where
they are read.  A text of a repeated hash is shuffled once, to be compared;
where all texts of a hash are equal, places are then joined by hash alone.

Defined results: null text stays null and has no lines; a text whose chunks are
all removed becomes empty; repeats inside one document are removed too; single
lines are never removed.  Rows with null doc_id come first; rows with one
doc_id are told apart by a hash of their text, and equal rows stay equal.
Other columns pass through, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import maybe_in, stored, table

MODULUS = 3
BASE = 31


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once: a one-element explode, which the optimizer
    does not repeat inside the lambdas that read the column."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _cut(df: DataFrame) -> DataFrame:
    """Adds ``_chunks``, the arrays of lines of ``text``, and what leads to them.

    A line's hash is 28 bits of its md5, which every SQL engine has; the line
    before the first counts as 0.
    """
    df = _settled(df, "_lines", F.split("text", "\n", -1))
    df = _settled(df, "_hashes", F.expr(
        "transform(_lines, x -> cast(conv(substring(md5(cast(x as binary)), 1, 7), 16, 10) as bigint))"))
    df = _settled(df, "_ends", F.expr(f"""
        filter(sequence(1, size(_lines)), i -> i = size(_lines) or
            (_hashes[i - 1] + {BASE} * if(i > 1, _hashes[greatest(i - 2, 0)], 0L)) % {MODULUS} = 0)"""))
    return _settled(df, "_chunks", F.expr("""
        transform(_ends, (e, k) -> slice(_lines, if(k = 0, 1, _ends[greatest(k - 1, 0)] + 1),
                                         e - if(k = 0, 0, _ends[greatest(k - 1, 0)])))"""))


def _hash(*columns: str) -> Column:
    return F.xxhash64(*columns)


def removed_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, row, gone): numbers of the chunks to remove from each document; row is the text's hash."""
    each = (_cut(docs.select("doc_id", "text").where("text is not null"))
            .select("doc_id", F.xxhash64("text").alias("row"), F.posexplode("_chunks").alias("k", "lines"))
            .where(F.size("lines") > 1).withColumn("chunk", F.array_join("lines", "\n"))
            .where(F.rlike("chunk", F.lit(r"[^ \t-\r]"))))
    keyed = each.select("doc_id", "row", "k", _hash("chunk").alias("h"), "chunk")
    # the small side of each join is written first: only then can Spark split a hot key's side
    seen = stored(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "line-seen")
    # the few chunks that stand once and still pass are first, and stay
    again = stored(maybe_in(keyed, "h", seen, "maybe").where("maybe").drop("maybe"), "line-chunks")
    place = F.struct("doc_id", "row", "k")
    first = again.groupBy("h", "chunk").agg(F.min(place).alias("first"))
    hashes = stored(first.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")),
                    "line-first")
    where, later = again.select("doc_id", "row", "k", "h"), ~place.eqNullSafe(F.col("first"))
    gone = where.join(hashes.where("texts = 1"), "h").where(later).select("doc_id", "row", "k")
    mixed = hashes.where("texts > 1").select("h")
    if not mixed.isEmpty():                                  # different texts with one hash
        several = stored(again.join(mixed, "h", "left_semi"), "line-mixed")
        first = stored(several.groupBy("h", "chunk").agg(F.min(place).alias("first")), "line-first")
        gone = gone.unionByName(several.join(first, ["h", "chunk"]).where(later).select("doc_id", "row", "k"))
    return stored(gone.groupBy("doc_id", "row").agg(F.collect_set("k").alias("gone")), "line-gone")


def line_dedup(docs: DataFrame) -> DataFrame:
    """(row: the input's columns as a struct, text: cleaned, n_lines, n_removed)."""
    gone = removed_chunks(docs).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"),
                                       F.col("gone").alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       "text", F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_key"))
    rows = maybe_in(rows.withColumn("_h", _hash("_doc", "_key")), "_h",
                    gone.select(_hash("_id", "_row").alias("_h")), "_maybe").drop("_h")

    def counted(df: DataFrame, lines: Column, text: Column, removed: Column) -> DataFrame:
        lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.coalesce(lines, F.lit(0)))
        return df.select("row", text.alias("text"), lines.cast("long").alias("n_lines"),
                         removed.cast("long").alias("n_removed"))
    whole = counted(rows.where("not _maybe"), F.size(F.split("text", "\n", -1)), F.col("text"), F.lit(0))
    both = (rows.where("_maybe").drop("_maybe")
            .join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left"))
    kept = _settled(_cut(both), "_kept", F.expr("""
        flatten(transform(filter(transform(_chunks, (c, k) -> struct(k as k, c as c)),
                                 x -> not array_contains(_gone, x.k)), x -> x.c))"""))
    touched = F.col("_gone").isNotNull()
    return whole.unionByName(counted(
        kept, F.size("_lines"), F.when(touched, F.array_join("_kept", "\n")).otherwise(F.col("text")),
        F.when(touched, F.size("_lines") - F.size("_kept")).otherwise(F.lit(0))))


def clean_documents(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The documents with repeated chunks removed; columns as they came, ``n_chars`` follows the text.

    With ``drop_emptied`` a document that had a word and lost all its words is no row any more.
    """
    kinds = dict(docs.dtypes)
    word = F.lit(r"[^ \t-\r]")

    def column(c: str):
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.length("text").cast(kinds[c]).alias(c)
        return F.col("row").getField(c).alias(c)
    out = line_dedup(docs)
    if drop_emptied:                                         # only chunks with a word are removed
        out = out.where((F.col("n_removed") == 0) | F.rlike("text", word))
    return out.select(*[column(c) for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    return (line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("text").alias("kept_text")))


ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line, len(x) AS n
           FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l),
e AS (SELECT *, i = n OR (h + {BASE} * coalesce(lag(h) OVER w, 0)) % {MODULUS} = 0 AS ends
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, k, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, k),
r AS (SELECT *, size > 1 AND regexp_matches(chunk, '[^ \\t-\\r]')
             AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS gone FROM c),
o AS (SELECT doc_id, sum(size) AS n_lines, coalesce(sum(size) FILTER (gone), 0) AS n_removed,
             coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept_text FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, kept_text
FROM documents d LEFT JOIN o USING (doc_id)
"""
