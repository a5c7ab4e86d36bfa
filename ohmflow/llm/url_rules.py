"""URL rules by a sort-merge range join (DataFrame functions only).

A rule (host, path) fits its host and all subdomains where the url's path
starts with the rule's.  The canonical key of a rule is its host's labels in
reverse order, a separator, then its path; the urls a rule fits are those with
a key in the interval of strings that start with the rule's key.  A url has
one key for each ancestor of its host (``a.example.org``: ``org``,
``org.example``, ``org.example.a``), down to the labels of the longest rule.

Rules and keys are range-partitioned and sorted together, rules first among
equals, and swept: prefix intervals nest, so the rules that can be open at a
key are the stack of the last rule before it (that rule and the rules whose
keys are prefixes of its key); those that no longer fit are popped.  The stack
at the start of a range is the last one of the ranges before it, from a table
with one row per range.  Neither side is broadcast, so rule lists may be large.

Equal (host, path) pairs are judged once, so a hot url or host is one key
before anything is sorted, and a range can split anywhere, also between equal
keys.

Defined results: the longest fitting rule wins (host and path written
together; of equally long ones the greatest string); of rules given twice
``block`` wins over ``allow``.  A url that is null or has no ``://`` has empty
host and path.  No fitting rule: rule null and the default verdict.  Rules
with a null part are left out.  Every row of the input gives one row; other
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .frames import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEP = "\x01"
#: the contract's rules
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url, both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def _stacks(rules: DataFrame) -> DataFrame:
    """Each rule's key with its stack: itself and all rules whose keys are prefixes of its key."""
    rules = (rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path")
             .agg(F.max("verdict").alias("verdict"))
             .withColumn("key", F.concat(F.array_join(_labels(F.col("host")), "."), F.lit(SEP), "path")))
    prefixes = rules.select(F.col("key").alias("inner"),
                            F.explode(F.expr("transform(sequence(1, length(key)), i -> left(key, i))")).alias("key"))
    frame = F.struct(F.col("key"), F.col("host"), F.col("path"), F.col("verdict"))
    return (prefixes.join(rules, "key").groupBy(F.col("inner").alias("key"))
            .agg(F.array_sort(F.collect_list(frame)).alias("stack")))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """One row per url: id, host, path, rule, verdict."""
    spark = urls.sparkSession
    ranges = shuffle_partitions(spark)
    host, path = url_parts(F.col(url_col))
    parts = urls.select(id_col, host.alias("host"), path.alias("path"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).collect()[0]
    stacks = _stacks(rules)
    # what lies beyond the longest rule's labels and path decides nothing
    keys = (parts.distinct()
            .withColumn("labels", _labels(F.col("host")))
            .withColumn("depth", F.explode(F.expr(f"sequence(1, least(size(labels), {max(1, deepest[0] or 1)}))")))
            .select("host", "path", F.expr("array_join(slice(labels, 1, depth), '.')").alias("rhost"))
            .withColumn("key", F.concat("rhost", F.lit(SEP), F.left("path", F.lit((deepest[1] or 0) + 1)))))
    nested = dict(stacks.dtypes)["stack"]
    both = (keys.select("key", F.lit(1).alias("kind"), "host", "path", "rhost",
                        F.lit(None).cast(nested).alias("stack"))
            .unionByName(stacks.select("key", F.lit(0).alias("kind"), F.lit("").alias("host"),
                                       F.lit("").alias("path"), F.lit("").alias("rhost"), "stack")))
    swept = stored(both.repartitionByRange(ranges, "key", "kind", "host", "path")
                   .withColumn("range", F.spark_partition_id()), "url-ranges")
    last = (spark.range(ranges).select(F.col("id").cast("int").alias("range"))
            .join(swept.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("own")), "range", "left")
            .withColumn("open", F.last("own", ignorenulls=True).over(
                Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
            .select("range", "open"))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.expr("""filter(coalesce(top, open), r -> startswith(key, r.key)
                            and rhost = array_join(reverse(split(r.host, '[.]', -1)), '.')
                            and startswith(path, r.path))""")
    best = F.expr("""array_max(transform(fits, r -> struct(length(r.host) + length(r.path) as size,
                                                           concat(r.host, r.path) as rule, r.verdict as verdict)))""")
    # one row per range: bounded by the number of shuffle partitions
    found = (swept.withColumn("top", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
             .join(F.broadcast(last), "range").withColumn("fits", fits)
             .groupBy("host", "path").agg(F.max(best).alias("best")).where("best is not null"))
    return (parts.join(found, ["host", "path"], "left")
            .select(id_col, "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def op5(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES
  {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
         FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT row_number() OVER () AS n, page_id, translate(h, '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM hosts),
fit AS (SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
               arg_max(verdict, length(rhost || rpath)) AS verdict
        FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (n)
"""
