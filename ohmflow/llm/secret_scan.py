"""Secret scan over a trigram inverted index (DataFrame functions only).

1. Each rule's regex gives a Boolean trigram query: an OR of clauses, each a set
   of trigrams that every match of that alternative must contain.
2. The index maps each trigram that a query asks for to the documents whose
   lower-cased text holds it (one posting per trigram and document).
3. Clauses intersect their postings: a document is a candidate of a rule if
   one clause has all its trigrams there.  The count is combined before the
   shuffle, so a document sends one row per clause, whatever its length.
4. Candidates are verified by the regex over the whole text.  A rule without
   a mandatory trigram (hex) scans every document.

Spans are code points, end exclusive; matches are leftmost and do not overlap
within a kind.  Base kinds come first, further kinds add spans.

Defined results: null and empty texts give no spans and the hash of the empty
string; every row gives one row, rows with equal or null doc_id are each
judged on their own text; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import table


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose ``group`` is shorter than ``least`` are dropped."""
    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The contract's kinds.  Where all of a match is one greedy run, the least
#: length is said in the regex itself: shorter runs never match, longer ones
#: match alike.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


#: a class of at most so many characters counts as that many alternatives
SMALL_CLASS = 8


def _members(items) -> list[str]:
    """The characters of a class, or more than SMALL_CLASS if it is negated, a category or a wide range."""
    out = []
    for op, arg in items:
        if str(op) == "LITERAL":
            out.append(chr(arg))
        elif str(op) == "RANGE" and arg[1] - arg[0] < SMALL_CLASS:
            out += map(chr, range(arg[0], arg[1] + 1))
        else:
            return ["\0"] * (SMALL_CLASS + 1)
    return sorted(set(out))


def _runs(items) -> list[list[str]]:
    """Alternatives of a parsed regex, each the list of literal runs that any match of it contains.

    ``\\0`` stands for "anything may come here".
    """
    out = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            parts = [chr(arg)]
        elif name == "SUBPATTERN":
            parts = _runs(arg[-1])
        elif name == "BRANCH":
            parts = [r for branch in arg[1] for r in _runs(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            least = _runs(arg[2])
            parts = [r * min(arg[0], 8) + "\0" for r in least] if len(least) == 1 else [r + "\0" for r in least]
        elif name == "IN" and len(few := _members(arg)) <= SMALL_CLASS:
            parts = few or ["\0"]
        elif name == "AT":
            parts = [""]
        else:                                                # classes, optional parts, anything else
            parts = ["\0"]
        out = [a + b for a in out for b in parts]
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams, one of which every match satisfies; [] if a match needs none."""
    clauses = set()
    for alternative in _runs(parser.parse(regex)):
        grams = frozenset(run[i:i + 3] for run in alternative.lower().split("\0") for i in range(len(run) - 2))
        if not grams:
            return []
        clauses.add(grams)
    return sorted(clauses, key=sorted)


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(doc_id, gram): the index, restricted to the trigrams asked for."""
    # an explode of one value settles it: each text is lower-cased once, not once per trigram
    low = docs.select("doc_id", F.explode(F.array(F.lower("text"))).alias("low"))
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])
    return low.select("doc_id", F.explode(F.array_compact(held)).alias("gram"))


def candidates(docs: DataFrame, rules) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document satisfies."""
    spark = docs.sparkSession
    rows = [(r.kind, i, g, len(clause)) for r in rules for i, clause in enumerate(trigram_query(r.regex))
            for g in clause]
    if not rows:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, kinds array<string>")
    # as many rows as the rules have trigrams: bounded by the rule list, not by the data
    clauses = F.broadcast(spark.createDataFrame(rows, "kind string, clause int, gram string, need int"))
    return (postings(docs, sorted({r[2] for r in rows})).join(clauses, "gram")
            .groupBy("doc_id", "kind", "clause", "need").agg(F.count_distinct("gram").alias("held"))
            .where("held = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


def _matches(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, end, kind) of one rule's matches."""
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    regex = F.lit(rule.regex)
    between = F.split(text, rule.regex, -1)
    # text between the matches and the matches themselves give every match's place
    pairs = F.arrays_zip(F.transform(between, F.length).alias("gap"),
                         F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length).alias("size"),
                         F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length).alias("part"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, p):
        begin = acc["at"] + p["gap"]
        end = begin + p["size"]
        hit = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"),
                       F.lit(rule.kind).alias("kind"))
        return F.struct(F.coalesce(end, begin).alias("at"),
                        F.when(p["part"] >= rule.least, F.concat(acc["out"], F.array(hit)))
                        .otherwise(acc["out"]).alias("out"))
    return F.when(F.rlike(text, regex), F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(none)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, extra=EXTRA) -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256, spans."""
    docs = docs.select("doc_id", "text")
    rules = [*BASE, *extra]
    hits = candidates(docs, rules)
    text = F.coalesce("text", F.lit(""))
    both = docs.join(hits.withColumnRenamed("doc_id", "hit_id"), docs.doc_id.eqNullSafe(F.col("hit_id")), "left")
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    cols = []
    for i, r in enumerate(rules):
        found = _matches(r, i, text)
        if trigram_query(r.regex):
            found = F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), found).otherwise(none)
        cols.append(found.alias(r.kind))
    found = both.select("doc_id", *cols)
    base = F.concat(*[F.col(r.kind) for r in BASE])
    return found.select("doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE],
                        F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.concat(*[F.col(r.kind) for r in rules])).alias("spans"))


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _duck(rule: Rule, order: int) -> str:
    rx = rule.regex.replace("'", "''")
    return f"""
  SELECT rid, {order} AS ord, '{rule.kind}' AS kind, start, stop FROM (
    SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(g) AS part,
           unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS start,
           unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))
             + list_sum(list_transform(m[1:i], lambda x: length(x)))))::BIGINT AS stop
    FROM (SELECT rid, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', {rule.group}) AS g,
                 string_split_regex(t, '{rx}') AS p FROM d) WHERE len(m) > 0)
  WHERE length(part) >= {rule.least}"""


_RULES = (*BASE, *EXTRA)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_duck(r, i) for i, r in enumerate(_RULES))}),
l AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
             count(*) FILTER (kind = 'hex') AS h,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS b,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS x FROM s GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans FROM d LEFT JOIN l USING (rid)
"""

