"""Language ID: multinomial naive Bayes over hashed character n-grams.

Learning counts, for every language, how often each hashed n-gram (1 to 3 code
points of the lower-cased text, everything that is no letter counting as one
blank) stands in its documents: each task counts its partition into one vector
per language (sent on before they are more than ``BLOCK_LANGS``) and sends the
non-zero cells, Spark adds them up.  The matrix of log probabilities has one row
per language and ``BUCKETS`` columns.  It is broadcast in blocks of
``BLOCK_LANGS`` languages in alphabetical order, each of at most
BLOCK_LANGS * BUCKETS * 4 bytes (16 MB), one after the other; so any number of
languages is learned, and up to 256 take one pass.

Prediction scores whole texts in numpy inside the tasks: a slice of rows gives
its n-gram buckets, the matrix is gathered at them and summed per row.  A block
gives each row its best language, that one's log score and the log of the sum
over the block; of several blocks Spark takes the best and adds the sums.

Learned rows: ``lang`` known and crc32(doc_id as text) mod 5 not 0; the other
fifth is held out.  A prediction reads the text alone.

Defined results: a null text, a text without a letter, or nothing learned:
``und`` with score 0.  Ties go to the first language in alphabetical order.
Rows with null doc_id are neither learned from nor held out.  Repeated rows are
learned and judged one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import stored, table

BUCKETS = 1 << 14
SIZES = (1, 2, 3)
BLOCK_LANGS = 256
ALPHA = 0.5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """Basic-plane code points: a letter's lower case, 0 for all else."""
    out = np.zeros(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end (0: no letter), and row offsets."""
    offs = tk.sums0(np.array([len(t) for t in texts], dtype=np.int64))
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    low = _lower_letters()
    out = low[np.minimum(cp, 0xFFFF)]
    for c in np.unique(cp[cp > 0xFFFF]):
        ch = chr(c).lower()
        out[cp == c] = ord(ch) if ch.isalpha() and len(ch) == 1 else (int(c) if chr(c).isalpha() else 0)
    return out, offs


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram with a letter, its row, and whether each row has a letter."""
    cp, offs = _letters(texts)
    n_rows = len(texts)
    row = np.repeat(np.arange(n_rows), np.diff(offs))
    has = np.bincount(row[cp > 0], minlength=n_rows) > 0
    end = offs[1:][row]
    buckets, rows = [], []
    for n in SIZES:
        if len(cp) < n:
            continue
        at = np.arange(len(cp) - n + 1)
        h = np.full(len(at), n, dtype=np.uint64)
        some = np.zeros(len(at), dtype=bool)
        for i in range(n):
            part = cp[i:i + len(at)]
            h = h * np.uint64(0x100000001B3) + part
            some |= part > 0
        ok = some & (at + n <= end[:len(at)])
        buckets.append((tk.mix(h[ok]) >> np.uint64(50)).astype(np.int32))       # 64 - 14 bits
        rows.append(row[:len(at)][ok])
    if not buckets:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), has
    return np.concatenate(buckets), np.concatenate(rows), has


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _cells(total: dict[str, np.ndarray]):
    for lang, v in total.items():
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(at)), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(v[at])],
            names=["lang", "bucket", "n"])


def _counting(block: int):
    def run(batches):
        """(lang, bucket, n), and the number of documents in bucket -1; a language may come several times."""
        total: dict[str, np.ndarray] = {}
        for batch in tk.chunked(batches, "text"):
            langs, codes = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str),
                                     return_inverse=True)
            bucket, row, _ = grams(_texts(batch))
            codes_at = codes[row]
            docs = np.bincount(codes, minlength=len(langs))
            order = np.argsort(codes_at, kind="stable")
            ends = tk.sums0(np.bincount(codes_at, minlength=len(langs)))
            for i, lang in enumerate(langs):
                if len(total) >= block and str(lang) not in total:
                    yield from _cells(total)
                    total = {}
                v = total.setdefault(str(lang), np.zeros(BUCKETS + 1, dtype=np.int64))
                v[:-1] += np.bincount(bucket[order[ends[i]:ends[i + 1]]], minlength=BUCKETS)
                v[-1] += docs[i]
        yield from _cells(total)
    return run


def held_out() -> Column:
    """True for the fifth of the documents that is not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, block: int = BLOCK_LANGS) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(languages, log priors, log probabilities) from the learned rows, at most ``block`` languages at a time."""
    seen = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull()).select("lang", "text")
    cells = stored(seen.mapInArrow(_counting(block), "lang string, bucket int, n long").groupBy("lang", "bucket")
                   .agg(F.sum("n").alias("n")), "language-cells")
    # one row per language, numbered in order
    place = F.floor((F.row_number().over(Window.orderBy("lang")) - 1) / F.lit(block)).cast("int")
    names = stored(cells.where("bucket = -1").select("lang", "n").withColumn("block", place), "languages")
    n_docs, blocks = names.agg(F.sum("n"), F.max("block")).collect()[0]
    for i in range(0 if blocks is None else blocks + 1):
        part = cells.join(names.where(F.col("block") == i).select("lang"), "lang", "left_semi").toArrow()
        langs, code = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str),
                                return_inverse=True)
        bucket, count = part.column("bucket").to_numpy(), part.column("n").to_numpy().astype(float)
        docs_of = np.zeros(len(langs))
        docs_of[code[bucket < 0]] = count[bucket < 0]
        m = np.full((len(langs), BUCKETS), ALPHA)
        real = bucket >= 0
        m[code[real], bucket[real]] += count[real]
        yield ([str(x) for x in langs], np.log(docs_of / n_docs),
               np.log(m / m.sum(axis=1, keepdims=True)).astype(np.float32))


def _best(model):
    def run(batches):
        langs, prior, matrix = model.value
        for batch in tk.chunked(batches, "text"):
            bucket, row, has = grams(_texts(batch))
            n = batch.num_rows
            score = np.stack([np.bincount(row, weights=m[bucket], minlength=n) for m in matrix], axis=1) + prior
            best, top = score.argmax(axis=1), score.max(axis=1)
            total = top + np.log(np.exp(score - top[:, None]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"],
                pa.array([langs[b] if h else None for b, h in zip(best, has)], pa.string()),
                pa.array(top), pa.array(total)],
                names=[*[c for c in batch.schema.names if c != "text"], "lang_pred", "top", "total"])
    return run


def identify(docs: DataFrame, block: int = BLOCK_LANGS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, "
    judged = "lang_pred string, top double, total double"
    model, following = None, []
    for model_of_block in learn(docs, block):
        if model is None:
            model = model_of_block
            continue
        if not following:                          # rows get a number that every block finds again
            rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "language-rows")
        shared = sc.broadcast(model_of_block)
        following.append(stored(rows.select("row", "text").mapInArrow(_best(shared), "row long, " + judged),
                                "language-block"))
        shared.destroy()
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    first = rows.mapInArrow(_best(sc.broadcast(model)), kind + ("row long, " if following else "") + judged)
    if following:
        rest = [x.withColumns({"doc_id": F.lit(None).cast(dict(docs.dtypes)["doc_id"]),
                               "held_out": F.lit(None).cast("boolean")}) for x in following]
        each = reduce(DataFrame.unionByName, rest, first)
        top = each.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
            F.min_by("lang_pred", F.struct(-F.col("top"), F.col("lang_pred"))).alias("lang_pred"),
            F.max("top").alias("top"), F.collect_list("total").alias("totals"))
        m = F.array_max("totals")
        first = top.withColumn("total", m + F.log(F.aggregate(
            "totals", F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))
    known = F.col("lang_pred").isNotNull()
    return first.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                        F.when(known, F.exp(F.col("top") - F.col("total"))).otherwise(0.0).alias("score"))


def op7(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
