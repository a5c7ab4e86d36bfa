"""Target-distribution importance resampling over hashed word n-grams.

Every document is normalised (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by one space) and scanned once: the running
crc32 after every word is kept.  The crc32 of any n-gram follows from two of
these prefixes: a prefix's crc moved over the bytes that follow it (a linear
map over GF(2): multiplication by x**8 per byte, modulo the crc polynomial)
cancels out of the longer prefix's crc by exclusive or.  So one scan serves
n-grams of every size, and no n-gram is ever built as text.

    features  all runs of 1 to ``max_n`` words, repeats counted; bucket = crc32 mod ``buckets``
    gains     per bucket, the log ratio of its smoothed share in the target (benchmark) and in
              the documents, in thousandths, rounded down
    weight    rounded-down mean of the gains of a document's features
    score     weight plus Gumbel noise from sha256 of ``seed:doc_id``
    rank      place among the ``percent`` per cent highest scores (ties to the smaller doc_id) of the
              documents with at least ``least_words`` words

How it scales: tasks count buckets into one vector and send its non-zero cells
(map-side), so at most tasks x ``buckets`` small rows are shuffled; the gains,
``buckets`` numbers, are broadcast.  Ranks come from one range partitioning of
the scored rows (ids and numbers only), whose ranges end between equal scores.
Scores are written first, so texts are read twice and never shuffled.

Defined results: null and empty texts have no features and weight 0; an empty
target gives the gains of t = T = 0; an empty table gives an empty result; a
null doc_id is hashed as an empty number and ranks behind equal scores with an
id.  Repeated rows are scored and drawn one by one, equal ones in any order.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import global_index
from . import textkit as tk
from .frames import stored, table

MAX_N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: the reflected polynomial of crc32 (a fixed value)
POLYNOMIAL = 0xEDB88320
ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """A zero byte's step for each low byte of the register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


STEP = _byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by what it makes of each value of each of the four bytes."""
    return (tables[0][crc & np.uint32(255)] ^ tables[1][(crc >> np.uint32(8)) & np.uint32(255)]
            ^ tables[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ tables[3][crc >> np.uint32(24)])


def _moves() -> np.ndarray:
    """Maps over 2**k zero bytes, k < 40, each as four tables; a map's square is the next."""
    x = np.arange(256, dtype=np.uint32)
    one = np.stack([STEP[(v := x << np.uint32(8 * i)) & np.uint32(255)] ^ (v >> np.uint32(8)) for i in range(4)])
    out = [one]
    for _ in range(39):
        out.append(np.stack([_apply(out[-1], t) for t in out[-1]]))
    return np.stack(out)


MOVES = _moves()


def moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each crc moved over ``size`` bytes: what it contributes to the crc of a text that goes on so long."""
    crc, size = crc.copy(), size.astype(np.int64)
    k = 0
    while len(size) and (size >> k).any():
        on = np.flatnonzero((size >> k) & 1)
        crc[on] = _apply(MOVES[k], crc[on])
        k += 1
    return crc


def scanned(arr) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the normalised rows: crc before each word, crc after it, its bytes, and each row's first word.

    "Before" is after the separator, which every word has before it (a row
    begins with one, so all words are alike; it cancels with the prefix).
    """
    data, offs = tk.utf8(arr)
    data = tk.LOWER[data]
    starts, ends, first = tk.spans(data, offs, tk.ALNUM_LOWER)
    after = np.zeros(len(starts), dtype=np.uint32)
    flat = data.tobytes()
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if a < b:
            pieces = (b" " + flat[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist()))
            run = accumulate(pieces, lambda crc, piece: zlib.crc32(piece, crc), initial=0)
            after[a:b] = np.fromiter(run, dtype=np.uint32, count=b - a + 1)[1:]
    before = np.zeros(len(starts), dtype=np.uint32)
    before[1:] = after[:-1]
    before[first[:-1][np.diff(first) > 0]] = 0
    register = before ^ ALL
    before = (STEP[(register ^ np.uint32(0x20)) & np.uint32(255)] ^ (register >> np.uint32(8))) ^ ALL
    return before, after, ends - starts, first


def features(arr, max_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc32 of every n-gram of 1 to ``max_n`` words, its row, words per row)."""
    before, after, size, first = scanned(arr)
    row = tk.rows_of(first)
    upto = tk.sums0(size + 1)                                # with the separator before each word
    crcs, rows = [], []
    for n in range(1, max_n + 1):
        at = tk.windows(first, n)
        last = at + n - 1
        crcs.append(after[last] ^ moved(before[at], upto[last + 1] - upto[at] - 1))
        rows.append(row[at])
    return np.concatenate(crcs), np.concatenate(rows), np.diff(first)


def _counted(max_n: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in tk.chunked(batches, "text"):
            total += np.bincount(features(batch.column("text"), max_n)[0] % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table each bucket holds (``buckets`` numbers, whatever its size)."""
    got = (texts.select("text").mapInArrow(_counted(max_n, buckets), "bucket int, n long")
           .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(buckets, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket."""
    b, big_s, big_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (big_s + b)) / float((s + 1) * (big_t + b))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gumbel(doc_id, seed: int) -> int:
    """Noise of a document in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(gain, max_n: int, seed: int):
    def run(batches):
        g = gain.value
        for batch in tk.chunked(batches, "text"):
            crc, row, words = features(batch.column("text"), max_n)
            n_rows = batch.num_rows
            n = np.bincount(row, minlength=n_rows)
            total = np.bincount(row, weights=g[crc % np.uint32(len(g))], minlength=n_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = np.array([gumbel(d, seed) for d in batch.column("doc_id").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight), pa.array(weight + noise)],
                names=["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, max_n, buckets),
                                                          bucket_counts(target, max_n, buckets)))
    scored = stored(docs.select("doc_id", "text").mapInArrow(
        _scored(gain, max_n, seed), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, "
        "weight long, score long"), "scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = global_index(scored.where(able).select("*", (-F.col("score")).alias("_down"),
                                                    F.col("doc_id").isNull().alias("_none")),
                          [], ["_down", "_none", "doc_id"])
    rank = F.when(F.col("_g") < drawn, F.col("_g") + 1)
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    return placed.select(*cols, rank.alias("rank")).unionByName(
        scored.where(~able).select(*cols, F.lit(None).cast("long").alias("rank")))


def op13(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: crc32 is worked out byte by byte, once per distinct word
ORACLE_SQL = f"""
WITH RECURSIVE z(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL
    SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, k + 1 FROM z WHERE k < 8),
tab AS (SELECT list(c::BIGINT ORDER BY i) AS tab FROM z WHERE k = 8),
x AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS (SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM x),
c AS (SELECT side, doc_id, word, count(*) AS n FROM w GROUP BY ALL),
d AS (SELECT word, hex(encode(word)) AS hx FROM (SELECT DISTINCT word FROM c)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(hx) // 2),
             lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)),
             lambda a, v: xor(a >> 8, tab[(xor(a, v) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket
      FROM d, tab),
s AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM c JOIN b USING (word)
      GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (S0 + {BUCKETS}))::DOUBLE
             / ((coalesce(s, 0) + 1) * (T0 + {BUCKETS}))::DOUBLE))::BIGINT AS gain
      FROM s, (SELECT coalesce(sum(s), 0) AS S0, coalesce(sum(t), 0) AS T0 FROM s)),
f AS (SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
      FROM c JOIN b USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN f USING (doc_id)),
q AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS}
             ORDER BY score DESC, doc_id) END AS place,
             count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS able FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * {PERCENT} // 100 THEN place END AS rank FROM r
"""
