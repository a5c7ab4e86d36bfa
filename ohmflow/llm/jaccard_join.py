"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document is the set of its shingles (``shingle`` consecutive words; fewer
words than that are one shingle together).  Documents with equal sets are
copies: one of them, the smallest doc_id, stands for all.

1. Each representative gets ``BANDS * ROWS`` MinHash values; representatives
   that agree in all values of a band share a bucket.  At similarity 0.8 a pair
   shares no bucket with probability (1 - 0.8 ** 4) ** 32 = 5e-8.  Every pair
   that shares a bucket is judged once, in its first common band.
2. Bayesian pruning: a pair's MinHash values are compared 16 at a time; with a
   uniform prior the similarity's posterior after m matches of n is
   Beta(m + 1, n - m + 1), and the pair is dropped as soon as
   P(similarity >= threshold) falls below ``tolerance``.
3. What is left is verified exactly on the shingle sets.
4. Buckets of up to ``SMALL`` members, nearly all of them, are written out as
   pairs.  Larger ones are examined in pairs of blocks of bounded size: a task
   prunes, then verifies all pairs of two blocks (members with a partner only),
   and reports the number of links of each member and links that connect the
   members that are linked.  So every link is counted, and no task or table
   ever holds all pairs of a group.
5. Links give components.

Result, one row per document: class_id (smallest doc_id that links reach),
n_links (all links of the document's text to different texts; copies count
once, by their representative), n_copies (documents with its very shingles).

Defined results: text without a word (null, empty): a class of its own, no
links, one copy.  Rows with equal doc_ids are one node of the components; if
their texts differ, links are counted per text and the largest number is given.
Rows with null doc_id come back with null class_id.  Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import components, stored, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-6
#: a block of a bucket has so many members, or so many bytes of shingles, on average
BLOCK, BLOCK_BYTES = 512, 16 << 20
SMALL = 8

_SEEDS = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(arr, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, end to end, and row offsets."""
    data, offs = tk.utf8(arr)
    starts, ends, first = tk.spans(data, offs, tk.NOT_SPACE)
    words = tk.span_hash(data, starts, ends)
    begin = tk.windows(first, n)
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    begin = np.concatenate([begin, first[few]])
    size = np.concatenate([np.full(len(begin) - len(few), n), np.diff(first)[few]])
    value = tk.range_hash(words, begin, begin + size, 3)
    row = tk.rows_of(first)[begin]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(offs)))


def _packed(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [
        None, pa.py_buffer((offs * values.itemsize).astype(np.int64).tobytes()),
        pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _set_hash(value: np.ndarray, offs: np.ndarray, has: np.ndarray, c: int) -> np.ndarray:
    """Hash of each of the (non-empty) sets ``has``, whatever their order."""
    total = np.add.reduceat(tk.mix(value + np.uint64(c)), offs[has])
    return tk.mix(total + np.diff(offs)[has].astype(np.uint64)).view(np.int64)


def _signatures(n: int):
    def run(batches):
        for batch in tk.chunked(batches, "text"):
            value, offs = shingle_sets(batch.column("text"), n)
            has = np.flatnonzero(np.diff(offs))
            if not len(has):
                continue
            at = offs[has]
            sig = np.empty((len(has), len(_SEEDS)), dtype=np.uint32)
            for k, seed in enumerate(_SEEDS):
                sig[:, k] = np.minimum.reduceat(value * seed, at) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(has)),
                *(pa.array(_set_hash(value, offs, has, c)) for c in (1, 2)),
                _packed(sig.reshape(-1), np.arange(len(has) + 1) * len(_SEEDS)), pa.array(8 * np.diff(offs)[has])],
                names=["doc_id", "set_a", "set_b", "sig", "bytes"])
    return run


def _sets(n: int):
    """Shingle sets of the texts whose set hash is the ``key`` beside them (a repeated doc_id meets all its keys)."""
    def run(batches):
        for batch in tk.chunked(batches, "text"):
            value, offs = shingle_sets(batch.column("text"), n)
            has = np.flatnonzero(np.diff(offs))
            if not len(has):
                continue
            own = np.zeros(batch.num_rows, dtype=bool)
            own[has] = _set_hash(value, offs, has, 1) == batch.column("key").to_numpy()[has]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key", "sig")), _packed(value, offs)],
                names=["doc_id", "key", "sig", "shingles"]).filter(pa.array(own))
    return run


def least_matches(threshold: float, tolerance: float, values: int = BANDS * ROWS, step: int = STEP) -> list[int]:
    """For n = step, 2 step, ...: fewest matches m with P(J >= threshold | m of n) >= tolerance."""
    x = (np.arange(200_000) + 0.5) / 200_000
    lx, ly, high = np.log(x), np.log1p(-x), x >= threshold
    out = []
    for n in range(step, values + 1, step):
        lo, hi = 0, n
        while lo < hi:
            m = (lo + hi) // 2
            log = m * lx + (n - m) * ly
            p = np.exp(log - log.max())
            if p[high].sum() / p.sum() >= tolerance:
                hi = m
            else:
                lo = m + 1
        out.append(lo)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the row pairs (a[i], b[i]) of signatures that no comparison step drops."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for i, m in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        ok = matches >= m
        alive, matches = alive[ok], matches[ok]
    return alive


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.uint32).reshape(len(col), BANDS * ROWS)


def similar(a: bytes, b: bytes, threshold: float) -> bool:
    """Whether two ascending sets of hashes reach the threshold (exact)."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < threshold * len(y) - 1e-9:
        return False
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return same >= threshold * (len(x) + len(y) - same) - 1e-9


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pair of signatures, the bands in which they agree."""
    return (a == b).reshape(len(a), -1, ROWS).all(axis=2)


def _prune(least: list[int]):
    """Pairs in their first common band that pruning leaves; ``band`` is the first among small buckets."""
    def run(batches):
        for batch in batches:
            a, b = (_matrix(batch.column(c).to_pylist()) for c in ("sig_a", "sig_b"))
            shared, band = _shared(a, b), batch.column("band").to_numpy()
            here = np.flatnonzero(shared.any(axis=1) & (shared.argmax(axis=1) == band))
            here = here[survivors(a[here], b[here], least)]
            yield batch.select(["a", "key_a", "b", "key_b"]).take(pa.array(here))
    return run


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            ok = [similar(x.as_py(), y.as_py(), threshold)
                  for x, y in zip(batch.column("sh_a"), batch.column("sh_b"))]
            yield batch.select(["a", "key_a", "b", "key_b"]).filter(pa.array(ok, pa.bool_()))
    return run


def _cross(pdf: pd.DataFrame, sig: np.ndarray, least: list[int]):
    """Per member of the lower block, the members of the other that pruning leaves.

    A pair that shares several buckets is left to the first of its bands.
    """
    doc, half, band = pdf["doc_id"].to_numpy(), pdf["blk"].to_numpy(), int(pdf["band"].iloc[0])
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    right = np.flatnonzero(half == hi)
    upto = (band + 1) * ROWS
    for i in np.flatnonzero(half == lo):
        others = right[(doc[right] != doc[i]) & ((lo != hi) | (right > i))]
        if len(others):
            shared = _shared(sig[others, :upto], np.broadcast_to(sig[i, :upto], (len(others), upto)))
            others = others[shared[:, band] & ~shared[:, :band].any(axis=1)]
            others = others[survivors(np.broadcast_to(sig[i], (len(others), sig.shape[1])), sig[others], least)]
            if len(others):
                yield i, others


_MEMBER = ["band", "bucket", "lo", "hi", "blk", "doc_id", "key"]


def _candidates(least: list[int]):
    """Members of a pair of blocks with a partner that pruning leaves."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "key"])
        keep = np.zeros(len(pdf), dtype=bool)
        for i, others in _cross(pdf, _matrix(pdf["sig"]), least):
            keep[i] = True
            keep[others] = True
        return pdf.loc[keep, _MEMBER]
    return run


def _block(least: list[int], threshold: float):
    """All links of a pair of blocks, as numbers and as a connecting part.

    Rows (a, key, a, n): the text has n links here; rows (a, key, b, 0): a link, as many as connect what is linked.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "key"])
        doc, key = pdf["doc_id"].to_numpy(), pdf["key"].to_numpy()
        size = pdf["shingles"].str.len().to_numpy() // 8
        value, number = np.unique(np.frombuffer(b"".join(pdf["shingles"]), dtype=np.uint64), return_inverse=True)
        offs = tk.sums0(size)
        row = np.repeat(np.arange(len(pdf)), size)
        mine = np.zeros(len(value), dtype=bool)
        label, degree, out = np.arange(len(pdf)), np.zeros(len(pdf), dtype=np.int64), []
        for i, others in _cross(pdf, _matrix(pdf["sig"]), least):
            own = number[offs[i]:offs[i + 1]]
            mine[own] = True
            if 8 * len(others) < len(pdf):
                same = np.array([mine[number[offs[j]:offs[j + 1]]].sum() for j in others])
            else:
                same = np.bincount(row[mine[number]], minlength=len(pdf))[others]
            mine[own] = False
            linked = others[same >= threshold * (size[i] + size[others] - same) - 1e-9]
            if len(linked):
                degree[i] += len(linked)
                degree[linked] += 1
                labels, at = np.unique(label[linked], return_index=True)
                out += [(doc[i], key[i], doc[j], 0) for j, c in zip(linked[at], labels) if c != label[i]]
                label[np.isin(label, labels)] = label[i]
        out += [(doc[i], key[i], doc[i], degree[i]) for i in np.flatnonzero(degree)]
        return pd.DataFrame(out, columns=["a", "key", "b", "n"]).astype("int64")
    return run


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE,
                  tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, rep, key, n_copies), (degrees: rep, key, n_links), (components: node, comp)."""
    least = least_matches(threshold, tolerance)
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    sigs = stored(texts.mapInArrow(_signatures(n), "doc_id long, set_a long, set_b long, sig binary, bytes long"), "jac-sig")
    copies = stored(sigs.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"),
                                                       F.count_distinct("doc_id").alias("n_copies")), "jac-copies")
    members = stored(sigs.select("doc_id", "set_a", "set_b").join(copies, ["set_a", "set_b"])
                     .select("doc_id", "rep", F.col("set_a").alias("key"), "n_copies"), "jac-members")
    # a text of a document is known by its set's hash, which need only differ inside the document
    reps = (sigs.select("doc_id", F.col("set_a").alias("key"), "sig", "bytes")
            .join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
            .dropDuplicates(["doc_id", "key"]))
    width = 4 * ROWS
    buckets = reps.select("doc_id", "key", "bytes", F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, i * {width} + 1, {width})))"))
        .alias("band", "bucket"))
    # written first: only then can Spark split the members of a hot bucket in the join
    sizes = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"))
                   .where("m > 1"), "jac-sizes")
    full = stored(buckets.drop("bytes").join(sizes, "bucket"), "jac-buckets")
    nodes = full.select("doc_id", "key").distinct()
    # the text and the signature of every document that shares a bucket, as its shingle set
    sets = stored(texts.join(reps.drop("bytes").join(nodes, ["doc_id", "key"], "left_semi"), "doc_id")
                  .mapInArrow(_sets(n), "doc_id long, key long, sig binary, shingles binary"), "jac-sets")

    pairs = (full.where(f"m <= {SMALL}").groupBy("band", "bucket")
             .agg(F.array_sort(F.collect_list(F.struct("doc_id", "key"))).alias("l"))
             .select("band", F.explode(F.expr(
                 "flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x, y))))"))
                 .alias("p"))
             .select("band", F.col("p.x.doc_id").alias("a"), F.col("p.x.key").alias("key_a"),
                     F.col("p.y.doc_id").alias("b"), F.col("p.y.key").alias("key_b"))
             .where("a <> b").groupBy("a", "key_a", "b", "key_b").agg(F.min("band").alias("band")))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("key").alias(f"key_{side}"),
                                       F.col("sig").alias(f"sig_{side}")), [side, f"key_{side}"])
    ends = "a long, key_a long, b long, key_b long"
    left = stored(pairs.mapInArrow(_prune(least), ends), "jac-pairs")
    for side in ("a", "b"):
        left = left.join(sets.select(F.col("doc_id").alias(side), F.col("key").alias(f"key_{side}"),
                                     F.col("shingles").alias(f"sh_{side}")), [side, f"key_{side}"])
    links = stored(left.mapInArrow(_verify(threshold), ends).distinct(), "jac-links")

    block = (full.where(f"m > {SMALL}").withColumn("blocks", F.ceil(F.greatest(
        F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int"))
             .withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
             .withColumns({"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")}).select(*_MEMBER))
    some = stored(block.join(sets.select("doc_id", "key", "sig"), ["doc_id", "key"]).groupBy("bucket", "lo", "hi")
                  .applyInPandas(_candidates(least), block.schema), "jac-some")
    more = stored(some.join(sets, ["doc_id", "key"]).groupBy("bucket", "lo", "hi")
                  .applyInPandas(_block(least, threshold), "a long, key long, b long, n long"), "jac-more")
    one = F.lit(1).cast("long").alias("n")
    degrees = (links.selectExpr("a as rep", "key_a as key").unionByName(links.selectExpr("b as rep", "key_b as key"))
               .select("rep", "key", one)
               .unionByName(more.where("n > 0").select(F.col("a").alias("rep"), "key", "n"))
               .groupBy("rep", "key").agg(F.sum("n").alias("n_links")))
    joined = links.select("a", "b").unionByName(more.where("n = 0").select("a", "b")).distinct()
    return members, degrees, components(joined)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies."""
    members, degrees, comps = jaccard_links(docs, threshold, n, tolerance)
    found = (members.distinct().join(comps.withColumnRenamed("node", "rep"), "rep", "left")
             .join(degrees, ["rep", "key"], "left")
             .groupBy("doc_id").agg(F.min(F.coalesce("comp", "rep")).alias("class_id"),
                                    F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"),
                                    F.max("n_copies").alias("n_copies")))
    return (docs.select("doc_id").join(found, "doc_id", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the smallest doc_id of each class (and those without id)."""
    classes = jaccard_join(docs, threshold).where("class_id < doc_id").select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti").select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
