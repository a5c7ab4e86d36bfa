"""Substring dedup by relative Lempel-Ziv factors: each document is parsed against indexed blocks of earlier ones.

The corpus itself is the reference.  It is cut into phrases by content, so that
equal passages are cut alike wherever they stand: among the k-word anchors
of a window of ``min_words`` words the one with the smallest hash names the
window, and neighbouring windows with the same anchor form one phrase of up to
2 * min_words - k words.  All phrases with one anchor are one reference block;
together the blocks index every window of every document.

The parse of a document goes through its phrases in order and looks each up in
its block; a match names the earliest document that holds it and the place
there (source, source start):

1. the whole phrase, if an earlier document holds it whole (an exact lookup of
   the phrase in the block);
2. what is left, the first occurrences of a phrase in a block that holds
   several different phrases, is factored window by window, so that a factor
   of ``min_words`` or more words that starts or ends inside a phrase is found
   at its own boundary.

Factors grow greedily: as long as the next match goes on in the same source at
the next place, it is part of the factor; where it does not, a factor ends and
another begins (``factors_of``).  The source is the earliest holder of each match,
not the one with the longest factor, so factors are maximal for their source.
A run of equal windows (one word said over and over) is a factor that stays at
one place of its source (step 0).  A factor has ``min_words`` words at least;
the words between the boundaries of factors are the duplicate spans.  A window of document d is a
duplicate exactly if its words also stand in a document with a smaller id:
every document holding the window cuts it to the same anchor, and the first
of them is also the first with its own phrase, so step 2 always meets it.

Cost: anchors have density 2 / (min_words - k + 2), so a twentieth of the words
is shuffled as 64-bit hashes; anchors of one document alone are dropped before
anything else, whole phrases are reduced by map-side minimums, and only first
occurrences reach step 2.  Hot passages are thereby pre-aggregated: no task
ever gathers the occurrences of one phrase, and skewed joins are split.

Defined results: null or empty text, or fewer than ``min_words`` words: nothing
is removed.  Repeats inside one document alone are kept.  Equal doc_ids count
as one document; rows with one doc_id are told apart by a hash of their text
(``key``), so that each row's spans are its own, and equal rows stay equal.  A row with null doc_id is neither earlier nor later than any
other: kept whole.  An empty table gives an empty result.  Other columns are
ignored.  A window's identity is (anchor hash, window hash), 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import stored

MIN_WORDS = 50
ANCHOR_WORDS = 12


def _anchors(gram: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the smallest gram hash in [i, i + width) for each window start i."""
    val, pos = gram, np.arange(len(gram))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = val[:-step], val[step:]
        later = b < a
        pos = np.where(later, pos[step:], pos[:-step])
        val = np.where(later, b, a)
        reach += step
    return pos[starts]


def _words(arr):
    data, offs = tk.utf8(arr)
    starts, ends, first = tk.spans(data, offs, tk.NOT_SPACE)
    return data, starts, ends, first


def _runs(value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal value within one row."""
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(value)))


def _cut(min_words: int, k: int):
    """Phrases of each document: (doc_id, key, anchor, phrase, start word, windows)."""
    def run(batches):
        for batch in tk.chunked(batches, "text"):
            data, starts, ends, first = _words(batch.column("text"))
            win = tk.windows(first, min_words)
            if not len(win):
                continue
            words = tk.span_hash(data, starts, ends)
            at = np.arange(len(words) - k + 1)
            gram = tk.range_hash(words, at, at + k, 1)
            anchor = _anchors(gram, win, min_words - k + 1)
            rows = tk.rows_of(first)[win]
            # by the anchor's hash, not its place: a word said a thousand times is one phrase
            head, count = _runs(gram[anchor], rows)
            begin = win[head]
            phrase = tk.range_hash(words, begin, begin + count + min_words - 1, 2)
            row = rows[head]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), batch.column("key").take(pa.array(row)),
                pa.array(gram[anchor[head]].view(np.int64)), pa.array(phrase.view(np.int64)),
                pa.array((begin - first[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["doc_id", "key", "anchor", "phrase", "pos", "n"])
    return run


def _split(min_words: int):
    """Windows of the phrases listed in ``todo`` (pos, n, anchor): (doc_id, key, anchor, win, pos, n equal ones)."""
    def run(batches):
        for batch in tk.chunked(batches, "text"):
            todo = batch.column("todo")
            lists = todo.flatten()
            if not len(lists):
                continue
            sizes = np.diff(todo.offsets.to_numpy())
            sizes = np.where(todo.is_null().to_numpy(zero_copy_only=False), 0, sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos, n, anchor = (lists.field(i).to_numpy() for i in range(3))
            data, starts, ends, first = _words(batch.column("text"))
            words = tk.span_hash(data, starts, ends)
            begin = np.repeat(first[row] + pos, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            win = tk.range_hash(words, begin, begin + min_words, 2)
            phrase = np.repeat(np.arange(len(n)), n)
            head, count = _runs(win, phrase)
            phrase, begin = phrase[head], begin[head]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row[phrase])), batch.column("key").take(pa.array(row[phrase])),
                pa.array(anchor[phrase]),
                pa.array(win[head].view(np.int64)), pa.array((begin - first[row[phrase]]).astype(np.int32)),
                pa.array(count.astype(np.int32))], names=["doc_id", "key", "anchor", "win", "pos", "n"])
    return run


def factors_of(row, pos, n, source, at, step):
    """Greedy parse: matched runs of windows, in order, become one factor as long as the source goes on.

    Returns the same six columns, one entry per factor (n: its windows).
    """
    order = np.lexsort((pos, row))
    row, pos, n, source, at, step = (x[order] for x in (row, pos, n, source, at, step))
    new = np.ones(len(row), dtype=bool)
    new[1:] = ((row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + n[:-1]) | (source[1:] != source[:-1])
               | (at[1:] != at[:-1] + n[:-1]) | (step[1:] * step[:-1] == 0))
    head = np.flatnonzero(new)
    return row[head], pos[head], np.add.reduceat(n, head) if len(head) else n, source[head], at[head], step[head]


def _remove(min_words: int, with_text: bool):
    def run(batches):
        for batch in tk.chunked(batches, "text"):
            data, starts, ends, first = _words(batch.column("text"))
            dup = batch.column("dup")
            lists = dup.flatten()
            gone = np.zeros(len(starts), dtype=bool)
            factors = [[] for _ in range(batch.num_rows)]
            if len(lists):
                sizes = np.diff(dup.offsets.to_numpy())
                sizes = np.where(dup.is_null().to_numpy(zero_copy_only=False), 0, sizes)
                row, pos, n, source, at, step = factors_of(
                    np.repeat(np.arange(len(sizes)), sizes), *(lists.field(i).to_numpy().astype(np.int64) for i in range(5)))
                # a factor's words, from its first boundary to its last: at least min_words
                size = n + min_words - 1
                begin = first[row] + pos
                gone = tk.cover(begin, begin + size, len(starts))
                if with_text:
                    for r, *f in zip(*(x.tolist() for x in (row, pos, size, source, at, step))):
                        factors[r].append(dict(zip(("start", "words", "source", "source_start", "step"), f)))
            kept = tk.joined(data, starts, ends, first, ~gone)
            cols = [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(tk.per_row(gone, first)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols += [pa.array([t.decode("utf-8", "replace") for t in kept], pa.string()), pa.array(factors, pa.list_(
                    pa.struct([(c, pa.int64()) for c in ("start", "words", "source", "source_start", "step")])))]
                names += ["kept_text", "factors"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def duplicate_spans(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """Rows (doc_id, key, dup): dup lists (pos, n, source, at, step): n windows from word pos on that the
    earlier document ``source`` holds from its word ``at`` on (step 1), or all at ``at`` (step 0)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").where("doc_id is not null")
    phrases = texts.mapInArrow(
        _cut(min_words, k), "doc_id long, key long, anchor long, phrase long, pos int, n int")
    phrases = stored(phrases, "rlz-phrases")
    # the small side of each join below is written first: only then can Spark split a hot key's side
    shared = stored(phrases.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                    .where("lo < hi").select("anchor"), "rlz-shared")
    block = stored(phrases.join(shared, "anchor", "left_semi"), "rlz-blocks")
    place = F.min(F.struct("doc_id", "pos")).alias("src")
    index = stored(block.groupBy("anchor", "phrase").agg(place), "rlz-firsts")
    several = stored(index.groupBy("anchor").agg(F.min("phrase").alias("a"), F.max("phrase").alias("b"))
                     .where("a <> b").select("anchor", F.lit(True).alias("several")), "rlz-several")
    index = stored(index.join(several, "anchor", "left"), "rlz-index")
    found = block.join(index, ["anchor", "phrase"]).where("src.doc_id < doc_id or several")
    whole = F.col("src.doc_id") < F.col("doc_id")

    def factor(step: int):
        return F.struct("pos", "n", F.col("src.doc_id").alias("source"), F.col("src.pos").alias("at"),
                        F.lit(step).alias("step"))
    # sets: equal rows bring the same spans several times
    found = found.groupBy("doc_id", "key").agg(
        F.collect_set(F.when(whole, factor(1))).alias("dup"),
        F.collect_set(F.when(~whole, F.struct("pos", "n", "anchor"))).alias("todo"))
    found = stored(found, "rlz-factors")
    windows = (texts.join(found.where("size(todo) > 0").select("doc_id", "key", "todo"), ["doc_id", "key"], "left")
               .mapInArrow(_split(min_words), "doc_id long, key long, anchor long, win long, pos int, n int"))
    windows = stored(windows, "rlz-windows")
    earliest = stored(windows.groupBy("anchor", "win").agg(place, F.max("doc_id").alias("hi"))
                      .where("src.doc_id < hi").drop("hi"), "rlz-earliest")
    # a single window goes on like a phrase; a run of equal ones stays at its source
    more = F.when(F.col("n") == 1, factor(1)).otherwise(factor(0))
    partial = (windows.join(earliest, ["anchor", "win"]).where("doc_id > src.doc_id")
               .groupBy("doc_id", "key").agg(F.collect_set(more).alias("more")))
    empty = F.array().cast("array<struct<pos:int,n:int,source:bigint,at:int,step:int>>")
    return (found.select("doc_id", "key", "dup").join(partial, ["doc_id", "key"], "full")
            .select("doc_id", "key", F.concat(F.coalesce("dup", empty), F.coalesce("more", empty)).alias("dup")))


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS,
                    with_text: bool = False) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256 (and kept_text, factors)."""
    dup = duplicate_spans(docs, min_words, k)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return (docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(dup, ["doc_id", "key"], "left")
            .mapInArrow(_remove(min_words, with_text), schema + (
                ", kept_text string, factors array<struct<start:long,words:long,source:long,source_start:long,"
                "step:long>>" if with_text else "")))


def op1(spark, sf_dir: str) -> DataFrame:
    from .frames import table
    return substring_dedup(table(spark, sf_dir, "documents"))
