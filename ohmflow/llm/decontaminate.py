"""Benchmark decontamination with training suffix arrays.

Every task builds suffix arrays over its own documents, one per slice of at
most ``textkit.CHUNK_BYTES`` of text, and binary-searches the test suffixes that
start a window in them; equal neighbours in the array are all locations of that
suffix.  The documents are neither shuffled nor collected: the index of the
benchmark moves.

The array is sparse and of bounded depth: it holds the suffixes whose first
``window`` words may start a test window (a bitmap of window hashes says so), and
is sorted by these words.  Likewise only the test suffixes whose hash the slice
has are searched, each distinct one once, so a slice costs its own length and
its matches, not the size of the benchmark.  Matches of consecutive windows at
consecutive places of one item unite to the longest verbatim match.

Spark indexes the benchmark: items of equal words become one text (a partial
aggregate, so one text may make up any part of the items), texts are put into
blocks by their words, at most ``BLOCK_BYTES`` of index each (a longer text is a
block of its own), and each block is broadcast to one pass over the documents.
A benchmark beyond one block goes through a chain of such passes, each adding
its matches.  Which items a text stands for is joined after the search, once
per distinct set of matched texts.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none,
is one window.  Items with the same words are searched once and all reported
(texts are told apart by 64 bits of hash, as words are).

Defined results: null and empty texts have no words and no hits; an empty
benchmark hits nothing; items with null id hit words but name no item; extra
columns are ignored by ``report`` and passed through by ``clean_documents``.
Every row is judged by itself, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import stored, table

WINDOW = 10
BLOCK_BYTES = 64 << 20
#: bytes of index for one word of a test text
WORD_BYTES = 48
_SPANS = "__match_spans"
_TEXTS = "__match_texts"
_LONGEST = "__match_longest"


def _words(arr):
    data, offs = tk.utf8(arr)
    data = tk.LOWER[data]
    starts, ends, first = tk.spans(data, offs, tk.ALNUM_LOWER)
    return tk.span_hash(data, starts, ends), first


def _keys(words: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` words of each suffix as fixed-width bytes."""
    rows = words[begin[:, None] + np.arange(n)].astype(">u8")
    return np.ascontiguousarray(rows).view(f"V{8 * n}").reshape(-1)


class Group:
    """The distinct windows of one length: sorted hashes, a place of each, all places and all texts of each."""

    def __init__(self, words: np.ndarray, at: np.ndarray, text: np.ndarray, n: int):
        self.n = n
        h = tk.range_hash(words, at, at + n, 3)
        order = np.lexsort((at, h))
        h, at, text = h[order], at[order], text[order]
        self.hash, head = np.unique(h, return_index=True)
        self.places, self.first_place = at, np.append(head, len(h))
        most = int(text.max()) + 1
        pair = np.unique(np.repeat(np.arange(len(self.hash)), np.diff(self.first_place)) * most + text)
        self.texts, self.first_text = pair % most, np.searchsorted(pair, np.arange(len(self.hash) + 1) * most)
        bits = max(16, int(16 * len(self.hash)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
        low = self.hash & self.mask
        np.bitwise_or.at(self.bitmap, low >> np.uint64(3), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        low = h & self.mask
        return (self.bitmap[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


class TestIndex:
    """Windows of one block of texts, given as arrays of word hashes with a key each."""

    def __init__(self, texts: list[tuple[int, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.keys = np.array([k for k, _ in texts], dtype=np.int64)
        # a gap behind each text, so that no place follows another text's
        gap = np.zeros(1, dtype=np.uint64)
        self.words = np.concatenate([gap, *[x for _, w in texts for x in (w, gap)]])
        size = np.array([len(w) for _, w in texts], dtype=np.int64)
        first = tk.sums0(size + 1)[:-1] + 1
        self.groups = []
        for n in sorted({*np.minimum(size, window).tolist()} - {0}):
            own = np.flatnonzero(np.minimum(size, window) == n)
            begin = [np.arange(first[i], first[i] + size[i] - n + 1) for i in own]
            self.groups.append(Group(self.words, np.concatenate(begin), np.repeat(own, [len(b) for b in begin]), n))

    def search(self, words: np.ndarray, first: np.ndarray):
        """All occurrences, each once: (start word, number of its group, its distinct window)."""
        out = []
        for g, group in enumerate(self.groups):
            begin = tk.windows(first, group.n)
            if not len(begin):
                continue
            h = tk.range_hash(words, begin, begin + group.n, 3)
            may = group.maybe(h)
            begin, h = begin[may], h[may]
            # the test suffixes that this slice can hold
            known = np.unique(h)
            at = np.minimum(np.searchsorted(group.hash, known), len(group.hash) - 1)
            asked = at[group.hash[at] == known]
            if not len(asked):
                continue
            # the slice's suffix array, and the test suffixes binary-searched in it
            suffix = _keys(words, begin, group.n)
            order = np.argsort(suffix, kind="stable")
            suffix, begin = suffix[order], begin[order]
            keys = _keys(self.words, group.places[group.first_place[asked]], group.n)
            lo, hi = _bounds(suffix, keys)
            hit = np.repeat(np.arange(len(asked)), hi - lo)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            out.append((begin[lo[hit] + nth], np.full(len(hit), g), asked[hit]))
        if not out:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out))


def _bounds(suffix: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each key in the sorted array, and the place behind its last."""
    # void values sort and compare byte by byte, but cannot be searched: compare their ranks
    values, rank = np.unique(np.concatenate([suffix, keys]), return_inverse=True)
    mine, theirs = rank[:len(suffix)], rank[len(suffix):]
    return np.searchsorted(mine, theirs, "left"), np.searchsorted(mine, theirs, "right")


def _longest(index: TestIndex, start, group, window, row, n_rows) -> np.ndarray:
    """Words of the longest verbatim match per row: windows at consecutive words that also stand at
    consecutive places of the benchmark.  Holds one window's places at a time."""
    out = np.zeros(n_rows, dtype=np.int64)
    order = np.lexsort((start, group))
    before, size, active = (-1, -1, -1), 0, None
    for i in order.tolist():
        g = index.groups[group[i]]
        u = window[i]
        places = g.places[g.first_place[u]:g.first_place[u + 1]]
        if before == (row[i], group[i], start[i] - 1):
            going = (places if len(places) == 1 and len(active) == 1 and places[0] == active[0] + 1
                     else np.intersect1d(places, active + 1, assume_unique=True))
            size, active = (size + 1, going) if len(going) else (g.n, places)
        else:
            size, active = g.n, places
        before = (row[i], group[i], start[i])
        out[row[i]] = max(out[row[i]], size)
    return out


def _pass(index, last: str | None):
    """One block of the benchmark over all rows; ``last`` is None, 'report' or 'filter'."""
    def run(batches):
        block: TestIndex = index.value
        for batch in tk.chunked(batches, "text"):
            words, first = _words(batch.column("text"))
            n_rows = batch.num_rows
            start, group, window = block.search(words, first)
            row = np.searchsorted(first, start, side="right") - 1
            length = np.array([g.n for g in block.groups], dtype=np.int64)[group] if len(start) else start
            longest = _longest(block, start, group, window, row, n_rows)
            texts: list[set] = [set() for _ in range(n_rows)]
            for r, g, u in set(zip(row.tolist(), group.tolist(), window.tolist())):
                found = block.groups[g]
                texts[r].update(block.keys[found.texts[found.first_text[u]:found.first_text[u + 1]]].tolist())
            if _SPANS in batch.schema.names:
                old = batch.column(_SPANS)
                lists = old.flatten().to_numpy().reshape(-1, 2)
                of = np.repeat(np.arange(n_rows), np.diff(old.offsets.to_numpy()) // 2)
                start = np.concatenate([start, first[of] + lists[:, 0]])
                length = np.concatenate([length, lists[:, 1]])
                row = np.concatenate([row, of])
                longest = np.maximum(longest, batch.column(_LONGEST).to_numpy())
                for mine, prev in zip(texts, batch.column(_TEXTS).to_pylist()):
                    mine.update(prev)
            hit = tk.cover(start, start + length, len(words))
            n_hit = tk.per_row(hit, first)
            found = pa.array([sorted(x) for x in texts], pa.list_(pa.int64()))
            if last == "filter":
                kept = batch.filter(pa.array(n_hit == 0))
                yield kept.select([c for c in kept.schema.names if c not in (_SPANS, _TEXTS, _LONGEST)])
            elif last == "report":
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(np.diff(first)), pa.array(n_hit), found, pa.array(n_hit > 0),
                    pa.array(longest)], names=["doc_id", "n_words", "n_hit", "texts", "contaminated", "longest_match"])
            else:
                # spans hand over as the runs of words that are hit
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                cut = np.zeros(len(hit) + 1, dtype=bool)
                cut[first] = True
                inner = np.flatnonzero(cut[1:-1] & hit[1:] & hit[:-1]) + 1 if len(hit) else np.zeros(0, dtype=np.int64)
                begin = np.sort(np.concatenate([np.flatnonzero(edge > 0), inner]))
                end = np.sort(np.concatenate([np.flatnonzero(edge < 0), inner]))
                at = np.searchsorted(first, begin, side="right") - 1
                flat = np.stack([begin - first[at], end - begin], axis=1).reshape(-1)
                offs = tk.sums0(np.bincount(at, minlength=n_rows) * 2)
                state = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int64())),
                         found, pa.array(longest)]
                rest = [c for c in batch.schema.names if c not in (_SPANS, _TEXTS, _LONGEST)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + state,
                                                 names=rest + [_SPANS, _TEXTS, _LONGEST])
    return run


def _item_texts(batches):
    """(item, key of its words, its words' hashes, their number); items without a word are left out."""
    for batch in tk.chunked(batches, "text"):
        words, first = _words(batch.column("text"))
        key = tk.range_hash(words, first[:-1], first[1:], 5).view(np.int64) if len(words) else np.zeros(
            batch.num_rows, dtype=np.int64)
        blobs = [words[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        out = pa.RecordBatch.from_arrays([batch.column("item"), pa.array(key), pa.array(blobs, pa.binary()),
                                          pa.array(np.diff(first))], names=["item", "key", "words", "n"])
        yield out.filter(pa.array(np.diff(first) > 0))


def _texts(benchmark: DataFrame) -> DataFrame:
    """(item, key, words, n) of the items, stored."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    return stored(items.mapInArrow(_item_texts, "item string, key long, words binary, n long"), "items")


def _blocks(texts: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The distinct texts in blocks of at most ``block_bytes`` of index (one longer text is a block)."""
    distinct = stored(texts.groupBy("key").agg(F.first("words").alias("words"), F.max("n").alias("n")), "texts")
    total = distinct.agg(F.sum("n")).collect()[0][0] or 0
    most = max(1, block_bytes // WORD_BYTES)
    # parts far smaller than a block, measured, then put together in order
    parts = F.pmod(F.col("key"), F.lit(max(1, math.ceil(16 * total / most))))
    blocks: list[list[int]] = []
    held = most + 1
    for part, n in sorted(map(tuple, distinct.groupBy(parts.alias("p")).agg(F.sum("n")).collect())):
        if held + n > most:
            blocks.append([])
            held = 0
        blocks[-1].append(part)
        held += n
    return [distinct.where((parts >= b[0]) & (parts <= b[-1])) for b in blocks]


def _searched(docs: DataFrame, texts: DataFrame, window: int, last: str, schema: str, block_bytes: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(texts, block_bytes) or [None]
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for i, block in enumerate(blocks):
        # one block of the index: bounded by block_bytes
        rows = block.select("key", "words").orderBy("key").collect() if block is not None else []
        index = sc.broadcast(TestIndex([(r.key, np.frombuffer(r.words, dtype=np.uint64)) for r in rows], window))
        end = i == len(blocks) - 1
        docs = docs.mapInArrow(_pass(index, last if end else None), schema if end else
                               f"{carried}, {_SPANS} array<long>, {_TEXTS} array<long>, {_LONGEST} long")
    return docs


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    texts = _texts(benchmark)
    kind = dict(docs.dtypes)["doc_id"]
    found = stored(_searched(docs.select("doc_id", "text"), texts, window, "report",
                             f"doc_id {kind}, n_words long, n_hit long, texts array<long>, contaminated boolean, "
                             "longest_match long", block_bytes), "matches")
    # items depend on the set of texts alone: looked up once per distinct set
    sets = found.where(F.size("texts") > 0).select("texts").distinct()
    ids = texts.where("item is not null").select("key", "item").distinct()
    items = (sets.select("texts", F.explode("texts").alias("key")).join(ids, "key").groupBy("texts")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    items = stored(items.select("texts", F.size("items").cast("long").alias("n_items"),
                                F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")), "item-sets")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.join(items, "texts", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), "contaminated", "longest_match")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, without those that hold a window."""
    return _searched(docs, _texts(benchmark), window, "filter",
                     ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), block_bytes)


def op8(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
