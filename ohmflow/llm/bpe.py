"""Byte-level BPE encoding and decoding over a minimal acyclic transducer lexicon.

1. Spark counts the pre-tokens of all documents; the ``LEXICON`` most frequent
   are merged once on the driver and compiled into a minimal acyclic automaton
   over their bytes: words share prefixes and suffixes, and the numbers on the
   path of a word add up to its place in the table of outputs (its token ids).
2. The compiled lexicon, a few MB bounded by ``LEXICON``, is written to the shared
   checkpoint folder and given to all executors as a Spark file; tasks
   memory-map it, so all workers of a node share its pages.
3. Pre-tokens are found for a slice of rows at once from runs of code point
   kinds (numpy); its distinct pre-tokens walk through the automaton together,
   one byte of each per step.  Words outside the
   lexicon are merged exactly by their ranks, in a heap for long ones.  A
   bounded pool keeps the ids of words met before; ids are laid out per text.
4. Decoding lays the bytes of the ids end to end and reads them as UTF-8.

The result is the tokenizers library's for a byte-level BPE without
normalizer, dropout, prefix space or post-processor (others are refused):
added tokens are split off the text first, then the pattern's pre-tokens.

Defined results: null is empty; an empty text has no tokens and the hash of
no bytes; rows are judged one by one, so repeated rows and ids repeat their
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from . import textkit as tk
from .frames import stored, table

LEXICON = 200_000
MEMO = 1_000_000
# the pre-token pattern of byte-level BPE that ``pretokens`` implements:
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+


def _byte_chars() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable Latin-1 as it is, others from 256 up."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = (model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
                 and not model.get("byte_fallback") and spec["normalizer"] is None and spec["post_processor"] is None
                 and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
                 and spec["decoder"]["type"] == "ByteLevel"
                 and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
        if not plain:
            raise ValueError("only plain byte-level BPE files are supported")
        chars = _byte_chars()
        ids = model["vocab"]
        self.single = [0] * 256
        for c, b in chars.items():
            self.single[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # pair of ids -> rank and new id, each packed into one number
        self.merges = {ids[a] << 32 | ids[b]: rank << 32 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.added_bytes = tuple(self.added)
        size = max([*ids.values(), *self.added.values()]) + 1
        text: list[bytes] = [b""] * size
        for token, i in ids.items():
            text[i] = bytes(chars[c] for c in token)
        for token, i in self.added.items():
            text[i] = token
        self.text = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.text_at = tk.sums0(np.array([len(t) for t in text], dtype=np.int64))

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-token: the pair of lowest rank first, the leftmost of equal ones."""
        if len(word) > 64:
            return self._merge_long(word)
        get, none = self.merges.get, 1 << 62
        ids = [self.single[b] for b in word]
        rank = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while rank and (best := min(rank)) != none:
            i = rank.index(best)
            ids[i:i + 2] = [best & 0xFFFFFFFF]
            del rank[i]
            if i:
                rank[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(rank):
                rank[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap of pairs, so that the work stays n log n."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i, j):
            if (m := self.merges.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[j]))
        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue                                     # one of the two has been merged since
            ids[i], alive[j], after[i] = m & 0xFFFFFFFF, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [t for t, ok in zip(ids, alive) if ok]


def compile_lexicon(words: dict[bytes, list[int]]) -> np.ndarray:
    """The automaton as one int64 array: a header of sizes, then its parts.

    Words are added in order; a state whose subtree is complete is replaced by
    an equal one that is already there, so equal suffixes are stored once.
    """
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []            # of finished states: (byte, state)
    final: list[bool] = []
    reach: list[int] = []                                    # words below a finished state

    def finish(node) -> int:
        key = (node[0], tuple(node[1]))
        got = register.get(key)
        if got is None:
            got = register[key] = len(edges)
            edges.append(key[1])
            final.append(key[0])
            reach.append(int(key[0]) + sum(reach[t] for _, t in key[1]))
        return got

    path: list[list] = [[False, []]]                         # unfinished states of the last word
    last = b""
    for word in sorted(words):
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for i in range(len(last), same, -1):
            path[i - 1][1].append((last[i - 1], finish(path.pop())))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        path[i - 1][1].append((last[i - 1], finish(path.pop())))
    root = finish(path[0])

    key, to, add = [], [], []
    for state, out in enumerate(edges):
        passed = int(final[state])
        for byte, target in out:
            key.append(state << 8 | byte)
            to.append(target)
            add.append(passed)
            passed += reach[target]
    ids = [words[w] for w in sorted(words)]
    at = tk.sums0(np.array([len(x) for x in ids], dtype=np.int64))
    flat = [i for x in ids for i in x]
    return np.concatenate([np.array(x, dtype=np.int64) for x in (
        [root, len(key), len(final), len(ids), len(flat)], key, to, add, final, at, flat)])


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, data: np.ndarray):
        self.root, e, s, w, t = (int(x) for x in data[:5])
        parts = np.split(data[5:], np.cumsum([e, e, e, s, w + 1]))
        self.key, self.to, self.add, self.final, self.at, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the table of outputs, -1 if the lexicon lacks it."""
        n = len(words)
        out = np.full(n, -1, dtype=np.int64)
        if not n or not len(self.key):
            return out
        size = np.array([len(w) for w in words], dtype=np.int64)
        begin = tk.sums0(size)
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        state, total, live = np.full(n, self.root), np.zeros(n, dtype=np.int64), np.arange(n)
        for step in range(int(size.max()) + 1):
            done = live[size[live] == step]
            ok = done[self.final[state[done]] > 0]
            out[ok] = total[ok]
            live = live[size[live] > step]
            if not len(live):
                break
            want = state[live] << 8 | data[begin[live] + step]
            edge = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[edge] == want
            live, edge = live[hit], edge[hit]
            state[live] = self.to[edge]
            total[live] += self.add[edge]
        return out


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(np.memmap(SparkFiles.get(name), dtype=np.int64, mode="r"))


BLANK, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of every code point, as the pre-token pattern tells them apart."""
    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "!" for i in range(0x110000))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            out[m.start():m.end()] = kind
    return out


def pretokens(arr, added: tuple[bytes, ...]):
    """Bytes of all rows, byte starts and ends of their pre-tokens in order, and each row's first one.

    The pattern's alternatives, read over the runs of one kind of code point:
    a run of letters, numbers or others is a token and takes in one plain space
    before it; of a run of blanks before something else all but the last
    character is a token, and the last one too unless it is that space; a
    lone apostrophe that no space precedes takes the letters of a contraction
    from the run behind it.  Added tokens cut the text before any of this.
    """
    data, offs = tk.utf8(arr)
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:                               # rows of broken bytes, as Arrow's strings allow
        rows = [raw[i:j].decode("utf-8", "replace") for i, j in zip(offs[:-1], offs[1:])]
        return pretokens(pa.array(rows, pa.large_string()), added)
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    lead = np.append(np.flatnonzero(tk.LEAD[data]), len(data))            # byte place of every code point
    row_at = np.searchsorted(lead, offs)
    if not len(cp):
        none = np.zeros(0, dtype=np.int64)
        return data, none, none, np.zeros(len(offs), dtype=np.int64)
    cuts, special = [row_at[:-1]], []
    if added:
        for m in _added_finder(added)(raw):
            if np.searchsorted(offs, m.start(), "right") == np.searchsorted(offs, m.end(), "left"):
                special.append((int(np.searchsorted(lead, m.start())), int(np.searchsorted(lead, m.end()))))
        cuts += [np.array(special, dtype=np.int64).reshape(-1)]
    cut = np.zeros(len(cp) + 1, dtype=bool)                  # a text, or what an added token leaves of it, begins
    cut[np.concatenate(cuts)] = True
    cut[-1] = True
    kind = _kinds()[cp]
    new = cut[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    end = np.append(run[1:], len(cp))
    k, size = kind[run], end - run
    solid = k != BLANK
    space = np.zeros(len(cp) + 1, dtype=bool)                # this code point follows a plain space in its text
    space[1:] = cp == 0x20
    space[:-1] &= ~cut[:-1]
    start = np.zeros(len(cp), dtype=bool)
    start[run[solid] - space[run[solid]]] = True
    blank, blank_end, blank_size = run[~solid], end[~solid], size[~solid]
    last = cut[blank_end]                                    # nothing behind it
    start[blank[last]] = True
    some = ~last & (blank_size > 1)
    start[blank[some]] = True
    start[blank_end[~last] - 1] = True                       # the last blank: a token, or the start of the next one
    quote = (k == OTHER) & (size == 1) & (cp[run] == 0x27) & ~space[run] & ~cut[end]
    quote[:-1] &= k[1:] == LETTER
    quote[-1:] = False
    q = run[quote]
    if len(q):
        one, room = cp[q + 1], size[1:][quote[:-1]]
        two = np.where(room > 1, cp[np.minimum(q + 2, len(cp) - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        n = np.where(single, 1, np.where(double, 2, 0))
        hit = n > 0
        start[q[hit] + 1] = False
        more = hit & (room > n)
        start[q[more] + 1 + n[more]] = True
    for a, b in special:
        start[a + 1:b] = False
    first = np.flatnonzero(start)
    return data, lead[first], lead[np.append(first[1:], len(cp))], np.searchsorted(first, row_at)


@lru_cache(maxsize=2)
def _added_finder(added: tuple[bytes, ...]):
    """Finds added tokens in bytes, the longest at a place."""
    return re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))).finditer


class Seen:
    """Numbers for 64-bit hashes in the order of their arrival, kept as two sorted arrays:
    all and the latest, which join the others now and then."""

    def __init__(self):
        self.n = 0
        self.parts = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)) for _ in range(2)]

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Number of each of the distinct ascending ``keys``; new ones get the next numbers, in their order."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for have, code in self.parts:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                out = np.where(have[at] == keys, code[at], out)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.n + np.arange(len(new))
            self.n += len(new)
            self.parts[1] = self._joined(self.parts[1], (keys[new], out[new]))
            if len(self.parts[1][0]) > 1 << 16:
                self.parts = [self._joined(*self.parts), (self.parts[1][0][:0], self.parts[1][1][:0])]
        return out

    @staticmethod
    def _joined(a, b):
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")              # two sorted runs: one merge
        return keys[order], np.concatenate([a[1], b[1]])[order]


def _distinct(data, starts, ends, seen: Seen):
    """(number of each pre-token, those that are new) with pre-tokens told apart by 64-bit hashes."""
    keys, at, inverse = np.unique(tk.span_hash(data, starts, ends), return_index=True, return_inverse=True)
    before = seen.n
    number = seen.number(keys)
    new = at[number >= before]
    raw = data.tobytes()
    return number[inverse], [raw[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist())]


def _count(added: tuple[bytes, ...], most: int = 500_000):
    """(word, n), sent whenever ``most`` words have been seen and at the end."""
    def emit(words, counts):
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts)], names=["word", "n"])

    def run(batches):
        seen, words, counts = Seen(), [], np.zeros(0, dtype=np.int64)
        for batch in tk.chunked(batches, "text"):
            data, starts, ends, _ = pretokens(batch.column("text"), added)
            code, new = _distinct(data, starts, ends, seen)
            words += new
            now = np.bincount(code, minlength=seen.n)
            now[:len(counts)] += counts
            counts = now
            if seen.n >= most:
                yield emit(words, counts)
                seen, words, counts = Seen(), [], np.zeros(0, dtype=np.int64)
        if words:
            yield emit(words, counts)
    return run


def frequent_words(docs: DataFrame, vocab: Vocabulary, size: int = LEXICON) -> dict[bytes, list[int]]:
    """The most frequent pre-tokens, at most ``size``, with their ids.

    Counts fall into bins of equal ratio; the rarest bin that still fits sets
    the bound, so that only the chosen words leave the executors.
    """
    ratio = F.floor(F.log2("n") * 16).cast("int")
    words = stored(docs.select("text").where("text is not null")
                   .mapInArrow(_count(vocab.added_bytes), "word binary, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")).where(F.octet_length("word") <= 64)
                   .withColumn("bin", ratio), "bpe-words")
    least, total = None, 0
    for r in words.groupBy("bin").count().orderBy(F.desc("bin")).collect():        # some hundred bins
        total += r["count"]
        if total > size:
            break
        least = r.bin
    if least is None:
        return {}
    chosen = [bytes(r.word) for r in words.where(F.col("bin") >= least).select("word").collect()]
    return {w: vocab.merge(w) for w in chosen if w not in vocab.added_bytes}


def publish(spark, lexicon: np.ndarray) -> str:
    """Give the compiled lexicon to all executors; returns its file name."""
    sc = spark.sparkContext
    path = scratch_path(spark, "lexicon")
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = jpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(jpath)
    out.write(lexicon.tobytes())
    out.close()
    sc.addFile(path)
    return path.rsplit("/", 1)[1]


class Encoder:
    """Encodes slices of texts with a lexicon and, beyond it, exact merges.

    Ids of the words met so far stay in one pool, which starts anew after
    ``MEMO`` words.
    """

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon):
        self.vocab, self.lexicon = vocab, lexicon
        self._reset()

    def _reset(self):
        self.seen = Seen()
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _learn(self, words: list[bytes]):
        """Append the ids of new words to the pool."""
        place = self.lexicon.find(words)
        known = place >= 0
        size = np.zeros(len(words), dtype=np.int64)
        at = self.lexicon.at[place[known]]
        size[known] = self.lexicon.at[place[known] + 1] - at
        added, merge = self.vocab.added, self.vocab.merge
        other = np.flatnonzero(~known)
        merged = [[added[w]] if w in added else merge(w) for w in (words[i] for i in other.tolist())]
        size[other] = list(map(len, merged))
        ends = self.used + tk.sums0(size)
        if ends[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), int(ends[-1])), dtype=np.uint32)])
        for where, values in ((known, self.lexicon.ids), (~known, np.array(list(chain.from_iterable(merged)),
                                                                          dtype=np.int64))):
            n = size[where]
            k = np.arange(n.sum()) - np.repeat(tk.sums0(n)[:-1], n)
            source = np.repeat(at, n) + k if where is known else np.arange(len(values))
            self.pool[np.repeat(ends[:-1][where], n) + k] = values[source]
        self.used = int(ends[-1])
        self.start, self.size = np.concatenate([self.start, ends[:-1]]), np.concatenate([self.size, size])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column end to end, and row offsets."""
        if self.seen.n > MEMO:
            self._reset()
        data, starts, ends, first = pretokens(texts, self.vocab.added_bytes)
        code, new = _distinct(data, starts, ends, self.seen)
        if new:
            self._learn(new)
        n = self.size[code]
        at = tk.sums0(n)
        ids = self.pool[np.repeat(self.start[code] - at[:-1], n) + np.arange(at[-1])]
        return ids.astype("<u4"), at[first]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        at, text = self.vocab.text_at, self.vocab.text
        begin, n = at[ids], at[ids.astype(np.int64) + 1] - at[ids]
        ends = tk.sums0(n)
        flat = text[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cut = ends[offs]
        return [flat[cut[i]:cut[i + 1]].decode("utf-8", "replace") for i in range(len(offs) - 1)]


_encoders: dict[str, Encoder] = {}


def _encoder(vocab, name: str) -> Encoder:
    """The worker's encoder for a lexicon; its memo serves later tasks too."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocab.value, _mapped(name))
    return _encoders[name]


def _encode(vocab, name: str, with_ids: bool):
    def run(batches):
        encoder = _encoder(vocab, name)
        for batch in tk.chunked(batches, "text"):
            ids, offs = encoder.encode(batch.column("text"))
            sha = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(offs[:-1], offs[1:])]
            back = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in encoder.decode(ids, offs)]
            cols = [batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(sha, pa.string()),
                    pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, lexicon: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256 (and ids)."""
    spark = docs.sparkSession
    vocab = Vocabulary(path or default_path())
    name = publish(spark, compile_lexicon(frequent_words(docs, vocab, lexicon)))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    # bounded by the tokenizer file
    return docs.select("doc_id", "text").mapInArrow(
        _encode(spark.sparkContext.broadcast(vocab), name, with_ids), schema + (", ids array<int>" if with_ids else ""))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from rows (doc_id, ids); null ids give null text."""
    vocab = tokens.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))

    def run(batches):
        encoder = Encoder(vocab.value, Lexicon(compile_lexicon({})))
        for batch in batches:
            lists = batch.column("ids")
            size = np.array([0 if x is None else len(x) for x in lists.to_pylist()], dtype=np.int64)
            texts = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tk.sums0(size))
            ok = lists.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(
                [t if v else None for t, v in zip(texts, ok)], pa.string())], names=["doc_id", "text"])
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(tokens.dtypes)['doc_id']}, text string")


def op6(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
