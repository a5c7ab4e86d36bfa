"""Toxicity scores by a weighted finite-state pattern grammar.

Words become symbols, clauses become symbol strings, and one automaton reads
every clause.  It is composed (product of states, ``compose``) from five small
transducers over the same symbols:

    insult     passes an insult on with its weight
    threat     an act of harm after an intent or beside a target
    target     a person within ``REACH`` words before, or right after, the word it belongs to
    negation   a negator within ``REACH`` words before
    report     a verb of saying anywhere in the clause (its end weight)

So a word counts by its clause: ``you are an idiot`` more than ``idiot``, ``not an
idiot`` and ``she called him an idiot`` less (``TARGETED``, ``NEGATED``, ``REPORTED``).  A
clause ends at ``. ! ? ;``, a line end or the text's end.

The insult arcs are learned: of the labelled documents, words and word stems
(first ``STEMS`` characters) that are found in toxic ones more often than chance
by ``LEAST_Z`` standard deviations; at most ``LEXICON`` of them, the surest.  Their
weights and the document's constant are those of a logistic regression on the
clause scores, each arc's sum over a document's clauses damped by log(1 + x).
Closed word classes (targets, negators, ...) are the fixed lists below.

Learning takes at most ``LABELLED`` labelled documents (those with the smallest
hashes of their ids; a documented bound, the same rows for any partitioning)
whose crc32(doc_id as text) mod 5 is not 0; arcs are counted per task and added
up by Spark.  Scoring reads all documents, whole texts, in numpy, slice by
slice, without a shuffle; the broadcast model has at most ``LEXICON`` arcs.

Defined results: null and empty texts have no clauses and get the constant's
score; without labels of both kinds every score is the share of toxic labels (0
without any); a document labelled more than once is toxic if one label says
so; null labels are no labels.  Rows with null doc_id are scored, never learned
from and not held out.  Repeated rows are scored one by one; other columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .frames import stored, table

LABELLED, LEXICON = 12_000, 4096
LEAST_Z, LEAST_DOCS = 3, 3
STEMS = (4, 5, 6, 7, 8, 9, 10)
REACH = 3
TARGETED, NEGATED, REPORTED = 1.25, 0.25, 0.5
#: weight of a threat: labelled examples are too few to learn it from
THREAT = 3.0
THRESHOLD = 0.5

# closed word classes of four languages (fixed values)
HARMS = ("kill hurt destroy beat smash stab shoot burn punish töten schlagen verletzen zerstören tuer frapper blesser "
         "détruire matar golpear herir destruir").split()
INTENTS = "will shall gonna must werde werden vais allons voy vamos".split()
TARGETS = ("you your yours u he she they him her them people du dich dir ihr euch tu te toi vous vos ils elles tú ti "
           "usted ustedes vosotros ellos ellas").split()
NEGATORS = ("not no never nor isn aren wasn don doesn won cannot nicht kein keine nie niemals pas jamais aucun nunca "
            "jamás tampoco").split()
SAYINGS = ("said says say told tells wrote writes called quoted quote alleged reported sagte sagt schrieb zitiert dit "
           "disait écrit cité dijo dice escribió citó").split()

OTHER, INSULT, HARM, INTENT, TARGET, NEGATOR, SAYING = range(7)
SYMBOLS = 7
_CLASSES = ((HARM, HARMS), (INTENT, INTENTS), (TARGET, TARGETS), (NEGATOR, NEGATORS), (SAYING, SAYINGS))
_ENDS = tk.byte_class((0x2E, 0x2E), (0x21, 0x21), (0x3F, 0x3F), (0x3B, 0x3B), (0x0A, 0x0A))

# what the composed automaton says of a symbol (bits)
IS_INSULT, IS_HARM, HAS_TARGET, HAS_NEGATOR, HAS_INTENT, LATE_TARGET = 1, 2, 4, 8, 16, 32


class Transducer:
    """next[state, symbol] and out[state, symbol] (bits); end[state] is the weight of a clause that ends there."""

    def __init__(self, step: np.ndarray, out: np.ndarray, end: np.ndarray):
        self.step, self.out, self.end = step, out, end


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both read the same symbols: product of the states reached, outputs united, end weights multiplied."""
    pairs, todo = {(0, 0): 0}, [(0, 0)]
    step, out = [], []
    for s, t in todo:
        row = []
        for x in range(SYMBOLS):
            to = int(a.step[s, x]), int(b.step[t, x])
            if to not in pairs:
                pairs[to] = len(pairs)
                todo.append(to)
            row.append(pairs[to])
        step.append(row)
        out.append(a.out[s] | b.out[t])
    return Transducer(np.array(step), np.array(out), np.array([a.end[s] * b.end[t] for s, t in todo]))


def _within(symbol: int, bit: int, on: tuple[int, ...]) -> Transducer:
    """State: words left in which ``symbol`` is near; ``bit`` is said of the symbols ``on`` while it is."""
    step = np.tile(np.maximum(np.arange(REACH + 1) - 1, 0)[:, None], (1, SYMBOLS))
    step[:, symbol] = REACH
    out = np.zeros((REACH + 1, SYMBOLS), dtype=np.int64)
    out[1:, list(on)] = bit
    return Transducer(step, out, np.ones(REACH + 1))


@lru_cache(maxsize=1)
def grammar() -> Transducer:
    """The composed automaton."""
    hit = (INSULT, HARM)
    one = np.zeros((1, SYMBOLS), dtype=np.int64)
    words = one.copy()
    words[0, INSULT], words[0, HARM] = IS_INSULT, IS_HARM
    after = np.zeros((2, SYMBOLS), dtype=np.int64)           # a target right after such a word
    after[:, list(hit)] = 1
    late = np.zeros((2, SYMBOLS), dtype=np.int64)
    late[1, TARGET] = LATE_TARGET
    said = np.array([[0] * SYMBOLS, [1] * SYMBOLS])
    said[0, SAYING] = 1
    parts = [Transducer(one, words, np.ones(1)), _within(TARGET, HAS_TARGET, hit), _within(NEGATOR, HAS_NEGATOR, hit),
             _within(INTENT, HAS_INTENT, (HARM,)), Transducer(after, late, np.ones(2)),
             Transducer(said, np.zeros((2, SYMBOLS), dtype=np.int64), np.array([1.0, REPORTED]))]
    whole = parts[0]
    for p in parts[1:]:
        whole = compose(whole, p)
    return whole


def _hash(words: list[str]) -> np.ndarray:
    data, offs = tk.utf8(pa.array(words, pa.large_string()))
    return tk.span_hash(data, offs[:-1], offs[1:])


@lru_cache(maxsize=1)
def _closed() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the closed classes' words in order, and their symbols."""
    h = np.concatenate([_hash(words) for _, words in _CLASSES])
    s = np.concatenate([np.full(len(words), symbol) for symbol, words in _CLASSES])
    order = np.argsort(h)
    return h[order], s[order]


def _lookup(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in the ordered table, -1 where it is not there."""
    if not len(table_) or not len(keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return np.where(table_[at] == keys, at, -1)


class Words:
    """The words of a slice: hashes, clause numbers, and keys of their stems."""

    def __init__(self, arr):
        data, offs = tk.utf8(arr)
        data = tk.LOWER[data]
        self.data = data
        self.starts, self.ends, self.first = tk.spans(data, offs, tk.ALNUM_LOWER)
        self.row = tk.rows_of(self.first)
        self.hash = tk.span_hash(data, self.starts, self.ends)
        ends = tk.sums0(_ENDS[data].astype(np.int64))
        new = np.ones(len(self.starts), dtype=bool)
        if len(new):
            new[1:] = (self.row[1:] != self.row[:-1]) | (ends[self.starts[1:]] != ends[self.ends[:-1]])
        self.clause = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)
        self.lead = np.flatnonzero(tk.LEAD[data])

    def keys(self):
        """(word, key) of every word and of every stem as long as the word or shorter."""
        at = np.arange(len(self.starts))
        yield at, self.hash
        begin = np.searchsorted(self.lead, self.starts)
        chars = np.searchsorted(self.lead, self.ends) - begin
        stop = np.append(self.lead, len(self.data))
        for n in STEMS:
            own = np.flatnonzero(chars >= n)
            end = np.where(chars[own] == n, self.ends[own], stop[begin[own] + n])
            yield own, tk.mix(tk.span_hash(self.data, self.starts[own], end) + np.uint64(n))


def read_clauses(words: Words, lexicon: np.ndarray):
    """Arcs taken in the matched clauses: (word, arc of the lexicon or len(lexicon) for a threat, factor).

    All clauses with an insult or an act of harm are read in step, a symbol of
    each at a time; words out of reach of any symbol are left out, since the
    automaton's counters are at rest there.
    """
    word, arc = [], []
    symbol = np.zeros(len(words.starts), dtype=np.int64)
    closed, kind = _closed()
    at = _lookup(closed, words.hash)
    symbol[at >= 0] = kind[at[at >= 0]]
    for own, key in words.keys():
        found = _lookup(lexicon, key)
        word.append(own[found >= 0])
        arc.append(found[found >= 0])
    word, arc = np.concatenate(word), np.concatenate(arc)
    symbol[word[symbol[word] != HARM]] = INSULT
    n_clauses = len(words.heads)
    active = np.zeros(n_clauses, dtype=bool)
    active[words.clause[(symbol == INSULT) | (symbol == HARM)]] = True
    near = symbol != OTHER
    for _ in range(REACH):                                   # words within reach after a symbol
        near[1:] |= near[:-1] & (words.clause[1:] == words.clause[:-1])
    pos = np.flatnonzero(near & active[words.clause]) if n_clauses else np.zeros(0, dtype=np.int64)
    said = np.zeros(len(symbol), dtype=np.int64)
    end = np.ones(max(n_clauses, 1))
    if len(pos):
        g = grammar()
        own = words.clause[pos]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(heads, len(pos)))
        order = np.argsort(-size, kind="stable")
        heads, size = heads[order], size[order]
        state = np.zeros(len(heads), dtype=np.int64)
        going = len(heads)
        for j in range(int(size[0])):
            going = int(np.searchsorted(-size, -j, side="left"))      # clauses with more than j symbols
            p = pos[heads[:going] + j]
            said[p] = g.out[state[:going], symbol[p]]
            state[:going] = g.step[state[:going], symbol[p]]
        end[own[heads]] = g.end[state]
    late = np.zeros(len(symbol), dtype=bool)
    late[:-1] = (said[1:] & LATE_TARGET) > 0
    aimed = late | ((said & HAS_TARGET) > 0)
    factor = (np.where(aimed, TARGETED, 1.0) * np.where(said & HAS_NEGATOR, NEGATED, 1.0)
              * end[words.clause] if len(symbol) else np.zeros(0))
    threat = np.flatnonzero(((said & IS_HARM) > 0) & (aimed | ((said & HAS_INTENT) > 0)))
    word, arc = np.concatenate([word, threat]), np.concatenate([arc, np.full(len(threat), len(lexicon))])
    return word, arc, factor[word]


def _features(words: Words, lexicon: np.ndarray):
    """(row, arc, damped sum of its factors over the row's clauses)."""
    word, arc, factor = read_clauses(words, lexicon)
    width = len(lexicon) + 1
    key, at = np.unique(words.row[word] * width + arc, return_inverse=True)
    return key // width, key % width, np.log1p(np.bincount(at, weights=factor, minlength=len(key)))


def held_out() -> Column:
    """True for the fifth of the documents that is not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``most`` labelled documents, none of them held out."""
    marks = (labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id")
             .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    chosen = (docs.select("doc_id").where("doc_id is not null").distinct().join(marks, "doc_id")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    # at most ``most`` rows of two numbers; a repeated doc_id is learned with the text that sorts first
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return stored(rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")), "labelled")


def _counted(batches):
    """Per task: in how many of its documents each key is found, and in how many toxic ones."""
    total: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in tk.chunked(batches, "text"):
        words = Words(batch.column("text"))
        toxic = batch.column("toxic").to_numpy().astype(np.int64)
        row = np.concatenate([words.row[own] for own, _ in words.keys()])
        key, code = np.unique(np.concatenate([k for _, k in words.keys()]), return_inverse=True)
        once = np.unique(row * (len(key) + 1) + code)
        row, code = once // (len(key) + 1), once % (len(key) + 1)
        total.append((key, np.bincount(code, minlength=len(key)),
                      np.bincount(code, weights=toxic[row], minlength=len(key)).astype(np.int64)))
        if len(total) == 16:
            total = [_added(total)]
    if total:
        key, n, k = _added(total)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(k)],
                                         names=["key", "n", "k"])


def _added(parts):
    key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return (key, *(np.bincount(at, weights=np.concatenate([p[i] for p in parts])).astype(np.int64) for i in (1, 2)))


def _extracted(lexicon):
    def run(batches):
        for batch in tk.chunked(batches, "text"):
            words = Words(batch.column("text"))
            row, arc, value = _features(words, lexicon.value)
            offs = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"),
                pa.array(np.diff(words.first)), pa.ListArray.from_arrays(offs, pa.array(arc.astype(np.int32))),
                pa.ListArray.from_arrays(offs, pa.array(value))],
                names=["doc_id", "toxic", "n_words", "arcs", "sums"])
    return run


def fit(row, arc, value, n_words, y, width, steps: int = 1500, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights of the arcs (none negative), of log(1 + words) and the constant, by Adagrad on all rows."""
    w, seen = np.zeros(width + 2), np.full(width + 2, 1e-8)
    size = np.log1p(n_words)
    for _ in range(steps):
        z = np.bincount(row, weights=w[arc] * value, minlength=len(y)) + w[-2] * size + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.concatenate([np.bincount(arc, weights=d[row] * value, minlength=width), [d @ size, d.sum()]]) + l2 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
        w[:width] = np.maximum(w[:width], 0)
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED):
    """(lexicon, weights), or the share of toxic labels where they are all of one kind."""
    sample = _sample(docs, labels, most)
    n_docs, n_toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).collect()[0]
    if not n_docs or n_toxic in (0, n_docs):
        return float(n_toxic / n_docs) if n_docs else 0.0
    share = n_toxic / n_docs
    n, k = F.col("n"), F.col("k")
    z = (k - n * share) / F.sqrt(n * share * (1 - share))
    # at most LEXICON rows
    top = (sample.select("toxic", "text").mapInArrow(_counted, "key long, n long, k long").groupBy("key")
           .agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where((k >= LEAST_DOCS) & (z > LEAST_Z))
           .orderBy(z.desc(), "key").limit(LEXICON).select("key").toArrow())
    lexicon = np.sort(top.column("key").to_numpy().view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = dict(docs.dtypes)["doc_id"]
    # at most LABELLED rows
    t = (sample.select("doc_id", "toxic", "text").mapInArrow(
        _extracted(shared), f"doc_id {kind}, toxic int, n_words long, arcs array<int>, sums array<double>")
        .orderBy("doc_id").toArrow().combine_chunks())
    arcs, sums = (t.column(c).chunk(0) for c in ("arcs", "sums"))
    row = np.repeat(np.arange(t.num_rows), np.diff(arcs.offsets.to_numpy()))
    arc, value = arcs.flatten().to_numpy().astype(np.int64), sums.flatten().to_numpy()
    own = arc < len(lexicon)                                 # threats have their own weight
    w = fit(row[own], arc[own], value[own], t.column("n_words").to_numpy(),
            t.column("toxic").to_numpy().astype(float), len(lexicon))
    return lexicon, np.insert(w, len(lexicon), THREAT)


def _scored(model):
    def run(batches):
        for batch in tk.chunked(batches, "text"):
            if isinstance(model.value, float):
                score = np.full(batch.num_rows, model.value)
            else:
                lexicon, w = model.value
                words = Words(batch.column("text"))
                row, arc, value = _features(words, lexicon)
                z = np.bincount(row, weights=w[arc] * value, minlength=batch.num_rows).astype(float)
                z += w[-2] * np.log1p(np.diff(words.first)) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                 pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return run


def score_documents(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1: toxic)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, most))
    return (docs.select("doc_id", held_out().alias("held_out"), "text")
            .mapInArrow(_scored(model), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, "
                                        "predicted int"))


def _matched(model):
    def run(batches):
        lexicon, w = model.value
        for batch in tk.chunked(batches, "text"):
            words = Words(batch.column("text"))
            word, arc, factor = read_clauses(words, lexicon)
            clause, at = np.unique(words.clause[word], return_inverse=True)
            weight = np.bincount(at, weights=w[arc] * factor, minlength=len(clause))
            head = words.heads[clause]
            last = np.append(words.heads, len(words.starts))[clause + 1] - 1
            row = words.row[head] if len(head) else head
            flat = words.data.tobytes()
            text = [flat[words.starts[a]:words.ends[b]] for a, b in zip(head, last)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(head - words.first[row]),
                 pa.array(last + 1 - words.first[row]), pa.array(weight),
                 pa.array(text, pa.binary()).cast(pa.string(), safe=False)],
                names=["doc_id", "first_word", "end_word", "weight", "clause"])
    return run


def matched_clauses(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """The clauses that add to a score: doc_id, first_word, end_word, weight, clause (A-Z lower-cased)."""
    model = learn(docs, labels, most)
    if isinstance(model, float):
        model = np.zeros(0, dtype=np.uint64), np.array([THREAT, 0.0, 0.0])
    return docs.select("doc_id", "text").mapInArrow(
        _matched(docs.sparkSession.sparkContext.broadcast(model)),
        f"doc_id {dict(docs.dtypes)['doc_id']}, first_word long, end_word long, weight double, clause string")


def op12(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
