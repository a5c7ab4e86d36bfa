"""Quality classifier by co-training of two views.

View 1 reads the text: hashed words, hashed word shapes (what kind of
characters a word starts and ends with) and a few shares (repeats, symbols,
capitals).  View 2 reads the page's metadata: language, source, length and line
layout, as hashed one-of-many features.  Each view is a logistic regression.

Learning takes at most ``LABELLED`` labelled documents, those with the smallest
hashes of their ids (a documented bound; the rows are the same for any
partitioning), a fifth of which is kept for calibration, and all other
documents as they are, unlabelled.  The features of those are packed once into
the shared folder; every pass over them is a Spark job that sends histograms or
gradients, never rows.  A view is first fitted to the labelled documents.  Then,
in each of ``ROUNDS`` rounds,

    either view scores all unlabelled documents into ``BINS`` bins of its margin;
    the bins it is surest of, up to ``SHARE`` times the round's number of the
    documents, in the proportion of the labels, are pseudo-labels for the other;
    ``STEPS`` steps of Adagrad follow, on the mean gradient of the labelled
    documents (in the driver) plus ``PSEUDO`` times the mean gradient of the
    pseudo-labelled ones (summed by Spark).

At the end each view's margin is calibrated on the kept fifth, and the
calibrated log-odds are added with the weights that fit that fifth best.

Toxicity is a second target, learned from the labelled documents: words whose
documents are labelled toxic far more often than others (``LEAST_Z`` standard
deviations) are the features of a logistic regression.  No pseudo-labels are
taken for it: metadata says nothing of it, so a view sure of nothing but the
base rate would teach toxic documents as clean.

Scoring covers every document and whole texts: the weights (a few MB, fixed by
the numbers of hash buckets) are broadcast, features are built in numpy slice
by slice.

Defined results: null and empty texts have no words and are judged by what is
left; documents are good if ``score`` is at least ``THRESHOLD`` and toxic if
``toxic`` is at least 0.5.  ``clean_documents`` rejects the toxic ones too;
``kept`` does with ``reject_toxic``, which the query op4 leaves off: its
``kept`` is the verdict on quality.  Without toxic labels of both kinds
``toxic`` is 0; a document labelled more than once is toxic if one label says so.  Without labels of
both kinds nothing is rejected: score 1 for only good labels or none, else 0.5.
Documents labelled more than once count as good only if all their labels say
so; null labels are no labels.  Rows are scored one by one, so repeated rows
and ids repeat their scores; rows with null doc_id are scored, never learned
from.  Other columns pass through ``clean_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import textstats
from .frames import stored, table

LABELLED = 3000
ROUNDS, SHARE, STEPS, PSEUDO = 3, 0.1, 3, 0.5
#: bins of a margin, over [-REACH, REACH]; what lies beyond is in the outer ones
BINS, REACH = 4096, 16.0
THRESHOLD = 0.5
LEAST_Z, LEAST_DOCS = 5, 3
WORDS, SHAPES, META = 1 << 15, 1 << 10, 1 << 12
SHARES = ("n_symbols", "n_upper", "n_punct", "n_repeat_words", "n_dup_lines", "few")
TEXT = WORDS + SHAPES + len(SHARES) + 1
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[tk.byte_class((0x41, 0x5A))] = 1
_KIND[tk.byte_class((0x61, 0x7A))] = 2
_KIND[tk.byte_class((0x30, 0x39))] = 3
_KIND[tk.byte_class((0x80, 0xFF))] = 4
_PUNCT = np.flatnonzero(tk.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)))
_KIND[_PUNCT] = 5 + np.arange(len(_PUNCT))


def _text_features(arr, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the text view; a family's values add up to at most 1 per row."""
    data, offs = tk.utf8(arr)
    starts, ends, first = tk.spans(data, offs, tk.NOT_SPACE)
    row = tk.rows_of(first)
    n_rows = len(offs) - 1
    weight = 1.0 / np.maximum(np.diff(first), 1)[row]
    word = (tk.span_hash(tk.LOWER[data], starts, ends) % np.uint64(WORDS)).astype(np.int64)
    kind = _KIND[data].astype(np.uint64)
    last = kind[ends - 1] if len(ends) else np.zeros(0, dtype=np.uint64)
    second = kind[np.maximum(ends - 2, starts)] if len(ends) else last
    shape = tk.mix((kind[starts] if len(starts) else last) * np.uint64(4096) + second * np.uint64(64) + last)
    shape = WORDS + (shape % np.uint64(SHAPES)).astype(np.int64)
    chars, words = np.maximum(counts["word_chars"], 1), np.maximum(counts["n_words"], 1)
    base = {"n_symbols": chars, "n_upper": chars, "n_punct": chars, "n_repeat_words": words,
            "n_dup_lines": np.maximum(counts["n_lines"], 1)}
    shares = [counts[c] / base[c] for c in SHARES[:-1]] + [(counts["n_words"] < 10).astype(float)]
    extra = np.stack([*shares, np.ones(n_rows)], axis=1)
    at = np.arange(n_rows)
    return (np.concatenate([row, row, np.repeat(at, extra.shape[1])]),
            np.concatenate([word, shape, np.tile(WORDS + SHAPES + np.arange(extra.shape[1]), n_rows)]),
            np.concatenate([weight, weight, extra.reshape(-1)]))


def _meta_features(batch, counts) -> np.ndarray:
    """Five hashed features per row of the metadata view."""
    lang, source = (batch.column(c).to_pylist() for c in ("lang", "source"))
    size = np.log2(1 + counts["word_chars"]).astype(int)
    lines = np.log2(1 + counts["n_lines"]).astype(int)
    per = np.log2(1 + counts["word_chars"] / np.maximum(counts["n_lines"], 1)).astype(int)
    out = []
    for i in range(len(lang)):
        out += [f"l{lang[i]}", f"s{source[i]}", f"n{size[i]}", f"r{lines[i]}", f"p{per[i]}.{lines[i]}"]
    col = pa.array(out, pa.large_string())
    data, offs = tk.utf8(col)
    return (tk.span_hash(data, offs[:-1], offs[1:]) % np.uint64(META)).astype(np.int64).reshape(-1, 5)


def _words(arr) -> tuple[np.ndarray, np.ndarray]:
    """(row, 31-bit word hash), each word once per row, without case and punctuation."""
    data, offs = tk.utf8(arr)
    data = tk.LOWER[data]
    starts, ends, first = tk.spans(data, offs, tk.ALNUM_LOWER)
    word = (tk.span_hash(data, starts, ends) >> np.uint64(33)).astype(np.int64)
    key = np.unique((tk.rows_of(first) << 31) | word)
    return key >> 31, key & ((1 << 31) - 1)


def _features(batch):
    counts = textstats.counts(batch.column("text"))
    return _text_features(batch.column("text"), counts), _meta_features(batch, counts)


def _collected(batches):
    """One row per document: text features summed per bucket, and metadata buckets."""
    for batch in tk.chunked(batches, "text"):
        (row, feature, value), meta = _features(batch)
        key, at = np.unique(row * TEXT + feature, return_inverse=True)
        total = np.bincount(at, weights=value)
        offs = np.searchsorted(key, np.arange(batch.num_rows + 1) * TEXT)
        lists = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(x)) for x in (
            (key % TEXT).astype(np.int32), total.astype(np.float32))]
        row, word = _words(batch.column("text"))
        lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32()),
                                              pa.array(word.astype(np.int32))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), batch.column("toxic"), *lists,
             pa.FixedSizeListArray.from_arrays(pa.array(meta.reshape(-1).astype(np.int32)), 5).cast(
                 pa.list_(pa.int32()))], names=["doc_id", "quality", "toxic", "feature", "value", "words", "meta"])


def _packed(batches):
    """One row per document: text features as (u2 bucket, u4 count) and 4-byte shares, metadata buckets as u2."""
    width = WORDS + SHAPES
    for batch in tk.chunked(batches, "text"):
        counts = textstats.counts(batch.column("text"))
        (row, feature, value), meta = _text_features(batch.column("text"), counts), _meta_features(batch, counts)
        n = batch.num_rows
        own = feature < width
        key, count = np.unique(row[own] * width + feature[own], return_counts=True)
        offs = np.searchsorted(key, np.arange(n + 1) * width)
        shares = np.column_stack([1.0 / np.maximum(counts["n_words"], 1), value[~own].reshape(n, -1)])

        def blobs(values, ends):
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)),
                                                          pa.py_buffer(np.ascontiguousarray(values))])
        at = np.arange(n + 1)
        yield pa.RecordBatch.from_arrays([
            blobs((key % width).astype("<u2"), offs * 2), blobs(count.astype("<u4"), offs * 4),
            blobs(shares.astype("<f4"), at * 4 * shares.shape[1]), blobs(meta.astype("<u2"), at * 2 * meta.shape[1])],
            names=["feature", "count", "shares", "meta"])


def _blob(arr, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column end to end, and each row's first one."""
    arr = arr.cast(pa.large_binary())
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    size = np.dtype(kind).itemsize
    data = arr.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]].view(kind) if data is not None else np.zeros(0, dtype=kind)
    return flat, (offs - offs[0]) // size


def _unpacked(batch) -> list[Rows]:
    """The two views of packed rows."""
    n = batch.num_rows
    feature, offs = _blob(batch.column("feature"), "<u2")
    count, _ = _blob(batch.column("count"), "<u4")
    shares = _blob(batch.column("shares"), "<f4")[0].reshape(n, -1).astype(float)
    row = np.repeat(np.arange(n), np.diff(offs))
    extra = shares.shape[1] - 1
    text = Rows(offs, feature.astype(np.int64), count * shares[row, 0], TEXT, row)
    text.dense = shares[:, 1:], WORDS + SHAPES, WORDS + SHAPES + extra
    meta, offs = _blob(batch.column("meta"), "<u2")
    return [text, Rows(offs, meta.astype(np.int64), np.ones(len(meta)), META)]


class Rows:
    """Sparse rows, multiplied with a weight vector; ``dense`` columns, if any, stand beside them."""

    def __init__(self, offs, feature, value, width, row=None):
        self.offs, self.feature, self.value, self.width = offs, feature, value, width
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(offs)) if row is None else row
        self.dense = None

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.bincount(self.row, weights=w[self.feature] * self.value, minlength=len(self.offs) - 1)
        return out if self.dense is None else out + self.dense[0] @ w[self.dense[1]:self.dense[2]]

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.bincount(self.feature, weights=g[self.row] * self.value, minlength=self.width).astype(float)
        if self.dense is not None:
            out[self.dense[1]:self.dense[2]] += self.dense[0].T @ g
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Learner:
    """Logistic regression by Adagrad; keeps its state between fits."""

    def __init__(self, x: Rows, y: np.ndarray, weight: np.ndarray, rate: float = 0.5, l2: float = 1e-4):
        self.x, self.y, self.weight, self.rate, self.l2 = x, y, weight / max(weight.sum(), 1e-12), rate, l2
        self.w, self.seen = np.zeros(x.width), np.full(x.width, 1e-8)

    def step(self, other: np.ndarray | float = 0.0) -> None:
        """One step on the gradient of its own rows plus ``other``."""
        g = self.x.back((_sigmoid(self.x.dot(self.w)) - self.y) * self.weight) + other + self.l2 * self.w
        self.seen += g * g
        self.w = self.w - self.rate * g / np.sqrt(self.seen)


def fit(x: Rows, y: np.ndarray, weight: np.ndarray, steps: int = 60, rate: float = 0.5, l2: float = 1e-4):
    """Weights after ``steps`` steps on all rows at once; rows of weight 0 take no part."""
    learner = Learner(x, y, weight, rate, l2)
    for _ in range(steps):
        learner.step()
    return learner.w


def _calibrated(margins: np.ndarray, y: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights (one per column and a constant, none negative but the constant) for the log-odds."""
    x = np.column_stack([margins, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    seen = np.full(len(w), 1e-8)
    for _ in range(steps):
        g = x.T @ (_sigmoid(x @ w) - y) / len(y) + 1e-3 * np.append(w[:-1], 0)
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def bins_of(margin: np.ndarray) -> np.ndarray:
    return np.clip((margin + REACH) * (BINS / (2 * REACH)), 0, BINS - 1).astype(np.int64)


def sure_bins(histogram: np.ndarray, share: float, rate: float) -> tuple[int, int]:
    """(last bin of sure negatives, first bin of sure positives): whole bins from either end, until they
    hold their part of ``share`` of all rows, never beyond the middle."""
    n, half = histogram.sum(), BINS // 2
    low = int(np.searchsorted(np.cumsum(histogram), share * n * (1 - rate)))
    high = int(np.searchsorted(np.cumsum(histogram[::-1]), share * n * rate))
    return min(low, half - 1), max(BINS - 1 - high, half)


def pool_histograms(rows, models) -> np.ndarray:
    """Per view, the rows in each bin of its margin."""
    return np.stack([np.bincount(bins_of(v.dot(m)), minlength=BINS) for v, m in zip(rows, models)])


def pool_gradients(rows, judges, sure, models) -> list[np.ndarray]:
    """Per view: sum of the gradients at ``models`` over the rows that the other view's judge is sure of,
    and, last, their number."""
    out = []
    for me in (0, 1):
        at = bins_of(rows[1 - me].dot(judges[1 - me]))
        label = np.where(at >= sure[1 - me][1], 1.0, 0.0)
        chosen = (at <= sure[1 - me][0]) | (at >= sure[1 - me][1])
        g = np.where(chosen, _sigmoid(rows[me].dot(models[me])) - label, 0.0)
        out.append(np.append(rows[me].back(g), chosen.sum()))
    return out


class Pool:
    """The packed unlabelled documents; every method is one Spark pass that returns sums."""

    def __init__(self, packed: DataFrame):
        self.packed = packed

    def _summed(self, model, work, size: int) -> np.ndarray:
        """``work(model, views)`` of every batch, added up: a vector of ``size``, sent as its non-zero cells."""
        shared = self.packed.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += work(shared.value, _unpacked(batch))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "v"])
        got = self.packed.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(size)
        out[got.column("at").to_numpy()] = got.column("v").to_numpy()
        shared.unpersist()
        return out

    def histograms(self, models) -> np.ndarray:
        return self._summed(models, lambda m, rows: pool_histograms(rows, m).reshape(-1), 2 * BINS).reshape(2, BINS)

    def gradients(self, judges, sure, models) -> list[np.ndarray]:
        sums = self._summed((judges, sure, models), lambda m, rows: np.concatenate(pool_gradients(rows, *m)),
                            TEXT + META + 2)
        return [sums[:TEXT + 1], sums[TEXT + 1:]]


def cotrain(views: list[Rows], label: np.ndarray, calib: np.ndarray, pool, rounds: int = ROUNDS, share: float = SHARE):
    """(weights of each view, weights of the combination); ``pool`` has the unlabelled documents."""
    train = (~calib).astype(float)
    rate = label[~calib].mean()
    learners = [Learner(v, label, train) for v in views]
    for learner in learners:
        for _ in range(60):
            learner.step()
    for r in range(1, rounds + 1):
        judges = [x.w for x in learners]
        histograms = pool.histograms(judges)
        if not histograms.sum():
            break
        sure = [sure_bins(h, share * r, rate) for h in histograms]
        for _ in range(STEPS):
            sums = pool.gradients(judges, sure, [x.w for x in learners])
            for learner, g in zip(learners, sums):
                learner.step(PSEUDO * g[:-1] / max(g[-1], 1.0))
    models = [x.w for x in learners]
    margins = np.column_stack([v.dot(m) for v, m in zip(views, models)])
    return models, _calibrated(margins[calib], label[calib])


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, toxic) of the labelled documents to learn from, at most LABELLED."""
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None)
    marks = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.min((F.col("quality") > 0).cast("int")).alias("quality"),
                  F.max((toxic.cast("double") > 0).cast("int")).alias("toxic")))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().join(marks, "doc_id")
    return stored(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "learned")


def learn(docs: DataFrame, labels: DataFrame):
    """((weights of both views, combination), or a constant where labels are of one kind; toxic words or None)."""
    kind = dict(docs.dtypes)["doc_id"]
    chosen = F.broadcast(_sample(docs, labels))              # bounded by LABELLED rows
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    t = (rows.join(chosen, "doc_id").select("doc_id", "quality", "toxic", "lang", "source", "text").mapInArrow(
        _collected, f"doc_id {kind}, quality int, toxic int, feature array<int>, value array<float>, "
        "words array<int>, meta array<int>")
        .dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().combine_chunks())
    label = t.column("quality").to_numpy(zero_copy_only=False).astype(float)
    if not t.num_rows:
        return 1.0, None
    mark = t.column("toxic").to_numpy(zero_copy_only=False).astype(float)
    others = rows.where("doc_id is not null").join(chosen, "doc_id", "left_anti").select("lang", "source", "text")
    return _learn_quality(t, label, others), learn_toxic(t.column("words").chunk(0), mark)


def packed(docs: DataFrame) -> DataFrame:
    """The features of documents (lang, source, text), written to the shared folder."""
    return stored(docs.mapInArrow(_packed, "feature binary, count binary, shares binary, meta binary"), "packed")


def learn_toxic(words: pa.ListArray, label: np.ndarray):
    """(word hashes, their weights and the constant) by documents with a label (nan: none), or None."""
    offs = words.offsets.to_numpy().astype(np.int64)
    word = words.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(label)), np.diff(offs))
    known = ~np.isnan(label)
    if not known.any() or label[known].min() == label[known].max():
        return None
    word, row = word[known[row]], row[known[row]]
    rate = label[known].mean()
    distinct, at = np.unique(word, return_inverse=True)
    n, k = np.bincount(at), np.bincount(at, weights=label[row])
    chosen = (k >= LEAST_DOCS) & (k - n * rate > LEAST_Z * np.sqrt(n * rate * (1 - rate)))
    if not chosen.any():
        return None
    number = np.where(chosen, np.cumsum(chosen) - 1, -1)[at]
    row, number = row[number >= 0], number[number >= 0]
    size = int(chosen.sum())
    order = np.argsort(np.concatenate([row, np.arange(len(label))]), kind="stable")
    row = np.concatenate([row, np.arange(len(label))])[order]
    number = np.concatenate([number, np.full(len(label), size)])[order]
    x = Rows(np.searchsorted(row, np.arange(len(label) + 1)), number, np.ones(len(number)), size + 1)
    return distinct[chosen], fit(x, np.where(known, label, 0.0), known.astype(float), steps=1000, l2=1e-5)


def _toxic(model, arr) -> np.ndarray:
    if model is None:
        return np.zeros(len(arr))
    row, word = _words(arr)
    at = np.minimum(np.searchsorted(model[0], word), len(model[0]) - 1)
    ok = model[0][at] == word
    return _sigmoid(np.bincount(row[ok], weights=model[1][at[ok]], minlength=len(arr)) + model[1][-1])


def _learn_quality(t: pa.Table, label: np.ndarray, others: DataFrame):
    if label.min() == label.max():
        return 0.5 if not label.max() else 1.0
    col = {c: t.column(c).chunk(0) for c in ("feature", "value", "meta")}
    offs = col["feature"].offsets.to_numpy().astype(np.int64)
    text = Rows(offs - offs[0], col["feature"].flatten().to_numpy(), col["value"].flatten().to_numpy(), TEXT)
    meta = col["meta"].flatten().to_numpy()
    views = [text, Rows(np.arange(len(label) + 1) * 5, meta, np.ones(len(meta)), META)]
    calib = np.zeros(len(label), dtype=bool)
    for kind in (0.0, 1.0):                                  # every fifth of either kind
        calib[np.flatnonzero(label == kind)[::5]] = True
    if any(not ((label == k) & ~calib).any() for k in (0.0, 1.0)):
        calib[:] = True                                      # too few labels to keep any back
        return cotrain_small(views, label, calib)
    return cotrain(views, label, calib, Pool(packed(others)))


def cotrain_small(views, label, known):
    """With a label or two of one kind: both views on all labels, calibrated on the same."""
    models = [fit(v, np.where(known, label, 0.0), known.astype(float)) for v in views]
    margins = np.column_stack([v.dot(m) for v, m in zip(views, models)])
    return models, _calibrated(margins[known], label[known])


def _scored(model, threshold: float, reject_toxic: bool):
    def run(batches):
        m, words = model.value
        for batch in tk.chunked(batches, "text"):
            if isinstance(m, float):
                margins, score = np.zeros((batch.num_rows, 2)), np.full(batch.num_rows, m)
            else:
                (row, feature, value), meta = _features(batch)
                margins = np.column_stack([
                    np.bincount(row, weights=m[0][0][feature] * value, minlength=batch.num_rows),
                    m[0][1][meta].sum(axis=1)])
                score = _sigmoid(margins @ m[1][:-1] + m[1][-1])
            toxic = _toxic(words, batch.column("text"))
            kept = (score >= threshold) & ~((toxic >= 0.5) & reject_toxic)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(kept),
                 *(pa.array(_sigmoid(margins[:, i])) for i in (0, 1)), pa.array(toxic)],
                names=["doc_id", "score", "kept", "text_view", "meta_view", "toxic"])
    return run


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                    reject_toxic: bool = True) -> DataFrame:
    """One row per document: score (0 to 1, calibrated), kept, each view's own opinion, and toxic (0 to 1)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    return rows.mapInArrow(_scored(model, threshold, reject_toxic), f"doc_id {dict(docs.dtypes)['doc_id']}, "
                           "score double, kept boolean, text_view double, meta_view double, toxic double")


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the classifier does not reject."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        judged = _scored(model, threshold, True)
        for batch in tk.chunked(batches, "text"):
            ok = pa.concat_arrays([b.column("kept") for b in judged([batch])])
            yield batch.filter(ok)
    return docs.mapInArrow(run, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), reject_toxic=False)
