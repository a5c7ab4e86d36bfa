"""Fill-in-middle, toxicity grammar and importance resampling against brute force and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ohmflow.llm import fill_middle, importance, queries, toxicity
from ohmflow.llm.frames import importable

from test_operators import SCHEMA, SF, odd_rows, tuples

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ["n", "form", "output", "restored", "bucket", "score", "rank", "_g", "toxic", "held_out", "arcs", "key", "k", "_n"]
TRICKY = ["<P>", "a<S>b", "x <M", "<", "S>", "<P", "a<" * 40, "P>S>M>" * 9, "\U0001F600é" * 30, "A" * 70_000 + " b"]


def more_rows():
    rows = odd_rows()
    return rows + [(100 + i, t, None, None, None) for i, t in enumerate(TRICKY * 4)]


@pytest.fixture(scope="module")
def odd(spark):
    importable(spark)
    return spark.createDataFrame(more_rows(), SCHEMA).select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(spark):
    importable(spark)
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ---- op11

def by_hand_11(rows):
    out = []
    for d, t in rows:
        t = t or ""
        u = UNIT.findall(t)
        h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
        h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            out.append((d, len(u), "plain", None, None, t))
            continue
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        form = "spm" if h[3] % 100 < 20 else "psm"
        out.append((d, len(u), form, len(p), len(m),
                    f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"))
    return sorted(out, key=repr)


def test_op11_matches_brute_force_and_restores(spark, odd, none):
    rows = [r[:2] for r in more_rows()]
    got = fill_middle.restore(fill_middle.transform(odd))
    assert tuples(got.drop("restored")) == by_hand_11(rows)
    assert sorted(r.restored for r in got.collect()) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(none)).collect() == []


def test_op11_query(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = dict(documents(spark))
    want = [(*r[:5], sha(r[5]), sha(texts[r[0]] or "")) for r in by_hand_11(documents(spark))]
    assert tuples(queries.QUERIES["op11_fill_middle"](spark, SF)) == sorted(want, key=repr)


@given(st.binary(max_size=300), st.integers(0, 300), st.integers(0, 300), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_op11_rotation(data, x, y, swap):
    a, b = sorted((min(x, len(data)), min(y, len(data))))
    buffer, was = bytearray(data), fill_middle.SWAP
    fill_middle.SWAP = swap                                  # several blocks from either end
    try:
        fill_middle.rotate(buffer, a, b, len(data))
    finally:
        fill_middle.SWAP = was
    assert bytes(buffer) == data[:a] + data[b:] + data[a:b]


# ---- op13

def by_hand_13(docs, target, max_n=1, buckets=10_000, least=20, percent=10):
    def features(t):
        w = WORD.findall((t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets
                        for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    s = collections.Counter(b for _, t in docs for b in features(t)[1])
    t = collections.Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for d, x in docs:
        n_words, f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    out = [(*r, i) for i, r in enumerate(drawn, 1)] + [(*r, None) for r in able[len(drawn):]]
    return sorted(out + [(*r, None) for r in rows if r[1] < least], key=repr)


@pytest.mark.parametrize("max_n,buckets,percent", [(1, 10_000, 10), (3, 97, 50)])
def test_op13_matches_brute_force(spark, max_n, buckets, percent):
    importable(spark)
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.resample(spark.read.parquet(f"{SF}/documents.parquet"), target, max_n, buckets, percent=percent)
    assert tuples(got) == by_hand_13(documents(spark), [r.text for r in target.collect()], max_n, buckets, percent=percent)


def test_op13_odd_and_empty(spark, odd, none):
    target = spark.createDataFrame([(None, "one two three"), ("a", None), ("b", "")], "item_id string, text string")
    rows = [r[:2] for r in more_rows()]
    got = tuples(importance.resample(odd, target, 2, 50, least_words=3, percent=60))
    want = by_hand_13(rows, ["one two three", None, ""], 2, 50, 3, 60)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    # equal rows may change places
    assert sorted(((r[0], r[4], r[5]) for r in got if r[5]), key=lambda r: r[2]) == sorted(
        ((r[0], r[4], r[5]) for r in want if r[5]), key=lambda r: r[2])
    assert importance.resample(none, target).collect() == []
    assert importance.resample(odd, target.where("false")).count() == len(rows)


def test_op13_one_row_over_and_over(spark):
    """Many copies of one row spread over the ranges and are drawn one by one."""
    importable(spark)
    df = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.repeat(F.lit("word "), 30).alias("text"))
    got = importance.resample(df, df.limit(1)).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 401)) and len(got) == 4000


@given(st.lists(st.text(alphabet="aé日z", min_size=1, max_size=9), min_size=1, max_size=12), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_op13_checksums(words, n):
    crc, row, _ = importance.features(pa.array([" ".join(words), None, words[0]]), n)
    want = [zlib.crc32(" ".join(w[i:i + k]).encode()) for k in range(1, n + 1) for w in (words, words[:1])
            for i in range(len(w) - k + 1)]
    assert crc.tolist() == want


# ---- op12

def by_hand_12(text, lexicon, w):
    """The score's log-odds, word by word and clause by clause."""
    words = toxicity.Words(pa.array([text]))
    place = {int(h): i for i, h in enumerate(lexicon)}
    arcs = collections.defaultdict(list)
    for own, key in words.keys():
        for i, k in zip(own, key):
            if int(k) in place:
                arcs[int(i)].append(place[int(k)])
    texts = WORD.findall((text or "").translate(LOWER))
    cut, at = [], 0
    low = (text or "").translate(LOWER)
    for x in texts:
        here = low.index(x, at)
        cut.append(bool(re.search(r"[.!?;\n]", low[at:here])) or not cut)
        at = here + len(x)
    clauses, sums = [], collections.defaultdict(float)
    for i, new in enumerate(cut):
        if new:
            clauses.append([])
        clauses[-1].append(i)
    for c in clauses:
        kind = {}
        for i in c:
            own = [s for s, group in toxicity._CLASSES if texts[i] in group]
            kind[i] = own[0] if own else toxicity.OTHER
            if arcs.get(i) and kind[i] != toxicity.HARM:
                kind[i] = toxicity.INSULT
        said = any(k == toxicity.SAYING for k in kind.values())
        for i in c:
            if kind[i] not in (toxicity.INSULT, toxicity.HARM):
                continue
            near = [kind.get(j) for j in range(i - toxicity.REACH, i)]
            aimed = toxicity.TARGET in near or kind.get(i + 1) == toxicity.TARGET
            f = (toxicity.TARGETED if aimed else 1) * (toxicity.NEGATED if toxicity.NEGATOR in near else 1)
            f *= toxicity.REPORTED if said else 1
            for a in arcs.get(i, []):
                sums[a] += f
            if kind[i] == toxicity.HARM and (aimed or toxicity.INTENT in near):
                sums[len(lexicon)] += f
    return sum(w[a] * math.log1p(x) for a, x in sums.items()) + w[-2] * math.log1p(len(texts)) + w[-1]


SENTENCES = ["you are an idiot", "not an idiot", "idiot", "he said you idiot", "idiot you are", "I will kill you",
             "they kill time. you stupid idiot!\nnever stupid", "kill", "", None, "an idiot is not here; idiots",
             "no no no no no idiot", "stupid people idiot people", "idiot " * 300, "é not an idiotic remark; you idiotic"]


def test_op12_scores_clauses(spark):
    lexicon = np.sort(np.concatenate([toxicity._hash(["idiot", "stupid"]),
                                      tkey := toxicity.tk.mix(toxicity._hash(["idio"]) + np.uint64(4))]))
    assert len(tkey) == 1
    w = np.array([2.0, 3.0, 1.5, toxicity.THREAT, 0.1, -4.0])
    words = toxicity.Words(pa.array(SENTENCES))
    row, arc, value = toxicity._features(words, lexicon)
    z = np.bincount(row, weights=w[arc] * value, minlength=len(SENTENCES)) + w[-2] * np.log1p(np.diff(words.first)) + w[-1]
    want = [by_hand_12(t, lexicon, w) for t in SENTENCES]
    assert np.allclose(z, want)
    plain, told, targeted, negated = want[2], want[3], want[0], want[1]
    assert targeted > plain > negated and want[5] > want[7] and targeted > told


def test_op12_composed_automaton_equals_its_parts():
    g = toxicity.grammar()
    assert g.step.shape[1] == toxicity.SYMBOLS and g.step.max() < len(g.step)
    assert sorted(set(g.end)) == [toxicity.REPORTED, 1.0]


def test_op12_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op12_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    bad, clean = ([r for r in held if labels[r.doc_id] == k] for k in (1, 0))
    assert len(bad) > 80 and np.mean([r.predicted for r in bad]) >= 0.85
    assert np.mean([r.predicted for r in clean]) <= 0.01
    order = np.argsort(np.argsort([r.score for r in clean + bad]))
    auc = (order[len(clean):].mean() - (len(bad) - 1) / 2) / len(clean)
    assert auc >= 0.95


def test_op12_model_equals_word_by_word(spark):
    """The query's scores on the smallest tables, from its model, recomputed word by word."""
    importable(spark)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    for d, t in documents(spark):
        z = by_hand_12(t, *model) if not isinstance(model, float) else math.log(model / (1 - model))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_op12_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (1, 0), (1, 1), (None, 0), (7, None), (13, 0), (11, 0), (999, 0)],
                                   "doc_id long, toxic int")
    out = toxicity.score_documents(odd, labels).collect()
    assert len(out) == len(more_rows()) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.score_documents(odd, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(odd, labels.where("toxic = 1")).collect()} <= {0.0, 1.0}
    assert toxicity.score_documents(none, labels).collect() == []
    found = toxicity.matched_clauses(spark.createDataFrame([(1, "Calm. I will kill you!")], "doc_id long, text string"),
                                     labels.where("false")).collect()
    assert [(r.first_word, r.end_word, r.clause) for r in found] == [(1, 5, "i will kill you")]
