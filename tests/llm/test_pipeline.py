"""The pipeline's stages against brute force and on awkward rows."""

from __future__ import annotations

import collections

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import by_hand_2, by_hand_6, by_hand_8, by_hand_10, odd_rows

import corpus_pipeline
from ohmflow.llm import bpe, cotraining
from ohmflow.llm.frames import importable, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.default_path())


def test_stage_names_and_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [
        "good_quality", "unique_lines", "one_of_each", "no_benchmark", "tokens"]


def test_stages_match_brute_force(spark, library):
    """Every stage on what its predecessor kept; the classifier's own verdict is taken from its scores."""
    docs = table(spark, SF, "documents")
    cols = docs.columns
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    good = {r.doc_id for r in cotraining.score_documents(docs, table(spark, SF, "labels")).where("kept").collect()}
    rows = sorted(tuple(r) for r in docs.collect())
    rows = [r for r in rows if r[0] in good]
    texts = by_hand_2([r[:2] for r in rows])
    # a document that loses all its words is a copy and goes
    rows = [(r[0], t, *r[2:4], len(t)) for r, t in zip(rows, texts) if t.split() or not r[1].split()]
    classes = by_hand_10([r[:2] for r in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    dirty = {w[0] for w in by_hand_8([r[:2] for r in rows], items) if w[5]}
    rows = [r for r in rows if r[0] not in dirty]

    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF)
        assert got.columns == cols
    assert sorted(tuple(r) for r in got.collect()) == rows
    out = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r) for r in out.collect()) == sorted(by_hand_6(library, r[0], r[1]) for r in rows)


def test_emptied_copies_go(spark):
    importable(spark)
    lines = "\n".join(f"line {i}" for i in range(60))
    rows = [(1, lines), (2, lines), (3, lines + "\nmore"), (4, ""), (5, None), (6, " \n ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.unique_lines(spark, docs, SF).collect()}
    left = {i: t for (i, _), t in zip(rows, by_hand_2(rows))}
    assert {i for i, t in left.items() if t is not None and not t.split()} - {4, 6} <= {2}
    assert got == {i: t for i, t in left.items() if i != 2 or t.split()}


def test_stages_on_odd_and_empty_rows(spark):
    importable(spark)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame(odd_rows(), schema).select("*", F.lit(1).alias("row"), F.lit(2).alias("kept"))
    for docs in (odd, odd.where("false")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns, name
            assert docs.count() <= n
        ids = collections.Counter(r.doc_id for r in corpus_pipeline.tokens(spark, docs, SF).collect())
        assert sum(ids.values()) == docs.count()
