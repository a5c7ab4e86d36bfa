"""Training-data pipeline over ``documents``; each stage calls one operator of ``ohmflow.llm``.

A stage takes all rows its predecessor kept and returns the columns of
``documents``; the last one returns the tokenizer's result.  ``run`` writes each
stage's rows to the shared checkpoint folder and reads them again.

A document that loses all its words to line dedup is a copy of what earlier
ones keep, and goes.

Defined results: rows with null doc_id, null or empty text pass the stages
unless the quality classifier rejects them; repeated rows are one document for
the near-duplicate stage if they share a doc_id; other columns stay.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ohmflow.llm import bpe, cotraining, decontaminate, jaccard_join, line_dedup
from ohmflow.llm.frames import importable, stored, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.clean_documents(docs, table(spark, sf_dir, "labels"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_documents(docs, drop_emptied=True)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard_join.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", unique_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("BPE encoding", tokens),
]

#: a learned classifier and a tokenizer are beyond SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i + 1}")
    return docs
