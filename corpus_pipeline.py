"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``documents``. Stages filter the rows of their input or, in mixing, repeat them; the last one writes the token files and returns what is read
back from them, a row per document: doc_id, start, n_tokens, ids_crc32.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from statwitness.llm import decontaminate, minhash, mixing, queries, tokens, toxicity  # noqa: E402
from statwitness.llm.common import materialise  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from the labels rejects go."""
    return toxicity.reject_toxic(docs, queries.toxic_lexicon(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    return minhash.drop_near_duplicates(docs, k=5, threshold=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.emit(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in id order, read back."""
    return tokens.read_tokens(tokens.write_tokens(docs, queries.tokenizer_path())).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: None: SQL can express neither the learned lexicon nor the tokenizer; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
