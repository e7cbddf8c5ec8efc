"""Embedding and exact nearest-neighbour retrieval."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from statwitness import params as P
from statwitness.functions import text as T
from statwitness.operators.neighbours import BLOCK_ROWS, nearest
from statwitness.operators.ordered import top_n


def term_bins(text: str, dimension: int) -> Column:
    """One bin per word: the first eight hex digits of its md5, modulo the dimension."""
    words = T.word_list(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dimension).cast("int"))


def embedding_model(chunks: DataFrame, text: str = "text", dimension: int = P.EMBEDDING_DIMENSION) -> list[float]:
    """Rarity weight of each bin in a corpus, ln((chunks + 1) / (chunks with the bin + 1)); one aggregate pass."""
    seen = chunks.select(F.explode_outer(F.array_append(F.array_distinct(term_bins(text, dimension)), F.lit(-1))).alias("bin"))
    found = {r["bin"]: r["n"] for r in seen.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most dimension + 1 rows
    total = found.get(-1, 0)
    return [math.log((total + 1) / (found.get(b, 0) + 1)) for b in range(dimension)]


def embed(chunks: DataFrame, text: str = "text", dimension: int = P.EMBEDDING_DIMENSION, model: list[float] | None = None) -> DataFrame:
    """Adds ``embedding``: hashed term counts, weighted by rarity, unit length (zeros for a text without words). Pass
    the ``model`` of the indexed chunks to embed queries with the same weights."""
    weights = np.array(model or embedding_model(chunks, text, dimension))

    @F.pandas_udf("array<double>")
    def unit(bins: pd.Series) -> pd.Series:
        width = len(weights)
        sizes = bins.map(len).to_numpy(dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *bins]).astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(bins)), sizes) * width + flat, minlength=len(bins) * width).reshape(len(bins), width)
        v = counts * weights
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return pd.Series(list(np.divide(v, length, out=np.zeros_like(v), where=length > 0)))

    return chunks.withColumn("embedding", unit(F.coalesce(term_bins(text, len(weights)), F.array().cast("array<int>"))))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = P.TOP_K, filtered: bool = False,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest vectors per query by squared L2 distance, similarity 1 / (1 + distance); see ``neighbours.nearest``.

    queries(query_id, vector[, filter_value]), vectors(id, vector[, filter_value]). Distances are compared at nine
    decimals, then by id. With ``filtered`` only vectors with the query's filter value count.
    """
    best = nearest(queries, vectors, k, filtered, block_rows=block_rows, pack_rows=block_rows)
    return best.withColumn("similarity", 1.0 / (1.0 + F.col("distance")))


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """The best hit per query and extraction, after k was applied (so fewer than k may remain)."""
    return top_n(hits, ["query_id", "extraction_id"], [F.asc("rank")], 1, "_first").drop("_first")


def filter_hits(queries: DataFrame, vectors: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """Nearest vectors among those of the query's own report or headline (``filter_value``)."""
    return top_k(queries, vectors, k, filtered=True)


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text contains."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    q = words(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(text))), F.size(q)), F.lit(0.0))


def rerank(hits: DataFrame, score: Column, keep: int = P.RERANK_TOP_K) -> DataFrame:
    """Order a query's hits by a second score and keep the best."""
    scored = hits.withColumn("score", score)
    return top_n(scored, ["query_id"], [F.desc("score"), F.asc("rank")], keep, "new_rank")


def column_index(profile: DataFrame) -> DataFrame:
    """Searchable text per column: its name and its sample values."""
    samples = F.array_join(F.coalesce("sample_values", F.array().cast("array<string>")), ", ")
    return profile.select("table_id", "column_name", F.concat_ws(
        ": ", F.regexp_replace("column_name", "_", " "), F.when(samples != "", samples)).alias("text"))


def join_full(hits: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each hit with its complete extraction."""
    return hits.join(extractions, "extraction_id")
