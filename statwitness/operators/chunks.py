"""Chunks for retrieval: by size, by meaning, by headline, and three views of each extraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from statwitness import params as P
from statwitness.functions import text as T
from statwitness.functions.rows import explode_computed
from statwitness.functions.vectors import cosine
from statwitness.operators import ordered
from statwitness.session import materialise


def chunk_fixed(docs: DataFrame, keys: list[str], text: str, size: int = P.CHUNK_CHARS,
                overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """Character windows of ``size`` that share ``overlap`` characters with the next one.

    The text is cut once into pieces of size - overlap; each chunk is a piece and the start of the next,
    so the cost is linear in the text. A last piece inside the previous overlap is no chunk of its own.
    """
    step = size - overlap
    pieces = docs.select(*keys, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("p"))
    p = F.col("p")
    windows = F.transform(p, lambda s, i: F.struct(
        i.alias("chunk_no"),
        F.concat(s, F.coalesce(F.substring(F.get(p, i + 1), 1, overlap), F.lit(""))).alias("chunk"), F.length(s).alias("n")))
    kept = F.filter(windows, lambda w: (w["n"] > overlap) | (w["chunk_no"] == 0) | (w["chunk_no"] < F.size(p) - 1))
    return explode_computed(pieces, keys, kept, "w").select(*keys, "w.chunk_no", "w.chunk")


def chunk_words(docs: DataFrame, keys: list[str], text: str, most: int = P.CHUNK_WORDS_MAX) -> DataFrame:
    """Equal parts of at most ``most`` words; with two or more parts each has at least half of that."""
    words = docs.select(*keys, T.word_list(F.col(text)).alias("w")).filter(F.size("w") > 0)
    n = F.ceil(F.size("w") / most).cast("int")
    size = F.ceil(F.size("w") / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col("w"), i * size + 1, size))
    return explode_computed(words, keys, parts, "part", "chunk_no").select(
        *keys, "chunk_no", F.size("part").alias("n_words"), F.array_join("part", " ").alias("chunk"))


def chunk_by_headline(sections: DataFrame, window: int = P.CONTEXT_WINDOW) -> DataFrame:
    """Each section with up to ``window`` paragraphs before and after it.

    sections(doc_id, section_no, paragraphs). Paragraphs get their position in the report; a section asks
    for the positions around it by equality, so no report is gathered in one place.
    """
    n = F.size("paragraphs")
    placed = ordered.running_sum(
        sections.withColumn("_b", F.floor(F.col("section_no") / 1000)), ["doc_id"], "_b", [F.col("section_no")], n, "_end"
    ).withColumn("_start", F.col("_end") - n)
    paragraphs = placed.select("doc_id", "_start", F.posexplode("paragraphs").alias("i", "text")).select(
        "doc_id", (F.col("_start") + F.col("i")).alias("pos"), "text")
    around = F.concat(
        F.transform(F.sequence(F.lit(-window), F.lit(-1)), lambda d: F.col("_start") + d),
        F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda d: F.col("_end") + d))
    context = (
        placed.select("doc_id", "section_no", "_start", F.explode(around).alias("pos"))
        .join(paragraphs, ["doc_id", "pos"]).groupBy("doc_id", "section_no")
        .agg(F.array_sort(F.collect_list(F.when(F.col("pos") < F.col("_start"), F.struct("pos", "text")))).alias("before"),
             F.array_sort(F.collect_list(F.when(F.col("pos") >= F.col("_start"), F.struct("pos", "text")))).alias("after"))
    )
    texts = lambda c: F.coalesce(F.transform(c, lambda s: s["text"]), F.array().cast("array<string>"))
    return placed.drop("_b", "_start", "_end").join(context, ["doc_id", "section_no"], "left").withColumn(
        "chunk", F.array_join(F.concat(texts("before"), F.col("paragraphs"), texts("after")), "\n\n")).drop("before", "after")


# ---- semantic chunks ------------------------------------------------------------------------------

_STATES = P.SEMANTIC_MAX_CHARS + 1


def _breaks(state, length, low):
    """New chunk before this sentence? ``state`` is the length of the open chunk (0: none)."""
    return (low & (state >= P.SEMANTIC_MIN_CHARS)) | (state + length > P.SEMANTIC_MAX_CHARS)


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(doc_id, block, rows...) runs of a stream that is sorted by document, block and position."""
    for pdf in batches:
        yield from pdf.itertuples(index=False, name=None)


def _exit_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block: open length at its end for every possible open length at its start."""
    key, state, out = None, None, []
    for doc, block, _pos, length, low in _groups(batches):
        if (doc, block) != key:
            if key is not None:
                out.append((*key, state.tolist()))
            key, state = (doc, block), np.arange(_STATES)
        # a sentence at or above the maximum leaves the chunk full
        state = np.minimum(np.where(_breaks(state, length, low), length, state + length), _STATES - 1)
        if len(out) >= 256:
            yield pd.DataFrame(out, columns=["doc_id", "block", "exits"])
            out = []
    if key is not None:
        out.append((*key, state.tolist()))
    if out:
        yield pd.DataFrame(out, columns=["doc_id", "block", "exits"])


def _entry_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Open length at the start of each block, from the exit tables of the blocks before it."""
    doc_now, state = None, 0
    for pdf in batches:
        out = []
        for doc, block, exits in pdf.itertuples(index=False, name=None):
            if doc != doc_now:
                doc_now, state = doc, 0
            state = int(exits[state])
            out.append((doc, block + 1, state))
        yield pd.DataFrame(out, columns=["doc_id", "block", "entry"])


def _chunk_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state = None, 0
    for pdf in batches:
        flags = np.zeros(len(pdf), dtype=np.int64)
        columns = (pdf[c].to_numpy() for c in ["doc_id", "block", "length", "low", "entry"])
        for i, (doc, block, length, low, entry) in enumerate(zip(*columns)):
            if (doc, block) != key:
                key, state = (doc, block), int(entry)
            if state == 0 or _breaks(state, length, low):
                flags[i], state = 1, int(length)
            else:
                state += int(length)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "block": pdf["block"], "pos": pdf["pos"], "start": flags})


def chunk_semantic(sentences: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Chunks of neighbouring sentences that belong together.

    sentences(doc_id, pos, text, embedding), texts not empty; a sentence above 1000 characters is a chunk of its own. A new
    chunk starts where similarity to the sentence before is under 0.7 and the open chunk has at least
    100 characters, or where it would exceed 1000. The rule is sequential, but its state is only the
    open length (0..1000): each block of sentences is summarised as a table from entry to exit length,
    the tables of a document are chained, and all blocks then run in parallel.
    """
    id_type = dict(sentences.dtypes)["doc_id"]
    held = materialise(sentences).withColumns({
        "block": F.floor(F.col("pos") / block_rows), "length": F.length("text").cast("bigint")})
    paired = ordered.previous_value(held, ["doc_id"], "block", [F.col("pos")], {"_before": "embedding"})
    low = F.coalesce(cosine(F.col("_before"), F.col("embedding")), F.lit(0.0)) < P.SEMANTIC_SIMILARITY
    flagged = materialise(paired.select("doc_id", "block", "pos", "length", low.alias("low"), "text"))

    def in_order(df: DataFrame, *columns: str) -> DataFrame:
        return df.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "pos").select(*columns)

    # Only documents of several blocks need the tables, and their last block none.
    several = flagged.filter("block > 0").groupBy("doc_id").agg(F.max("block").alias("_last"))
    long_docs = flagged.join(several, "doc_id").filter(F.col("block") < F.col("_last"))
    exits = in_order(long_docs, "doc_id", "block", "pos", "length", "low").mapInPandas(
        _exit_states, f"doc_id {id_type}, block bigint, exits array<bigint>")
    entries = exits.repartition("doc_id").sortWithinPartitions("doc_id", "block").mapInPandas(
        _entry_states, f"doc_id {id_type}, block bigint, entry bigint")
    ready = flagged.join(entries, ["doc_id", "block"], "left").fillna(0, ["entry"])
    starts = in_order(ready, "doc_id", "block", "pos", "length", "low", "entry").mapInPandas(
        _chunk_starts, f"doc_id {id_type}, block bigint, pos bigint, start bigint")
    numbered = ordered.running_sum(starts, ["doc_id"], "block", [F.col("pos")], F.col("start"), "chunk_no")
    return (
        numbered.join(flagged.select("doc_id", "pos", "text"), ["doc_id", "pos"])
        .groupBy("doc_id", "chunk_no").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("chunk"),
            F.count(F.lit(1)).alias("n_sentences"), F.min("pos").alias("first_pos"))
    )


# ---- three views of an extraction -------------------------------------------------------------------


def semantic_chunk() -> Column:
    return F.concat(
        F.lit("Headline: "), "headline_text", F.lit("\n\nContext: "), F.array_join("paragraphs", " "),
        F.lit("\n\nDimensions: "), F.array_join(F.map_keys("filters_applied"), ", "),
        F.lit("\n\nMetrics: "), F.array_join("columns_selected", ", "))


def table_chunk() -> Column:
    n = F.size("extracted_table")
    line = lambda row: F.concat(F.lit("- "), F.array_join(F.transform(
        F.map_entries(row), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), ", "))
    rows = F.array_join(F.transform(F.slice("extracted_table", 1, P.TABLE_CHUNK_ROWS), line), "\n")
    more = F.when(n > P.TABLE_CHUNK_ROWS, F.concat(
        F.lit("\n... (and "), (n - P.TABLE_CHUNK_ROWS).cast("string"), F.lit(" more rows)"))).otherwise("")
    return F.concat(F.lit("Headline: "), "headline_text", F.lit("\n\nTable Data:\n"), rows, more)


def metadata_chunk() -> Column:
    filters, columns = F.to_json("filters_applied"), F.to_json("columns_selected")
    return F.concat(
        F.lit("Extraction ID: "), "extraction_id", F.lit("\n\nHeadline: "), "headline_text", F.lit(" (page "),
        F.coalesce(F.col("headline_page").cast("string"), F.lit("N/A")), F.lit(")\n\nFilters Applied: "), filters,
        F.lit("\n\nColumns Selected: "), columns, F.lit("\n\nRow Count: "), F.size("extracted_table").cast("string"),
        F.lit("\n\nGenerated Code Summary:\n- DataFrame filtering: "), filters, F.lit("\n- Column projection: "), columns)


def typed_chunks() -> Column:
    """The three views of an extraction as an array of (type, text)."""
    return F.array(*[
        F.struct(F.lit(kind).alias("type"), text.alias("text"))
        for kind, text in [("semantic", semantic_chunk()), ("table", table_chunk()), ("metadata", metadata_chunk())]])


def explode_chunks(extractions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Exactly three typed chunks per extraction. The chunk id is the extraction's id and the chunk's
    position, so it needs no global numbering."""
    rows = extractions.select(
        *(keep or []), "extraction_id", F.col("headline_text").alias("headline"), F.col("headline_page").alias("page"),
        F.posexplode(typed_chunks()).alias("pos", "c"))
    return rows.select(
        *(keep or []), F.concat_ws(":", "extraction_id", "pos").alias("chunk_id"), F.col("c.type").alias("type"),
        F.col("c.text").alias("text"), "extraction_id", "headline", "page")
