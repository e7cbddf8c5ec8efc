"""Mapping headlines to data tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statwitness import params as P
from statwitness.operators.ordered import top_n


def headline_key(page: Column, text: Column) -> Column:
    """h<page>_<first 50 characters>: the identity under which choices are stored."""
    return F.concat(F.lit("h"), page.cast("string"), F.lit("_"), F.substring(text, 1, 50))


def map_headlines(headlines: DataFrame, choices: DataFrame) -> DataFrame:
    """Headlines with at least one chosen table.

    headlines(report, headline_no, text, page, ...), choices(report, key, csv_file). Headlines with the
    same key in a report share the choice.
    """
    chosen = choices.groupBy("report", "key").agg(F.array_sort(F.collect_set("csv_file")).alias("csv_files"))
    keyed = headlines.withColumn("key", headline_key(F.col("page"), F.col("text")))
    return keyed.join(chosen, ["report", "key"])


def explode_mapping(mappings: DataFrame, first_only: bool = False) -> DataFrame:
    """One row per headline and table; ``first_only`` keeps the first paragraph and the first table."""
    item = mappings.select("pdf_filename", F.posexplode("mappings").alias("pos", "m"))
    files = F.slice("m.csv_files", 1, 1) if first_only else F.col("m.csv_files")
    paragraphs = F.slice("m.paragraphs", 1, 1) if first_only else F.col("m.paragraphs")
    return item.select(
        "pdf_filename", "pos", F.col("m.headline_text").alias("headline_text"),
        F.col("m.headline_page").alias("headline_page"), paragraphs.alias("paragraphs"),
        F.explode_outer(files).alias("csv_file"))


def mapping_errors(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds ``error`` where a pair cannot be processed; the others go on.

    tables(csv_file): the tables that can be read.
    """
    known = tables.select("csv_file", F.lit(True).alias("_known")).distinct()
    missing = F.col("csv_file").isNull() | (F.coalesce(F.size("paragraphs"), F.lit(0)) < 1) | (
        F.coalesce(F.get("paragraphs", 0), F.lit("")) == "")
    return pairs.join(known, "csv_file", "left").withColumn(
        "error",
        F.when(missing, "Missing paragraph or CSV file")
        .when(F.col("_known").isNull(), "Failed to load CSV")).drop("_known")


def run_summary(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total, successful and failed headlines of a run."""
    return results.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_headlines"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"))


def _token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def suggest_mappings(headlines: DataFrame, columns: DataFrame, minimum: float = P.SUGGEST_MIN_SIMILARITY,
                     keep: int = P.SUGGEST_MAX) -> DataFrame:
    """The most similar columns per headline (cosine over word sets).

    headlines(headline_id, text), columns(column_id, text). Equal word sets are compared once. Two sets
    with cosine >= t share a word among the rarest few of each (prefix rule), so only those words are
    joined on: frequent words never bring their whole groups together, and nothing is missed.
    """
    h = headlines.select("headline_id", _token_set(F.col("text")).alias("words")).filter(F.size("words") > 0)
    c = columns.select("column_id", _token_set(F.col("text")).alias("words")).filter(F.size("words") > 0)
    h_sets, c_sets = h.select("words").distinct(), c.select("words").distinct()
    frequency = h_sets.unionAll(c_sets).select(F.explode("words").alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("df"))

    def prefixes(sets: DataFrame) -> DataFrame:
        """The rarest words of each set that any similar set must meet."""
        counted = (
            sets.select("words", F.explode("words").alias("word")).join(frequency, "word").groupBy("words")
            .agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("by_rarity"))
        )
        n = F.size("words")
        # A similar set shares at least ceil(t^2 * n) words, so one of the first n - that + 1 is shared.
        length = n - F.ceil(F.lit(minimum * minimum) * n - 1e-9).cast("int") + 1
        return counted.select("words", F.explode(F.transform(
            F.slice("by_rarity", 1, length), lambda s: s["word"])).alias("word"))

    a = prefixes(h_sets).withColumnRenamed("words", "h_words")
    b = prefixes(c_sets).withColumnRenamed("words", "c_words")
    shared = F.size(F.array_intersect("h_words", "c_words"))
    pairs = (
        a.join(b, "word").filter(F.size("c_words") >= F.lit(minimum * minimum) * F.size("h_words") - 1e-9)
        .filter(F.size("h_words") >= F.lit(minimum * minimum) * F.size("c_words") - 1e-9)
        .select("h_words", "c_words").distinct()
        .withColumn("similarity", shared / F.sqrt(F.size("h_words").cast("double") * F.size("c_words")))
        .filter(F.col("similarity") >= minimum - 1e-12)
    )
    # Only the first few columns of a word set can be among a headline's best.
    ids = top_n(c, ["words"], [F.asc("column_id")], keep).drop("rank").withColumnRenamed("words", "c_words")
    best = top_n(pairs.join(ids, "c_words").select("h_words", "column_id", "similarity"),
                 ["h_words"], [F.desc("similarity"), F.asc("column_id")], keep)
    return h.join(best, F.col("words") == F.col("h_words")).select("headline_id", "column_id", "similarity", "rank")
