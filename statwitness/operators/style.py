"""Style and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from statwitness import params as P
from statwitness.functions import text as T
from statwitness.functions.rows import explode_computed
from statwitness.operators.claims import split_sentences
from statwitness.session import materialise


def all_cells(extractions: DataFrame) -> DataFrame:
    """Every cell of every extracted table."""
    rows = extractions.select("extraction_id", F.posexplode("extracted_table").alias("row_no", "row"))
    return rows.select("extraction_id", "row_no", F.explode("row").alias("column_name", "value"))


def check_unit_consistency(cells: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """Percent columns must lie in 0..1 or in 0..100; gives the offending columns per extraction. Extractions
    without cells pass if ``extractions`` (extraction_id) names them."""
    num = T.to_number(F.regexp_replace("value", "%$", ""))
    per_column = (
        cells.filter(F.contains(F.lower("column_name"), F.lit("percent")))
        .groupBy("extraction_id", "column_name")
        .agg(F.min(num).alias("low"), F.max(num).alias("high"), F.count("value").alias("n"))
    )
    fine = (F.col("low") >= 0) & (F.col("high") <= 100)
    only_markers = F.col("low").isNull() & (F.col("n") > 0)
    issue = F.when(~only_markers & ~F.coalesce(fine, F.lit(False)), F.concat(
        "column_name", F.lit(": Mixed formats detected (range: "), T.plain_number(F.col("low")), F.lit("-"),
        T.plain_number(F.col("high")), F.lit(")")))
    found = per_column.groupBy("extraction_id").agg(F.array_sort(F.collect_list(issue)).alias("issues"))
    return _per_extraction(cells if extractions is None else extractions, found, "unit_consistency")


def _per_extraction(cells: DataFrame, found: DataFrame, check: str) -> DataFrame:
    """One row per extraction; no issues where nothing was found."""
    return cells.select("extraction_id").distinct().join(found, "extraction_id", "left").select(
        "extraction_id", F.lit(check).alias("check_name"),
        F.coalesce(F.size("issues") == 0, F.lit(True)).alias("passed"),
        F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def check_suppression_markers(extractions: DataFrame) -> DataFrame:
    """Text that speaks of suppressed values needs a marker in the table (both sit in one row)."""
    said = F.lower(F.array_join("paragraphs", " ")).rlike("|".join(P.SUPPRESSION_PHRASES))
    kept = F.exists("extracted_table", lambda row: F.exists(F.map_values(row), lambda v: v.isin(P.STYLE_MARKERS)))
    failed = said & ~F.coalesce(kept, F.lit(False))
    return extractions.select(
        "extraction_id", F.lit("suppression_markers").alias("check_name"), (~failed).alias("passed"),
        F.when(failed, F.array(F.lit("Paragraph mentions suppression but table contains numeric values")))
        .otherwise(F.array().cast("array<string>")).alias("issues"))


def check_time_format(cells: DataFrame, column: str = "time_period", extractions: DataFrame | None = None) -> DataFrame:
    """All periods of a table in one notation; a table without the column, or without rows, passes."""
    value = F.col("value")
    notation = F.when(value.rlike("^[0-9]{6}$"), "YYYYYY").when(F.contains(value, F.lit("-")), "YYYY-YY").otherwise("other")
    sets = (
        cells.filter(F.col("column_name") == column).groupBy("extraction_id")
        .agg(F.array_sort(F.collect_set(notation)).alias("formats"))
        .select("extraction_id", F.when(F.size("formats") > 1, F.array(F.concat(
            F.lit("Mixed time formats detected: "), F.array_join("formats", ", ")))).otherwise(
                F.array().cast("array<string>")).alias("issues"))
    )
    return _per_extraction(cells if extractions is None else extractions, sets, "time_format")


def style_report(*checks: DataFrame) -> DataFrame:
    """All checks of an extraction together."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    return rows.groupBy("extraction_id").agg(
        F.bool_and("passed").alias("all_passed"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_name")))).alias("failed_checks"),
        F.array_sort(F.flatten(F.collect_list("issues"))).alias("issues"))


def terminology_inconsistencies(sections: DataFrame, keys: list[str], text: str, variants: dict[str, list[str]]) -> DataFrame:
    """Terms written in more than one way within a report, with the count of sections per variant."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    known = F.array(*[
        F.struct(F.lit(term).alias("term"), F.lit(v).alias("variant")) for term, vs in variants.items() for v in vs])
    held = sections.withColumn("_w", words)
    hits = F.filter(known, lambda k: F.contains(F.col("_w"), F.concat(F.lit(" "), k["variant"], F.lit(" "))))
    used = explode_computed(held, keys, hits, "h").groupBy(*keys, "h.term", "h.variant").agg(
        F.count(F.lit(1)).alias("n"))
    return used.groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.array_sort(F.collect_list(F.struct("variant", "n"))).alias("variants")).filter("n_variants > 1")


def number_format_consistency(paragraphs: DataFrame, claims: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Number notations used in a report: decimals, and % against "per cent"."""
    worded = paragraphs.groupBy(*keys).agg(
        F.coalesce(F.bool_or(F.lower(text).rlike("per cent|percent")), F.lit(False)).alias("worded"))
    numbers = claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_claims"), F.bool_or("is_percent").alias("signed"),
        F.array_sort(F.collect_set("decimals")).alias("decimals"))
    out = worded.join(numbers, keys)
    return out.withColumn("consistent", ~(F.col("worded") & F.col("signed")) & (F.size("decimals") <= 1))


def readability(paragraphs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sentences, words per sentence and the share of long sentences."""
    n = T.word_count(F.col("sentence"))
    per_sentence = split_sentences(paragraphs, keys, text).withColumn("n_words", n).filter("n_words > 0")
    return per_sentence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.avg("n_words").alias("words_per_sentence"),
        F.avg((F.col("n_words") > P.LONG_SENTENCE_WORDS).cast("double")).alias("long_share"))


def _surface_forms(paragraphs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys..., key, form, pair, n: words, hyphenated words and pairs of neighbouring words with their letters run together."""
    shown = F.concat(F.regexp_replace(F.lower(text), r"[^\p{L} -]+", " | "), F.lit(" |"))
    tokens = F.filter(F.split(shown, r"[ ]+"), lambda t: t != "")
    word = lambda t: t.rlike(r"^\p{L}+(-\p{L}+)*$")
    plain = lambda t: t.rlike(r"^\p{L}+$")
    held = paragraphs.select(*keys, tokens.alias("_tokens"))
    singles = F.transform(F.filter("_tokens", word), lambda t: F.struct(F.replace(t, F.lit("-"), F.lit("")).alias("key"), t.alias("form"), F.lit(False).alias("pair")))
    pairs = F.zip_with(F.slice("_tokens", F.lit(1), F.greatest(F.size("_tokens") - 1, F.lit(0))), F.slice("_tokens", F.lit(2), F.greatest(F.size("_tokens") - 1, F.lit(0))),
                       lambda a, b: F.when(plain(a) & plain(b), F.struct(F.concat(a, b).alias("key"), F.concat_ws(" ", a, b).alias("form"), F.lit(True).alias("pair"))))
    forms = F.concat(singles, F.filter(pairs, lambda p: p.isNotNull()))
    rows = explode_computed(held, keys, forms, "f")
    return rows.groupBy(*keys, "f.key", "f.form", "f.pair").agg(F.count(F.lit(1)).alias("n"))


def term_variants(paragraphs: DataFrame, keys: list[str], text: str, min_length: int = P.VARIANT_MIN_LENGTH) -> DataFrame:
    """Competing spellings inside a report, found without a list: keys..., kind, term, variant, n_term, n_variant.

    ``spacing``: one word written solid, with a hyphen or as two words ("dataset", "data-set", "data set"). ``spelling``: words of ``min_length`` letters or
    more that differ in one letter, found by equality of the words with one letter left out, so that no two words of a report are
    compared unless they share such a remainder; a plural s is no difference. The term is the more frequent form, then the first in the alphabet.

    Forms are read by three branches and written once. The remainders are many times the text they come from, which Spark's size estimate
    does not know, so words always meet by a shuffled join and no side goes through the driver.
    """
    forms = materialise(_surface_forms(paragraphs, keys, text).filter(F.length("key") >= min_length))
    group = W.partitionBy(*keys, "key")
    ranked = group.orderBy(F.desc("n"), "form")
    spacing = forms.withColumns({
        "_forms": F.count(F.lit(1)).over(group), "_solid": F.max(~F.col("pair")).over(group), "_term": F.first("form").over(ranked), "_n": F.first("n").over(ranked)}).filter(
        "_forms > 1 and _solid and form <> _term").select(*keys, F.lit("spacing").alias("kind"), F.col("_term").alias("term"), F.col("form").alias("variant"), F.col("_n").alias("n_term"), F.col("n").alias("n_variant"))
    words = forms.filter(~F.col("pair")).groupBy(*keys, "key").agg(F.sum("n").alias("n"))
    rests = F.concat(F.array("key"), F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.concat(F.substring("key", F.lit(1), i - 1), F.substring("key", i + 1, F.length("key")))))
    near = words.select(*keys, "key", "n", F.explode(F.array_distinct(rests)).alias("rest"))
    a, b = near.alias("a"), near.select(*keys, "rest", F.col("key").alias("other"), F.col("n").alias("n_other")).alias("b")
    met = a.join(b.hint("merge"), [*keys, "rest"]).filter((F.col("n_other") > F.col("n")) | ((F.col("n_other") == F.col("n")) & (F.col("other") < F.col("key")))).filter(
        (F.levenshtein("key", "other") == 1) & (F.col("key") != F.concat("other", F.lit("s"))) & (F.col("other") != F.concat("key", F.lit("s"))))
    spelling = met.select(*keys, F.lit("spelling").alias("kind"), F.col("other").alias("term"), F.col("key").alias("variant"), F.col("n_other").alias("n_term"), F.col("n").alias("n_variant")).distinct()
    return spacing.unionByName(spelling)
