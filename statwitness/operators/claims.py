"""Numeric claims in report text and their link to metrics and filter values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statwitness.functions.rows import explode_computed

# a sign belongs to the number unless a word, a number or a mark stands right before it
NUMBER = r"(?:(?<![\w.,%)])[-\u2212])?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?"
_BREAK = "\u0001"


def sentences_of(text: Column) -> Column:
    """Sentences: cut after . ! or ? when white space follows."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + _BREAK), _BREAK)


def split_sentences(paragraphs: DataFrame, keys: list[str], text: str) -> DataFrame:
    return explode_computed(paragraphs, keys, sentences_of(F.col(text)), "sentence", "sentence_no")


def _numbers(sentence: str) -> dict[str, Column]:
    """The numbers of a sentence and the text between them, as columns so each is computed once."""
    return {"_found": F.regexp_extract_all(sentence, F.lit(NUMBER), F.lit(0)), "_between": F.split(sentence, NUMBER)}


def _indexed() -> Column:
    return F.transform("_found", lambda raw, i: F.struct(i.alias("claim_no"), raw.alias("raw")))


def _position(claim_no: Column) -> Column:
    """1-based character position of a number: all text and all numbers before it."""
    chars = lambda texts: F.aggregate(texts, F.lit(0), lambda acc, s: acc + F.length(s))
    return chars(F.slice("_between", F.lit(1), claim_no + 1)) + chars(F.slice("_found", F.lit(1), claim_no)) + 1


def claim_value(raw: Column) -> Column:
    return F.translate(raw, "\u2212,%", "-").try_cast("double")


def claim_decimals(raw: Column) -> Column:
    return F.length(F.regexp_extract(raw, r"\.([0-9]+)", 1))


def extract_claims(paragraphs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per number: value, percent flag, decimals, position and its sentence."""
    found = split_sentences(paragraphs, keys, text).filter(F.col("sentence").rlike("[0-9]")).withColumns(_numbers("sentence"))
    c = explode_computed(found, [*keys, "sentence_no", "sentence", "_found", "_between"], _indexed(), "c")
    raw = F.col("c.raw")
    return c.select(
        *keys, "sentence_no", F.col("c.claim_no").alias("claim_no"), raw.alias("raw"),
        _position(F.col("c.claim_no")).alias("pos"), claim_value(raw).alias("value"), F.endswith(raw, F.lit("%")).alias("is_percent"),
        claim_decimals(raw).alias("decimals"), "sentence")


def _as_words(text: Column) -> Column:
    """The text with a space for every mark, and one at both ends, so that whole words can be found by position."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]", " "), F.lit(" "))


def _with_words(entries: str) -> Column:
    """The entries with their mention as words, from either end, so that it is made once and not per number."""
    return F.transform(F.transform(entries, lambda e: F.struct(e["name"].alias("name"), e["mention"].alias("mention"), _as_words(e["mention"]).alias("words"))), lambda e: F.struct(
        e["name"].alias("name"), F.length(e["mention"]).alias("length"), e["words"].alias("words"), F.reverse(e["words"]).alias("reversed")))


def _placed(words: str, entries: str) -> Column:
    """The entries mentioned as whole words, with the place of their first mention."""
    return F.filter(
        F.transform(entries, lambda e: F.struct(
            F.instr(F.col(words), e["words"]).alias("at"), e["length"].alias("length"), e["name"].alias("name"))),
        lambda s: s["at"] > 0)


def _names_in_order(placed: str) -> Column:
    """Names of the placed entries, by their first mention; one inside a longer mention does not count."""
    outer = F.filter(placed, lambda s: ~F.exists(placed, lambda o: (o["length"] > s["length"]) & (o["at"] <= s["at"]) & (
        o["at"] + o["length"] >= s["at"] + s["length"])))
    return F.array_distinct(F.transform(F.array_sort(F.transform(outer, lambda s: F.struct(s["at"], s["name"]))), lambda s: s["name"]))


def _nearest(entries: str) -> Column:
    """(distance, -length, name) of the entry mentioned as whole words closest to the number; a mention before it wins a
    tie, then the longer one."""
    met = F.transform(entries, lambda e: F.struct(
        F.instr(F.col("_back"), e["reversed"]).alias("back"), F.instr(F.col("_ahead"), e["words"]).alias("ahead"),
        (-e["length"]).alias("shorter"), e["name"].alias("name")))
    return F.array_min(F.transform(F.filter(met, lambda m: (m["back"] > 0) | (m["ahead"] > 0)), lambda m: F.struct(
        F.least(F.when(m["back"] > 0, (m["back"] - 1) * 2), F.when(m["ahead"] > 0, (m["ahead"] - 1) * 2 + 1)).alias("distance"),
        m["shorter"].alias("shorter"), m["name"].alias("name"))))


def link_claims(sentences: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """Each number with the metric and the filter value it speaks about.

    sentences(extraction_id, keys..., sentence_no, sentence); vocabulary(extraction_id, metrics, values)
    with arrays of (name, mention), mentions in lower case. Numbers that are themselves a filter value
    (such as a year) are no claims. Under "respectively" the last numbers before that word go with the
    mentioned names in order; every other number goes with the nearest mention. Numbers meet mentions
    inside their sentence, so no pairs are shuffled.
    """
    known = vocabulary.select("extraction_id", _with_words("metrics").alias("metrics"), _with_words("values").alias("values"), F.transform("values", lambda v: v["mention"]).alias("_mentions"))
    held = sentences.filter(F.col("sentence").rlike("[0-9]")).join(known, "extraction_id").withColumn("_s", F.lower("sentence"))
    held = held.withColumns(_numbers("_s")).withColumn("_w", _as_words(F.col("_s"))).withColumns({
        "_cue": F.instr("_s", F.lit("respectively")), "_placed_metrics": _placed("_w", "metrics"), "_placed_values": _placed("_w", "values")})
    is_claim = lambda raw: ~F.array_contains("_mentions", raw)
    before_cue = F.regexp_extract_all(F.substring("_s", F.lit(1), F.greatest(F.col("_cue") - 1, F.lit(0))), F.lit(NUMBER), F.lit(0))
    listed = held.withColumns({
        "_metrics": _names_in_order("_placed_metrics"), "_values": _names_in_order("_placed_values"),
        "_n": F.size(F.filter(before_cue, is_claim)), "_c": F.filter(_indexed(), lambda c: is_claim(c["raw"]))})
    keep = ["extraction_id", *keys, "sentence_no", "_s", "_found", "_between", "metrics", "values", "_metrics", "_values", "_cue", "_n"]
    one = explode_computed(listed, keep, F.col("_c"), "c", "_i").withColumn("_pos", _position(F.col("c.claim_no")))
    around = one.withColumns({
        "_back": F.reverse(_as_words(F.substring("_s", F.lit(1), F.col("_pos") - 1))),
        "_ahead": _as_words(F.substring("_s", F.col("_pos") + F.length("c.raw"), F.length("_s")))})
    near = around.withColumns({"_near_metric": _nearest("metrics"), "_near_value": _nearest("values")})

    def assigned(names: str, nearest: str) -> tuple[Column, Column]:
        m = F.size(names)
        k = F.col("_i") - (F.col("_n") - m)
        paired = (F.col("_cue") > 0) & (m >= 2) & (F.col("_n") >= m) & (k >= 0) & (k < m)
        name = F.when(paired, F.get(names, k)).otherwise(F.col(nearest)["name"])
        return name, F.when(paired, "respectively").when(F.col(nearest).isNotNull(), "nearest")

    metric, metric_method = assigned("_metrics", "_near_metric")
    value, value_method = assigned("_values", "_near_value")
    raw = F.col("c.raw")
    return near.select(
        "extraction_id", *keys, "sentence_no", F.col("c.claim_no").alias("claim_no"), raw.alias("raw"),
        claim_value(raw).alias("stated"), claim_decimals(raw).alias("decimals"),
        metric.alias("metric"), metric_method.alias("metric_method"),
        value.alias("filter_value"), value_method.alias("value_method"))
