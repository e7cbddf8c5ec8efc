"""Finding many phrases in many texts: an inverted index keyed by the rarest part of each phrase.

A text's parts are its words, or the three-letter pieces of its words where a phrase may begin or end inside a word. Every part of a
phrase that occurs in a text is a part of the text, so it is enough to look a phrase up by one of its parts, and the rarest one brings
the fewest texts. Texts and phrases meet by equality on table and part, without the text; what meets is then checked in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PIECE = 3


def words_between_blanks(c: Column) -> Column:
    """Lower-case words with one blank around each, so containment respects word limits."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def _parts(text: Column, whole_words: bool) -> Column:
    """The different parts of a text or phrase."""
    words = F.array_distinct(F.filter(F.split(words_between_blanks(text), " "), lambda w: w != ""))
    if whole_words:
        return words
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (PIECE - 1)), lambda i: F.substring(w, i, F.lit(PIECE)))
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= PIECE), pieces)))


def phrase_hits(texts: DataFrame, phrases: DataFrame, keys: list[str], text: str, whole_words: bool) -> DataFrame:
    """keys..., table_id and hit of every phrase that a text of its table contains, once each.

    texts(keys..., table_id, text), phrases(table_id, phrase, hit). Case does not count. With ``whole_words`` a phrase matches as a run of
    whole words, else anywhere. Phrases without any part (two letters, say) are looked up in every text of their table.

    Parts of texts are many times the text's file, which Spark's size estimate does not know: what grows with the texts meets by
    shuffled joins, so none of it goes through the driver.
    """
    shown = words_between_blanks(F.col(text)) if whole_words else F.lower(text)
    held = texts.select(*keys, "table_id", shown.alias("_text"), F.xxhash64(shown).alias("_digest"), _parts(F.col(text), whole_words).alias("_parts"))
    # the empty part stands for phrases that have none
    parts = held.select(*keys, "table_id", "_digest", F.explode(F.array_append("_parts", F.lit(""))).alias("_part"))
    sought = phrases.select("table_id", "hit", (words_between_blanks(F.col("phrase")) if whole_words else F.lower("phrase")).alias("_phrase"),
                            _parts(F.col("phrase"), whole_words).alias("_parts")).filter(F.trim("_phrase") != "" if whole_words else F.lit(True)).distinct()
    often = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    rare = sought.select("table_id", "hit", "_phrase", F.explode(F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(F.array(F.lit("")))).alias("_part"))
    index = rare.join(often.hint("merge"), "_part", "left").groupBy("table_id", "hit", "_phrase").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_part")).alias("k")).select("table_id", "hit", "_phrase", F.col("k._part").alias("_part"))
    met = parts.hint("merge").join(index, ["table_id", "_part"]).select(*keys, "table_id", "_digest", "_phrase", "hit").distinct()
    # by digest only where it is the text's own: equal digests of one key are checked one by one
    checked = met.join(held.drop("_parts").hint("merge"), [*keys, "table_id", "_digest"]).filter(F.contains("_text", F.col("_phrase")))
    return checked.select(*keys, "table_id", "hit").distinct()
