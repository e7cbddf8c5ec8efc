"""Breakdowns of two levels: which filter columns determine each other, and which of them a headline compares.

A column determines another when each of its values goes with one value of the other ("nation" determines "region"): as many different
pairs as different values. Rows that stand for a whole ("Total") are left out on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from statwitness import params as P
from statwitness.functions.rows import explode_computed
from statwitness.operators.ordered import top_n
from statwitness.operators.phrases import words_between_blanks as _words


def _whole(value):
    return value.isNull() | F.lower(value).isin(P.AGGREGATE_WORDS)


def column_pairs(data: DataFrame, filters: DataFrame) -> DataFrame:
    """table_id, minor, major, minor_value, major_value: the different value pairs of every two filter columns.

    data(table_id, row_no, values MAP), filters(table_id, columns): the filter columns of each table. Rows shrink to their different
    combinations of filter values in the tasks that read them, before columns are paired.
    """
    held = data.join(filters, "table_id").select(
        "table_id", F.transform(F.array_sort("columns"), lambda c: F.struct(c.alias("column"), F.col("values")[c].alias("value"))).alias("held")).distinct()
    one = held.select("table_id", "held", F.explode("held").alias("a")).filter(~_whole(F.col("a.value")))
    both = one.select("table_id", "a", F.explode("held").alias("b")).filter(~_whole(F.col("b.value")) & (F.col("a.column") != F.col("b.column")))
    return both.select("table_id", F.col("a.column").alias("minor"), F.col("b.column").alias("major"),
                       F.col("a.value").alias("minor_value"), F.col("b.value").alias("major_value")).distinct()


def column_dependencies(pairs: DataFrame) -> DataFrame:
    """table_id, minor, major, n_minor, n_major: ``minor`` determines ``major``. A hierarchy has fewer majors than minors, and two or more."""
    per_minor = pairs.groupBy("table_id", "minor", "major", "minor_value").agg(F.count(F.lit(1)).alias("n"), F.min("major_value").alias("major_value"))
    per_major = per_minor.groupBy("table_id", "minor", "major", "major_value").agg(F.count(F.lit(1)).alias("minors"), F.max("n").alias("n"))
    sized = per_major.groupBy("table_id", "minor", "major").agg(F.sum("minors").alias("n_minor"), F.count(F.lit(1)).alias("n_major"), F.max("n").alias("_most"))
    return sized.filter("_most = 1").drop("_most")


def hierarchies(dependencies: DataFrame) -> DataFrame:
    return dependencies.filter("n_major >= 2 and n_minor > n_major")


def name_mentions(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """Headlines whose text names both columns of a hierarchy ("by region and nation"), or what their names share ("ethnicity").

    paragraphs(headline_id, table_id, paragraph), levels(table_id, major, minor)."""
    spoken = lambda c: _words(F.regexp_replace(c, "_", " "))
    shared = F.array_intersect(F.split("major", "_"), F.split("minor", "_"))
    known = levels.groupBy("table_id").agg(F.collect_set(F.struct(
        "major", "minor", spoken(F.col("major")).alias("a"), spoken(F.col("minor")).alias("b"), F.transform(F.filter(shared, lambda w: F.length(w) >= 4), _words).alias("stems"))).alias("known"))
    held = paragraphs.join(known, "table_id").withColumn("_text", _words(F.col("paragraph")))
    said = lambda w: F.contains(F.col("_text"), w)
    hits = F.filter("known", lambda k: (said(k["a"]) & said(k["b"])) | F.exists(k["stems"], said))
    return explode_computed(held, ["headline_id", "table_id"], hits, "hit").select("headline_id", "table_id", "hit.major", "hit.minor").distinct()


def choose_breakdowns(matches: DataFrame, names: DataFrame, dependencies: DataFrame, pairs: DataFrame) -> DataFrame:
    """headline_id, table_id, columns, keys, implied, n_named: the one breakdown of each headline, of one level or two.

    matches(headline_id, table_id, column_name, value): values that the text names; names: ``name_mentions``. A breakdown of one level
    needs two named values of a column. One of two levels needs named values on both levels, or the names of the levels. Its keys are the
    named minors with their majors and, for a major of which no minor is named, all its minors; all pairs where only the names of the levels
    occur. The breakdown with more named values wins (names of levels count as two), then two levels, then the column name. ``implied`` are the columns
    that the breakdown determines.
    """
    named = matches.filter(~F.lower("value").isin(P.AGGREGATE_WORDS)).select("headline_id", "table_id", "column_name", "value").distinct()
    head = ["headline_id", "table_id"]
    single = named.groupBy(*head, "column_name").agg(F.array_sort(F.collect_set("value")).alias("v")).filter(F.size("v") >= 2).select(
        *head, F.array("column_name").alias("columns"), F.transform("v", lambda v: F.array(v)).alias("keys"), F.size("v").alias("n_named"), F.lit(1).alias("levels"))
    levels = hierarchies(dependencies)
    kin = pairs.join(levels.select("table_id", "minor", "major"), ["table_id", "minor", "major"])
    at = lambda level: named.select(*head, F.col("column_name").alias(level), F.col("value").alias(f"{level}_value"))
    columns = [*head, "major", "minor", "major_value", "minor_value"]
    by_minor = kin.join(at("minor"), ["table_id", "minor", "minor_value"]).select(*columns, F.lit("minor").alias("by"))
    by_major = kin.join(at("major"), ["table_id", "major", "major_value"]).select(*columns, F.lit("major").alias("by"))
    by_name = kin.join(names, ["table_id", "major", "minor"]).select(*columns, F.lit("name").alias("by"))
    found = by_minor.unionByName(by_major).unionByName(by_name).groupBy(*columns).agg(F.collect_set("by").alias("by"))
    on = lambda level: F.array_contains("by", level)
    whole = W.partitionBy(*head, "major", "minor")  # one headline's keys: at most the table's minors
    told = found.withColumns({
        "in_major": F.max(on("minor")).over(W.partitionBy(*head, "major", "minor", "major_value")),
        "any_minor": F.max(on("minor")).over(whole), "any_major": F.max(on("major")).over(whole), "any_name": F.max(on("name")).over(whole)})
    both = F.col("any_minor") & F.col("any_major")
    kept = told.filter(F.when(both, on("minor") | (on("major") & ~F.col("in_major"))).otherwise(F.col("any_name") & (~F.col("any_minor") | on("minor")) & (~F.col("any_major") | on("major"))))
    double = kept.groupBy(*head, "major", "minor").agg(
        F.array_sort(F.collect_set(F.array("major_value", "minor_value"))).alias("keys"),
        (F.count_if(on("minor")) + F.count_distinct(F.when(on("major"), F.col("major_value"))) + F.when(F.max("any_name"), 2).otherwise(0)).cast("int").alias("n_named"),
        F.lit(2).alias("levels")).select(*head, F.array("major", "minor").alias("columns"), "keys", "n_named", "levels")
    best = top_n(single.unionByName(double), head, [F.desc("n_named"), F.desc("levels"), F.asc("columns")], 1).drop("rank")
    determined = dependencies.groupBy("table_id", F.col("minor").alias("_minor")).agg(F.array_sort(F.collect_set("major")).alias("implied"))
    return best.withColumn("_minor", F.when(F.col("levels") == 2, F.element_at("columns", -1))).join(determined, ["table_id", "_minor"], "left").select(
        *head, "columns", "keys", F.coalesce("implied", F.array().cast("array<string>")).alias("implied"), "n_named")
