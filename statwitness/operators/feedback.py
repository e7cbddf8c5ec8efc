"""Learning from reviewer feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statwitness import params as P
from statwitness.operators import ordered
from statwitness.operators.retrieve import top_k


def categorize(comment: Column) -> Column:
    """Kind of error a comment speaks of; the first matching rule counts."""
    c = F.lower(F.coalesce(comment, F.lit("")))
    return (
        F.when(c.rlike("suppression|marker"), "suppression_marker_error")
        .when(c.rlike("filter"), "wrong_filter")
        .when(c.rlike("column"), "wrong_columns")
        .when(c.rlike("year|time"), "time_period_mismatch")
        .otherwise("other"))


def categorize_feedback(fb: DataFrame) -> DataFrame:
    return fb.withColumn("error_type", categorize(F.col("user_comment")))


def feedback_patterns(fb: DataFrame) -> DataFrame:
    """Counts in one long table: section (total, error, headline), name, n and, for the top errors, rank. One pass
    over the feedback; ranks are given among the few error types only."""
    counted = categorize_feedback(fb).groupingSets([["error_type"], ["headline_text"], []], "error_type", "headline_text").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("error_type").alias("_e"), F.grouping("headline_text").alias("_h"))
    named = counted.select(
        F.when(F.col("_e") == 0, "error").when(F.col("_h") == 0, "headline").otherwise("total").alias("section"),
        F.when(F.col("_e") == 0, F.col("error_type")).when(F.col("_h") == 0, F.col("headline_text")).otherwise("all").alias("name"), "n")
    is_error = F.col("section") == "error"
    among = W.partitionBy("section", F.when(~is_error, F.col("name"))).orderBy(F.desc("n"), F.asc("name"))
    ranked = named.withColumn("_rank", F.row_number().over(among))
    rows = F.array_compact(F.array(
        F.struct("section", F.lit(None).cast("int").alias("rank")),
        F.when(is_error & (F.col("_rank") <= P.TOP_ERRORS), F.struct(F.lit("top_error").alias("section"), F.col("_rank").alias("rank")))))
    return ranked.select("name", "n", F.inline(rows)).select("section", "name", "n", "rank")


def guidance_triggers(patterns: DataFrame) -> DataFrame:
    """Guidance that is due because an error type has become frequent."""
    rules = patterns.sparkSession.createDataFrame(P.GUIDANCE_RULES, "name string, more_than int, guidance string")
    return patterns.filter(F.col("section") == "error").join(rules, "name").filter(
        F.col("n") > F.col("more_than")).select(F.col("name").alias("error_type"), "n", "guidance")


def correction_diff(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Cells (extraction_id, row_no, column_name, value) that a reviewer changed, added or removed."""
    keys = ["extraction_id", "row_no", "column_name"]
    a = original.select(*keys, F.struct("value").alias("old"))
    b = corrected.select(*keys, F.struct("value").alias("new"))
    both = a.join(b, keys, "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.withColumn("change", kind).filter(
        (F.col("change") != "changed") | ~F.col("old.value").eqNullSafe(F.col("new.value"))).select(
        *keys, "change", F.col("old.value").alias("old_value"), F.col("new.value").alias("new_value"))


def agreement_rate(fb: DataFrame, *by: str) -> DataFrame:
    """Answers and share of agreement per value of each of the columns, in one pass."""
    counted = fb.groupingSets([[b] for b in by], *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("agree").cast("double")).alias("agreement"),
        *[F.grouping(b).alias(f"_g{i}") for i, b in enumerate(by)])
    own = [F.col(f"_g{i}") == 0 for i in range(len(by))]
    return counted.select(
        F.coalesce(*[F.when(o, F.col(b).cast("string")) for o, b in zip(own, by)]).alias("name"), "n", "agreement",
        F.coalesce(*[F.when(o, F.lit(b)) for o, b in zip(own, by)]).alias("by"))


def weighted_agreement(fb: DataFrame, key: str, rate: float = P.LEARNING_RATE, minimum: int = P.MIN_FEEDBACK) -> DataFrame:
    """Running agreement where each answer moves the value by ``rate``; null below the minimum count.

    The fold r <- (1 - rate) r + rate x is a weighted sum once each answer's position is known; positions
    are counted inside minutes first, so a key with very many answers is spread over tasks.
    """
    held = fb.withColumn("_minute", F.date_trunc("minute", "ts"))
    placed = ordered.row_number(held, [key], "_minute", [F.col("ts"), F.col("feedback_id")], "_i")
    counts = fb.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    later = F.pow(F.lit(1.0 - rate), F.col("n") - F.col("_i"))
    weight = F.when(F.col("_i") == 1, later).otherwise(rate * later)
    folded = placed.join(counts, key).groupBy(key).agg(
        F.max("n").alias("n"), F.sum(weight * F.col("agree").cast("double")).alias("_w"))
    return folded.select(key, "n", F.when(F.col("n") >= minimum, F.col("_w")).alias("weighted_agreement"))


def impact(fb: DataFrame, cut: Column) -> DataFrame:
    """Pass rate and error rates before and after a point in time, and the relative change."""
    after, before, agree = F.col("ts") >= cut, F.col("ts") < cut, F.col("agree")
    # At most one row per error type from here on.
    by_type = categorize_feedback(fb).groupBy("error_type").agg(
        F.count_if(after).alias("na"), F.count_if(before).alias("nb"),
        F.count_if(after & agree).alias("pa"), F.count_if(before & agree).alias("pb"))
    totals = W.partitionBy(F.lit(1))
    parts = by_type.withColumns({"ta": F.sum("na").over(totals), "tb": F.sum("nb").over(totals)}).select("ta", "tb", F.explode(F.array(
        F.struct(F.lit("pass_rate").alias("measure"), F.col("pa").alias("a"), F.col("pb").alias("b")),
        F.struct(F.col("error_type").alias("measure"), (F.col("na") - F.col("pa")).alias("a"), (F.col("nb") - F.col("pb")).alias("b")))).alias("m"))
    rated = parts.groupBy("m.measure", "ta", "tb").agg(F.sum("m.a").alias("a"), F.sum("m.b").alias("b")).select(
        "measure", F.try_divide("b", "tb").alias("before"), F.try_divide("a", "ta").alias("after"))
    return rated.withColumn("relative_change", F.try_divide(F.col("after") - F.col("before"), F.col("before")))


def similar_corrections(queries: DataFrame, feedback_vectors: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """Nearest past corrections."""
    return top_k(queries, feedback_vectors, k)


def run_metrics(runs: DataFrame, by: str) -> DataFrame:
    """Mean analysis time and retrieval relevance."""
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("analysis_seconds").alias("average_analysis_time"),
        F.avg("relevance").alias("retrieval_relevance"))
