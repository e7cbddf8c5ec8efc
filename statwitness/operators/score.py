"""Quality scores and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness import params as P


def quality_score(numeric: DataFrame, style: DataFrame) -> DataFrame:
    """0.7 times numeric confidence plus 0.3 times style; passed from 0.85. An extraction that only one side
    knows is scored too: no numeric report is confidence 0, no style report is a failed one."""
    style_part = F.when(F.col("all_passed"), 1.0).otherwise(P.STYLE_FAILED_SCORE)
    score = F.coalesce("overall_confidence", F.lit(0.0)) * P.NUMERIC_WEIGHT + style_part * P.STYLE_WEIGHT
    return numeric.join(style, "extraction_id", "full").fillna(0, ["verified_cells", "total_cells"]).withColumn("quality_score", score).withColumn(
        "passed", F.round("quality_score", 9) >= P.PASS_SCORE)


def quality_dashboard(scores: DataFrame) -> DataFrame:
    passed = F.count_if("passed")
    total = F.count(F.lit(1))
    return scores.agg(
        total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"),
        F.try_divide(passed, total).alias("passed_share"), F.try_divide(total - passed, total).alias("failed_share"),
        F.avg("quality_score").alias("average_score"))


def failed_extractions(scores: DataFrame) -> DataFrame:
    """Extractions to review with their issues; order by quality_score to see the worst first."""
    unverified = F.col("total_cells") - F.col("verified_cells")
    cells = F.when(unverified > 0, F.array(F.concat(unverified.cast("string"), F.lit(" cells could not be verified"))))
    return scores.filter(~F.col("passed")).withColumn(
        "all_issues", F.concat(F.coalesce(cells, F.array().cast("array<string>")), F.coalesce("issues", F.array().cast("array<string>")))
    ).orderBy("quality_score", "extraction_id")


def results_table(results: DataFrame, feedback: DataFrame, check: str) -> DataFrame:
    """The reviewer's table: headline, text, PASS or FAIL, suggestions, answer and comment.

    results(extraction_id, headline_text, analyzed_text, ok, suggestions); feedback has at most one
    row per extraction.
    """
    return results.join(feedback.select("extraction_id", "agree", "commentary"), "extraction_id", "left").select(
        "extraction_id", F.col("headline_text").alias("Headline"), F.col("analyzed_text").alias("Analyzed Text"),
        F.when(F.col("ok"), "PASS").otherwise("FAIL").alias(check), F.col("suggestions").alias("Suggestions"),
        F.when(F.col("agree"), "Yes").when(~F.col("agree"), "No").alias("Agree"), F.col("commentary").alias("Commentary"))


def numeric_results_table(results: DataFrame, feedback: DataFrame) -> DataFrame:
    return results_table(results, feedback, "Numbers Correct")


def style_results_table(results: DataFrame, feedback: DataFrame) -> DataFrame:
    return results_table(results, feedback, "Style Check")


def trace(verified_claims: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each verified claim back to its report page, table row and filter spec."""
    source = extractions.select("extraction_id", "headline_text", "headline_page", "filters_applied", "columns_selected")
    return verified_claims.join(source, "extraction_id")
