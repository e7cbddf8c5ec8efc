"""Checking cells against text and claims against tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statwitness import params as P
from statwitness.functions import text as T
from statwitness.functions.rows import explode_computed
from statwitness.operators.claims import NUMBER, claim_value, sentences_of
from statwitness.operators.ordered import top_n


def _metric_entries(row: Column) -> Column:
    return F.filter(F.map_entries(row), lambda e: e["key"].rlike(P.METRIC_NAME_PATTERN))


def table_cells(extractions: DataFrame) -> DataFrame:
    """One row per metric cell; row_filters holds the other columns of its row."""
    rows = extractions.select("extraction_id", F.posexplode("extracted_table").alias("row_no", "row"))
    return rows.select("extraction_id", "row_no", "row", F.explode(_metric_entries(F.col("row"))).alias("e")).select(
        "extraction_id", "row_no", F.col("e.key").alias("metric"), F.col("e.value").alias("value"),
        F.map_filter("row", lambda k, v: k != F.col("e.key")).alias("row_filters"))


def verify_cells(extractions: DataFrame, mode: str = "number") -> DataFrame:
    """Is each cell's value stated in the paragraphs?

    ``substring`` looks for the text of the value anywhere (so 9.6 is found in 19.6); ``number`` compares
    it with the numbers in the text (so 97.0 is found in 97%). Each cell comes with the other columns of its row and the first
    sentence that states its value. Text and table sit in one row, so nothing is joined and the paragraphs are not repeated per cell.
    """
    text = F.array_join("paragraphs", " ")
    held = extractions.withColumns({
        "_text": text, "_sentences": F.flatten(F.transform("paragraphs", sentences_of))})
    if mode == "substring":
        stated = lambda v: F.contains(F.col("_text"), v)
        evidence = lambda v: F.get(F.filter("_sentences", lambda s: F.contains(s, v)), F.lit(0))
    else:
        numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), claim_value)
        held = held.withColumns({"_numbers": F.array_distinct(numbers(text)), "_by_sentence": F.transform("_sentences", lambda s: F.struct(s.alias("s"), numbers(s).alias("n")))})
        stated = lambda v: F.array_contains(F.col("_numbers"), T.to_number(v))
        evidence = lambda v: F.get(F.filter("_by_sentence", lambda s: F.array_contains(s["n"], T.to_number(v))), F.lit(0))["s"]
    cells = F.flatten(F.transform("extracted_table", lambda row, i: F.transform(
        _metric_entries(row), lambda e: F.struct(
            i.alias("row_no"), e["key"].alias("metric"), e["value"].alias("value"), F.map_filter(row, lambda k, v: k != e["key"]).alias("row_filters"),
            F.coalesce(stated(e["value"]), F.lit(False)).alias("verified"), evidence(e["value"]).alias("evidence")))))
    out = explode_computed(held, ["extraction_id"], cells, "c").select("extraction_id", "c.*")
    return out.withColumns({
        "confidence": F.when(F.col("verified"), P.DIRECT_MATCH_CONFIDENCE),
        "evidence_type": F.when(F.col("verified"), "direct_text_match").otherwise("not_stated"),
    })


def verify_cell_evidence(cells: DataFrame, extractions: DataFrame) -> DataFrame:
    """Three-way answer per asked cell: stated in the text, only in the table, or not there.

    cells(extraction_id, row_filters, metric, value, filter_text)
    """
    there = extractions.select("extraction_id", "extracted_table", F.array_join("paragraphs", " ").alias("_text"))
    wanted = F.map_concat("row_filters", F.create_map("metric", "value"))
    matches = F.exists("extracted_table", lambda row: F.forall(
        F.map_entries(wanted), lambda e: ~F.array_contains(F.map_keys(row), e["key"]) | row[e["key"]].eqNullSafe(e["value"])))
    in_text = F.contains("_text", F.col("value")) & F.contains(F.lower("_text"), F.lower("filter_text"))
    out = cells.join(there, "extraction_id", "left").withColumn(
        "status",
        F.when(F.col("extracted_table").isNull(), "No matching extraction found")
        .when(~matches, "Value not found in extracted table")
        .when(in_text, "verified")
        .otherwise("Value in table but not explicitly stated in paragraph"))
    return out.withColumns({
        "verified": F.col("status") == "verified",
        "confidence": F.when(F.col("status") == "verified", P.DIRECT_MATCH_CONFIDENCE).when(
            F.startswith("status", F.lit("Value in table")), P.TABLE_ONLY_CONFIDENCE),
    }).drop("extracted_table", "_text")


def agrees(stated: Column, computed: Column, decimals: Column) -> Column:
    """Equal at the precision the text states."""
    return F.abs(stated - computed) <= 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-6


def verify_claims(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """PASS, FAIL, UNMATCHED or AMBIGUOUS per claim, with the table value as evidence; one row per claim.

    claims(extraction_id, metric, filter_value, stated, decimals, ...), cells(extraction_id, metric,
    filter_value, row_no, value). Where several cells carry the metric and the filter value, a dimension is open that the text
    does not name: the claim is AMBIGUOUS, ``candidates`` counts the cells, and none is named as evidence.
    """
    one = F.count(F.lit(1)) == 1
    found = cells.groupBy("extraction_id", "metric", "filter_value").agg(
        F.count(F.lit(1)).alias("candidates"), F.when(one, F.min("row_no")).alias("row_no"),
        F.when(one, F.min("value")).alias("table_value"))
    out = claims.join(found, ["extraction_id", "metric", "filter_value"], "left")
    num = T.to_number(F.col("table_value"))
    return out.withColumns({
        "candidates": F.coalesce("candidates", F.lit(0)),
        "status": F.when(F.col("candidates") > 1, "AMBIGUOUS")
        .when(F.col("table_value").isNull() | num.isNull(), "UNMATCHED")
        .when(agrees(F.col("stated"), num, F.col("decimals")), "PASS").otherwise("FAIL")})


def _half(decimals: Column) -> Column:
    """Half a unit of the last decimal: how far a rounded figure may be from the exact one."""
    return 0.5 * F.pow(F.lit(10.0), -decimals)


def _table_half(decimals: int | None) -> float:
    return 0.0 if decimals is None else 0.5 * 10.0 ** -decimals


def covers(stated: Column, decimals: Column, low: Column, high: Column) -> Column:
    """Does a figure stated at some decimals fit a range of possible values?"""
    slack = _half(decimals) + 1e-6
    return (stated + slack >= low) & (stated - slack <= high)


def _judged(claims: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """computed has the columns computed, low and high: the value, and the range it may have."""
    return claims.join(computed, keys, "left").withColumn(
        "status", F.when(F.col("computed").isNull(), "UNMATCHED")
        .when(covers(F.col("stated"), F.col("decimals"), F.col("low"), F.col("high")), "PASS").otherwise("FAIL"))


def verify_mean(claims: DataFrame, table: DataFrame, keys: list[str], value: Column, table_decimals: int | None = None) -> DataFrame:
    """Stated means. Where the table's figures are rounded to ``table_decimals``, the mean is a range."""
    h = _table_half(table_decimals)
    mean = F.avg(value)
    return _judged(claims, table.groupBy(*keys).agg(mean.alias("computed"), (mean - h).alias("low"), (mean + h).alias("high")), keys)


def verify_percentage(claims: DataFrame, table: DataFrame, keys: list[str], part: Column, whole: Column, table_decimals: int | None = None) -> DataFrame:
    """Stated shares of a whole. Where the table's figures are rounded, both sums are ranges, and so is the share."""
    h = F.lit(_table_half(table_decimals))
    p, w = F.sum(part), F.sum(whole)
    dp, dw = h * F.count_if((part.isNotNull()) & (part != 0)), h * F.count_if(whole.isNotNull())
    share = lambda a, b: F.try_divide(100.0 * a, b)
    return _judged(claims, table.groupBy(*keys).agg(
        share(p, w).alias("computed"), share(p - dp, w + dw).alias("low"), F.coalesce(F.when(w - dw > 0, share(p + dp, w - dw)), share(p, w)).alias("high")), keys)


def verify_difference(claims: DataFrame, table: DataFrame, keys: list[str], group: str, value: Column, mean_decimals: int | None = None) -> DataFrame:
    """claims(keys..., group_a, group_b, direction[, amount, decimals, unit]): is group A's mean higher or lower than group B's, and by
    the stated amount?

    Reports take differences of means that they have rounded to ``mean_decimals``; each is then a range, and so is their difference. The
    amount may be in ``points`` (A - B) or in ``percent`` of B. A claim without an amount is judged by its direction. The result has the
    difference, the range that the amount may have, and which of the two statements holds.
    """
    means = table.groupBy(*keys, group).agg(F.avg(value).alias("mean"))
    side = lambda s: means.select(*keys, F.col(group).alias(f"group_{s}"), F.col("mean").alias(f"mean_{s}"))
    out = claims.join(side("a"), [*keys, "group_a"], "left").join(side("b"), [*keys, "group_b"], "left")
    h = _table_half(mean_decimals)
    a, b = F.col("mean_a"), F.col("mean_b")
    gap = a - b
    low, high = gap - 2 * h, gap + 2 * h
    seen = (
        F.when(F.col("direction") == "higher", high > 0).when(F.col("direction") == "lower", low < 0)
        .when(F.col("direction") == "equal", (low <= 0) & (high >= 0)).otherwise(F.lit(False)))
    out = out.withColumns({"difference": gap, "direction_holds": seen})
    if "amount" not in claims.columns:
        return out.withColumn("status", F.when(gap.isNull(), "UNMATCHED").when(seen, "PASS").otherwise("FAIL"))
    # percentages of a mean that may be zero have no upper end
    least_b, most_b = b - h, b + h
    percent = lambda x, base: F.try_divide(100.0 * x, base)
    down = F.when(F.col("unit") == "percent", percent(a - h, most_b) - 100.0).otherwise(low)
    up = F.when(F.col("unit") == "percent", F.when(least_b > 0, percent(a + h, least_b) - 100.0).otherwise(float("inf"))).otherwise(high)
    ranged = out.withColumns({"_down": down, "_up": up}).withColumns({
        "amount_low": F.when((F.col("_down") <= 0) & (F.col("_up") >= 0), 0.0).otherwise(F.least(F.abs("_down"), F.abs("_up"))), "amount_high": F.greatest(F.abs("_down"), F.abs("_up"))})
    fits = F.col("amount").isNull() | covers(F.col("amount"), F.col("decimals"), F.col("amount_low"), F.col("amount_high"))
    return ranged.withColumn("amount_holds", fits).withColumn(
        "status", F.when(gap.isNull(), "UNMATCHED").when(seen & fits, "PASS").otherwise("FAIL")).drop("_down", "_up")


def verify_trend(claims: DataFrame, series: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """series holds one row per key and period. The claim holds when first to last moves that way;
    ``monotone`` says whether every step does."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(time))
    steps = series.withColumn("_d", F.col(value) - before)
    ends = steps.groupBy(*keys).agg(
        F.min_by(value, time).alias("first_value"), F.max_by(value, time).alias("last_value"),
        F.coalesce(F.bool_and(F.col("_d") >= 0), F.lit(True)).alias("_up"),
        F.coalesce(F.bool_and(F.col("_d") <= 0), F.lit(True)).alias("_down"))
    seen = (
        F.when(F.col("last_value") > F.col("first_value"), "increasing")
        .when(F.col("last_value") < F.col("first_value"), "decreasing").otherwise("stable"))
    out = claims.join(ends.withColumn("computed", seen).withColumn("monotone", F.col("_up") | F.col("_down")), keys, "left")
    return out.drop("_up", "_down").withColumn(
        "status", F.when(F.col("computed").isNull(), "UNMATCHED")
        .when(F.col("computed") == F.col("direction"), "PASS").otherwise("FAIL"))


def verify_extreme(claims: DataFrame, totals: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """claims(keys..., stated_group): is it really the highest one?"""
    top = top_n(totals, keys, [F.desc(value), F.asc(group)], 1).select(
        *keys, F.col(group).alias("top_group"), F.col(value).alias("top_value"))
    return claims.join(top, keys, "left").withColumn(
        "status", F.when(F.col("top_group").isNull(), "UNMATCHED")
        .when(F.col("top_group") == F.col("stated_group"), "PASS").otherwise("FAIL"))


def numeric_report(cell_reports: DataFrame, extractions: DataFrame | None = None) -> DataFrame:
    """Per extraction: verified cells, all cells, their ratio, and the cells themselves. With ``extractions``
    (extraction_id) those without any metric cell are there too, with confidence 0."""
    done = cell_reports.groupBy("extraction_id").agg(
        F.count_if("verified").alias("verified_cells"), F.count(F.lit(1)).alias("total_cells"),
        F.array_sort(F.collect_list(F.struct("row_no", "metric", "value", "verified"))).alias("cell_reports"))
    if extractions is not None:
        done = extractions.select("extraction_id").join(done, "extraction_id", "left").fillna(0, ["verified_cells", "total_cells"])
    return done.withColumn("overall_confidence", F.coalesce(
        F.try_divide(F.col("verified_cells"), F.col("total_cells")), F.lit(0.0)))


def suggest_corrections(verified_claims: DataFrame) -> DataFrame:
    """For failed claims: what the table says instead."""
    return verified_claims.filter(F.col("status") == "FAIL").withColumn("suggestion", F.concat(
        F.lit("Replace "), F.col("raw"), F.lit(" by "), T.plain_number(F.col("table_value")),
        F.lit(" ("), F.col("metric"), F.lit(", "), F.col("filter_value"), F.lit(")")))
