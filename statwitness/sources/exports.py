"""Exports of extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def results_documents(results: DataFrame, keys: list[str]) -> DataFrame:
    """Run header with counts and one entry per headline; failed ones carry the error instead of a table.

    results(keys..., extraction_number, headline_text, paragraph, csv_filename, error, pivot_table,
    row_count, confidence, ...). One document per run, whatever its length.
    """
    ok = F.col("error").isNull()
    entry = F.struct(
        "extraction_number", "headline_text", "paragraph", "csv_filename",
        F.when(ok, "success").otherwise("error").alias("status"),
        F.when(ok, F.col("pivot_table")).alias("pivot_table"),
        F.when(ok, F.struct("row_count", "columns_selected", "filters_applied", "confidence", "extracted_at")).alias("metadata"),
        F.when(~ok, F.col("error")).alias("error"))
    by_number = lambda a, b: (a["extraction_number"] - b["extraction_number"]).cast("int")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_headlines"), F.count_if(ok).alias("successful_extractions"),
        F.count_if(~ok).alias("failed_extractions"), F.array_sort(F.collect_list(entry), by_number).alias("extractions"))


def export_results(results: DataFrame, keys: list[str], path: str) -> None:
    results_documents(results, keys).write.mode("overwrite").json(path)


def _quoted(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(tables: DataFrame) -> DataFrame:
    """tables(headline_id, row_no, record MAP): header line and row lines of each table, in order."""
    line = lambda values: F.array_join(F.transform(values, _quoted), ",")
    rows = tables.select("headline_id", "row_no", line(F.map_values("record")).alias("value"))
    heads = tables.groupBy("headline_id").agg(F.min_by(F.map_keys("record"), "row_no").alias("names")).select(
        "headline_id", F.lit(0).alias("row_no"), line(F.col("names")).alias("value"))
    return rows.unionByName(heads)


def export_tables_csv(tables: DataFrame, path: str) -> None:
    """One CSV per headline. A table has at most a fixed number of rows, so one task can hold it."""
    (
        csv_lines(tables).repartition("headline_id").sortWithinPartitions("headline_id", "row_no")
        .select("headline_id", "value").write.mode("overwrite").partitionBy("headline_id").text(path)
    )
