"""Headline-to-table mappings as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ITEM = "headline_text string, headline_page int, paragraphs array<string>, csv_files array<string>"
MAPPING_SCHEMA = f"pdf_filename string, created_at string, mappings array<struct<{_ITEM}>>"


def read_mappings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Mapping documents; one that cannot be parsed, or a missing path, gives a row with ``error``."""
    schema = f"{MAPPING_SCHEMA}, _raw string"
    try:
        raw = (
            spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_raw").json(path, multiLine=multi_line)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], MAPPING_SCHEMA).schema],
            F.lit(f"Mapping file not found: {path}").alias("error"))
    return raw.withColumn("error", F.when(F.col("_raw").isNotNull(), "Invalid JSON")).drop("_raw")


def mapping_documents(mapped: DataFrame, created_at: Column) -> DataFrame:
    """One document per report, as the file format has it, whatever the number of headlines: like the report's text, its list
    of headlines is one value.

    mapped(pdf_filename, headline_no, headline_text, headline_page, paragraphs, csv_files)
    """
    entry = F.struct("headline_no", "headline_text", "headline_page", "paragraphs", "csv_files")
    return (
        mapped.groupBy("pdf_filename")
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("headline_no")).alias("mappings"))
        .withColumn("created_at", created_at)
    )


def write_mappings(documents: DataFrame, path: str, snapshot: bool = False) -> None:
    """Replace the stored mappings, or add a snapshot next to the earlier ones."""
    if snapshot:
        documents.withColumn("snapshot", F.col("created_at")).write.mode("append").partitionBy("snapshot").json(path)
    else:
        documents.write.mode("overwrite").json(path)
