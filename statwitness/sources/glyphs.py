"""The glyph table: one row per positioned character or run of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GLYPH_SCHEMA = ("doc_id {id_type}, page int, glyph_no bigint, text string, size double, font string, "
                "top double, x0 double")


def read_glyphs(spark: SparkSession, path: str, fmt: str = "parquet", id_type: str = "string") -> DataFrame:
    """Parquet or JSON lines; the schema is fixed, so nothing is inferred. Document ids are texts unless told otherwise."""
    return spark.read.schema(GLYPH_SCHEMA.format(id_type=id_type)).format(fmt).load(path)
