"""CSV data tables."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statwitness.functions import text as T

SALTS = 64  # parts of a file's records that meet its header apart from each other
_FIELD = r',(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'  # a field with the comma before it; commas and doubled quotes inside quotes belong to it


def read_data_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A headed CSV file or folder, every column as text, missing-value tokens as null.

    ``multi_line`` allows line breaks inside quotes but keeps a file from being split between tasks.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line)
    return raw.select(*[T.na_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def table_name(path: str) -> str:
    name = os.path.basename(path.rstrip("/"))
    return name[:-4] if name.endswith(".csv") else name


def _plain(path: str) -> str:
    """A path without scheme and host, as ``_plain_column`` makes it of Spark's."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/", path).rstrip("/")


def _plain_column(path: Column) -> Column:
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")


def _fields(record: Column) -> Column:
    """The fields of a record, unquoted; an empty field is null, as is an empty quoted one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_FIELD), F.lit(0))
    bare = lambda f: F.replace(F.regexp_replace(f, r'(?s)^,"(.*)"[^"]*$', "$1"), F.lit('""'), F.lit('"'))
    value = lambda f: F.when(F.startswith(f, F.lit(',"')), bare(f)).otherwise(F.substring(f, F.lit(2), F.length(f)))
    return F.transform(raw, value)


def _names(fields: Column) -> Column:
    """Column names of a header: one without a name is called by its position, one that repeats gets its position behind it."""
    named = F.transform(fields, lambda f, i: F.when(F.length(f) > 0, f).otherwise(F.concat(F.lit("_c"), i.cast("string"))))
    again = lambda n: F.size(F.filter(named, lambda o: F.lower(o) == F.lower(n))) > 1
    return F.transform(named, lambda n, i: F.when(again(n), F.concat(n, i.cast("string"))).otherwise(n))


def read_data_tables(spark: SparkSession, paths: Sequence[str], multi_line: bool = True) -> DataFrame:
    """Cells of any number of tables with different columns: (table_id, col_no, column_name, value).

    One scan reads the records of all files, whatever their columns: the reader is told of one column and hands over the whole text of
    every record that has more. A file's first record is its header; headers, a row per file, are joined back to the
    records by file, and by salt so that a long file does not meet its header in one task. A path is a file, or a folder of part
    files that each have a header. Line breaks inside quotes are part of a value; a file is then read by one task. Without such
    values ``multi_line=False`` lets large files be split.
    """
    scan = spark.read.schema("first string, record string").csv(
        list(paths), header=False, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord="record")
    line = F.regexp_replace("record", r"[\r\n]+$", "")
    records = scan.select(
        _plain_column(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.when(F.col("record").isNull(), F.array("first")).otherwise(_fields(line)).alias("fields"))
    heads = records.groupBy("file").agg(F.min(F.struct("block", "at", "fields")).alias("h"))
    tables = spark.createDataFrame([(_plain(p), table_name(p)) for p in paths], "path string, table_id string")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    owned = heads.withColumn("path", F.explode(F.array("file", folder))).join(tables, "path").select(
        "file", "table_id", F.col("h.block").alias("head_block"), F.col("h.at").alias("head_at"), _names(F.col("h.fields")).alias("names"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = records.withColumn("salt", F.pmod(F.xxhash64("block", "at"), F.lit(SALTS)).cast("int")).join(owned, ["file", "salt"])
    body = met.filter((F.col("block") != F.col("head_block")) | (F.col("at") != F.col("head_at")))
    cells = body.select("table_id", F.posexplode("names").alias("col", "column_name"), "fields")
    return cells.select("table_id", (F.col("col") + 1).alias("col_no"), "column_name", T.na_to_null(F.get("fields", F.col("col"))).alias("value"))
