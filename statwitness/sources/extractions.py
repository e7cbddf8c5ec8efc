"""Stored extractions: one document per id.

The store is a log of batches. Saving writes one new batch and reads nothing; deleting writes a batch of tombstones; reading takes
the newest entry of each id, found from the id and batch columns alone. Sizes are stored, so listing reads no document.
Batches are ordered by the clock of the driver that writes them. ``compact_extractions`` rewrites a store as one batch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statwitness.functions.text import safe_id
from statwitness.operators.ordered import top_n
from statwitness.session import materialise

VERSION = "1.0"
STORE_SCHEMA = "safe_id string, doc_id string, document string, modified string, size_bytes bigint, deleted boolean, batch string"


def envelope(df: DataFrame, saved_at: Column, include_metadata: bool = True) -> DataFrame:
    """(safe_id, document): the payload as JSON, by default wrapped with id, time and version.

    Two ids that become the same file name share one document; the later id (in text order) wins.
    """
    payload = F.col("data")
    wrapped = F.struct(
        "doc_id", saved_at.cast("string").alias("timestamp"), F.lit(VERSION).alias("version"), payload.alias("data"))
    rows = df.select(
        safe_id(F.col("doc_id")).alias("safe_id"), "doc_id",
        F.to_json(wrapped if include_metadata else payload).alias("document"),
        saved_at.cast("string").alias("modified"))
    return top_n(rows, ["safe_id"], [F.desc("doc_id")], 1).drop("rank")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _append(rows: DataFrame, path: str) -> None:
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    # sorted files, so that a read by id skips row groups
    rows.sortWithinPartitions("safe_id").withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(path)


def save_extractions(df: DataFrame, path: str, saved_at: Column, include_metadata: bool = True) -> None:
    """Write documents as one new batch; an id that is already stored is replaced for readers."""
    new = envelope(df, saved_at, include_metadata)
    _append(new.withColumns({"size_bytes": F.octet_length("document").cast("bigint"), "deleted": F.lit(False)}), path)


def load_extractions(spark: SparkSession, path: str, doc_ids: Sequence[str] | None = None) -> DataFrame:
    """Stored documents with their sizes, all or by id; nothing stored gives no rows."""
    stored = _stored(spark, path)
    if stored is None:
        return spark.createDataFrame([], STORE_SCHEMA).drop("deleted", "batch")
    if doc_ids is not None:
        stored = stored.filter(F.col("safe_id").isin([i.replace(" ", "_").replace("/", "_") for i in doc_ids]))
    newest = (stored.groupBy("safe_id").agg(F.max(F.struct("batch", "deleted")).alias("last")).filter("not last.deleted")
              .select("safe_id", F.col("last.batch").alias("batch")))
    return stored.join(newest, ["safe_id", "batch"]).drop("deleted", "batch")


def compact_extractions(spark: SparkSession, path: str, target: str) -> None:
    """The store as one batch in another folder, without replaced and deleted documents."""
    _append(load_extractions(spark, path).withColumn("deleted", F.lit(False)), target)


def list_extractions(stored: DataFrame) -> DataFrame:
    """Id, file name, size and time of every stored document, by file name; documents are not read."""
    return stored.select(
        F.col("safe_id").alias("doc_id"), F.concat("safe_id", F.lit(".json")).alias("filename"),
        F.round(F.col("size_bytes") / 1024, 2).alias("size_kb"), "modified").orderBy("filename")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder of JSON documents; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.regexp_extract("path", r"[^/]*$", 0)
    return files.select(
        F.regexp_replace(name, r"\.json$", "").alias("doc_id"), name.alias("filename"), "path",
        F.round(F.col("length") / 1024, 2).alias("size_kb"), F.col("modificationTime").alias("modified"))


def delete_extractions(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Delete the ids (doc_id) from the store; gives for each whether it was there."""
    wanted = ids.select("doc_id", safe_id(F.col("doc_id")).alias("safe_id")).distinct()
    there = load_extractions(spark, path).select("safe_id", F.lit(True).alias("deleted"))
    report = materialise(wanted.join(there, "safe_id", "left").select("doc_id", "safe_id", F.coalesce("deleted", F.lit(False)).alias("deleted")))
    gone = report.filter("deleted").groupBy("safe_id").agg(F.min("doc_id").alias("doc_id"))
    none = lambda kind: F.lit(None).cast(kind)
    _append(gone.select("safe_id", "doc_id", none("string").alias("document"), none("string").alias("modified"),
                        none("bigint").alias("size_bytes"), F.lit(True).alias("deleted")), path)
    return report.select("doc_id", "deleted")


def storage_stats(listing: DataFrame) -> DataFrame:
    """Number of documents and total size; the rounded sizes are what is summed."""
    return listing.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.round(F.coalesce(F.sum("size_kb"), F.lit(0.0)) / 1024, 2).alias("total_size_mb"))
