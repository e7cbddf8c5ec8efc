"""Keeping the chunk table in step with arriving, changed and deleted extractions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from statwitness.operators.chunks import explode_chunks, typed_chunks


def stream_chunks(extractions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Three chunks per arriving extraction; a chunk id seen again within ``delay`` is dropped. For extractions that
    never change; ``chunk_changes`` follows those that do."""
    timed = extractions.withColumn("ts", F.col("ts").cast("timestamp"))
    return explode_chunks(timed, keep=["ts"]).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["chunk_id"])


# ---- an index that follows changes ---------------------------------------------------------------

CHANGE = "op string, chunk_id string, type string, text string, extraction_id string, headline string, page bigint, ts timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _ChunkIndex(StatefulProcessor):
    """Per extraction: the time of its newest version and the digests of the chunks that the index holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "micros bigint")
        self.held = handle.getMapState("held", "pos int", "digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r.micros, r.deleted, [c["digest"] for c in r.chunks]))
        known = self.version.get()
        if known is not None and known[0] > newest.micros:
            return  # an older version that comes late changes nothing
        self.version.update((newest.micros,))
        wanted = {} if newest.deleted else {c["pos"]: c for c in newest.chunks}
        held = {k[0]: v[0] for k, v in self.held.iterator()}
        for pos, chunk in sorted(wanted.items()):
            if held.get(pos) != chunk["digest"]:
                self.held.updateValue((pos,), (chunk["digest"],))
                yield self._change("upsert", newest, pos, chunk["type"], chunk["text"])
        for pos in sorted(held.keys() - wanted.keys()):
            self.held.removeKey((pos,))
            yield self._change("delete", newest, pos, None, None)

    @staticmethod
    def _change(op: str, row: Row, pos: int, kind: str | None, text: str | None) -> Row:
        return Row(op=op, chunk_id=f"{row.extraction_id}:{pos}", type=kind, text=text, extraction_id=row.extraction_id,
                   headline=row.headline_text, page=row.headline_page, ts=row.ts)

    def close(self) -> None:
        pass


def chunk_changes(changes: DataFrame) -> DataFrame:
    """What to do to the chunk index: one row per chunk that is new, changed ("upsert") or gone ("delete").

    changes: a stream of extractions (as for ``explode_chunks``) with ts, the time of the version, and deleted. Per extraction the newest
    version counts, however late others arrive; of versions with one time a deletion wins. Chunks whose text stayed as it was give no row.
    The state of an extraction is its time and a digest per chunk; it stays after a deletion, so that late versions do not revive it.
    """
    kept = changes.select(
        F.col("extraction_id").cast("string").alias("extraction_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.coalesce("deleted", F.lit(False)).alias("deleted"),
        "headline_text", F.col("headline_page").cast("bigint").alias("headline_page"),
        F.transform(typed_chunks(), lambda c, i: F.struct(
            i.alias("pos"), c["type"].alias("type"), c["text"].alias("text"),
            F.sha2(F.concat_ws("\n", F.coalesce(c["text"], F.lit("")), "headline_text", F.col("headline_page").cast("string")), 256).alias("digest"))).alias("chunks"))
    return kept.filter(F.col("extraction_id").isNotNull() & F.col("ts").isNotNull()).groupBy("extraction_id").transformWithState(
        statefulProcessor=_ChunkIndex(), outputStructType=CHANGE, outputMode="Append", timeMode="None")


@contextmanager
def _rocksdb(spark: SparkSession):
    """Keyed state of several kinds needs the RocksDB store; the session's own choice is put back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def sync_index(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Bring the index at ``path`` up to date with everything that has arrived, and stop.

    The index is a log: each micro-batch writes its changes under its own number, so a batch that is run again after a failure replaces
    what it wrote before, and no batch rewrites the index.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _rocksdb(changes.sparkSession):
        (chunk_changes(changes).writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that the index holds: the last change of each, deletions left out."""
    log = spark.read.schema(CHANGE + ", batch bigint").parquet(path)
    kept = [c for c in log.columns if c not in ("chunk_id", "batch")]
    last = log.groupBy("chunk_id").agg(F.max_by(F.struct(*kept), F.struct("batch", "ts")).alias("c"))
    return last.filter(F.col("c.op") == "upsert").select("chunk_id", *[f"c.{c}" for c in kept if c != "op"])


def compact_index(spark: SparkSession, path: str, target: str) -> None:
    """Write the present chunks as one batch of a new index folder. A stream that goes on writing to it needs its own checkpoint kept; its
    batches have higher numbers than 0 from then on."""
    read_index(spark, path).select(F.lit("upsert").alias("op"), *[c.split()[0] for c in CHANGE.split(", ")[1:]]).write.parquet(f"{target}/batch=0")
