"""Exact nearest neighbours by pivot partitions.

A few vectors are pivots; every vector belongs to the nearest one, at a known radius. A query first visits the nearest partitions
that hold k vectors together. Its k-th distance there bounds what can still matter: a partition is visited in the second
round only if no triangle inequality puts all of its vectors beyond that distance. Queries and vectors meet by equality on
the partition, in cells of bounded size on both sides: a large partition is cut into blocks of vectors, a
sought-after one into packs of queries. Nothing but the pivots passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from statwitness.operators.ordered import top_n
from statwitness.session import materialise

PIVOTS = 64
MAX_PIVOT_BYTES = 64 << 20
BLOCK_ROWS = 4096  # vectors of a cell, about
PACK_ROWS = 2048  # queries of a cell, about
DISTANCE_DECIMALS = 9
SLACK = 1e-6  # distances are rounded before they are compared; bounds give way by more than that


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, from differences of norms and products."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """A bounded sample, by a hash of the id: ``pivots`` different vectors at most."""
    drawn = vectors.select("vector").orderBy(F.xxhash64("id")).limit(pivots).collect()
    found = np.unique(np.array([list(r["vector"]) for r in drawn], dtype=np.float64), axis=0) if drawn else np.zeros((0, 0))
    if found.nbytes > MAX_PIVOT_BYTES:
        raise ValueError(f"{len(found)} pivots of {found.shape[1]} numbers are more than {MAX_PIVOT_BYTES} bytes; ask for fewer")
    return found


def _partitioned(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, vector, part, pivot, radius."""
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column("vector")), pivots) if batch.num_rows else np.zeros((0, 1))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(d)), near]))], names=[*batch.schema.names, "pivot", "radius"])

    return vectors.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in vectors.columns) + ", pivot int, radius double")


def _to_pivots(queries: DataFrame, pivots: np.ndarray) -> DataFrame:
    """query_id, part, pivot, d: how far each query is from each pivot."""
    kinds = dict(queries.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = np.sqrt(_distances(_matrix(batch.column("vector")), pivots))
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(pivots)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("part").take(at), pa.array(np.tile(np.arange(len(pivots), dtype=np.int32), batch.num_rows)), pa.array(d.ravel())],
                                             names=["query_id", "part", "pivot", "d"])

    return queries.select("query_id", "part", "vector").mapInArrow(run, f"query_id {kinds['query_id']}, part {kinds['part']}, pivot int, d double")


def _best(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances, smaller id first among equals."""
    keep = np.arange(len(distances))
    if len(distances) > k:
        keep = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1])
    return keep[np.lexsort((ids[keep], distances[keep]))[:k]]


def _visit(visits: DataFrame, queries: DataFrame, parts: DataFrame, sizes: DataFrame, k: int, block_rows: int, pack_rows: int) -> DataFrame:
    """query_id, id, distance: the k nearest of each cell to each query that visits it, none beyond the query's ``limit``.

    visits(query_id, part, pivot, limit); parts: ``_partitioned``; sizes(part, pivot, n)."""
    asked = visits.groupBy("part", "pivot").agg(F.count(F.lit(1)).alias("visits"))
    cut = sizes.select("part", "pivot", "n").join(asked, ["part", "pivot"]).select(
        "part", "pivot", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("visits") / pack_rows).cast("int").alias("packs"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    stored = parts.join(cut, ["part", "pivot"]).select(
        "part", "pivot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), upto("packs").alias("pack"), "id", "vector")
    asking = visits.join(queries, ["query_id", "part"]).join(cut, ["part", "pivot"]).select(
        "part", "pivot", upto("blocks").alias("block"), F.pmod(F.xxhash64("query_id"), F.col("packs")).cast("int").alias("pack"), "query_id", "limit", F.col("vector").alias("asked"))
    kinds = dict(queries.dtypes)["query_id"], dict(parts.dtypes)["id"]

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, query_ids = left.column("id").to_numpy(), right.column("query_id")
        found = ([], [], [])
        if len(ids) and len(query_ids):
            d = np.round(_distances(_matrix(right.column("asked")), _matrix(left.column("vector"))), DISTANCE_DECIMALS)
            limits = right.column("limit").to_numpy()
            for n in range(len(d)):
                near = np.flatnonzero(d[n] <= limits[n])
                keep = near[_best(ids[near], d[n][near], k)]
                found[0].append(np.full(len(keep), n))
                found[1].append(keep)
                found[2].append(d[n][keep])
        asked_by, hit, distance = (np.concatenate(f) if f else np.zeros(0, int) for f in found)
        return pa.Table.from_arrays([query_ids.take(pa.array(asked_by.astype(np.int64))), left.column("id").take(pa.array(hit.astype(np.int64))), pa.array(distance.astype(np.float64))], names=["query_id", "id", "distance"])

    key = ["part", "pivot", "block", "pack"]
    return stored.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(cell, f"query_id {kinds[0]}, id {kinds[1]}, distance double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, filtered: bool = False, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, pack_rows: int = PACK_ROWS) -> DataFrame:
    """query_id, id, distance, rank: the k nearest vectors of each query by squared L2 distance, compared at nine decimals, then by id.

    queries(query_id, vector[, filter_value]), vectors(id, vector[, filter_value]). With ``filtered`` only vectors of the query's filter value
    count. Rows without a vector or, if filtered, without a filter value take no part.
    """
    part = F.col("filter_value") if filtered else F.lit(0)
    usable = F.col("vector").isNotNull() & part.isNotNull()
    queries = materialise(queries.filter(usable).select("query_id", part.alias("part"), "vector"))
    vectors = vectors.filter(usable).select("id", part.alias("part"), "vector")
    drawn = choose_pivots(vectors, pivots)
    if not len(drawn):
        return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, distance double, rank int")
    parts = materialise(_partitioned(vectors, drawn))
    sizes = parts.groupBy("part", "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("radius").alias("inner"), F.max("radius").alias("outer"))
    near_first = W.partitionBy("query_id", "part").orderBy("d", "pivot")  # a row per pivot
    reach = materialise(_to_pivots(queries, drawn).join(sizes, ["part", "pivot"]).withColumns({
        "before": F.coalesce(F.sum("n").over(near_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "closest": F.min("d").over(W.partitionBy("query_id", "part"))}))
    first = F.col("before") < k
    hits = materialise(_visit(reach.filter(first).select("query_id", "part", "pivot", F.lit(float("inf")).alias("limit")), queries, parts, sizes, k, block_rows, pack_rows))
    kth = top_n(hits, ["query_id"], [F.asc("distance"), F.asc("id")], k).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("kth"))
    limit = F.when(F.col("found") >= k, F.col("kth")).otherwise(float("inf"))
    # no vector of the partition is nearer than this: by its radii, and because its vectors are no nearer to the closest pivot than to their own
    least = F.greatest(F.col("d") - F.col("outer"), F.col("inner") - F.col("d"), (F.col("d") - F.col("closest")) / 2)
    more = reach.filter(~first).join(kth, "query_id").withColumn("limit", limit).filter(least <= F.sqrt("limit") * (1 + SLACK) + SLACK).select("query_id", "part", "pivot", "limit")
    both = hits.unionByName(_visit(more, queries, parts, sizes, k, block_rows, pack_rows))
    return top_n(both, ["query_id"], [F.asc("distance"), F.asc("id")], k)
