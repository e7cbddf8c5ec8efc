"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target size; every document of a source then has the same expected number of copies,
``target / source_size``. Documents of a source are put in one order, expected copies are prefix-summed along it
from one random offset per source, and a document is emitted once for every integer boundary its interval crosses.
The order goes by size first, so that each size class is taken evenly and the words taken come close to the target
for small sources too.

The prefix sum needs no window over a whole source: a source is cut into blocks by size class and a hash of the id,
rows are numbered inside blocks, and only one row per block meets in a window over the source. The number of blocks
is fixed by the size classes and ``BLOCKS``, so a source of any size is spread evenly.

Defined results: null text has size 0; a null source is a source of its own and sorts last; a null id sorts last in
its block; repeated rows are rows of their own; a source without words has target 0 and emits nothing; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statwitness.llm.common import NON_SPACE, column, text_column

BLOCKS = 32


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_SPACE)).cast("bigint")


def size_class(size: Column) -> Column:
    """Number of digits and the two leading ones: classes are 1 to 10 % wide."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int")


def _hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source (``_key``, ``_size``): target size. Weights repeat along the sources in code-point order.
    The sources share the total by weight; none gets more than ``cap`` times its size, and what is cut goes to the
    others by weight. That is a common level per unit of weight, found by taking sources in the order in which they
    reach their cap."""
    ranked = sizes.withColumns({
        "_rank": F.row_number().over(W.orderBy(F.col("_key").asc_nulls_last())),
        "_total": F.sum("_size").over(W.partitionBy())})
    weighted = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                    ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    capped = weighted.withColumns({"_cap": F.col("_size") * cap,
                                   "_ratio": (F.col("_size") * cap).cast("double") / F.col("_w").cast("double")})
    by_ratio = W.orderBy("_ratio", "_rank")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    leveled = capped.withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double")
        / F.sum("_w").over(after).cast("double"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_level"))).over(W.partitionBy())
    return leveled.withColumn("_common", level["_level"]).select(
        "_key", "_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_common")).alias("_target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 17, text: str = "text",
        source: str = "source", doc_id: str = "doc_id", name: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``name``: size, source_size, target, expected, copies, taken."""
    size = n_words(text_column(text))
    # a text key instead of the null-able source: 's' before every source, null for the null source
    keyed = docs.withColumn(name, F.struct(
        F.coalesce(F.concat(F.lit("s"), column(source).cast("string")), F.lit("null")).alias("_key"), size.alias("_size"),
        size_class(size).alias("_class"),
        (F.coalesce(_hex_number(column(doc_id).cast("string"), 4), F.lit(0)) % BLOCKS).cast("int").alias("_block")))
    part = {c: F.col(f"{name}.{c}") for c in ("_key", "_class", "_block")}
    light = keyed.select(*[c.alias(n) for n, c in part.items()], F.col(f"{name}._size").alias("_n"))
    blocks = light.groupBy(*part).agg(F.count("*").alias("_rows"), F.sum("_n").alias("_words"))
    sources = blocks.groupBy("_key").agg(F.sum("_words").alias("_size"))
    # 'null' sorts before every 's...' key, so it is put last by hand
    targets = source_targets(sources.withColumn("_key", F.when(F.col("_key") != "null", F.col("_key"))), weights, cap)
    targets = targets.withColumn("_key", F.coalesce("_key", F.lit("null")))
    along = W.partitionBy("_key").orderBy("_class", "_block").rowsBetween(W.unboundedPreceding, -1)
    plan = (
        blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(along), F.lit(0)))
        .join(targets, "_key")
        .select(*part, F.struct(
            "_before", F.col("_size").alias("_source_size"), "_target",
            F.when(F.col("_size") > 0, F.col("_target") / F.col("_size").cast("double")).otherwise(F.lit(0.0)).alias("_expected"),
            (_hex_number(F.concat(F.lit(f"{seed}:"), F.col("_key")), 5) / F.lit(1048576.0)).alias("_offset")).alias("_plan")))
    inner = W.partitionBy(*part.values()).orderBy(column(doc_id).asc_nulls_last(), F.xxhash64(text_column(text)))
    numbered = keyed.withColumn(name, F.struct(f"{name}.*", F.row_number().over(inner).alias("_row")))
    joined = numbered.alias("d").join(plan.alias("p"), [part[c] == F.col(f"p.{c}") for c in part]).select("d.*", F.col("p._plan").alias(f"{name}_plan"))
    p, m = F.col(f"{name}_plan"), F.col(name)
    at = (p["_before"] + m["_row"]).cast("double")
    crossed = F.floor(p["_offset"] + p["_expected"] * at) - F.floor(p["_offset"] + p["_expected"] * (at - 1))
    copies = F.least(crossed, F.ceil(p["_expected"])).cast("bigint")
    return joined.withColumn(name, F.struct(
        m["_size"].alias("size"), p["_source_size"].alias("source_size"), p["_target"].alias("target"),
        p["_expected"].alias("expected"), copies.alias("copies"), (copies * m["_size"]).alias("taken"))).drop(f"{name}_plan")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: every row as often as it is taken, with the columns of ``docs``."""
    name = options.setdefault("name", "mix_of_sources")
    mixed = mix(docs, **options).filter(F.col(f"{name}.copies") > 0)
    return mixed.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).select(*[column(c) for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'null') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
c AS (
  SELECT *, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS cls,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT, 0) % 32 AS block FROM d),
s AS (
  SELECT k, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY k = 'null', k) AS rank FROM c GROUP BY k),
w AS (
  SELECT *, [5, 2, 1][(rank - 1) % 3 + 1]::BIGINT AS w, size * 3 AS cap, sum(size) OVER ()::BIGINT AS total FROM s),
r AS (SELECT *, cap::DOUBLE / w::DOUBLE AS ratio FROM w),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
t AS (
  SELECT k, size AS source_size,
         least(cap::DOUBLE, w::DOUBLE * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1)) AS target,
         ('0x' || substr(md5('17:' || k), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS expected FROM t),
p AS (
  SELECT doc_id, size, source_size, target, expected, u,
         (row_number() OVER (PARTITION BY c.k ORDER BY cls, block, doc_id))::DOUBLE AS pos FROM c JOIN e ON c.k = e.k)
SELECT doc_id, size, source_size, target,
       (least(floor(u + expected * pos) - floor(u + expected * (pos - 1)), ceil(expected))::BIGINT * size)::BIGINT AS taken FROM p
"""
