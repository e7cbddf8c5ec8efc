"""Order-dependent columns over groups of any size.

A plain window over a group puts the whole group into one task. Here each group is cut into
consecutive blocks (pages, hours, runs of positions). A window runs inside (group, block), one
summary row per block carries the rest, and only those summary rows meet in a window over the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _inner(keys: Sequence[str], block: str, order: Sequence[Column]):
    return W.partitionBy(*keys, block).orderBy(*order)


def _running(window):
    return window.rowsBetween(W.unboundedPreceding, W.currentRow)


def _before(keys: Sequence[str], block: str):
    return W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)


def running_sum(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column],
                value: Column, name: str) -> DataFrame:
    """Sum of ``value`` from the start of the group up to this row, in order."""
    inside = df.withColumn("_v", value).withColumn(
        name, F.sum("_v").over(_running(_inner(keys, block, order))))
    carry = (
        inside.groupBy(*keys, block).agg(F.sum("_v").alias("_t"))
        .withColumn("_c", F.coalesce(F.sum("_t").over(_before(keys, block)), F.lit(0)))
        .drop("_t")
    )
    return (
        inside.join(carry, [*keys, block])
        .withColumn(name, F.col(name) + F.col("_c")).drop("_v", "_c")
    )


def row_number(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column],
               name: str) -> DataFrame:
    """1-based position of the row in its group."""
    return running_sum(df, keys, block, order, F.lit(1), name)


def last_before(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column],
                values: dict[str, Column]) -> DataFrame:
    """For each name: the nearest earlier non-null value in the group (null if none)."""
    inner = _inner(keys, block, order)
    held = df
    for name, value in values.items():
        held = held.withColumn(f"_v_{name}", value)
    inside = held
    for name in values:
        inside = inside.withColumn(
            name, F.last(f"_v_{name}", ignorenulls=True).over(
                inner.rowsBetween(W.unboundedPreceding, -1)))
    position = F.struct(*order)
    carry = held.groupBy(*keys, block).agg(*[
        F.max_by(f"_v_{name}", F.when(F.col(f"_v_{name}").isNotNull(), position)).alias(f"_l_{name}")
        for name in values])
    for name in values:
        carry = carry.withColumn(
            f"_c_{name}", F.last(f"_l_{name}", ignorenulls=True).over(_before(keys, block)))
    carry = carry.select(*keys, block, *[f"_c_{name}" for name in values])
    out = inside.join(carry, [*keys, block])
    for name in values:
        out = out.withColumn(name, F.coalesce(name, f"_c_{name}"))
    return out.drop(*[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def next_value(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column],
               value: Column, name: str) -> DataFrame:
    """The (non-null) value of the following row of the group; null on the last row."""
    held = df.withColumn("_v", value)
    inside = held.withColumn(name, F.lead("_v").over(_inner(keys, block, order)))
    carry = (
        held.groupBy(*keys, block).agg(F.min_by("_v", F.struct(*order)).alias("_f"))
        .withColumn("_c", F.lead("_f").over(W.partitionBy(*keys).orderBy(block))).drop("_f")
    )
    return (
        inside.join(carry, [*keys, block])
        .withColumn(name, F.coalesce(name, "_c")).drop("_v", "_c")
    )


def previous_value(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column],
                   values: dict[str, str]) -> DataFrame:
    """For each name: the value (never null) of that column on the row before; null on the first row."""
    inner = _inner(keys, block, order)
    inside = df.withColumns({name: F.lag(column).over(inner) for name, column in values.items()})
    last = df.groupBy(*keys, block).agg(F.max_by(F.struct(*values.values()), F.struct(*order)).alias("_l"))
    carry = last.select(*keys, block, F.lag("_l").over(W.partitionBy(*keys).orderBy(block)).alias("_c"))
    return inside.join(carry, [*keys, block]).withColumns({
        name: F.coalesce(name, F.col("_c")[column]) for name, column in values.items()}).drop("_c")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          name: str = "rank") -> DataFrame:
    """First ``n`` rows of each group. Every task keeps at most n rows per group before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)
