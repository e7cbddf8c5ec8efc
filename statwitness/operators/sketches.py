"""Column profiles that add up: one small summary per file, united when files arrive.

A summary of a column in a file has exact counts of rows, numbers and so on, a HyperLogLog sketch of its distinct values, and its most
frequent values with their counts and the largest count that was left out. United, counts stay exact, distinct counts are estimates with a relative
standard error of 1.04 / sqrt(2 ** ``LOG_REGISTERS``), and the count of a value is a range: what was counted, and at most
the left-out bound more for every file that does not list it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statwitness.functions import text as T
from statwitness.operators.ordered import top_n
from statwitness.operators.profile import KEYS, _kind
from statwitness.session import materialise

LOG_REGISTERS = 14
LISTED = 64  # values listed per column and file
COUNTS = ["n_rows", "n_non_null", "n_numeric", "n_integer", "n_bool"]


def distinct_error(sigmas: float = 4.0) -> float:
    """Relative error of a distinct count that ``sigmas`` standard errors stay under."""
    return sigmas * 1.04 / math.sqrt(1 << LOG_REGISTERS)


def summarise(cells: DataFrame, part: Column, listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """(columns, values): per part (a file, say) and column the counts, sketch and left-out bound; and the listed values.

    cells(table_id, col_no, column_name, value). Values are counted per part, with map-side combining; only summaries go on.
    Both results read the counts and the ranks, which are written once."""
    value, keys = F.col("value"), ["part", *KEYS]
    counted = materialise(cells.withColumn("part", part).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")))
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    columns = counted.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), rows(value.isNotNull()).alias("n_non_null"), rows(value.rlike(T.NUMBER_PATTERN)).alias("n_numeric"),
        rows(value.rlike(T.INTEGER_PATTERN)).alias("n_integer"), rows(F.lower(value).isin("true", "false")).alias("n_bool"),
        F.hll_sketch_agg(value, F.lit(LOG_REGISTERS)).alias("sketch"))
    ranked = materialise(top_n(counted.filter(value.isNotNull()), keys, [F.desc("n"), F.asc("value")], listed + 1))
    left_out = ranked.filter(F.col("rank") == listed + 1).select(*keys, F.col("n").alias("left_out"))
    bounded = columns.join(left_out, keys, "left").fillna(0, ["left_out"])
    values = ranked.filter(F.col("rank") <= listed).drop("rank").join(left_out, keys, "left").fillna(0, ["left_out"])
    return bounded, values


def save_summaries(columns: DataFrame, values: DataFrame, path: str) -> None:
    """Add the summaries of new files; nothing that is stored is read."""
    columns.write.mode("append").parquet(f"{path}/columns")
    values.write.mode("append").parquet(f"{path}/values")


def read_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/columns"), spark.read.parquet(f"{path}/values")


def united_columns(columns: DataFrame) -> DataFrame:
    """table_id, col_no, column_name, exact counts, n_distinct (estimate), kind: over all summaries."""
    return columns.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"), F.sum("left_out").alias("left_out")).withColumn("kind", _kind())


def united_values(columns: DataFrame, values: DataFrame) -> DataFrame:
    """table_id, col_no, column_name, value, n_low, n_high: the range of each listed value's count."""
    bound = columns.groupBy(*KEYS).agg(F.sum("left_out").alias("_all"))
    seen = values.groupBy(*KEYS, "value").agg(F.sum("n").alias("n_low"), F.sum("left_out").alias("_own"))
    return seen.join(bound, KEYS).select(*KEYS, "value", "n_low", (F.col("n_low") + F.col("_all") - F.col("_own")).alias("n_high"))


def frequent_values(columns: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """The ``n`` values of each column with the highest counts for sure; ``certain`` where no other value can have more."""
    ranged = united_values(columns, values)
    top = top_n(ranged, KEYS, [F.desc("n_low"), F.asc("value")], n + 1)
    # a value that no file lists may still have the sum of the bounds
    unseen = columns.groupBy(*KEYS).agg(F.sum("left_out").alias("_unseen"))
    others = ranged.join(top.filter(F.col("rank") <= n).select(*KEYS, "value"), [*KEYS, "value"], "left_anti").groupBy(*KEYS).agg(F.max("n_high").alias("_other"))
    out = top.filter(F.col("rank") <= n).join(unseen, KEYS).join(others, KEYS, "left")
    return out.withColumn("certain", F.col("n_low") >= F.greatest("_unseen", F.coalesce("_other", F.lit(0)))).drop("_unseen", "_other")
