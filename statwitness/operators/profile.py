"""Column profiling: role, samples and suppression markers of every column of every table.

All tables are read as text, turned into (table_id, col_no, column_name, value) rows and counted once
per distinct value. Everything else is derived from those counts, so one shuffle serves all columns
and a very frequent value is combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statwitness import params as P
from statwitness.functions import text as T
from statwitness.operators.ordered import top_n
from statwitness.session import materialise

KEYS = ["table_id", "col_no", "column_name"]


def long_values(df: DataFrame, table_id: str) -> DataFrame:
    """One row per cell of a table whose columns are all text."""
    names = df.columns
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(None)) for c in names])
    return df.select(F.posexplode(cells).alias("pos", "value")).select(
        F.lit(table_id).alias("table_id"),
        (F.col("pos") + 1).alias("col_no"),
        F.element_at(F.array(*[F.lit(c) for c in names]), F.col("pos") + 1).alias("column_name"),
        T.na_to_null(F.col("value")).alias("value"),
    )


def value_counts(cells: DataFrame) -> DataFrame:
    """Rows per (column, value); null is one of the values."""
    return cells.groupBy(*KEYS, "value").agg(F.count(F.lit(1)).alias("n"))


def table_value_counts(df: DataFrame, table_id: str) -> DataFrame:
    """``value_counts`` of one table: rows are counted by column number and value, names are added to the counts."""
    names = df.columns
    cells = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in names])).alias("pos", "value"))
    counted = cells.groupBy("pos", T.na_to_null(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.lit(table_id).alias("table_id"), (F.col("pos") + 1).alias("col_no"),
        F.element_at(F.array(*[F.lit(c) for c in names]), F.col("pos") + 1).alias("column_name"), "value", "n")


def column_stats(counts: DataFrame) -> DataFrame:
    """Rows, non-null rows, distinct non-null values and rows that parse as numbers, per column."""
    value, n = F.col("value"), F.col("n")
    numeric = value.rlike(T.NUMBER_PATTERN)

    def rows_where(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).alias(name)

    stats = counts.groupBy(*KEYS).agg(
        F.sum("n").alias("n_rows"),
        rows_where(value.isNotNull(), "n_non_null"),
        F.count("value").alias("n_distinct"),
        rows_where(numeric, "n_numeric"),
        rows_where(value.rlike(T.INTEGER_PATTERN), "n_integer"),
        rows_where(F.lower(value).isin("true", "false"), "n_bool"),
    )
    return stats.withColumn("kind", _kind())


def approximate_column_stats(cells: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Same counts in one pass without shuffling values; distinct counts are estimates."""
    value = F.col("value")
    return cells.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("value").alias("n_non_null"),
        F.approx_count_distinct("value", rsd).alias("n_distinct"),
        F.count_if(value.rlike(T.NUMBER_PATTERN)).alias("n_numeric"),
        F.count_if(value.rlike(T.INTEGER_PATTERN)).alias("n_integer"),
        F.count_if(F.lower(value).isin("true", "false")).alias("n_bool"),
    ).withColumn("kind", _kind())


def _kind() -> Column:
    """The type a data frame library would give the column, from the counts."""
    full = F.col("n_non_null") == F.col("n_rows")
    return (
        F.when((F.col("n_rows") > 0) & (F.col("n_numeric") == F.col("n_non_null")),
               F.when(full & (F.col("n_integer") == F.col("n_rows")), "int").otherwise("float"))
        .when(full & (F.col("n_rows") > 0) & (F.col("n_bool") == F.col("n_rows")), "bool")
        .otherwise("text")
    )


def is_numeric_with_suppression(stats: DataFrame) -> DataFrame:
    """Text columns that are mostly numbers with markers in between."""
    share = F.try_divide(F.col("n_numeric"), F.col("n_rows"))
    return stats.withColumn(
        "numeric_with_suppression",
        F.coalesce((F.col("kind") == "text") & (share >= P.SUPPRESSION_NUMERIC_SHARE), F.lit(False)))


def infer_column_role(stats: DataFrame) -> DataFrame:
    """metric, filter, identifier or unknown."""
    distinct_share = F.try_divide(F.col("n_distinct"), F.col("n_rows"))
    number = F.col("kind").isin("int", "float")
    return is_numeric_with_suppression(stats).withColumn(
        "role",
        F.when(number & (distinct_share > P.METRIC_DISTINCT_SHARE), "metric")
        .when(number, "filter")
        .when(F.col("kind") == "bool", "unknown")
        .when(F.col("numeric_with_suppression"), "metric")
        .when(F.col("n_distinct") < P.FILTER_MAX_DISTINCT, "filter")
        .otherwise("identifier"))


def is_time_column(name: Column) -> Column:
    return F.lower(name).rlike("|".join(P.TIME_KEYWORDS))


def sample_values(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Sample values in long form: (table_id, col_no, column_name, value, n, ordinal).

    Time-like columns give every distinct value (order: the value itself, ordinal null, so no group
    is sorted in one task); other text columns give all values up to 20, else the 10 most frequent.
    """
    time_like = is_time_column(F.col("column_name"))
    known = stats.select(*KEYS, "kind", "n_distinct")
    rows = counts.filter(F.col("value").isNotNull()).join(known, KEYS)
    of_time = rows.filter(time_like & F.col("kind").isin("int", "float", "text")).select(
        *KEYS, "value", "n", F.lit(None).cast("int").alias("ordinal"))
    frequent = top_n(
        rows.filter(~time_like & (F.col("kind") == "text")),
        KEYS, [F.desc("n"), F.asc("value")], P.SAMPLE_ALL_MAX_DISTINCT, "ordinal",
    ).filter((F.col("n_distinct") <= P.SAMPLE_ALL_MAX_DISTINCT) | (F.col("ordinal") <= P.SAMPLE_TOP_N))
    return of_time.unionByName(frequent.select(*KEYS, "value", "n", "ordinal"))


def column_profile(counts: DataFrame) -> DataFrame:
    """One row per column: type, role and its samples as an array (null where there are none).

    A time-like column lists every distinct value at any size; consumers that need rows instead of the list
    take ``sample_values``. The counts are read several times and cost a scan of all tables, so they are written once.
    """
    counts = materialise(counts)
    stats = materialise(infer_column_role(column_stats(counts)))
    # numbers of a time-like number column in their own order, texts as texts
    numbers = stats.filter(F.col("kind").isin("int", "float")).select(*KEYS, F.lit(True).alias("numbers"))
    listed = sample_values(counts, stats).join(numbers, KEYS, "left")
    position = F.struct(
        F.col("ordinal"), F.when(F.col("numbers"), T.to_number(F.col("value"))).alias("num"), F.col("value").alias("value"))
    arrays = listed.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(position)), lambda s: s["value"]).alias("sample_values"))
    return stats.join(arrays, KEYS, "left")


def table_metadata(profile: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One document per table: rows, columns and the profile of each column in column order."""
    entry = F.struct(
        "col_no", F.col("column_name").alias("name"), F.col("kind").alias("type"), "role", "sample_values")
    meta = profile.groupBy("table_id").agg(
        F.max("n_rows").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.array_sort(F.collect_list(entry)).alias("columns"))
    meta = meta.withColumn("filename", F.concat("table_id", F.lit(".csv")))
    return meta if files is None else meta.drop("filename").join(files, "table_id", "left")


def profile_summary(profile: DataFrame) -> DataFrame:
    """Per table: its filter columns with samples, and how many metric columns it has."""
    line = F.concat(
        F.col("column_name"), F.lit(": ["),
        F.array_join(F.coalesce("sample_values", F.array().cast("array<string>")), ", "), F.lit("]"))
    return profile.groupBy("table_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("role") == "filter", F.struct("col_no", line.alias("line"))))),
            lambda s: s["line"]).alias("filter_columns"),
        F.count_if(F.col("role") == "metric").alias("n_metrics"))


def numeric_summary(cells: DataFrame) -> DataFrame:
    """Min, max, sum, mean and standard deviation of the numbers of each column."""
    num = T.to_number(F.col("value"))
    return (
        cells.withColumn("num", num).filter(F.col("num").isNotNull()).groupBy(*KEYS)
        .agg(F.count("num").alias("n"), F.min("num").alias("min_value"), F.max("num").alias("max_value"),
             F.sum("num").alias("sum_value"), F.avg("num").alias("mean_value"),
             F.stddev("num").alias("std_value"))
    )


def aggregate_value(samples: DataFrame, roles: DataFrame) -> DataFrame:
    """For each filter column the value that means "everything" (Total, All, National, Overall)."""
    return (
        samples.filter(F.lower("value").isin(P.AGGREGATE_WORDS))
        .join(roles.filter(F.col("role") == "filter").select(*KEYS), KEYS, "left_semi")
        .groupBy(*KEYS)
        .agg(F.min_by("value", F.struct("ordinal", "value")).alias("aggregate_value"))
    )


def suppression_profile(counts: DataFrame) -> DataFrame:
    """How often each suppression marker occurs in each column."""
    return (
        counts.filter(F.col("value").isin(P.SUPPRESSION_MARKERS))
        .groupBy(*KEYS, F.col("value").alias("marker")).agg(F.sum("n").alias("n"))
    )
