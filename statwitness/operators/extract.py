"""Table extraction: from a headline's paragraphs to the small table behind it.

An extraction is described by a spec (metrics, breakdown column and values, scope filters) instead of
generated code. ``extract_tables`` runs all specs over all tables in one plan; the long form
(metric, time, breakdown, value) is canonical and pivots happen only at the edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statwitness import params as P
from statwitness.functions import text as T
from statwitness.operators.ordered import top_n
from statwitness.operators.phrases import phrase_hits
from statwitness.session import materialise

TABLE_SALTS = 64  # parts of a table's rows that meet its specs' column sets apart from each other

# ---- finding metrics, filter values and the breakdown -----------------------------------------


def match_metrics(paragraphs: DataFrame, phrases: DataFrame, columns: DataFrame) -> DataFrame:
    """Metrics whose phrase occurs in the paragraph text and that exist as a column of its table.

    paragraphs(headline_id, table_id, paragraph), phrases(phrase, metric), columns(table_id, column_name).
    """
    known = phrases.join(columns.select("table_id", F.col("column_name").alias("metric")), "metric").select("table_id", "phrase", F.col("metric").alias("hit"))
    return phrase_hits(paragraphs, known, ["headline_id"], "paragraph", whole_words=False).withColumnRenamed("hit", "metric")


def match_filter_values(paragraphs: DataFrame, samples: DataFrame) -> DataFrame:
    """Filter values mentioned as whole words, case-insensitively; the stored spelling is returned.

    samples(table_id, column_name, value): the sample values of the profile.
    """
    known = samples.select("table_id", F.col("value").alias("phrase"), F.struct("column_name", "value").alias("hit"))
    return phrase_hits(paragraphs, known, ["headline_id"], "paragraph", whole_words=True).select("headline_id", "table_id", "hit.column_name", "hit.value")


def choose_breakdown(matches: DataFrame) -> DataFrame:
    """The column holding most of the compared values (at least two, aggregates not counted)."""
    per_column = (
        matches.filter(~F.lower("value").isin(P.AGGREGATE_WORDS))
        .groupBy("headline_id", "table_id", "column_name")
        .agg(F.array_sort(F.collect_set("value")).alias("values"))
        .withColumn("n_values", F.size("values")).filter(F.col("n_values") >= 2)
    )
    return top_n(per_column, ["headline_id", "table_id"], [F.desc("n_values"), F.asc("column_name")], 1).drop("rank")


# ---- single table operators ----------------------------------------------------------------------


def filter_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def filter_aggregate_scope(df: DataFrame, aggregate_values: dict[str, str], breakdowns: Sequence[str]) -> DataFrame:
    """Fix every other filter column that has an aggregate value to it."""
    for column, value in aggregate_values.items():
        if column in df.columns and column not in breakdowns:
            df = df.filter(F.col(column) == value)
    return df


def exclude_total(df: DataFrame, breakdowns: Sequence[str]) -> DataFrame:
    """Drop total rows of the breakdown columns; missing values stay."""
    for column in breakdowns:
        if column in df.columns:
            df = df.filter(F.col(column).isNull() | (F.col(column) != "Total"))
    return df


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def melt(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide to long; metrics become text first because markers and numbers share the column."""
    text = [F.col(m).cast("string").alias(m) for m in metrics]
    return df.select(*ids, *text).unpivot(list(ids), list(metrics), "metric", "value")


def pivot_first(long: DataFrame, index: Sequence[str], column: str, values: Sequence[str],
                order: Sequence[str]) -> DataFrame:
    """Long to wide: the first non-null value per cell, by ``order``; all-null rows and columns are dropped.

    Which columns have a value is only known from the result, so it is written once."""
    first = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(*order)))
    wide = materialise(long.groupBy(*index).pivot(column, list(values)).agg(first).filter(F.coalesce(*[F.col(f"`{v}`") for v in values]).isNotNull()))
    held = wide.agg(*[F.count(F.col(f"`{v}`")).alias(f"c{i}") for i, v in enumerate(values)]).first()
    return wide.select(*index, *[F.col(f"`{v}`") for v, n in zip(values, held) if n])


def pivot_hierarchical(long: DataFrame, index: Sequence[str], major: str, minor: str,
                       keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As ``pivot_first`` with column keys ``major / minor``."""
    joined = long.withColumn("_key", F.concat_ws(" / ", major, minor))
    return pivot_first(joined, index, "_key", keys, order)


def first_cells(long: DataFrame, index: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """The pivot in long form: one row per (index, column), any number of column keys."""
    return (
        long.filter(F.col("value").isNotNull()).groupBy(*index, column)
        .agg(F.min_by("value", F.struct(*order)).alias("value"))
    )


def label_metrics(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Readable label per metric; a metric without one keeps its name."""
    return df.join(labels.select("metric", "label"), "metric", "left").withColumn(
        "label", F.coalesce("label", "metric"))


def with_percent(label: Column, value: Column) -> Column:
    """``95.0`` under a Percentage label becomes ``95%``; markers and nulls stay."""
    shown = T.plain_number(value)
    return F.when(value.isNull() | value.isin(P.SUPPRESSION_MARKERS), value).when(
        F.contains(label, F.lit("Percentage")), F.concat(shown, F.lit("%"))).otherwise(shown)


def format_percent(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    return df.withColumns({c: with_percent(F.col(label), F.col(f"`{c}`")) for c in columns})


def blank_repeats(df: DataFrame, keys: Sequence[str], metric: str, order: Sequence[str],
                  label: str = "label") -> DataFrame:
    """Show the metric's label on its first row only (tables here are already limited in rows)."""
    n = F.row_number().over(W.partitionBy(*keys, metric).orderBy(*order))
    return df.withColumn(label, F.when(n == 1, F.col(label)).otherwise(""))


def limit_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = P.TABLE_ROW_LIMIT) -> DataFrame:
    """At most n rows per table, in a stated order."""
    return top_n(df, keys, order, n, "row_no")


def confidence(row_count: Column, column_count: Column) -> Column:
    """Score of a table by its size, counted in tenths to stay exact."""
    tenths = (
        F.lit(5) + F.when(row_count > 0, 2).otherwise(0)
        + F.when(row_count.between(10, 50), 2).when(row_count > 50, 1).otherwise(0)
        + F.when(column_count.between(2, 10), 1).otherwise(0)
    )
    return F.least(tenths, F.lit(10)) / 10.0


def extraction_confidence(headlines: DataFrame, rows: DataFrame, column_count: Column) -> DataFrame:
    """Confidence per headline; headlines without rows count as empty, failed ones as 0."""
    sizes = rows.groupBy("headline_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.max(column_count).alias("column_count"))
    out = headlines.join(sizes, "headline_id", "left").fillna(0, ["row_count", "column_count"])
    score = confidence(F.col("row_count"), F.col("column_count"))
    return out.withColumn("confidence", F.when(F.col("error").isNull(), score).otherwise(0.0))


# ---- logged code snippets -----------------------------------------------------------------------

_ISIN_BRACKET = r"df\[['\"](\w+)['\"]\]\.isin\(\[(.*?)\]\)"
_ISIN_DOT = r"df\.(\w+)\.isin\(\[(.*?)\]\)"


def filters_applied(code: Column) -> Column:
    """Map column -> values of the ``isin`` filters in a snippet; a later filter replaces an earlier one."""

    def entries(pattern: str) -> Column:
        names = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
        lists = F.regexp_extract_all(code, F.lit(pattern), F.lit(2))
        return F.zip_with(names, lists, lambda n, v: F.struct(n.alias("key"), v.alias("raw")))

    both = F.concat(entries(_ISIN_BRACKET), entries(_ISIN_DOT))
    last = F.filter(both, lambda e, i: ~F.exists(
        F.slice(both, i + 2, F.size(both)), lambda later: later["key"] == e["key"]))

    def values(raw: Column) -> Column:
        parts = F.filter(F.transform(F.split(raw, ","), T.strip), lambda v: v != "")
        return F.transform(parts, lambda v: F.regexp_replace(v, r"^['\"]+|['\"]+$", ""))

    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], values(e["raw"]))))


def flag_unsafe_snippets(snippets: DataFrame) -> DataFrame:
    """Audit of logged code: import lines, and risky words outside comments."""
    bare = F.lower(F.regexp_replace("code", r"#[^\n]*", ""))
    found = F.filter(F.array(*[F.lit(k) for k in P.UNSAFE_KEYWORDS]), lambda k: F.contains(bare, k))
    return snippets.withColumns({
        "has_import": F.col("code").rlike(r"(?m)^\s*(import|from)\s+"),
        "keywords": found,
    }).withColumn("unsafe", F.col("has_import") | (F.size("keywords") > 0))


# ---- many headlines at once ---------------------------------------------------------------------


def extraction_context(headlines: DataFrame, profile: DataFrame) -> DataFrame:
    """What a reviewer needs next to a headline: first paragraphs and the usable columns of its table."""
    role = F.col("role")
    line = F.when(
        (role == "filter") & (F.size("sample_values") > 0),
        F.concat(F.lit(" - "), "column_name", F.lit(": "), "kind", F.lit(" (sample values: ["),
                 F.array_join("sample_values", ", "), F.lit("])")),
    ).when(role == "metric", F.concat(
        F.lit(" - "), "column_name", F.lit(": ("), "kind", F.lit(", metric): Numeric column for analysis")))
    columns = profile.groupBy("table_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("col_no", line.alias("line"))))),
        lambda s: s["line"]), "\n").alias("columns_text"))
    return headlines.join(columns, "table_id", "left").select(
        "headline_id", "headline_text",
        F.array_join(F.slice("paragraphs", 1, P.CONTEXT_PARAGRAPHS), "\n").alias("paragraphs_text"),
        F.coalesce("columns_text", F.lit("")).alias("columns_text"))


def build_specs(headlines: DataFrame, metrics: DataFrame, breakdowns: DataFrame,
                aggregates: DataFrame) -> DataFrame:
    """One spec per headline; ``error`` says why there is none.

    breakdowns as ``choose_breakdown`` gives them (column_name, values), or with several levels (``hierarchy.choose_breakdowns``: columns,
    keys, implied); aggregates(table_id, column_name, aggregate_value): scope filter per filter column. Columns of the breakdown,
    and those whose value it implies, are no scope.
    """
    if "keys" not in breakdowns.columns:
        breakdowns = breakdowns.withColumns({
            "columns": F.array("column_name"), "keys": F.transform("values", lambda v: F.array(v)), "implied": F.array().cast("array<string>")})
    scope = aggregates.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("column_name", "aggregate_value"))).alias("all_scope"))
    wanted = metrics.groupBy("headline_id", "table_id").agg(F.array_sort(F.collect_set("metric")).alias("metrics"))
    out = (
        headlines.join(wanted, ["headline_id", "table_id"], "left")
        .join(breakdowns.select("headline_id", "table_id", "columns", "keys", "implied"), ["headline_id", "table_id"], "left")
        .join(scope, "table_id", "left")
    )
    fixed = F.filter(F.coalesce("all_scope", F.array()), lambda s: ~F.array_contains(F.concat("columns", "implied"), s["column_name"]))
    return out.withColumn("scope", fixed).drop("all_scope", "implied").withColumn(
        "error",
        F.when(F.col("metrics").isNull(), "No metric found")
        .when(F.col("columns").isNull(), "No breakdown found"))


def extract_tables(specs: DataFrame, data: DataFrame, labels: DataFrame, time_column: str) -> DataFrame:
    """Run every spec over its table: one output row per (headline, metric, time); a cell's name is its breakdown value, or
    ``major / minor`` for a breakdown of two levels.

    data(table_id, row_no, values MAP): rows of all tables. Equal specs are computed once. A spec is
    turned into the exact key values its rows must have, so data rows meet specs by equality only. A data row
    gets one key per set of columns that specs of its table use; the sets are few per table and reach all rows of it, so
    they are sent along with each salt of the table's rows instead of drawing the table into one task.
    """
    good = specs.filter(F.col("error").isNull()).withColumn(
        "spec_id", F.sha2(F.to_json(F.struct("table_id", "metrics", "columns", "keys", "scope")), 256))
    distinct = good.select("spec_id", "table_id", "metrics", "columns", "keys", "scope").dropDuplicates(["spec_id"])
    used = F.concat(F.transform("scope", lambda s: s["column_name"]), F.col("columns"))
    fixed = F.transform("scope", lambda s: s["aggregate_value"])
    keyed = distinct.select("spec_id", "table_id", "metrics", used.alias("columns"), fixed.alias("fixed"), F.explode("keys").alias("breakdown")).select(
        "spec_id", "table_id", "metrics", "columns", F.concat("fixed", "breakdown").alias("key"), F.array_join("breakdown", " / ").alias("breakdown_value"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(TABLE_SALTS - 1))).alias("salt")
    signatures = keyed.groupBy("table_id").agg(F.collect_set("columns").alias("signatures")).select("table_id", "signatures", salts)
    salted = data.withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(TABLE_SALTS)).cast("int"))
    rows = (
        salted.join(signatures, ["table_id", "salt"]).select("table_id", "row_no", "values", F.explode("signatures").alias("columns"))
        .withColumn("key", F.transform("columns", lambda c: F.col("values")[c]))
    )
    matched = rows.join(keyed, ["table_id", "columns", "key"])
    long = matched.select(
        "spec_id", "row_no", F.col("breakdown_value"),
        F.col("values")[F.lit(time_column)].alias("time_value"),
        F.explode("metrics").alias("metric"), "values",
    ).withColumn("value", F.col("values")[F.col("metric")]).drop("values")
    cells = first_cells(long, ["spec_id", "metric", "time_value"], "breakdown_value", ["row_no"])
    labelled = label_metrics(cells, labels).withColumn("value", with_percent(F.col("label"), F.col("value")))
    table = labelled.groupBy("spec_id", "metric", "label", "time_value").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("breakdown_value", "value")))).alias("cells"))
    limited = limit_rows(table, ["spec_id"], [F.asc("metric"), F.asc("time_value")])
    shown = blank_repeats(limited, ["spec_id"], "metric", ["time_value"])
    # specs repeat and compress well: their file's size says nothing about the number of headlines
    return good.select("headline_id", "spec_id").hint("merge").join(shown, "spec_id")


def select_columns_used(tables: DataFrame, extracted_at: Column) -> DataFrame:
    """Per headline: the columns of its table in order, its row count, and the time of extraction."""
    keys = tables.select("headline_id", F.explode(F.map_keys("cells")).alias("c")).groupBy("headline_id").agg(
        F.array_sort(F.collect_set("c")).alias("breakdown_columns"))
    sizes = tables.groupBy("headline_id").agg(F.count(F.lit(1)).alias("row_count"))
    return sizes.join(keys, "headline_id").select(
        "headline_id", "row_count",
        F.concat(F.array(F.lit("metric"), F.lit("time_period")), "breakdown_columns").alias("columns_selected"),
        extracted_at.cast("string").alias("extracted_at"))
