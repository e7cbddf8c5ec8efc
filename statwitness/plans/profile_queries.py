"""Profiling queries: every column of lineitem, orders, part and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from statwitness.operators import profile as O, sketches as S
from statwitness.plans.registry import query
from statwitness.session import materialise, new_folder


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def text_tables(load) -> dict[str, DataFrame]:
    """The four tables with every column as text, as a CSV reader would give them."""
    s = lambda c: F.col(c).cast("string").alias(c)
    return {
        "lineitem": load("lineitem").select(
            *map(s, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]),
            day("l_shipdate").alias("l_shipdate"),
            F.when(F.col("l_quantity") < 5, "c").when(F.col("l_tax") >= 0.08, "z")
            .otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity_reported")),
        "orders": load("orders").select(
            *map(s, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]),
            day("o_orderdate").alias("o_orderdate"), s("o_orderpriority"),
            F.date_format("o_orderdate", "yyyy").alias("order_year"),
            F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("is_final"),
            F.when(F.col("o_totalprice") > 250000, "N/A").when(F.col("o_totalprice") > 240000, "Total")
            .otherwise(F.col("o_orderpriority")).alias("checked_priority")),
        "part": load("part").select(
            *map(s, ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])),
        "events": load("events").select(
            s("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
            *map(s, ["user_id", "event_type", "value", "props"])),
    }


def cells(load) -> DataFrame:
    parts = [O.long_values(df, name) for name, df in text_tables(load).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts(load) -> DataFrame:
    parts = [O.table_value_counts(df, name) for name, df in text_tables(load).items()]
    return reduce(DataFrame.unionByName, parts)


_TABLES = {
    "lineitem": ("lineitem", [
        ("l_orderkey",) * 2, ("l_partkey",) * 2, ("l_suppkey",) * 2, ("l_linenumber",) * 2,
        ("l_quantity",) * 2, ("l_extendedprice",) * 2, ("l_discount",) * 2, ("l_tax",) * 2,
        ("l_returnflag",) * 2, ("l_linestatus",) * 2,
        ("l_shipdate", "strftime(l_shipdate,'%Y-%m-%d')"),
        ("quantity_reported", "CASE WHEN l_quantity < 5 THEN 'c' WHEN l_tax >= 0.08 THEN 'z' "
                              "ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END")]),
    "orders": ("orders", [
        ("o_orderkey",) * 2, ("o_custkey",) * 2, ("o_orderstatus",) * 2, ("o_totalprice",) * 2,
        ("o_orderdate", "strftime(o_orderdate,'%Y-%m-%d')"), ("o_orderpriority",) * 2,
        ("order_year", "strftime(o_orderdate,'%Y')"),
        ("is_final", "CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END"),
        ("checked_priority", "CASE WHEN o_totalprice > 250000 THEN NULL WHEN o_totalprice > 240000 "
                             "THEN 'Total' ELSE o_orderpriority END")]),
    "part": ("part", [(c, c) for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]]),
    "events": ("events", [
        ("event_id",) * 2, ("ts", "strftime(ts,'%Y-%m-%d %H:%M:%S.%f')"), ("user_id",) * 2,
        ("event_type",) * 2, ("value",) * 2, ("props",) * 2]),
}

NUM = r"regexp_full_match({0}, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')"
INT = r"regexp_full_match({0}, '\s*[+-]?[0-9]+\s*')"
TIME = "regexp_matches(lower(column_name), 'year|period|date|time|quarter|month')"

CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_id, {i} AS col_no, '{name}' AS column_name, CAST({expr} AS VARCHAR) AS value FROM {src}"
    for t, (src, cols) in _TABLES.items() for i, (name, expr) in enumerate(cols, 1)) + ")"

STATS = CELLS + f""",
stats0 AS (
  SELECT table_id, col_no, column_name, count(*) AS n_rows, count(value) AS n_non_null,
         count(DISTINCT value) AS n_distinct,
         count(*) FILTER (WHERE {NUM.format('value')}) AS n_numeric,
         count(*) FILTER (WHERE {INT.format('value')}) AS n_integer,
         count(*) FILTER (WHERE lower(value) IN ('true','false')) AS n_bool
  FROM cells GROUP BY ALL),
stats AS (
  SELECT *, CASE WHEN n_numeric = n_non_null THEN CASE WHEN n_non_null = n_rows AND n_integer = n_rows
                 THEN 'int' ELSE 'float' END
                 WHEN n_bool = n_rows THEN 'bool' ELSE 'text' END AS kind
  FROM stats0),
roles AS (
  SELECT *, (kind = 'text' AND n_numeric * 1.0 / n_rows >= 0.3) AS numeric_with_suppression,
    CASE WHEN kind IN ('int','float') AND n_distinct * 1.0 / n_rows > 0.5 THEN 'metric'
         WHEN kind IN ('int','float') THEN 'filter'
         WHEN kind = 'bool' THEN 'unknown'
         WHEN n_numeric * 1.0 / n_rows >= 0.3 THEN 'metric'
         WHEN n_distinct < 50 THEN 'filter' ELSE 'identifier' END AS role
  FROM stats)"""

SAMPLES = STATS + f""",
vc AS (SELECT table_id, col_no, column_name, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL),
freq AS (
  SELECT table_id, col_no, column_name, value, n, n_distinct,
         row_number() OVER (PARTITION BY table_id, col_no ORDER BY n DESC, value) AS ordinal
  FROM vc JOIN roles USING (table_id, col_no, column_name) WHERE kind = 'text' AND NOT {TIME}),
samples AS (
  SELECT table_id, col_no, column_name, value, n, CAST(NULL AS BIGINT) AS ordinal
  FROM vc JOIN roles USING (table_id, col_no, column_name)
  WHERE {TIME} AND kind IN ('int','float','text')
  UNION ALL
  SELECT table_id, col_no, column_name, value, n, ordinal FROM freq
  WHERE ordinal <= CASE WHEN n_distinct <= 20 THEN 20 ELSE 10 END),
lists AS (
  SELECT table_id, col_no, column_name,
         string_agg(value, '|' ORDER BY ordinal, CASE WHEN kind IN ('int','float') THEN TRY_CAST(value AS DOUBLE) END, value) AS sample_values
  FROM samples JOIN (SELECT table_id, col_no, column_name, kind FROM roles) USING (table_id, col_no, column_name) GROUP BY ALL)"""


@query("column_stats", f"WITH {STATS} SELECT table_id, column_name, n_rows, n_non_null, n_distinct, n_numeric FROM stats")
def _(load):
    return O.column_stats(counts(load)).select(
        "table_id", "column_name", "n_rows", "n_non_null", "n_distinct", "n_numeric")


@query("is_numeric_with_suppression",
       f"WITH {STATS} SELECT table_id, column_name, numeric_with_suppression FROM roles")
def _(load):
    return O.is_numeric_with_suppression(O.column_stats(counts(load))).select(
        "table_id", "column_name", "numeric_with_suppression")


@query("infer_column_role", f"WITH {STATS} SELECT table_id, column_name, kind, role FROM roles")
def _(load):
    return O.infer_column_role(O.column_stats(counts(load))).select("table_id", "column_name", "kind", "role")


@query("get_sample_values", f"WITH {SAMPLES} SELECT table_id, column_name, value, n, ordinal FROM samples")
def _(load):
    vc = materialise(counts(load))
    return O.sample_values(vc, O.column_stats(vc)).select("table_id", "column_name", "value", "n", "ordinal")


@query("is_time_column",
       f"WITH {CELLS} SELECT DISTINCT table_id, column_name, {TIME} AS is_time, "
       f"CAST(count(value) OVER (PARTITION BY table_id, col_no) AS BIGINT) AS n_values FROM cells")
def _(load):
    return (
        O.column_stats(counts(load))
        .select("table_id", "column_name", O.is_time_column(F.col("column_name")).alias("is_time"),
                F.col("n_non_null").alias("n_values"))
    )


@query("table_metadata", f"""WITH {SAMPLES}
SELECT table_id || '.csv' AS filename, max(n_rows) AS row_count, count(*) AS column_count,
       string_agg(column_name || ':' || kind || ':' || role || ':' || coalesce(sample_values, 'None'), ';' ORDER BY col_no)
         AS columns
FROM roles LEFT JOIN lists USING (table_id, col_no, column_name) GROUP BY table_id""")
def _(load):
    line = lambda c: F.concat_ws(
        ":", c["name"], c["type"], c["role"], F.coalesce(F.array_join(c["sample_values"], "|"), F.lit("None")))
    return O.table_metadata(O.column_profile(counts(load))).select(
        "filename", "row_count", "column_count", F.array_join(F.transform("columns", line), ";").alias("columns"))


@query("profile_summary", f"""WITH {SAMPLES}
SELECT table_id,
  coalesce(string_agg(column_name || ': [' || coalesce(replace(sample_values, '|', ', '), '') || ']', '; ' ORDER BY col_no)
           FILTER (WHERE role = 'filter'), '') AS filter_columns,
  count(*) FILTER (WHERE role = 'metric') AS n_metrics
FROM roles LEFT JOIN lists USING (table_id, col_no, column_name) GROUP BY table_id""")
def _(load):
    return O.profile_summary(O.column_profile(counts(load))).withColumn(
        "filter_columns", F.array_join("filter_columns", "; "))


@query("numeric_summary", f"""WITH {CELLS}
SELECT table_id, column_name, count(*) AS n, round(min(x), 2) AS min_value, round(max(x), 2) AS max_value,
       round(sum(x), 2) AS sum_value, round(avg(x), 3) AS mean_value, round(stddev_samp(x), 3) AS std_value
FROM (SELECT table_id, col_no, column_name, CAST(trim(value) AS DOUBLE) AS x FROM cells WHERE {NUM.format('value')})
GROUP BY table_id, col_no, column_name""")
def _(load):
    r = lambda c, d: F.round(c, d).alias(c)
    return O.numeric_summary(cells(load)).select(
        "table_id", "column_name", "n", r("min_value", 2), r("max_value", 2), r("sum_value", 2),
        r("mean_value", 3), r("std_value", 3))


@query("aggregate_value", f"""WITH {SAMPLES}
SELECT table_id, column_name, arg_min(value, coalesce(ordinal, 0)) AS aggregate_value
FROM samples JOIN roles USING (table_id, col_no, column_name)
WHERE role = 'filter' AND lower(value) IN ('total','all','national','overall') GROUP BY ALL""")
def _(load):
    vc = materialise(counts(load))
    stats = O.infer_column_role(O.column_stats(vc))
    return O.aggregate_value(O.sample_values(vc, stats), stats).select("table_id", "column_name", "aggregate_value")


@query("suppression_profile", f"""WITH {CELLS}
SELECT table_id, column_name, value AS marker, count(*) AS n FROM cells
WHERE value IN ('c','z','x','.','C','Z','X') GROUP BY ALL""")
def _(load):
    return O.suppression_profile(counts(load)).select("table_id", "column_name", "marker", "n")


@query("united_profile", f"""WITH {STATS} SELECT table_id, column_name, n_rows, n_non_null, n_numeric, kind, TRUE AS distinct_within, TRUE AS counts_within FROM stats""")
def _(load):
    """Profiles of the cells dealt over seven files, stored in two arrivals and united; estimates are held against exact counts."""
    dealt = materialise(cells(load).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(7)).cast("int")))
    path = new_folder(load.spark, "summaries")
    for arriving in (dealt.filter("part < 4"), dealt.filter("part >= 4")):
        S.save_summaries(*S.summarise(arriving, F.col("part")), path)
    columns, values = S.read_summaries(load.spark, path)
    exact = materialise(O.value_counts(dealt))
    distinct = exact.groupBy(*O.KEYS).agg(F.count("value").alias("true_distinct"))
    held = S.united_values(columns, values).join(exact.select(*O.KEYS, "value", "n"), [*O.KEYS, "value"]).groupBy(*O.KEYS).agg(
        F.bool_and(F.col("n").between(F.col("n_low"), F.col("n_high"))).alias("counts_within"))
    near = F.abs(F.col("n_distinct") - F.col("true_distinct")) <= F.col("true_distinct") * S.distinct_error() + 1
    return S.united_columns(columns).join(distinct, O.KEYS).join(held, O.KEYS, "left").select(
        "table_id", "column_name", "n_rows", "n_non_null", "n_numeric", "kind", near.alias("distinct_within"), F.coalesce("counts_within", F.lit(True)).alias("counts_within"))
