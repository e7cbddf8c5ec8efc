"""Extraction queries: a shipment statistics table built from the order tables, and one report
headline per customer that talks about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness.operators import extract as O, profile as PR
from statwitness.plans.profile_queries import CELLS, SAMPLES
from statwitness.plans.registry import query
from statwitness.session import materialise

DIMS = ["returnflag", "region", "nation", "geographic_level", "time_period"]
METRICS = ["quantity_average", "discounted_percent", "taxed_percent"]
LABELS = [
    ("quantity_average", "Average quantity per line"),
    ("discounted_percent", "Percentage of lines sold at a discount"),
]
PHRASES = [
    ("average quantity", "quantity_average"),
    ("sold at a discount", "discounted_percent"),
    ("taxed in full", "taxed_percent"),
    ("shipped late", "late_percent"),
]
AGGREGATES = {"returnflag": "Total", "region": "Total", "nation": "Total", "geographic_level": "National"}


def shipments(load) -> DataFrame:
    """Shipment statistics by return flag, region, nation and year, with total rows and markers."""
    lines = load("lineitem").join(load("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    year = F.year("l_shipdate")
    measures = [
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"),
        F.count_if(F.col("l_discount") > 0.05).alias("d"), F.count_if(F.col("l_tax") >= 0.08).alias("t"),
    ]
    sums = [F.sum(c).alias(c) for c in ["n", "q", "d", "t"]]
    # Reduce to one row per customer, flag and year before the dimension joins.
    fine = (
        lines.groupBy("o_custkey", "l_returnflag", year.alias("y")).agg(*measures)
        .join(load("customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "l_returnflag", "y").agg(*sums)
        .join(load("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(load("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    total = F.lit("Total")
    levels = F.array(
        F.struct(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.lit("Local").alias("geographic_level")),
        F.struct(F.col("r_name").alias("region"), total.alias("nation"), F.lit("Regional").alias("geographic_level")),
        F.struct(total.alias("region"), total.alias("nation"), F.lit("National").alias("geographic_level")))
    cube = (
        fine.withColumn("returnflag", F.explode(F.array("l_returnflag", total))).withColumn("g", F.explode(levels))
        .groupBy("returnflag", "g.region", "g.nation", "g.geographic_level", "y").agg(*sums)
    )
    n = F.col("n")
    tenths = F.expr("(20 * q + n) div (2 * n)")
    percent = lambda c: F.expr(f"(200 * {c} + n) div (2 * n)").cast("string")
    return cube.select(
        "returnflag", "region", "nation", "geographic_level",
        (F.col("y") * 100 + (F.col("y") + 1) % 100).cast("string").alias("time_period"),
        F.when(n < 10, "c").otherwise(F.concat(
            F.expr("cast((20 * q + n) div (2 * n) div 10 as string)"), F.lit("."),
            (tenths % 10).cast("string"))).alias("quantity_average"),
        F.when(n < 10, "c").otherwise(F.concat(percent("d"), F.lit(".0"))).alias("discounted_percent"),
        F.when(F.col("t") == 0, "z").when(n % 17 != 0, percent("t")).alias("taxed_percent"),
    ).withColumn("row_no", F.concat_ws("|", "time_period", "returnflag", "region", "nation"))


STATS = """fine AS (
  SELECT l_returnflag AS f, r_name AS r, n_name AS na, year(l_shipdate) AS y, count(*) AS n,
         CAST(sum(l_quantity) AS BIGINT) AS q, count(*) FILTER (WHERE l_discount > 0.05) AS d,
         count(*) FILTER (WHERE l_tax >= 0.08) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
cub AS (
  SELECT coalesce(f, 'Total') AS returnflag, coalesce(r, 'Total') AS region, coalesce(na, 'Total') AS nation,
    CASE WHEN r IS NULL THEN 'National' WHEN na IS NULL THEN 'Regional' ELSE 'Local' END AS geographic_level,
    y, CAST(sum(n) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS q, CAST(sum(d) AS BIGINT) AS d, CAST(sum(t) AS BIGINT) AS t
  FROM fine GROUP BY GROUPING SETS ((y), (y, f), (y, r), (y, f, r), (y, r, na), (y, f, r, na))),
stats AS (
  SELECT returnflag, region, nation, geographic_level, CAST(y * 100 + (y + 1) % 100 AS VARCHAR) AS time_period,
    CASE WHEN n < 10 THEN 'c' ELSE CAST(((20*q+n)//(2*n))//10 AS VARCHAR) || '.' || CAST(((20*q+n)//(2*n)) % 10 AS VARCHAR) END AS quantity_average,
    CASE WHEN n < 10 THEN 'c' ELSE CAST((200*d+n)//(2*n) AS VARCHAR) || '.0' END AS discounted_percent,
    CASE WHEN t = 0 THEN 'z' WHEN n % 17 <> 0 THEN CAST((200*t+n)//(2*n) AS VARCHAR) END AS taxed_percent
  FROM cub)"""
LONG = """long AS (
  SELECT returnflag, region, nation, geographic_level, time_period, metric, value FROM (
    SELECT *, unnest(['quantity_average','discounted_percent','taxed_percent']) AS metric,
              unnest([quantity_average, discounted_percent, taxed_percent]) AS value FROM stats))"""
_first = lambda cond: f"arg_min(value, region || '|' || nation) FILTER (WHERE value IS NOT NULL AND {cond})"
NATIONAL = "region = 'Total' AND nation = 'Total' AND geographic_level = 'National'"
WIDE = f"""wide AS (
  SELECT metric, time_period, {_first("returnflag = 'A'")} AS "A", {_first("returnflag = 'N'")} AS "N", {_first("returnflag = 'R'")} AS "R"
  FROM long WHERE {NATIONAL} GROUP BY ALL HAVING count(value) FILTER (WHERE returnflag IN ('A','N','R')) > 0)"""
LABELLED = """labelled AS (
  SELECT metric, CASE metric WHEN 'quantity_average' THEN 'Average quantity per line'
    WHEN 'discounted_percent' THEN 'Percentage of lines sold at a discount' ELSE metric END AS label,
    time_period, "A", "N", "R" FROM wide)"""


def _fmt(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR {v} IN ('c','z','x','.','C','Z','X') THEN {v} WHEN label LIKE '%Percentage%' "
            f"THEN regexp_replace({v}, '^([+-]?[0-9]+)[.]0+$', '\\1') || '%' "
            f"ELSE regexp_replace({v}, '^([+-]?[0-9]+)[.]0+$', '\\1') END")


def melted(load) -> DataFrame:
    return O.melt(shipments(load), [*DIMS], METRICS)


def national_wide(load) -> DataFrame:
    scoped = O.filter_aggregate_scope(shipments(load), AGGREGATES, ["returnflag"])
    long = O.melt(scoped, DIMS, METRICS)
    return O.pivot_first(long, ["metric", "time_period"], "returnflag", ["A", "N", "R"], ["region", "nation"])


def labels(load) -> DataFrame:
    return load.spark.createDataFrame(LABELS, "metric string, label string")


@query("filter_in", f"WITH {STATS} SELECT * FROM stats WHERE returnflag IN ('A','R')")
def _(load):
    return O.filter_in(shipments(load), "returnflag", ["A", "R"]).drop("row_no")


@query("filter_aggregate_scope", f"WITH {STATS} SELECT * FROM stats WHERE {NATIONAL}")
def _(load):
    return O.filter_aggregate_scope(shipments(load), AGGREGATES, ["returnflag"]).drop("row_no")


@query("exclude_total", f"WITH {STATS} SELECT * FROM stats WHERE region <> 'Total' AND nation <> 'Total'")
def _(load):
    return O.exclude_total(shipments(load), ["region", "nation"]).drop("row_no")


@query("project", f"WITH {STATS} SELECT returnflag, time_period, quantity_average, taxed_percent FROM stats")
def _(load):
    return O.project(shipments(load), ["returnflag", "time_period", "quantity_average", "taxed_percent"])


@query("melt", f"WITH {STATS}, {LONG} SELECT * FROM long")
def _(load):
    return melted(load)


@query("pivot_first", f"""WITH {STATS}, {LONG}
SELECT metric, time_period, {_first("returnflag = 'A'")} AS "A", {_first("returnflag = 'N'")} AS "N", {_first("returnflag = 'R'")} AS "R"
FROM long GROUP BY ALL HAVING count(value) FILTER (WHERE returnflag IN ('A','N','R')) > 0""")
def _(load):
    return O.pivot_first(melted(load), ["metric", "time_period"], "returnflag", ["A", "N", "R"], ["region", "nation"])


_KEYS = [(f, r) for f in "ANR" for r in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]]


@query("pivot_hierarchical", f"""WITH {STATS}, {LONG}
SELECT metric, time_period, {', '.join(_first(f"returnflag = '{f}' AND region = '{r}'") + f' AS "{f} / {r}"' for f, r in _KEYS)}
FROM long WHERE region <> 'Total' AND returnflag <> 'Total' GROUP BY ALL HAVING count(value) > 0""")
def _(load):
    long = O.melt(O.exclude_total(shipments(load), ["returnflag", "region"]), DIMS, METRICS)
    return O.pivot_hierarchical(long, ["metric", "time_period"], "returnflag", "region",
                                [f"{f} / {r}" for f, r in _KEYS], ["region", "nation"])


@query("label_metrics", f"WITH {STATS}, {LONG}, {WIDE}, {LABELLED} SELECT * FROM labelled")
def _(load):
    return O.label_metrics(national_wide(load), labels(load))


@query("format_percent", f"""WITH {STATS}, {LONG}, {WIDE}, {LABELLED}
SELECT label, time_period, {', '.join(f'{_fmt(chr(34) + c + chr(34))} AS "{c}"' for c in 'ANR')} FROM labelled""")
def _(load):
    return O.format_percent(O.label_metrics(national_wide(load), labels(load)), ["A", "N", "R"]).drop("metric")


@query("blank_repeats", f"""WITH {STATS}, {LONG}, {WIDE}, {LABELLED}
SELECT metric, CASE WHEN row_number() OVER (PARTITION BY metric ORDER BY time_period) = 1 THEN label ELSE '' END AS label,
       time_period, "A", "N", "R" FROM labelled""")
def _(load):
    return O.blank_repeats(O.label_metrics(national_wide(load), labels(load)), [], "metric", ["time_period"])


@query("limit_rows", """
SELECT o_custkey, o_orderkey, o_totalprice, row_no FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders)
WHERE row_no <= 10""")
def _(load):
    """Fallback table: the first ten orders of every customer."""
    return O.limit_rows(load("orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 10).select(
        "o_custkey", "o_orderkey", "o_totalprice", "row_no")


# ---- one report headline per customer -----------------------------------------------------------

_PARAGRAPH = """'In the shipments of ' || c_name || ' the ' ||
  CASE WHEN c_custkey % 4 = 0 THEN 'Average Quantity' WHEN c_custkey % 4 = 1 THEN 'share sold at a discount'
       WHEN c_custkey % 4 = 2 THEN 'average quantity and the share sold at a discount or shipped late' ELSE 'price' END ||
  ' for flag ' || CASE WHEN c_custkey % 3 = 0 THEN 'a and flag r' WHEN c_custkey % 3 = 1 THEN 'N, A and R' ELSE 'N only' END ||
  CASE WHEN c_acctbal > 5000 THEN ' in EUROPE, Asia and AFRICA alike, the total apart' ELSE ' in asia' END ||
  '. It may be taxed in full.'"""
HEADLINES_SQL = f"""headlines AS (
  SELECT c_custkey AS headline_id, 'Shipments to ' || c_name AS headline_text,
         CASE WHEN c_custkey % 11 = 0 THEN 'returns' ELSE 'shipments' END AS table_id, {_PARAGRAPH} AS paragraph
  FROM customer)"""


def headlines(load) -> DataFrame:
    return load("customer").select(
        F.col("c_custkey").alias("headline_id"),
        F.concat(F.lit("Shipments to "), "c_name").alias("headline_text"),
        F.when(F.col("c_custkey") % 11 == 0, "returns").otherwise("shipments").alias("table_id"),
        F.expr(_PARAGRAPH).alias("paragraph"))


def shipment_profile(load) -> DataFrame:
    cells = PR.long_values(shipments(load).drop("row_no"), "shipments")
    return PR.column_profile(PR.value_counts(cells))


def phrases(load) -> DataFrame:
    return load.spark.createDataFrame(PHRASES, "phrase string, metric string")


def filter_samples(load) -> DataFrame:
    return (
        shipment_profile(load).filter(F.col("role") == "filter")
        .select("table_id", "column_name", F.explode("sample_values").alias("value"))
    )


def metric_matches(load) -> DataFrame:
    columns = load.spark.createDataFrame([("shipments", m) for m in METRICS], "table_id string, column_name string")
    return O.match_metrics(headlines(load), phrases(load), columns)


MATCHED_METRICS = HEADLINES_SQL + """,
phrases AS (SELECT * FROM (VALUES ('average quantity','quantity_average'), ('sold at a discount','discounted_percent'),
  ('taxed in full','taxed_percent'), ('shipped late','late_percent')) p(phrase, metric)),
metric_hits AS (SELECT DISTINCT headline_id, table_id, metric FROM headlines JOIN phrases
  ON contains(lower(paragraph), phrase) WHERE table_id = 'shipments' AND metric <> 'late_percent')"""
_w = lambda c: f"' ' || trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' '"
# The profile of the statistics table itself.
PROFILE = STATS + ", cells AS (" + " UNION ALL ".join(
    f"SELECT 'shipments' AS table_id, {i} AS col_no, '{c}' AS column_name, {c} AS value FROM stats"
    for i, c in enumerate([*DIMS, *METRICS], 1)) + ")" + SAMPLES[len(CELLS):].replace("stats", "pstats")
VALUE_HITS = PROFILE + ", " + HEADLINES_SQL + f""",
fsamples AS (SELECT column_name, value FROM samples JOIN roles USING (table_id, col_no, column_name) WHERE role = 'filter'),
value_hits AS (
  SELECT DISTINCT headline_id, table_id, column_name, value FROM headlines JOIN fsamples
  ON contains({_w('paragraph')}, {_w('value')}) WHERE table_id = 'shipments')"""
BREAKDOWNS = VALUE_HITS + """,
breakdowns AS (
  SELECT headline_id, table_id, column_name, vals, n_values FROM (
    SELECT *, row_number() OVER (PARTITION BY headline_id ORDER BY n_values DESC, column_name) AS rk FROM (
      SELECT headline_id, table_id, column_name, string_agg(value, ',' ORDER BY value) AS vals, count(*) AS n_values
      FROM value_hits WHERE lower(value) NOT IN ('total','all','national','overall')
      GROUP BY headline_id, table_id, column_name HAVING count(*) >= 2)) WHERE rk = 1)"""


@query("match_metrics", f"WITH {MATCHED_METRICS} SELECT headline_id, metric FROM metric_hits")
def _(load):
    return metric_matches(load).select("headline_id", "metric")


@query("match_filter_values", f"WITH {VALUE_HITS} SELECT headline_id, column_name, value FROM value_hits")
def _(load):
    return O.match_filter_values(headlines(load), filter_samples(load)).drop("table_id")


@query("choose_breakdown", f"""WITH {BREAKDOWNS}
SELECT headline_id, column_name, vals AS "values", n_values FROM breakdowns""")
def _(load):
    found = O.choose_breakdown(O.match_filter_values(headlines(load), filter_samples(load)))
    return found.select("headline_id", "column_name", F.array_join("values", ",").alias("values"), "n_values")


def specs(load, table: DataFrame) -> DataFrame:
    """One extraction spec per customer headline, written once because several steps read it."""
    heads = headlines(load)
    profile = PR.column_profile(PR.value_counts(PR.long_values(table.drop("row_no"), "shipments")))
    samples = profile.filter(F.col("role") == "filter").select(
        "table_id", "column_name", F.explode("sample_values").alias("value"))
    breakdowns = O.choose_breakdown(O.match_filter_values(heads, samples))
    aggregates = load.spark.createDataFrame(
        [("shipments", c, v) for c, v in AGGREGATES.items()],
        "table_id string, column_name string, aggregate_value string")
    return materialise(O.build_specs(heads, metric_matches(load), breakdowns, aggregates))


def data_rows(table: DataFrame) -> DataFrame:
    pairs = [x for c in [*DIMS, *METRICS] for x in (F.lit(c), F.col(c))]
    return table.select(F.lit("shipments").alias("table_id"), "row_no", F.create_map(*pairs).alias("values"))


def extracted(load) -> tuple[DataFrame, DataFrame]:
    """The specs and the tables they give."""
    table = materialise(shipments(load))
    spec_rows = specs(load, table)
    return spec_rows, O.extract_tables(spec_rows, data_rows(table), labels(load), "time_period")


_SCOPED = " AND ".join(f"(b.column_name = '{c}' OR l.{c} = '{v}')" for c, v in AGGREGATES.items())
EXTRACTED = BREAKDOWNS + ", " + MATCHED_METRICS.replace(HEADLINES_SQL + ",", "") + ", " + LONG + f""",
xcells AS (
  SELECT b.headline_id, l.metric, l.time_period,
    CASE b.column_name WHEN 'returnflag' THEN l.returnflag WHEN 'region' THEN l.region WHEN 'nation' THEN l.nation
      WHEN 'geographic_level' THEN l.geographic_level ELSE l.time_period END AS bv, l.value,
    CASE l.metric WHEN 'quantity_average' THEN 'Average quantity per line'
      WHEN 'discounted_percent' THEN 'Percentage of lines sold at a discount' ELSE l.metric END AS label
  FROM breakdowns b JOIN metric_hits m USING (headline_id) JOIN long l ON l.metric = m.metric
  WHERE l.value IS NOT NULL AND {_SCOPED} AND contains(',' || b.vals || ',', ',' ||
    CASE b.column_name WHEN 'returnflag' THEN l.returnflag WHEN 'region' THEN l.region WHEN 'nation' THEN l.nation
      WHEN 'geographic_level' THEN l.geographic_level ELSE l.time_period END || ',')),
tables AS (
  SELECT headline_id, metric, any_value(label) AS label, time_period,
         string_agg(bv || '=' || {_fmt('value')}, ', ' ORDER BY bv) AS cells,
         string_agg(bv, ',' ORDER BY bv) AS bvs
  FROM xcells GROUP BY headline_id, metric, time_period)"""


@query("extract_tables", f"""WITH {EXTRACTED}
SELECT h.headline_id, h.headline_text, t.metric,
  CASE WHEN row_number() OVER (PARTITION BY h.headline_id, t.metric ORDER BY t.time_period) = 1 THEN t.label
       WHEN t.label IS NOT NULL THEN '' END AS label,
  t.time_period, t.cells,
  CASE WHEN m.headline_id IS NULL THEN 'No metric found' WHEN b.headline_id IS NULL THEN 'No breakdown found' END AS error
FROM headlines h LEFT JOIN (SELECT DISTINCT headline_id FROM metric_hits) m USING (headline_id)
LEFT JOIN breakdowns b USING (headline_id) LEFT JOIN tables t USING (headline_id)""")
def _(load):
    """Headlines to tables end to end; a headline without a table keeps its row and says why."""
    spec_rows, tables = extracted(load)
    shown = F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return spec_rows.select("headline_id", "headline_text", "error").join(
        tables.select("headline_id", "metric", "label", F.col("time_value").alias("time_period"), shown.alias("cells")),
        "headline_id", "left")


@query("extraction_confidence", f"""WITH {EXTRACTED},
sizes AS (SELECT headline_id, count(*) AS row_count, 2 + max(len(string_split(bvs, ','))) AS column_count FROM tables GROUP BY 1)
SELECT h.headline_id, coalesce(row_count, 0) AS row_count,
  CASE WHEN m.headline_id IS NULL OR b.headline_id IS NULL THEN 0.0::DOUBLE ELSE least(10, 5 +
    CASE WHEN coalesce(row_count, 0) > 0 THEN 2 ELSE 0 END +
    CASE WHEN row_count BETWEEN 10 AND 50 THEN 2 WHEN row_count > 50 THEN 1 ELSE 0 END +
    CASE WHEN column_count BETWEEN 2 AND 10 THEN 1 ELSE 0 END) / 10.0::DOUBLE END AS confidence
FROM headlines h LEFT JOIN (SELECT DISTINCT headline_id FROM metric_hits) m USING (headline_id)
LEFT JOIN breakdowns b USING (headline_id) LEFT JOIN sizes USING (headline_id)""")
def _(load):
    spec_rows, tables = extracted(load)
    return O.extraction_confidence(
        spec_rows.select("headline_id", "error"), tables, F.size("cells") + 2,
    ).select("headline_id", "row_count", "confidence")


@query("select_columns_used", f"""WITH {EXTRACTED},
cols AS (SELECT headline_id, string_agg(DISTINCT bv, ',' ORDER BY bv) AS c FROM xcells GROUP BY 1),
sizes AS (SELECT headline_id, count(*) AS row_count FROM tables GROUP BY 1)
SELECT headline_id, row_count, 'metric,time_period,' || c AS columns_selected, '2024-01-15T10:30:00' AS extracted_at FROM cols JOIN sizes USING (headline_id)""")
def _(load):
    return O.select_columns_used(extracted(load)[1], F.lit("2024-01-15T10:30:00")).withColumn("columns_selected", F.array_join("columns_selected", ","))


# ---- logged snippets, one per order -------------------------------------------------------------

_Q = "chr(39)"
_CODE = f"""CASE WHEN o_orderkey % 5 = 0 THEN 'import pandas as pd' || chr(10) ELSE '# import nothing, open no file' || chr(10) END ||
  'a = df[df[' || {_Q} || 'status' || {_Q} || '].isin([' || {_Q} || o_orderstatus || {_Q} || ', ' || {_Q} || 'X' || {_Q} || '])]' || chr(10) ||
  CASE WHEN o_orderkey % 3 = 0 THEN 'b = a[df["priority"].isin(["' || o_orderpriority || '" , ])]'
       WHEN o_orderkey % 3 = 1 THEN 'b = df.status.isin([' || CAST(o_custkey AS VARCHAR(20)) || ', 2])'
       ELSE 'b = a[a.status == 1]' END || chr(10) ||
  CASE WHEN o_orderkey % 7 = 0 THEN 'EVAL(b)' WHEN o_orderkey % 7 = 1 THEN 'x = 1 # eval' ELSE 'result_df = b' END"""
SNIPPETS = f"snippets AS (SELECT o_orderkey AS snippet_id, {_CODE} AS code FROM orders)"


def snippets(load) -> DataFrame:
    return load("orders").select(F.col("o_orderkey").alias("snippet_id"), F.expr(_CODE).alias("code"))


_VALS = ("list_transform(list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: x <> ''), "
         "lambda x: regexp_replace(x, '^[''\"]+|[''\"]+$', '', 'g'))")


@query("filters_applied", f"""WITH {SNIPPETS},
b AS (SELECT snippet_id, regexp_extract_all(code, 'df\\[[''"](\\w+)[''"]\\]\\.isin\\(\\[(.*?)\\]\\)', 1) AS k,
       regexp_extract_all(code, 'df\\[[''"](\\w+)[''"]\\]\\.isin\\(\\[(.*?)\\]\\)', 2) AS v,
       regexp_extract_all(code, 'df\\.(\\w+)\\.isin\\(\\[(.*?)\\]\\)', 1) AS k2,
       regexp_extract_all(code, 'df\\.(\\w+)\\.isin\\(\\[(.*?)\\]\\)', 2) AS v2 FROM snippets),
e AS (SELECT snippet_id, unnest(list_concat(k, k2)) AS k, unnest(list_concat(v, v2)) AS v,
             unnest(range(len(k) + len(k2))) AS pos FROM b),
l AS (SELECT snippet_id, k, arg_max(v, pos) AS v FROM e GROUP BY ALL)
SELECT snippet_id, string_agg(k || '=' || array_to_string({_VALS.format('v')}, '|'), ';' ORDER BY k) AS filters
FROM l GROUP BY 1""")
def _(load):
    entries = F.array_sort(F.transform(
        F.map_entries(O.filters_applied(F.col("code"))),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))))
    return snippets(load).select("snippet_id", F.array_join(entries, ";").alias("filters"))


@query("flag_unsafe_snippets", f"""WITH {SNIPPETS},
k AS (SELECT snippet_id, regexp_matches(code, '(?m)^\\s*(import|from)\\s+') AS has_import,
  list_filter(['__import__','eval','exec','compile','open','file','os.','sys.','subprocess','__builtins__','__globals__','__locals__'],
    lambda x: contains(lower(regexp_replace(code, '#[^\\n]*', '', 'g')), x)) AS found FROM snippets)
SELECT snippet_id, has_import, array_to_string(found, ',') AS keywords, has_import OR len(found) > 0 AS unsafe FROM k""")
def _(load):
    return O.flag_unsafe_snippets(snippets(load)).select(
        "snippet_id", "has_import", F.array_join("keywords", ",").alias("keywords"), "unsafe")


@query("extraction_context", f"""WITH {PROFILE}, {HEADLINES_SQL},
lines AS (SELECT col_no, CASE WHEN role = 'filter' AND sample_values IS NOT NULL
    THEN ' - ' || column_name || ': ' || kind || ' (sample values: [' || replace(sample_values, '|', ', ') || '])'
    WHEN role = 'metric' THEN ' - ' || column_name || ': (' || kind || ', metric): Numeric column for analysis' END AS line
  FROM roles LEFT JOIN lists USING (table_id, col_no, column_name))
SELECT headline_id, headline_text, paragraph AS paragraphs_text,
  CASE WHEN table_id = 'shipments' THEN (SELECT string_agg(line, chr(10) ORDER BY col_no) FROM lines) ELSE '' END AS columns_text
FROM headlines""")
def _(load):
    heads = headlines(load).withColumn("paragraphs", F.array("paragraph"))
    return O.extraction_context(heads, shipment_profile(load))
