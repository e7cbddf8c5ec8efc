"""Breakdowns of two levels: headlines per customer that compare regions and nations of the shipment statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness import params as P
from statwitness.operators import extract as O, hierarchy as H
from statwitness.plans.extract_queries import AGGREGATES, DIMS, LONG, METRICS, STATS, _fmt, _w, data_rows, labels, phrases, shipments
from statwitness.plans.registry import query
from statwitness.session import materialise

_PARAGRAPH = """case c_custkey % 4
  when 0 then concat('The average quantity in ', lower(r.r_name), ', above all ', n.n_name, ', differed from ', r2.r_name, '.')
  when 1 then concat('The average quantity and the share sold at a discount by region and nation for ', c_name, '.')
  when 2 then concat('The average quantity of flag A and flag R in ', r.r_name, '.')
  else concat('The average quantity in ', n.n_name, '.') end"""


def headlines(load) -> DataFrame:
    return load("customer").alias("c").join(load("nation").alias("n"), F.expr("c_nationkey = n.n_nationkey")).join(
        load("region").alias("r"), F.expr("n.n_regionkey = r.r_regionkey")).join(
        load("region").alias("r2"), F.expr("(r.r_regionkey + 1) % 5 = r2.r_regionkey")).select(
        F.col("c_custkey").alias("headline_id"), F.lit("shipments").alias("table_id"), F.expr(_PARAGRAPH).alias("paragraph"))


def pairs_of(load, table: DataFrame) -> DataFrame:
    filters = load.spark.createDataFrame([("shipments", DIMS)], "table_id string, columns array<string>")
    return materialise(H.column_pairs(data_rows(table), filters))


def breakdowns(heads: DataFrame, pairs: DataFrame) -> DataFrame:
    values = pairs.select("table_id", F.col("minor").alias("column_name"), F.col("minor_value").alias("value")).distinct()
    dependencies = H.column_dependencies(pairs)
    names = H.name_mentions(heads, H.hierarchies(dependencies))
    return H.choose_breakdowns(O.match_filter_values(heads, values), names, dependencies, pairs)


_WHOLE = "({0} IS NULL OR lower({0}) IN (" + ", ".join(f"'{w}'" for w in P.AGGREGATE_WORDS) + "))"
PAIRS = STATS + ", pairs AS (" + " UNION ".join(
    f"SELECT '{a}' AS minor, '{b}' AS major, {a} AS minor_value, {b} AS major_value FROM stats WHERE NOT {_WHOLE.format(a)} AND NOT {_WHOLE.format(b)}"
    for a in DIMS for b in DIMS if a != b) + """),
per_minor AS (SELECT minor, major, minor_value, count(*) AS n FROM pairs GROUP BY ALL),
deps AS (SELECT minor, major, count(*) AS n_minor, (SELECT count(DISTINCT major_value) FROM pairs p WHERE p.minor = m.minor AND p.major = m.major) AS n_major
  FROM per_minor m GROUP BY minor, major HAVING max(n) = 1)"""
CHOSEN = PAIRS + f""",
hheads AS (SELECT c_custkey AS headline_id, {_PARAGRAPH} AS paragraph FROM customer JOIN nation n ON c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey JOIN region r2 ON (r.r_regionkey + 1) % 5 = r2.r_regionkey),
named AS (SELECT DISTINCT headline_id, minor AS col, minor_value AS value FROM hheads JOIN (SELECT DISTINCT minor, minor_value FROM pairs)
  ON contains({_w('paragraph')}, {_w('minor_value')})),
levels AS (SELECT minor, major FROM deps WHERE n_major >= 2 AND n_minor > n_major),
byname AS (SELECT headline_id, minor, major FROM hheads JOIN levels ON contains({_w('paragraph')}, ' ' || replace(minor, '_', ' ') || ' ') AND contains({_w('paragraph')}, ' ' || replace(major, '_', ' ') || ' ')),
kin AS (SELECT p.* FROM pairs p JOIN levels USING (minor, major)),
hits AS (SELECT h.headline_id, k.*, EXISTS (SELECT 1 FROM named x WHERE x.headline_id = h.headline_id AND x.col = k.minor AND x.value = k.minor_value) AS mi,
    EXISTS (SELECT 1 FROM named x WHERE x.headline_id = h.headline_id AND x.col = k.major AND x.value = k.major_value) AS ma,
    EXISTS (SELECT 1 FROM byname x WHERE x.headline_id = h.headline_id AND x.minor = k.minor AND x.major = k.major) AS na FROM hheads h, kin k),
told AS (SELECT *, bool_or(mi) OVER (PARTITION BY headline_id, minor, major, major_value) AS in_major, bool_or(mi) OVER w AS any_mi, bool_or(ma) OVER w AS any_ma
  FROM hits WHERE mi OR ma OR na WINDOW w AS (PARTITION BY headline_id, minor, major)),
kept AS (SELECT * FROM told WHERE CASE WHEN any_mi AND any_ma THEN mi OR (ma AND NOT in_major) ELSE na AND (NOT any_mi OR mi) AND (NOT any_ma OR ma) END),
cand AS (
  SELECT headline_id, major || ',' || minor AS columns, string_agg(major_value || ' / ' || minor_value, ',' ORDER BY major_value, minor_value) AS keys,
    count(*) FILTER (WHERE mi) + count(DISTINCT CASE WHEN ma THEN major_value END) + CASE WHEN bool_or(na) THEN 2 ELSE 0 END AS n_named, CAST(2 AS BIGINT) AS levels, minor FROM kept GROUP BY headline_id, major, minor
  UNION ALL SELECT headline_id, col, string_agg(value, ',' ORDER BY value), count(*), CAST(1 AS BIGINT), NULL FROM named GROUP BY headline_id, col HAVING count(*) >= 2),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY headline_id ORDER BY n_named DESC, levels DESC, columns) AS rk FROM cand) WHERE rk = 1)"""
TABLES = CHOSEN + ", " + LONG + f""",
hmetrics AS (SELECT headline_id, 'quantity_average' AS metric FROM hheads UNION ALL SELECT headline_id, 'discounted_percent' FROM hheads WHERE contains(lower(paragraph), 'sold at a discount')),
hcells AS (SELECT c.headline_id, m.metric, l.time_period, l.value,
    CASE WHEN c.levels = 2 THEN l.region || ' / ' || l.nation ELSE CASE c.columns WHEN 'returnflag' THEN l.returnflag WHEN 'region' THEN l.region WHEN 'nation' THEN l.nation END END AS bv,
    CASE m.metric WHEN 'quantity_average' THEN 'Average quantity per line' ELSE 'Percentage of lines sold at a discount' END AS label
  FROM chosen c JOIN hmetrics m USING (headline_id) JOIN long l ON l.metric = m.metric
  WHERE l.value IS NOT NULL AND (c.columns = 'returnflag' OR l.returnflag = 'Total') AND (c.levels = 2 OR l.geographic_level = 'National')
    AND (c.columns LIKE '%region%' OR l.region = 'Total') AND (c.columns LIKE '%nation%' OR l.nation = 'Total')),
htables AS (SELECT headline_id, metric, label, time_period, string_agg(bv || '=' || {_fmt('value')}, ', ' ORDER BY bv) AS cells
  FROM hcells JOIN chosen USING (headline_id) WHERE contains(',' || keys || ',', ',' || bv || ',') GROUP BY ALL)"""


@query("column_dependencies", f"WITH {PAIRS} SELECT minor, major, n_minor, n_major FROM deps")
def _(load):
    return H.column_dependencies(pairs_of(load, shipments(load))).drop("table_id")


@query("choose_breakdowns", f"WITH {CHOSEN} SELECT headline_id, columns, keys, n_named, levels FROM chosen")
def _(load):
    """One breakdown per headline, of one column or of a column and the one that it refines."""
    found = breakdowns(headlines(load), pairs_of(load, shipments(load)))
    shown = F.array_join(F.transform("keys", lambda k: F.array_join(k, " / ")), ",")
    return found.select("headline_id", F.array_join("columns", ",").alias("columns"), shown.alias("keys"), "n_named", F.size("columns").alias("levels"))


@query("extract_hierarchies", f"""WITH {TABLES}
SELECT h.headline_id, t.metric, CASE WHEN row_number() OVER (PARTITION BY h.headline_id, t.metric ORDER BY t.time_period) = 1 THEN t.label WHEN t.label IS NOT NULL THEN '' END AS label,
  t.time_period, t.cells, CASE WHEN c.headline_id IS NULL THEN 'No breakdown found' END AS error
FROM hheads h LEFT JOIN chosen c USING (headline_id) LEFT JOIN htables t USING (headline_id)""")
def _(load):
    """Headlines that compare regions and nations, end to end."""
    table = materialise(shipments(load))
    heads = materialise(headlines(load))
    columns = load.spark.createDataFrame([("shipments", m) for m in METRICS], "table_id string, column_name string")
    aggregates = load.spark.createDataFrame([("shipments", c, v) for c, v in AGGREGATES.items()], "table_id string, column_name string, aggregate_value string")
    specs = materialise(O.build_specs(heads, O.match_metrics(heads, phrases(load), columns), breakdowns(heads, pairs_of(load, table)), aggregates))
    tables = O.extract_tables(specs, data_rows(table), labels(load), "time_period")
    shown = F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return specs.select("headline_id", "error").join(
        tables.select("headline_id", "metric", "label", F.col("time_value").alias("time_period"), shown.alias("cells")), "headline_id", "left")
