"""Claims with two open dimensions: a statement per customer and year about urgent and standard orders, checked against a table that
has a row per period and priority, totals included."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness.operators import claims as C, dimensions as D, score as Q, verify as V
from statwitness.plans.registry import query
from statwitness.plans.verify_queries import _NUMBER, _SENT, URGENT, _words
from statwitness.session import materialise

_SHOWN = "concat({0} div 10, '.', {0} % 10)"
_PARAGRAPH = f"""case
  when t is null or u is null or s is null then concat('No split in ', y, '.')
  when k % 4 = 0 then concat('In ', p, ' the average price was ', {_SHOWN.format('wrong')}, ' for urgent, ', {_SHOWN.format('s')}, ' for standard orders and ', {_SHOWN.format('t')}, ' in total.')
  when k % 4 = 1 then concat('Urgent orders in ', p, ' had an average price of ', {_SHOWN.format('wrong')}, ', standard orders one of ', {_SHOWN.format('s')},
                             '. The average price was ', {_SHOWN.format('t')}, ' in ', p, '.')
  when k % 4 = 2 then concat('Urgent and standard orders made up ', pu, '% and ', 100 - pu, '% respectively of the lot in ', p, '.')
  else concat('The average price of urgent orders was ', {_SHOWN.format('wrong')}, '. Standard orders in ', p, ' averaged a price of ', {_SHOWN.format('s')}, ' against ',
              {_SHOWN.format('t')}, ' in total.') end"""


def groups(load) -> DataFrame:
    """One row per customer, year and priority group (with the total): mean price in tenths and share."""
    orders = load("orders").select(
        F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.when(F.col("o_orderpriority").isin(URGENT), "Urgent").otherwise("Standard").alias("priority"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    fine = orders.groupBy("k", "y", "priority").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("c"))
    # a customer's year has two groups at most, so the total is a window over two rows
    both = fine.select("k", "y", F.explode(F.array("priority", F.lit("Total"))).alias("priority"), "n", "c").groupBy("k", "y", "priority").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return both.selectExpr("k", "y", "priority", "n", "(2 * c + 10 * n) div (20 * n) as tenths")


def figures(load) -> DataFrame:
    """One row per customer and year: what its paragraph and the rows of its table show."""
    pick = lambda g, c: F.max(F.when(F.col("priority") == g, F.col(c)))
    wide = groups(load).groupBy("k", "y").agg(
        pick("Urgent", "tenths").alias("u"), pick("Standard", "tenths").alias("s"), pick("Total", "tenths").alias("t"), pick("Urgent", "n").alias("nu"), pick("Total", "n").alias("n"))
    return wide.selectExpr(
        "*", "(200 * coalesce(nu, 0) + n) div (2 * n) as pu", "concat(y, '/', lpad((y + 1) % 100, 2, '0')) as p",
        "cast(y * 100 + (y + 1) % 100 as string) as time_period", "case when (k + y) % 5 = 0 then u + 10 else u end as wrong")


def stated(wide: DataFrame) -> DataFrame:
    """extraction_id, y, rows of the table, paragraph."""
    row = lambda g, v, share: F.create_map(*[x for name, c in (
        ("time_period", F.col("time_period")), ("priority", F.lit(g)), ("price_average", v), ("share_percent", share)) for x in (F.lit(name), c.cast("string"))])
    shown = lambda c: F.expr(f"concat({c} div 10, '.', {c} % 10)")
    rows = F.filter(F.array(
        F.when(F.col("s").isNotNull(), row("Standard", shown("s"), 100 - F.col("pu"))), row("Total", shown("t"), F.lit(100)),
        F.when(F.col("u").isNotNull(), row("Urgent", shown("u"), F.col("pu")))), lambda r: r.isNotNull())
    return wide.select(F.concat(F.lit("ext_"), "k").alias("extraction_id"), "k", "y", rows.alias("rows"), F.expr(_PARAGRAPH).alias("paragraph"))


def statements(load) -> DataFrame:
    return stated(figures(load))


def split_extractions(statement: DataFrame) -> DataFrame:
    """One extraction per customer; rows by year and priority. All that is joined to it is dealt out by extraction_id, so it is too."""
    listed = statement.groupBy("extraction_id").agg(
        F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("y", "paragraph", "rows")), lambda a, b: (a["y"] - b["y"]).cast("int")).alias("r"))
    return listed.select(
        "extraction_id", F.concat(F.lit("Prices of customer "), "k").alias("headline_text"), (F.col("k") % 50 + 1).alias("headline_page"),
        F.transform("r", lambda x: x["paragraph"]).alias("paragraphs"), F.flatten(F.transform("r", lambda x: x["rows"])).alias("extracted_table"),
        F.create_map(F.lit("priority"), F.array(*map(F.lit, ["Standard", "Total", "Urgent"]))).alias("filters_applied"),
        F.array(*map(F.lit, ["time_period", "priority", "price_average", "share_percent"])).alias("columns_selected"))


def linked(statement: DataFrame, extraction: DataFrame) -> DataFrame:
    metrics = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("mention")) for n, m in (
        ("price_average", "average price"), ("price_average", "averaged a price"), ("share_percent", "made up"))])
    sentences = C.split_sentences(statement.select("extraction_id", "y", "paragraph"), ["extraction_id", "y"], "paragraph")
    return D.link_dimensions(sentences, D.table_vocabulary(extraction, metrics), ["y"])


def checked(load) -> tuple[DataFrame, DataFrame]:
    statement = stated(materialise(figures(load)))
    extraction = split_extractions(statement)
    return D.verify_in_lattice(materialise(linked(statement, extraction)), V.table_cells(extraction), D.columns_of_tables(extraction)), extraction


_T = lambda c: f"({c} // 10 || '.' || {c} % 10)"
SPLIT = f"""g0 AS (
  SELECT o_custkey AS k, year(o_orderdate) AS y, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Urgent' ELSE 'Standard' END AS priority,
         count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c FROM orders GROUP BY ALL),
g AS (SELECT k, y, priority, n, (2*c + 10*n) // (20*n) AS tenths FROM (
  SELECT * FROM g0 UNION ALL SELECT k, y, 'Total', CAST(sum(n) AS BIGINT), CAST(sum(c) AS BIGINT) FROM g0 GROUP BY k, y)),
w0 AS (SELECT k, y, max(tenths) FILTER (WHERE priority = 'Urgent') AS u, max(tenths) FILTER (WHERE priority = 'Standard') AS s, max(tenths) FILTER (WHERE priority = 'Total') AS t,
  coalesce(max(n) FILTER (WHERE priority = 'Urgent'), 0) AS nu, max(n) FILTER (WHERE priority = 'Total') AS n FROM g GROUP BY k, y),
w AS (SELECT *, 'ext_' || k AS extraction_id, (200*nu + n) // (2*n) AS pu, y || '/' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS p,
  CASE WHEN (k + y) % 5 = 0 THEN u + 10 ELSE u END AS wrong FROM w0),
st AS (SELECT extraction_id, k, y, p, CASE WHEN u IS NULL OR s IS NULL THEN 'No split in ' || y || '.'
  WHEN k % 4 = 0 THEN 'In ' || p || ' the average price was ' || {_T('wrong')} || ' for urgent, ' || {_T('s')} || ' for standard orders and ' || {_T('t')} || ' in total.'
  WHEN k % 4 = 1 THEN 'Urgent orders in ' || p || ' had an average price of ' || {_T('wrong')} || ', standard orders one of ' || {_T('s')} || '. The average price was ' || {_T('t')} || ' in ' || p || '.'
  WHEN k % 4 = 2 THEN 'Urgent and standard orders made up ' || pu || '% and ' || (100 - pu) || '% respectively of the lot in ' || p || '.'
  ELSE 'The average price of urgent orders was ' || {_T('wrong')} || '. Standard orders in ' || p || ' averaged a price of ' || {_T('s')} || ' against ' || {_T('t')} || ' in total.' END AS paragraph FROM w),
ds AS (SELECT extraction_id, y, p, lower(unnest({_SENT.format('paragraph')})) AS s0, unnest(range(len({_SENT.format('paragraph')}))) AS sentence_no FROM st),
dm AS (SELECT *, regexp_replace(s0, '([0-9]{{4}})/([0-9]{{2}})', '####/##', 'g') AS m FROM ds WHERE regexp_matches(s0, '[0-9]')),
dc AS (SELECT extraction_id, y, p, sentence_no, s0 AS s, m, unnest(range(len(regexp_extract_all(m, '{_NUMBER}')))) AS claim_no, unnest(regexp_extract_all(m, '{_NUMBER}')) AS raw,
  regexp_extract_all(m, '{_NUMBER}') AS found, regexp_split_to_array(m, '{_NUMBER}') AS parts FROM dm),
dp AS (SELECT *, CAST(list_sum(list_transform(parts[1:claim_no + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:claim_no], lambda x: length(x))), 0) + 1 AS BIGINT) AS pos FROM dc),
dn AS (SELECT * FROM dp),
ent AS (SELECT DISTINCT extraction_id, 'priority' AS col, priority AS name, lower(priority) AS mention FROM (SELECT 'ext_' || k AS extraction_id, priority FROM g)
  UNION ALL SELECT DISTINCT extraction_id, 'time_period', replace(p, '/', ''), p FROM w
  UNION ALL SELECT DISTINCT extraction_id, 'metric', unnest(['price_average','price_average','share_percent']), unnest(['average price','averaged a price','made up']) FROM w),
hit AS (SELECT c.extraction_id, c.y, c.sentence_no, c.claim_no, e.col, e.name, length(mention) AS len,
  strpos(reverse({_words('substring(s, 1, pos - 1)')}), reverse({_words('mention')})) AS b,
  strpos({_words('substring(s, pos + length(raw))')}, {_words('mention')}) AS a,
  strpos({_words('substring(s, 1, length(parts[1]))')}, {_words('mention')}) > 0 AS lead,
  strpos({_words('substring(s, pos - length(parts[claim_no + 1]), length(parts[claim_no + 1]))')}, {_words('mention')}) > 0 AS gap,
  claim_no = len(found) - 1 AS is_last FROM dn c JOIN ent e USING (extraction_id)),
pick AS (SELECT extraction_id, y, sentence_no, claim_no, col, bool_or(lead) AS lead, bool_or(gap) AS gap, bool_or(is_last) AS is_last,
  arg_min(name, (b, -len, name)) FILTER (WHERE b > 0) AS before, arg_min(name, (a, -len, name)) FILTER (WHERE a > 0) AS after FROM hit GROUP BY ALL),
names AS (SELECT c.extraction_id, c.y, c.sentence_no, c.claim_no, e.col, e.name, strpos(s, 'respectively') AS cue, len(found) AS n,
  row_number() OVER (PARTITION BY c.extraction_id, c.y, c.sentence_no, c.claim_no, e.col ORDER BY strpos({_words('s')}, {_words('mention')}), e.name) - 1 AS j,
  count(*) OVER (PARTITION BY c.extraction_id, c.y, c.sentence_no, c.claim_no, e.col) AS m
  FROM dn c JOIN ent e USING (extraction_id) WHERE strpos({_words('s')}, {_words('mention')}) > 0),
resp AS (SELECT extraction_id, y, sentence_no, claim_no, col, name FROM names WHERE cue > 0 AND m >= 2 AND n >= m AND j = claim_no - (n - m)),
val AS (SELECT p.extraction_id, p.y, p.sentence_no, p.claim_no, p.col, coalesce(r.name, CASE
    WHEN lead AND is_last AND NOT gap THEN coalesce(after, before) WHEN lead THEN before ELSE coalesce(after, before) END) AS name
  FROM pick p LEFT JOIN resp r USING (extraction_id, y, sentence_no, claim_no, col)),
dl AS (SELECT extraction_id, y, sentence_no, claim_no, raw, CAST(regexp_replace(raw, '[,%]', '', 'g') AS DOUBLE) AS stated, length(regexp_extract(raw, '\\.([0-9]+)', 1)) AS decimals,
  (SELECT name FROM val v WHERE v.extraction_id = c.extraction_id AND v.y = c.y AND v.sentence_no = c.sentence_no AND v.claim_no = c.claim_no AND col = 'metric') AS metric,
  (SELECT name FROM val v WHERE v.extraction_id = c.extraction_id AND v.y = c.y AND v.sentence_no = c.sentence_no AND v.claim_no = c.claim_no AND col = 'priority') AS priority,
  (SELECT name FROM val v WHERE v.extraction_id = c.extraction_id AND v.y = c.y AND v.sentence_no = c.sentence_no AND v.claim_no = c.claim_no AND col = 'time_period') AS time_period
  FROM dn c),
cell AS (SELECT 'ext_' || k AS extraction_id, CAST(y * 100 + (y + 1) % 100 AS VARCHAR) AS time_period, priority,
  row_number() OVER (PARTITION BY k ORDER BY y, priority) - 1 AS row_no, {_T('tenths')} AS price_average,
  CASE priority WHEN 'Total' THEN '100' WHEN 'Urgent' THEN CAST(pu AS VARCHAR) ELSE CAST(100 - pu AS VARCHAR) END AS share_percent FROM g JOIN w USING (k, y)),
dv AS (SELECT l.*, (SELECT count(*) FROM cell x WHERE x.extraction_id = l.extraction_id AND l.metric IS NOT NULL AND x.priority = coalesce(l.priority, 'Total') AND x.time_period = coalesce(l.time_period, x.time_period)) AS candidates FROM dl l),
dr AS (SELECT v.*, CASE WHEN candidates = 1 THEN x.row_no END AS row_no, CASE WHEN candidates = 1 THEN CASE v.metric WHEN 'price_average' THEN x.price_average ELSE x.share_percent END END AS table_value,
  CASE WHEN candidates = 1 THEN 'priority=' || x.priority || ', time_period=' || x.time_period ELSE '' END AS evidence,
  concat_ws(', ', coalesce(v.priority, 'Total'), v.time_period) AS filter_value, CASE WHEN v.time_period IS NULL THEN 'time_period' ELSE '' END AS open_columns
  FROM dv v LEFT JOIN (SELECT v2.extraction_id AS e, v2.y AS yy, v2.sentence_no AS sn, v2.claim_no AS cn, any_value(x) AS x FROM dv v2 JOIN cell x
    ON x.extraction_id = v2.extraction_id AND x.priority = coalesce(v2.priority, 'Total') AND x.time_period = coalesce(v2.time_period, x.time_period) WHERE candidates = 1 GROUP BY ALL)
  ON e = v.extraction_id AND yy = v.y AND sn = v.sentence_no AND cn = v.claim_no),
checked AS (SELECT *, CASE WHEN candidates > 1 THEN 'AMBIGUOUS' WHEN TRY_CAST(table_value AS DOUBLE) IS NULL THEN 'UNMATCHED'
  WHEN abs(stated - CAST(table_value AS DOUBLE)) <= 0.5 * pow(10.0, -decimals) + 1e-6 THEN 'PASS' ELSE 'FAIL' END AS status FROM dr)"""


@query("link_dimensions", f"WITH {SPLIT} SELECT extraction_id, y, sentence_no, claim_no, raw, stated, metric, priority, time_period FROM dl")
def _(load):
    """Every number with a value for each filter column that its sentence names."""
    statement = statements(load)
    return linked(statement, split_extractions(statement)).select(
        "extraction_id", "y", "sentence_no", "claim_no", "raw", "stated", "metric", F.col("dimensions")["priority"].alias("priority"), F.col("dimensions")["time_period"].alias("time_period"))


@query("verify_in_lattice", f"WITH {SPLIT} SELECT extraction_id, y, sentence_no, claim_no, raw, metric, filter_value, candidates, open_columns, table_value, evidence, status FROM checked")
def _(load):
    """Claims with two dimensions against the one cell they mean."""
    return checked(load)[0].select("extraction_id", "y", "sentence_no", "claim_no", "raw", "metric", "filter_value", "candidates",
                                   F.array_join("open_columns", ",").alias("open_columns"), "table_value", "evidence", "status")


@query("trace_dimensions", f"""WITH {SPLIT} SELECT extraction_id, y, claim_no, sentence_no, raw, status, row_no, 'Prices of customer ' || replace(extraction_id, 'ext_', '') AS headline_text,
  CASE WHEN status = 'FAIL' THEN 'Replace ' || raw || ' by ' || regexp_replace(table_value, '^([+-]?[0-9]+)[.]0+$', '\\1') || ' (' || metric || ', ' || filter_value || ')' END AS suggestion FROM checked""")
def _(load):
    """Verified claims back to report, table row and correction."""
    claims, extraction = checked(load)
    claims = materialise(claims)
    # a claim is one row, so what is not corrected only lacks a suggestion
    noted = V.suggest_corrections(claims).unionByName(claims.filter(F.col("status") != "FAIL"), allowMissingColumns=True)
    return Q.trace(noted, extraction).select("extraction_id", "y", "claim_no", "sentence_no", "raw", "status", "row_no", "headline_text", "suggestion")
