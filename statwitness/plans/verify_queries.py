"""Verification queries: a yearly statement per customer, computed from all orders, with wrong figures in
some sentences; and the prose of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness.operators import claims as C, score as Q, style as Y, verify as V
from statwitness.plans.registry import query
from statwitness.plans.structure_queries import LINES0, text_lines

URGENT = ["1-URGENT", "2-HIGH"]


def accounts(load) -> DataFrame:
    """One row per customer and year: figures of the table and the sentence of the report."""
    base = load("orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("s"),
        F.count_if(F.col("o_orderpriority").isin(URGENT)).alias("u"))
    shown = base.selectExpr(
        "*", "(2 * s + 10 * n) div (20 * n) as tenths", "(200 * u + n) div (2 * n) as pct",
        "n = 1 and k % 5 = 0 as hidden").withColumn(
        "st", F.expr("tenths + case when (k + y) % 7 = 0 then 10 else 0 end"))
    return shown.selectExpr(
        "k", "y", "n", "s", "u", "pct", "tenths", "st", "hidden",
        "case when k % 13 = 0 and y % 2 = 0 then concat(y, '-', (y + 1) % 100) else cast(y * 100 + (y + 1) % 100 as string) end as time_period",
        "case when hidden then 'c' else concat(tenths div 10, '.', tenths % 10) end as price_average",
        "case when k % 19 = 0 then concat(pct * 10, '.0') else cast(pct as string) end as urgent_percent",
        "cast(100 - pct as string) as standard_percent",
        """concat('In ', y, ' the average price was ', case when hidden then 'suppressed' else concat(st div 10, '.', st % 10) end,
           ' while urgent and standard orders made up ', pct, '% and ', 100 - pct, '% respectively.',
           case when k % 17 = 0 then ' Some prices are not available.' else '' end) as paragraph""")


def extractions(load) -> DataFrame:
    """One extraction per customer (at most one row per year)."""
    row = F.create_map(*[x for c in ["time_period", "price_average", "urgent_percent", "standard_percent"] for x in (F.lit(c), F.col(c))])
    listed = accounts(load).groupBy("k").agg(F.array_sort(
        F.collect_list(F.struct("y", "paragraph", row.alias("row"))), lambda a, b: (a["y"] - b["y"]).cast("int")).alias("r"))
    return listed.select(
        F.concat(F.lit("ext_"), "k").alias("extraction_id"), F.col("k").alias("custkey"),
        F.concat(F.lit("Orders of customer "), "k").alias("headline_text"), (F.col("k") % 50 + 1).alias("headline_page"),
        F.transform("r", lambda x: x["paragraph"]).alias("paragraphs"),
        F.transform("r", lambda x: x["row"]).alias("extracted_table"),
        F.create_map(F.lit("customer"), F.array(F.col("k").cast("string")), F.lit("time_period"),
                     F.transform("r", lambda x: x["row"]["time_period"])).alias("filters_applied"),
        F.array(*map(F.lit, ["time_period", "price_average", "urgent_percent", "standard_percent"])).alias("columns_selected"))


def sentences(load) -> DataFrame:
    rows = accounts(load).select(F.concat(F.lit("ext_"), "k").alias("extraction_id"), "y", "paragraph")
    return C.split_sentences(rows, ["extraction_id", "y"], "paragraph")


def vocabulary(load) -> DataFrame:
    """Metric phrases and the years each customer's statement may speak about."""
    phrases = [("price_average", "average price"), ("urgent_percent", "urgent"), ("standard_percent", "standard")]
    metrics = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("mention")) for n, m in phrases])
    return accounts(load).groupBy("k").agg(F.array_sort(F.collect_list(F.struct(
        F.col("time_period").alias("name"), F.col("y").cast("string").alias("mention")))).alias("values")).select(
        F.concat(F.lit("ext_"), "k").alias("extraction_id"), metrics.alias("metrics"), "values")


def linked(load) -> DataFrame:
    return C.link_claims(sentences(load), vocabulary(load), ["y"])


def cells_by_time(load) -> DataFrame:
    """Metric cells keyed by their period."""
    return V.table_cells(extractions(load)).withColumn("filter_value", F.col("row_filters")["time_period"])


def checked_claims(load) -> DataFrame:
    return V.verify_claims(linked(load), cells_by_time(load))


def numeric(load) -> DataFrame:
    return V.numeric_report(V.verify_cells(extractions(load)), extractions(load))


def style(load) -> DataFrame:
    ext = extractions(load)
    cells = Y.all_cells(ext)
    return Y.style_report(Y.check_unit_consistency(cells, ext), Y.check_suppression_markers(ext), Y.check_time_format(cells, extractions=ext))


def scores(load) -> DataFrame:
    return Q.quality_score(numeric(load).drop("cell_reports"), style(load))


ACC = """acc0 AS (
  SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS s,
         count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) AS u FROM orders GROUP BY ALL),
acc1 AS (SELECT *, (2*s + 10*n) // (20*n) AS tenths, (200*u + n) // (2*n) AS pct, n = 1 AND k % 5 = 0 AS hidden FROM acc0),
acc2 AS (SELECT *, tenths + CASE WHEN (k + y) % 7 = 0 THEN 10 ELSE 0 END AS st FROM acc1),
acc AS (SELECT *, 'ext_' || k AS extraction_id,
  CASE WHEN k % 13 = 0 AND y % 2 = 0 THEN y || '-' || (y + 1) % 100 ELSE CAST(y * 100 + (y + 1) % 100 AS VARCHAR) END AS time_period,
  CASE WHEN hidden THEN 'c' ELSE tenths // 10 || '.' || tenths % 10 END AS price_average,
  CASE WHEN k % 19 = 0 THEN pct * 10 || '.0' ELSE CAST(pct AS VARCHAR) END AS urgent_percent,
  CAST(100 - pct AS VARCHAR) AS standard_percent,
  'In ' || y || ' the average price was ' || CASE WHEN hidden THEN 'suppressed' ELSE st // 10 || '.' || st % 10 END ||
  ' while urgent and standard orders made up ' || pct || '% and ' || (100 - pct) || '% respectively.' ||
  CASE WHEN k % 17 = 0 THEN ' Some prices are not available.' ELSE '' END AS paragraph,
  row_number() OVER (PARTITION BY k ORDER BY y) - 1 AS row_no FROM acc2),
texts AS (SELECT k, extraction_id, string_agg(paragraph, ' ' ORDER BY y) AS text FROM acc GROUP BY ALL)"""
MCELLS = ACC + """,
mcells AS (SELECT k, extraction_id, row_no, time_period, unnest(['price_average','urgent_percent','standard_percent']) AS metric,
  unnest([price_average, urgent_percent, standard_percent]) AS value, price_average, urgent_percent, standard_percent FROM acc)"""
_NUMBER = "[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?%?"
VERIFIED = MCELLS + f""",
numbers AS (SELECT extraction_id, list_transform(regexp_extract_all(text, '{_NUMBER}'), lambda x: CAST(regexp_replace(x, '[,%]', '', 'g') AS DOUBLE)) AS nums FROM texts),
verified AS (SELECT m.*, coalesce(list_contains(nums, TRY_CAST(value AS DOUBLE)), FALSE) AS verified FROM mcells m JOIN numbers USING (extraction_id)),
report AS (SELECT extraction_id, count(*) FILTER (WHERE verified) AS verified_cells, count(*) AS total_cells,
  count(*) FILTER (WHERE verified)::DOUBLE / count(*) AS overall_confidence,
  string_agg(row_no || ':' || metric || '=' || value || CASE WHEN verified THEN '' ELSE '!' END, ';' ORDER BY row_no, metric) AS cells FROM verified GROUP BY 1)"""
STYLE = """,
units AS (SELECT extraction_id, column_name, min(v) AS low, max(v) AS high FROM (
  SELECT extraction_id, metric AS column_name, TRY_CAST(value AS DOUBLE) AS v FROM mcells WHERE metric LIKE '%percent%') GROUP BY ALL),
unit_issues AS (SELECT extraction_id, string_agg(CASE WHEN NOT (low >= 0 AND high <= 100) THEN
  column_name || ': Mixed formats detected (range: ' || CAST(low AS BIGINT) || '-' || CAST(high AS BIGINT) || ')' END, ';' ORDER BY column_name) AS issue FROM units GROUP BY 1),
marks AS (SELECT extraction_id, CASE WHEN regexp_matches(lower(any_value(text)), 'suppressed|not available|not applicable|confidential')
    AND NOT bool_or(price_average IN ('c','x','z')) THEN 'Paragraph mentions suppression but table contains numeric values' END AS issue
  FROM acc JOIN texts USING (extraction_id) GROUP BY 1),
formats AS (SELECT extraction_id, CASE WHEN count(DISTINCT f) > 1 THEN 'Mixed time formats detected: ' || string_agg(DISTINCT f, ', ' ORDER BY f) END AS issue FROM (
  SELECT extraction_id, CASE WHEN regexp_full_match(time_period, '[0-9]{6}') THEN 'YYYYYY' WHEN contains(time_period, '-') THEN 'YYYY-YY' ELSE 'other' END AS f FROM acc) GROUP BY 1),
style AS (SELECT u.extraction_id, u.issue IS NULL AND m.issue IS NULL AND t.issue IS NULL AS all_passed,
  concat_ws(',', CASE WHEN m.issue IS NOT NULL THEN 'suppression_markers' END, CASE WHEN t.issue IS NOT NULL THEN 'time_format' END,
            CASE WHEN u.issue IS NOT NULL THEN 'unit_consistency' END) AS failed_checks,
  concat_ws(';', t.issue, m.issue, u.issue) AS issues
  FROM unit_issues u JOIN marks m USING (extraction_id) JOIN formats t USING (extraction_id))"""
SCORES = VERIFIED + STYLE + """,
scores AS (SELECT r.extraction_id, r.verified_cells, r.total_cells, overall_confidence, all_passed, issues, failed_checks,
  overall_confidence * 0.7::DOUBLE + CASE WHEN all_passed THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.3::DOUBLE AS quality_score
  FROM report r JOIN style s USING (extraction_id)),
judged AS (SELECT *, round(quality_score, 9) >= 0.85 AS passed FROM scores)"""
_SENT = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
CLAIMS = LINES0 + f""",
sents AS (SELECT doc_id, line_no, unnest({_SENT.format('line')}) AS sentence, unnest(range(len({_SENT.format('line')}))) AS sentence_no FROM text_lines),
cl AS (SELECT *, regexp_extract_all(sentence, '{_NUMBER}') AS found, regexp_split_to_array(sentence, '{_NUMBER}') AS parts FROM sents WHERE regexp_matches(sentence, '[0-9]')),
claims AS (SELECT doc_id, line_no, sentence_no, sentence, unnest(range(len(found))) AS claim_no, unnest(found) AS raw, found, parts FROM cl),
claims1 AS (SELECT doc_id, line_no, sentence_no, claim_no, raw,
  CAST(coalesce(list_sum(list_transform(parts[1:claim_no + 1], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(found[1:claim_no], lambda p: length(p))), 0) + 1 AS BIGINT) AS pos,
  CAST(regexp_replace(raw, '[,%]', '', 'g') AS DOUBLE) AS value, raw LIKE '%\\%' ESCAPE '\\' AS is_percent,
  length(regexp_extract(raw, '\\.([0-9]+)', 1)) AS decimals FROM claims)"""
def _words(text: str) -> str:
    """SQL: the text with a space for every mark and at both ends."""
    return f"(' ' || regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g') || ' ')"


_BACK, _AHEAD = _words("substring(s, 1, pos - 1)"), _words("substring(s, pos + length(raw))")
LINKED = ACC + f""",
lsents AS (SELECT extraction_id, y, lower(unnest({_SENT.format('paragraph')})) AS s, unnest(range(len({_SENT.format('paragraph')}))) AS sentence_no FROM acc),
lcl AS (SELECT *, regexp_extract_all(s, '{_NUMBER}') AS found, regexp_split_to_array(s, '{_NUMBER}') AS parts FROM lsents WHERE regexp_matches(s, '[0-9]')),
lall AS (SELECT *, unnest(range(len(found))) AS claim_no, unnest(found) AS raw FROM lcl),
lclaims AS (SELECT extraction_id, y, sentence_no, s, claim_no, raw,
  CAST(coalesce(list_sum(list_transform(parts[1:claim_no + 1], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(found[1:claim_no], lambda p: length(p))), 0) + 1 AS BIGINT) AS pos
  FROM lall a WHERE NOT EXISTS (SELECT 1 FROM acc v WHERE v.extraction_id = a.extraction_id AND CAST(v.y AS VARCHAR) = a.raw)),
entries AS (SELECT extraction_id, 'value' AS kind, time_period AS name, CAST(y AS VARCHAR) AS mention FROM acc
  UNION ALL SELECT DISTINCT extraction_id, 'metric', unnest(['price_average','urgent_percent','standard_percent']), unnest(['average price','urgent','standard']) FROM acc),
near AS (SELECT c.extraction_id, c.y, c.sentence_no, c.claim_no, kind, name,
    length(mention) AS len,
    least(CASE WHEN strpos(reverse({_BACK}), reverse({_words('mention')})) > 0 THEN (strpos(reverse({_BACK}), reverse({_words('mention')})) - 1) * 2 END,
          CASE WHEN strpos({_AHEAD}, {_words('mention')}) > 0 THEN (strpos({_AHEAD}, {_words('mention')}) - 1) * 2 + 1 END) AS d
  FROM lclaims c JOIN entries USING (extraction_id)),
nearest AS (SELECT extraction_id, y, sentence_no, claim_no, kind, arg_min(name, (d, -len, name)) AS name FROM near WHERE d IS NOT NULL GROUP BY ALL),
listed AS (SELECT extraction_id, y, sentence_no, s, count(*) FILTER (WHERE pos < strpos(s, 'respectively')) AS n FROM lclaims GROUP BY ALL),
order0 AS (SELECT l.extraction_id, l.y, l.sentence_no, kind, name, n, strpos(s, 'respectively') AS cue,
  row_number() OVER (PARTITION BY l.extraction_id, l.y, l.sentence_no, kind ORDER BY strpos({_words('s')}, {_words('mention')}), name) - 1 AS j,
  count(*) OVER (PARTITION BY l.extraction_id, l.y, l.sentence_no, kind) AS m
  FROM listed l JOIN entries e USING (extraction_id) WHERE strpos({_words('s')}, {_words('mention')}) > 0),
nclaims AS (SELECT *, row_number() OVER (PARTITION BY extraction_id, y, sentence_no ORDER BY claim_no) - 1 AS i FROM lclaims),
paired AS (SELECT c.extraction_id, c.y, c.sentence_no, c.claim_no, o.kind, o.name FROM nclaims c JOIN order0 o
  ON o.extraction_id = c.extraction_id AND o.y = c.y AND o.sentence_no = c.sentence_no AND o.j = c.i - (n - m)
  WHERE cue > 0 AND m >= 2 AND n >= m),
linked AS (SELECT c.extraction_id, c.y, c.sentence_no, c.claim_no, c.raw, CAST(regexp_replace(c.raw, '[,%]', '', 'g') AS DOUBLE) AS stated,
  length(regexp_extract(c.raw, '\\.([0-9]+)', 1)) AS decimals,
  coalesce(pm.name, nm.name) AS metric, CASE WHEN pm.name IS NOT NULL THEN 'respectively' WHEN nm.name IS NOT NULL THEN 'nearest' END AS metric_method,
  coalesce(pv.name, nv.name) AS filter_value
  FROM lclaims c
  LEFT JOIN paired pm ON pm.extraction_id = c.extraction_id AND pm.y = c.y AND pm.sentence_no = c.sentence_no AND pm.claim_no = c.claim_no AND pm.kind = 'metric'
  LEFT JOIN paired pv ON pv.extraction_id = c.extraction_id AND pv.y = c.y AND pv.sentence_no = c.sentence_no AND pv.claim_no = c.claim_no AND pv.kind = 'value'
  LEFT JOIN nearest nm ON nm.extraction_id = c.extraction_id AND nm.y = c.y AND nm.sentence_no = c.sentence_no AND nm.claim_no = c.claim_no AND nm.kind = 'metric'
  LEFT JOIN nearest nv ON nv.extraction_id = c.extraction_id AND nv.y = c.y AND nv.sentence_no = c.sentence_no AND nv.claim_no = c.claim_no AND nv.kind = 'value'),
tcells AS (SELECT extraction_id, row_no, time_period AS filter_value, unnest(['price_average','urgent_percent','standard_percent']) AS metric,
  unnest([price_average, urgent_percent, standard_percent]) AS table_value FROM acc),
vclaims AS (SELECT l.*, t.table_value, t.row_no, CASE WHEN TRY_CAST(t.table_value AS DOUBLE) IS NULL THEN 'UNMATCHED'
  WHEN abs(stated - CAST(t.table_value AS DOUBLE)) <= 0.5 * pow(10.0, -decimals) + 1e-6 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM linked l LEFT JOIN tcells t USING (extraction_id, metric, filter_value))"""


def doc_claims(load) -> DataFrame:
    return C.extract_claims(text_lines(load), ["doc_id", "line_no"], "line")


@query("extract_claims", f"WITH {CLAIMS} SELECT * FROM claims1")
def _(load):
    return doc_claims(load).drop("sentence")


@query("link_claims", f"WITH {LINKED} SELECT extraction_id, y, sentence_no, claim_no, raw, stated, metric, metric_method, filter_value FROM linked")
def _(load):
    return linked(load).select("extraction_id", "y", "sentence_no", "claim_no", "raw", "stated", "metric", "metric_method", "filter_value")


@query("table_cells", f"""WITH {MCELLS}
SELECT extraction_id, row_no, metric, value, concat_ws(', ', CASE WHEN metric <> 'price_average' THEN 'price_average=' || price_average END,
  CASE WHEN metric <> 'standard_percent' THEN 'standard_percent=' || standard_percent END, 'time_period=' || time_period,
  CASE WHEN metric <> 'urgent_percent' THEN 'urgent_percent=' || urgent_percent END) AS row_filters FROM mcells""")
def _(load):
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("row_filters")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return V.table_cells(extractions(load)).withColumn("row_filters", shown)


@query("verify_cells", f"""WITH {VERIFIED}
SELECT extraction_id, row_no, metric, value, v.verified, contains(text, value) AS in_text,
  CASE WHEN v.verified THEN 0.95::DOUBLE END AS confidence FROM verified v JOIN texts USING (extraction_id)""")
def _(load):
    ext = extractions(load)
    loose = V.verify_cells(ext, "substring").select("extraction_id", "row_no", "metric", F.col("verified").alias("in_text"))
    return V.verify_cells(ext).join(loose, ["extraction_id", "row_no", "metric"]).select(
        "extraction_id", "row_no", "metric", "value", "verified", "in_text", "confidence")


@query("verify_cell_evidence", f"""WITH {ACC},
asked AS (SELECT CASE WHEN k % 23 = 0 THEN 'none' ELSE extraction_id END AS extraction_id, y, time_period,
  CASE WHEN hidden THEN 'c' ELSE st // 10 || '.' || st % 10 END AS value, CASE WHEN k % 3 = 0 THEN 'In ' || y ELSE 'year ' || y END AS filter_text FROM acc)
SELECT a.extraction_id, a.y, a.value, CASE WHEN t.extraction_id IS NULL THEN 'No matching extraction found'
  WHEN NOT EXISTS (SELECT 1 FROM acc b WHERE b.extraction_id = a.extraction_id AND b.time_period = a.time_period AND b.price_average = a.value) THEN 'Value not found in extracted table'
  WHEN contains(text, a.value) AND contains(lower(text), lower(filter_text)) THEN 'verified'
  ELSE 'Value in table but not explicitly stated in paragraph' END AS status FROM asked a LEFT JOIN texts t USING (extraction_id)""")
def _(load):
    asked = accounts(load).select(
        F.when(F.col("k") % 23 == 0, "none").otherwise(F.concat(F.lit("ext_"), "k")).alias("extraction_id"), "y",
        F.create_map(F.lit("time_period"), "time_period").alias("row_filters"), F.lit("price_average").alias("metric"),
        F.expr("case when hidden then 'c' else concat(st div 10, '.', st % 10) end").alias("value"),
        F.expr("case when k % 3 = 0 then concat('In ', y) else concat('year ', y) end").alias("filter_text"))
    return V.verify_cell_evidence(asked, extractions(load)).select("extraction_id", "y", "value", "status")


@query("verify_claims", f"WITH {LINKED} SELECT extraction_id, y, sentence_no, claim_no, raw, metric, filter_value, table_value, status FROM vclaims")
def _(load):
    return checked_claims(load).select(
        "extraction_id", "y", "sentence_no", "claim_no", "raw", "metric", "filter_value", "table_value", "status")


def customer_claims(load) -> DataFrame:
    """Stated totals per customer, some of them wrong."""
    return load("orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("s"),
        F.count_if(F.col("o_orderpriority").isin(URGENT)).alias("u")).selectExpr(
        "k", "cast(((2 * s + 10 * n) div (20 * n) + case when k % 7 = 0 then 3 else 0 end) * 10 as double) as mean_stated",
        "cast((200 * u + n) div (2 * n) + case when k % 7 = 1 then 3 else 0 end as double) as share_stated")


CUST = """cust AS (SELECT o_custkey AS k, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS s,
  count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) AS u FROM orders GROUP BY 1)"""


@query("verify_mean", f"""WITH {CUST}, c AS (SELECT k, CAST(((2*s + 10*n) // (20*n) + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END) * 10 AS DOUBLE) AS stated, s::DOUBLE / n AS computed FROM cust)
SELECT k, stated, round(computed, 3) AS computed, CASE WHEN abs(stated - computed) <= 5 + 1e-6 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def _(load):
    """Means in cents, stated to the nearest ten."""
    claims = customer_claims(load).select("k", F.col("mean_stated").alias("stated"), F.lit(-1).alias("decimals"))
    table = load("orders").select(F.col("o_custkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return V.verify_mean(claims, table, ["k"], F.col("cents")).select("k", "stated", F.round("computed", 3).alias("computed"), "status")


@query("verify_percentage", f"""WITH {CUST}, c AS (SELECT k, CAST((200*u + n) // (2*n) + CASE WHEN k % 7 = 1 THEN 3 ELSE 0 END AS DOUBLE) AS stated, 100.0::DOUBLE * u / n AS computed FROM cust)
SELECT k, stated, round(computed, 6) AS computed, CASE WHEN abs(stated - computed) <= 0.5 + 1e-6 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def _(load):
    claims = customer_claims(load).select("k", F.col("share_stated").alias("stated"), F.lit(0).alias("decimals"))
    table = load("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").isin(URGENT).cast("int").alias("part"))
    return V.verify_percentage(claims, table, ["k"], F.col("part"), F.lit(1)).select("k", "stated", F.round("computed", 6).alias("computed"), "status")


@query("verify_difference", """WITH m AS (SELECT o_custkey AS k, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) AS DOUBLE)
    / count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) AS a,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')) AS DOUBLE)
    / count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')) AS b FROM orders GROUP BY 1),
c AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'higher' ELSE 'lower' END AS direction, CASE WHEN isfinite(a) AND isfinite(b) THEN a - b END AS d FROM m)
SELECT k, direction, round(d, 3) AS difference, CASE WHEN d IS NULL THEN 'UNMATCHED'
  WHEN direction = CASE WHEN d > 0 THEN 'higher' WHEN d < 0 THEN 'lower' ELSE 'equal' END THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def _(load):
    table = load("orders").select(
        F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority").isin(URGENT), "urgent").otherwise("standard").alias("g"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    claims = table.select("k").distinct().select(
        "k", F.lit("urgent").alias("group_a"), F.lit("standard").alias("group_b"),
        F.when(F.col("k") % 2 == 0, "higher").otherwise("lower").alias("direction"))
    return V.verify_difference(claims, table, ["k"], "g", F.col("cents")).select(
        "k", "direction", F.round("difference", 3).alias("difference"), "status")


_AMOUNTS = """WITH m AS (SELECT o_custkey AS k,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')) AS DOUBLE) / nullif(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT','2-HIGH')), 0) AS a,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')) AS DOUBLE) / nullif(count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')), 0) AS b
  FROM orders GROUP BY 1),
r AS (SELECT *, CAST(floor(a / 10000 + 0.5) AS BIGINT) AS ra, CAST(floor(b / 10000 + 0.5) AS BIGINT) AS rb, CASE WHEN k % 3 = 0 THEN 'percent' ELSE 'points' END AS unit FROM m),
c AS (SELECT *, CASE WHEN k % 11 = 0 THEN CASE WHEN ra > rb THEN 'lower' ELSE 'higher' END WHEN ra > rb THEN 'higher' WHEN ra < rb THEN 'lower' ELSE 'equal' END AS direction,
  CASE WHEN k % 13 = 0 OR ra IS NULL OR rb IS NULL THEN NULL WHEN unit = 'percent' THEN CAST((200 * abs(ra - rb) + rb) // (2 * rb) + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END AS DOUBLE)
    ELSE CAST((abs(ra - rb) + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END) * 10000 AS DOUBLE) END AS amount FROM r),
d AS (SELECT *, a - b AS diff, CASE direction WHEN 'higher' THEN a - b + 10000 > 0 WHEN 'lower' THEN a - b - 10000 < 0 ELSE a - b - 10000 <= 0 AND a - b + 10000 >= 0 END AS direction_holds,
  CASE WHEN unit = 'percent' THEN 100 * (a - 5000) / (b + 5000) - 100 ELSE a - b - 10000 END AS dn, CASE WHEN unit = 'percent' THEN 100 * (a + 5000) / (b - 5000) - 100 ELSE a - b + 10000 END AS up FROM c),
e AS (SELECT *, CASE WHEN dn <= 0 AND up >= 0 THEN 0.0 ELSE least(abs(dn), abs(up)) END AS lo, greatest(abs(dn), abs(up)) AS hi FROM d),
f AS (SELECT *, amount IS NULL OR (amount + CASE unit WHEN 'percent' THEN 0.5 ELSE 5000 END + 1e-6 >= lo AND amount - CASE unit WHEN 'percent' THEN 0.5 ELSE 5000 END - 1e-6 <= hi) AS amount_holds FROM e)
SELECT k, direction, unit, amount, round(diff, 3) AS difference, direction_holds, amount_holds,
  CASE WHEN diff IS NULL THEN 'UNMATCHED' WHEN direction_holds AND amount_holds THEN 'PASS' ELSE 'FAIL' END AS status FROM f"""


@query("verify_amounts", _AMOUNTS)
def _(load):
    """Stated differences between means that were rounded to a hundred before they were compared: direction and amount."""
    table = load("orders").select(
        F.col("o_custkey").alias("k"), F.when(F.col("o_orderpriority").isin(URGENT), "urgent").otherwise("standard").alias("g"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    mean = lambda g: F.avg(F.when(F.col("g") == g, F.col("cents")))
    rounded = table.groupBy("k").agg(F.floor(mean("urgent") / 10000 + 0.5).alias("ra"), F.floor(mean("standard") / 10000 + 0.5).alias("rb"))
    claims = rounded.selectExpr(
        "k", "'urgent' as group_a", "'standard' as group_b", "case when k % 3 = 0 then 'percent' else 'points' end as unit",
        "case when k % 11 = 0 then case when ra > rb then 'lower' else 'higher' end when ra > rb then 'higher' when ra < rb then 'lower' else 'equal' end as direction",
        """cast(case when k % 13 = 0 or ra is null or rb is null then null when k % 3 = 0 then (200 * abs(ra - rb) + rb) div (2 * rb) + case when k % 7 = 0 then 3 else 0 end
             else (abs(ra - rb) + case when k % 7 = 0 then 3 else 0 end) * 10000 end as double) as amount""",
        "case when k % 3 = 0 then 0 else -4 end as decimals")
    out = V.verify_difference(claims, table, ["k"], "g", F.col("cents"), mean_decimals=-4)
    return out.select("k", "direction", "unit", "amount", F.round("difference", 3).alias("difference"), "direction_holds", "amount_holds", "status")


@query("cell_evidence", f"""WITH {VERIFIED},
es AS (SELECT extraction_id, y, unnest({_SENT.format('paragraph')}) AS sentence, unnest(range(len({_SENT.format('paragraph')}))) AS i FROM acc),
en AS (SELECT *, list_transform(regexp_extract_all(sentence, '{_NUMBER}'), lambda x: CAST(regexp_replace(x, '[,%]', '', 'g') AS DOUBLE)) AS nums FROM es),
ev AS (SELECT v.extraction_id, v.row_no, v.metric, arg_min(sentence, (y, i)) AS evidence FROM verified v JOIN en USING (extraction_id)
  WHERE list_contains(nums, TRY_CAST(value AS DOUBLE)) GROUP BY ALL)
SELECT v.extraction_id, v.row_no, v.metric, value, v.verified, CASE WHEN v.verified THEN 'direct_text_match' ELSE 'not_stated' END AS evidence_type,
  concat_ws(', ', CASE WHEN metric <> 'price_average' THEN 'price_average=' || price_average END,
  CASE WHEN metric <> 'standard_percent' THEN 'standard_percent=' || standard_percent END, 'time_period=' || time_period,
  CASE WHEN metric <> 'urgent_percent' THEN 'urgent_percent=' || urgent_percent END) AS row_filters, evidence
FROM verified v LEFT JOIN ev USING (extraction_id, row_no, metric)""")
def _(load):
    """Cells with the other columns of their row and the sentence that states them."""
    cells = V.verify_cells(extractions(load))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("row_filters")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return cells.select("extraction_id", "row_no", "metric", "value", "verified", "evidence_type", shown.alias("row_filters"), "evidence")


@query("verify_trend", f"""WITH {ACC},
steps AS (SELECT k, y, tenths, tenths - lag(tenths) OVER (PARTITION BY k ORDER BY y) AS d FROM acc),
ends AS (SELECT k, arg_min(tenths, y) AS first_value, arg_max(tenths, y) AS last_value,
  coalesce(bool_and(d >= 0), TRUE) OR coalesce(bool_and(d <= 0), TRUE) AS monotone FROM steps GROUP BY k),
c AS (SELECT *, ['increasing','decreasing','stable'][k % 3 + 1] AS direction,
  CASE WHEN last_value > first_value THEN 'increasing' WHEN last_value < first_value THEN 'decreasing' ELSE 'stable' END AS computed FROM ends)
SELECT k, direction, first_value, last_value, computed, monotone, CASE WHEN computed = direction THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def _(load):
    series = accounts(load).select("k", "y", "tenths")
    claims = series.select("k").distinct().withColumn("direction", F.element_at(
        F.array(*map(F.lit, ["increasing", "decreasing", "stable"])), (F.col("k") % 3 + 1).cast("int")))
    return V.verify_trend(claims, series, ["k"], "y", "tenths")


@query("verify_extreme", """WITH t AS (SELECT o_custkey AS k, o_orderpriority AS g, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY ALL),
top AS (SELECT k, g AS top_group, v AS top_value FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, g) AS rk FROM t) WHERE rk = 1)
SELECT k, CASE WHEN k % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS stated_group, top_group, top_value,
  CASE WHEN top_group = CASE WHEN k % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END THEN 'PASS' ELSE 'FAIL' END AS status FROM top""")
def _(load):
    totals = load("orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("g")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("v"))
    claims = totals.select("k").distinct().withColumn("stated_group", F.when(F.col("k") % 2 == 0, "1-URGENT").otherwise("5-LOW"))
    return V.verify_extreme(claims, totals, ["k"], "g", "v")


@query("numeric_report", f"WITH {VERIFIED} SELECT extraction_id, verified_cells, total_cells, round(overall_confidence, 9) AS overall_confidence, cells FROM report")
def _(load):
    shown = lambda c: F.concat(c["row_no"], F.lit(":"), c["metric"], F.lit("="), c["value"], F.when(c["verified"], "").otherwise("!"))
    return numeric(load).select("extraction_id", "verified_cells", "total_cells", F.round("overall_confidence", 9).alias("overall_confidence"),
                                F.array_join(F.transform("cell_reports", shown), ";").alias("cells"))


@query("suggest_corrections", f"""WITH {LINKED}
SELECT extraction_id, y, raw, 'Replace ' || raw || ' by ' || regexp_replace(table_value, '^([+-]?[0-9]+)[.]0+$', '\\1') || ' (' || metric || ', ' || filter_value || ')' AS suggestion
FROM vclaims WHERE status = 'FAIL'""")
def _(load):
    return V.suggest_corrections(checked_claims(load)).select("extraction_id", "y", "raw", "suggestion")


# ---- style ------------------------------------------------------------------------------------


@query("check_unit_consistency", f"WITH {VERIFIED}{STYLE} SELECT extraction_id, issue IS NULL AS passed, coalesce(issue, '') AS issues FROM unit_issues")
def _(load):
    return Y.check_unit_consistency(Y.all_cells(extractions(load))).select("extraction_id", "passed", F.array_join("issues", ";").alias("issues"))


@query("check_suppression_markers", f"WITH {VERIFIED}{STYLE} SELECT extraction_id, issue IS NULL AS passed, coalesce(issue, '') AS issues FROM marks")
def _(load):
    return Y.check_suppression_markers(extractions(load)).select("extraction_id", "passed", F.array_join("issues", ";").alias("issues"))


@query("check_time_format", f"WITH {VERIFIED}{STYLE} SELECT extraction_id, issue IS NULL AS passed, coalesce(issue, '') AS issues FROM formats")
def _(load):
    return Y.check_time_format(Y.all_cells(extractions(load))).select("extraction_id", "passed", F.array_join("issues", ";").alias("issues"))


@query("style_report", f"WITH {VERIFIED}{STYLE} SELECT extraction_id, all_passed, failed_checks FROM style")
def _(load):
    return style(load).select("extraction_id", "all_passed", F.array_join("failed_checks", ",").alias("failed_checks"))


VARIANTS = {"th": ["the", "thth"], "an": ["and", "anan", "in and"], "de": ["de", "des"], "cion": ["ción", "ciónes"]}
_W = "' ' || trim(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"


@query("terminology_inconsistencies", f"""WITH {LINES0},
v AS (SELECT * FROM (VALUES {', '.join(f"('{t}', '{x}')" for t, xs in VARIANTS.items() for x in xs)}) v(term, variant)),
hits AS (SELECT doc_id, term, variant, count(*) AS n FROM text_lines JOIN v ON contains({_W}, ' ' || variant || ' ') GROUP BY ALL)
SELECT doc_id, term, count(*) AS n_variants, string_agg(variant || ':' || n, ',' ORDER BY variant) AS variants FROM hits GROUP BY ALL HAVING count(*) > 1""")
def _(load):
    shown = lambda v: F.concat(v["variant"], F.lit(":"), v["n"])
    return Y.terminology_inconsistencies(text_lines(load), ["doc_id"], "line", VARIANTS).withColumn(
        "variants", F.array_join(F.transform("variants", shown), ","))


_FORMS = """tok AS (SELECT conv_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{L} -]+', ' | ', 'g') || ' |', '[ ]+'), lambda t: t <> '') AS t FROM conversations WHERE text IS NOT NULL),
f0 AS (
  SELECT conv_id, replace(x, '-', '') AS key, x AS form, FALSE AS pair FROM (SELECT conv_id, unnest(t) AS x FROM tok) WHERE regexp_full_match(x, '\\p{L}+(-\\p{L}+)*')
  UNION ALL SELECT conv_id, a || b, a || ' ' || b, TRUE FROM (SELECT conv_id, unnest(t[1:len(t) - 1]) AS a, unnest(t[2:len(t)]) AS b FROM tok) WHERE regexp_full_match(a, '\\p{L}+') AND regexp_full_match(b, '\\p{L}+')),
forms AS (SELECT conv_id, key, form, pair, count(*) AS n FROM f0 WHERE length(key) >= 6 GROUP BY ALL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY conv_id, key) AS m, bool_or(NOT pair) OVER (PARTITION BY conv_id, key) AS solid,
  first_value(form) OVER w AS term, first_value(n) OVER w AS n_term FROM forms WINDOW w AS (PARTITION BY conv_id, key ORDER BY n DESC, form)),
words AS (SELECT conv_id, key, CAST(sum(n) AS BIGINT) AS n FROM forms WHERE NOT pair GROUP BY ALL)"""


@query("term_variants", f"""WITH {_FORMS}
SELECT conv_id, 'spacing' AS kind, term, form AS variant, n_term, n AS n_variant FROM ranked WHERE m > 1 AND solid AND form <> term
UNION ALL SELECT a.conv_id, 'spelling', b.key, a.key, b.n, a.n FROM words a JOIN words b ON a.conv_id = b.conv_id AND abs(length(a.key) - length(b.key)) <= 1
  AND (b.n > a.n OR (b.n = a.n AND b.key < a.key)) WHERE CASE WHEN length(a.key) = length(b.key) THEN len(list_filter(range(1, length(a.key) + 1), lambda i: substr(a.key, i::INT, 1) <> substr(b.key, i::INT, 1))) = 1
    WHEN length(a.key) > length(b.key) THEN list_contains(list_transform(range(1, length(a.key) + 1), lambda i: substr(a.key, 1, (i - 1)::INT) || substr(a.key, (i + 1)::INT)), b.key)
    ELSE list_contains(list_transform(range(1, length(b.key) + 1), lambda i: substr(b.key, 1, (i - 1)::INT) || substr(b.key, (i + 1)::INT)), a.key) END AND a.key <> b.key || 's' AND b.key <> a.key || 's'""")
def _(load):
    """Competing spellings inside a conversation, without a list of terms."""
    return Y.term_variants(load("conversations"), ["conv_id"], "text")


@query("number_format_consistency", f"""WITH {CLAIMS},
w AS (SELECT doc_id, bool_or(regexp_matches(lower(line), 'per cent|percent')) AS worded FROM text_lines GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_claims, bool_or(is_percent) AS signed, string_agg(DISTINCT CAST(decimals AS VARCHAR), ',' ORDER BY CAST(decimals AS VARCHAR)) AS decimals,
  count(DISTINCT decimals) AS nd FROM claims1 GROUP BY 1)
SELECT doc_id, worded, n_claims, signed, decimals, NOT (worded AND signed) AND nd <= 1 AS consistent FROM w JOIN f USING (doc_id)""")
def _(load):
    out = Y.number_format_consistency(text_lines(load), doc_claims(load), ["doc_id"], "line")
    return out.withColumn("decimals", F.array_join(F.array_sort(F.transform("decimals", lambda d: d.cast("string"))), ","))


@query("readability", f"""WITH {LINES0},
s AS (SELECT doc_id, unnest({_SENT.format('line')}) AS sentence FROM text_lines),
n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(sentence, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+'), lambda w: w <> '')) AS n FROM s)
SELECT doc_id, count(*) AS n_sentences, round(avg(n), 6) AS words_per_sentence, round(avg(CASE WHEN n > 25 THEN 1.0 ELSE 0.0 END), 6) AS long_share
FROM n WHERE n > 0 GROUP BY 1""")
def _(load):
    out = Y.readability(text_lines(load), ["doc_id"], "line")
    return out.select("doc_id", "n_sentences", F.round("words_per_sentence", 6).alias("words_per_sentence"), F.round("long_share", 6).alias("long_share"))


# ---- scores -----------------------------------------------------------------------------------


@query("quality_score", f"WITH {SCORES} SELECT extraction_id, round(quality_score, 9) AS quality_score, passed FROM judged")
def _(load):
    return scores(load).select("extraction_id", F.round("quality_score", 9).alias("quality_score"), "passed")


@query("quality_dashboard", f"""WITH {SCORES} SELECT count(*) AS total, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
  round(count(*) FILTER (WHERE passed)::DOUBLE / count(*), 9) AS passed_share, round(count(*) FILTER (WHERE NOT passed)::DOUBLE / count(*), 9) AS failed_share,
  round(avg(quality_score), 7) AS average_score FROM judged""")
def _(load):
    d = Q.quality_dashboard(scores(load))
    return d.select("total", "passed", "failed", F.round("passed_share", 9).alias("passed_share"),
                    F.round("failed_share", 9).alias("failed_share"), F.round("average_score", 7).alias("average_score"))


@query("failed_extractions", f"""WITH {SCORES} SELECT extraction_id, round(quality_score, 9) AS quality_score,
  concat_ws(';', CASE WHEN total_cells > verified_cells THEN (total_cells - verified_cells) || ' cells could not be verified' END, nullif(issues, '')) AS issues
FROM judged WHERE NOT passed""")
def _(load):
    return Q.failed_extractions(scores(load)).select(
        "extraction_id", F.round("quality_score", 9).alias("quality_score"), F.array_join("all_issues", ";").alias("issues"))


def answers(load) -> DataFrame:
    """The last feedback of each user, read as the answer to the statement of the customer with that number."""
    last = load("events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return last.select(F.concat(F.lit("ext_"), "user_id").alias("extraction_id"), (F.col("e.value") > 20).alias("agree"),
                       F.col("e.event_type").alias("commentary"))


ANSWERS = """answers AS (SELECT 'ext_' || user_id AS extraction_id, arg_max(value, (ts, event_id)) > 20 AS agree, arg_max(event_type, (ts, event_id)) AS commentary
  FROM events GROUP BY user_id)"""
_TABLE = "extraction_id, 'Orders of customer ' || k AS \"Headline\", text AS \"Analyzed Text\""
_AGREE = "CASE WHEN agree THEN 'Yes' WHEN NOT agree THEN 'No' END AS \"Agree\", commentary AS \"Commentary\""


@query("numeric_results_table", f"""WITH {LINKED}, {ANSWERS},
v AS (SELECT extraction_id, count(*) FILTER (WHERE status = 'FAIL') = 0 AS ok,
  coalesce(string_agg('Replace ' || raw || ' by ' || regexp_replace(table_value, '^([+-]?[0-9]+)[.]0+$', '\\1') || ' (' || metric || ', ' || filter_value || ')', '; ' ORDER BY y, sentence_no, claim_no) FILTER (WHERE status = 'FAIL'), '') AS sug
  FROM vclaims GROUP BY 1)
SELECT {_TABLE}, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS "Numbers Correct", sug AS "Suggestions", {_AGREE}
FROM v JOIN texts USING (extraction_id) LEFT JOIN answers USING (extraction_id)""")
def _(load):
    claims = checked_claims(load)
    notes = V.suggest_corrections(claims).groupBy("extraction_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("y", "sentence_no", "claim_no", "suggestion"))), lambda s: s["suggestion"]), "; ").alias("suggestions"))
    judged = claims.groupBy("extraction_id").agg((F.count_if(F.col("status") == "FAIL") == 0).alias("ok"))
    texts = extractions(load).select("extraction_id", "headline_text", F.array_join("paragraphs", " ").alias("analyzed_text"))
    results = texts.join(judged, "extraction_id").join(notes, "extraction_id", "left").fillna("", ["suggestions"])
    return Q.numeric_results_table(results, answers(load))


@query("style_results_table", f"""WITH {VERIFIED}{STYLE}, {ANSWERS}
SELECT {_TABLE}, CASE WHEN all_passed THEN 'PASS' ELSE 'FAIL' END AS "Style Check", issues AS "Suggestions", {_AGREE}
FROM style JOIN texts USING (extraction_id) LEFT JOIN answers USING (extraction_id)""")
def _(load):
    texts = extractions(load).select("extraction_id", "headline_text", F.array_join("paragraphs", " ").alias("analyzed_text"))
    results = texts.join(style(load), "extraction_id").select(
        "*", F.col("all_passed").alias("ok"), F.array_join("issues", ";").alias("suggestions"))
    return Q.style_results_table(results, answers(load))


@query("trace", f"""WITH {LINKED}
SELECT extraction_id, y, claim_no, raw, status, row_no, 'Orders of customer ' || k AS headline_text, k % 50 + 1 AS headline_page,
  'customer,time_period' AS filters, 'time_period,price_average,urgent_percent,standard_percent' AS columns_selected
FROM vclaims v JOIN texts USING (extraction_id)""")
def _(load):
    return Q.trace(checked_claims(load), extractions(load)).select(
        "extraction_id", "y", "claim_no", "raw", "status", "row_no", "headline_text", "headline_page",
        F.array_join(F.array_sort(F.map_keys("filters_applied")), ",").alias("filters"),
        F.array_join("columns_selected", ",").alias("columns_selected"))
