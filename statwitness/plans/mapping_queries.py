"""Mapping and storage queries: every line of documents is a headline, labels say which tables it uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness.operators import mapping as O
from statwitness.operators.profile import column_stats, value_counts
from statwitness.plans.extract_queries import STATS, shipments
from statwitness.plans.registry import query
from statwitness.plans.structure_queries import LINES0, text_lines
from statwitness.session import materialise, new_folder
from statwitness.sources import exports, extractions as X, mappings as MP
from statwitness.sources.tables import read_data_tables

CREATED = "2024-01-15T10:30:00"
TEXTS_PER_FILE = 2000


def headlines(load) -> DataFrame:
    return text_lines(load).select(
        F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")).alias("report"), "doc_id",
        (F.col("line_no") + 1).alias("headline_no"), F.col("line").alias("text"), "page",
        F.when(F.length("line") % 5 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("About: "), "line"))).alias("paragraphs"))


def choices(load) -> DataFrame:
    picked = headlines(load).join(load("labels"), "doc_id").select(
        "report", O.headline_key(F.col("page"), F.col("text")).alias("key"),
        F.when(F.col("headline_no") % 3 != F.col("quality"),
               F.concat(F.lit("quality_"), "quality", F.lit(".csv"))).alias("a"),
        F.when(F.col("toxic") == 1, "toxic.csv").alias("b"))
    return picked.select("report", "key", F.explode(F.array("a", "b")).alias("csv_file")).filter("csv_file is not null")


def mapped(load) -> DataFrame:
    return O.map_headlines(headlines(load), choices(load))


def documents(load) -> DataFrame:
    rows = mapped(load).select(
        F.col("report").alias("pdf_filename"), "headline_no", F.col("text").alias("headline_text"),
        F.col("page").alias("headline_page"), "paragraphs", "csv_files")
    return MP.mapping_documents(rows, F.lit(CREATED))


def pairs(load, first_only: bool = False) -> DataFrame:
    return O.explode_mapping(documents(load), first_only)


def known_tables(load) -> DataFrame:
    return load.spark.createDataFrame([("quality_0.csv",), ("quality_1.csv",)], "csv_file string")


HEADS = LINES0 + """,
heads AS (SELECT 'doc_' || doc_id || '.pdf' AS report, doc_id, line_no + 1 AS headline_no, line AS text, page,
  'h' || page || '_' || substring(line, 1, 50) AS key, CASE WHEN length(line) % 5 = 0 THEN NULL ELSE 'About: ' || line END AS paragraph
  FROM text_lines)"""
MAPPED = HEADS + """,
picked AS (SELECT DISTINCT report, key, csv_file FROM (
  SELECT report, key, unnest([CASE WHEN headline_no % 3 <> quality THEN 'quality_' || quality || '.csv' END,
                              CASE WHEN toxic = 1 THEN 'toxic.csv' END]) AS csv_file
  FROM heads JOIN labels USING (doc_id)) WHERE csv_file IS NOT NULL),
pairs AS (SELECT h.*, csv_file FROM heads h JOIN picked USING (report, key)),
mapped AS (SELECT report, headline_no, text, page, paragraph, string_agg(csv_file, ',' ORDER BY csv_file) AS csv_files
  FROM pairs GROUP BY ALL)"""
ERRORS = MAPPED + """,
checked AS (SELECT *, CASE WHEN paragraph IS NULL THEN 'Missing paragraph or CSV file'
  WHEN csv_file NOT IN ('quality_0.csv','quality_1.csv') THEN 'Failed to load CSV' END AS error FROM pairs)"""


@query("headline_key", f"WITH {HEADS} SELECT doc_id, headline_no, key FROM heads")
def _(load):
    return headlines(load).select("doc_id", "headline_no", O.headline_key(F.col("page"), F.col("text")).alias("key"))


@query("map_headlines", f"WITH {MAPPED} SELECT report, headline_no, text, csv_files FROM mapped")
def _(load):
    return mapped(load).select("report", "headline_no", "text", F.array_join("csv_files", ",").alias("csv_files"))


@query("write_mappings", f"""WITH {MAPPED}
SELECT report AS pdf_filename, '{CREATED}' AS created_at, count(*) AS n_mappings,
  string_agg(text || ' -> ' || csv_files, chr(10) ORDER BY headline_no) AS mappings FROM mapped GROUP BY report""")
def _(load):
    """Write the mapping documents as JSON and read them back."""
    path = new_folder(load.spark, "mappings")
    MP.write_mappings(documents(load), path)
    line = lambda m: F.concat(m["headline_text"], F.lit(" -> "), F.array_join(m["csv_files"], ","))
    return MP.read_mappings(load.spark, path).select(
        "pdf_filename", "created_at", F.size("mappings").alias("n_mappings"),
        F.array_join(F.transform("mappings", line), "\n").alias("mappings"))


@query("read_mappings", f"""WITH {MAPPED},
docs AS (SELECT report, count(*) AS n, count(*) % 3 = 1 AS bad FROM mapped GROUP BY 1)
SELECT CASE WHEN bad THEN 'Invalid JSON' END AS error, count(*) AS n_documents,
       CAST(coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS BIGINT) AS n_headlines FROM docs GROUP BY 1""")
def _(load):
    """Documents with one or four or seven ... headlines are cut short on purpose before reading."""
    path = new_folder(load.spark, "mappings")
    text = F.to_json(F.struct("pdf_filename", "created_at", "mappings"))
    cut = F.when(F.size("mappings") % 3 == 1, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    documents(load).select(cut.alias("value")).write.text(path)
    return MP.read_mappings(load.spark, path).groupBy("error").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("mappings"))), F.lit(0)).alias("n_headlines"))


@query("explode_mapping", f"""WITH {MAPPED}
SELECT report AS pdf_filename, text AS headline_text, headline_page, csv_file FROM (
  SELECT report, text, page AS headline_page, csv_file FROM pairs)""")
def _(load):
    return pairs(load).select("pdf_filename", "headline_text", "headline_page", "csv_file")


@query("mapping_errors", f"WITH {ERRORS} SELECT report AS pdf_filename, text AS headline_text, csv_file, error FROM checked")
def _(load):
    return O.mapping_errors(pairs(load), known_tables(load)).select("pdf_filename", "headline_text", "csv_file", "error")


@query("run_summary", f"""WITH {ERRORS},
firsts AS (SELECT report, headline_no, arg_min(error, csv_file) FILTER (WHERE TRUE) AS e, min_by(coalesce(error, ''), csv_file) AS error FROM checked GROUP BY ALL)
SELECT report AS pdf_filename, count(*) AS total_headlines, count(*) FILTER (WHERE error = '') AS successful,
       count(*) FILTER (WHERE error <> '') AS failed FROM firsts GROUP BY 1""")
def _(load):
    """As the interactive run does: first paragraph and first table of each headline."""
    return O.run_summary(O.mapping_errors(pairs(load, first_only=True), known_tables(load)), ["pdf_filename"])


_SETS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')))"


def part_headlines(load) -> DataFrame:
    return load("part").select(
        F.col("p_partkey").alias("headline_id"),
        F.concat(F.lit("Price of "), "p_name", F.lit(" "), F.lower("p_type"), F.when(F.col("p_size") > 25, " large").otherwise("")).alias("text"))


def part_columns(load) -> DataFrame:
    """One column per part name and type, named like ``price_red_widget_economy``."""
    name = F.concat(F.lit("price_"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.lower("p_type"))
    return load("part").select(name.alias("column_id")).distinct().withColumn("text", F.regexp_replace("column_id", "_", " "))


@query("suggest_mappings", f"""WITH h AS (SELECT p_partkey AS headline_id, {_SETS.format(
    "'Price of ' || p_name || ' ' || lower(p_type) || CASE WHEN p_size > 25 THEN ' large' ELSE '' END")} AS hw FROM part),
c AS (SELECT column_id, {_SETS.format("replace(column_id, '_', ' ')")} AS cw FROM (
  SELECT DISTINCT 'price_' || replace(p_name, ' ', '_') || '_' || lower(p_type) AS column_id FROM part)),
hs AS (SELECT DISTINCT hw FROM h),
p AS (SELECT hw, column_id, len(list_intersect(hw, cw)) / sqrt(len(hw) * len(cw)) AS s FROM hs, c),
r AS (SELECT *, row_number() OVER (PARTITION BY hw ORDER BY round(s, 9) DESC, column_id) AS rank FROM p WHERE s >= 0.8 - 1e-12)
SELECT headline_id, column_id, round(s, 6) AS similarity, rank FROM h JOIN r USING (hw) WHERE rank <= 3""")
def _(load):
    return O.suggest_mappings(part_headlines(load), part_columns(load)).withColumn("similarity", F.round("similarity", 6))


# ---- storage --------------------------------------------------------------------------------


def payloads(load) -> DataFrame:
    """One document per text: its language, length and number of lines. Some ids become one file name."""
    doc_id = F.concat(F.lit("doc "), "source", F.when(F.col("doc_id") % 2 == 0, "/").otherwise("_"),
                      F.floor(F.col("doc_id") / 2))
    return load("documents").select(
        doc_id.alias("doc_id"), F.col("doc_id").alias("key"),
        F.struct("lang", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines")).alias("data"))


def saved(load) -> str:
    """The folder of a store: all documents, then the labelled ones again with a later time."""
    path = new_folder(load.spark, "extractions")
    all_docs = payloads(load)
    X.save_extractions(all_docs.drop("key"), path, F.lit(CREATED))
    again = all_docs.join(load("labels").select(F.col("doc_id").alias("key")), "key", "left_semi").drop("key")
    X.save_extractions(again, path, F.lit("2024-02-01T00:00:00"))
    return path


def stored(load) -> DataFrame:
    return X.load_extractions(load.spark, saved(load))


STORED = f"""docs AS (SELECT doc_id AS key, 'doc ' || source || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '_' END || doc_id // 2 AS doc_id,
  lang, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines FROM documents),
saved AS (SELECT *, '{CREATED}' AS t FROM docs UNION ALL
          SELECT *, '2024-02-01T00:00:00' AS t FROM docs WHERE key IN (SELECT doc_id FROM labels)),
stored AS (SELECT safe_id, doc_id, t AS modified, '{{"doc_id":"' || doc_id || '","timestamp":"' || t || '","version":"1.0","data":{{"lang":"' || lang ||
    '","n_chars":' || n_chars || ',"n_lines":' || n_lines || '}}}}' AS document FROM (
  SELECT *, replace(replace(doc_id, ' ', '_'), '/', '_') AS safe_id,
    row_number() OVER (PARTITION BY replace(replace(doc_id, ' ', '_'), '/', '_') ORDER BY t DESC, doc_id DESC) AS rk FROM saved) WHERE rk = 1),
listing AS (SELECT safe_id AS doc_id, safe_id || '.json' AS filename, round(strlen(document) / 1024, 2) AS size_kb, modified FROM stored)"""


@query("save_extractions", f"WITH {STORED} SELECT safe_id, doc_id, document, modified FROM stored")
def _(load):
    return stored(load).drop("size_bytes")


@query("load_extractions", f"""WITH {STORED}
SELECT s.doc_id, s.modified AS saved_at, '1.0' AS version, d.lang, d.n_chars, d.n_lines FROM stored s JOIN docs d USING (doc_id)""")
def _(load):
    schema = "doc_id string, timestamp string, version string, data struct<lang string, n_chars bigint, n_lines bigint>"
    d = stored(load).select(F.from_json("document", schema).alias("d"))
    return d.select("d.doc_id", F.col("d.timestamp").alias("saved_at"), "d.version", "d.data.lang", "d.data.n_chars", "d.data.n_lines")


@query("list_extractions", f"WITH {STORED} SELECT * FROM listing")
def _(load):
    return X.list_extractions(stored(load))


@query("storage_stats", f"WITH {STORED} SELECT count(*) AS total_files, round(sum(size_kb) / 1024, 2) AS total_size_mb FROM listing")
def _(load):
    return X.storage_stats(X.list_extractions(stored(load)))


@query("delete_extractions", f"""WITH {STORED},
ids AS (SELECT d.doc_id FROM docs d JOIN labels l ON d.key = l.doc_id WHERE quality = 1 UNION SELECT 'missing ' || item_id FROM benchmark),
safe AS (SELECT DISTINCT doc_id, replace(replace(doc_id, ' ', '_'), '/', '_') AS safe_id FROM ids)
SELECT safe_id, 'remaining' AS outcome FROM stored WHERE safe_id NOT IN (SELECT safe_id FROM safe)
UNION ALL SELECT doc_id, CASE WHEN safe_id IN (SELECT safe_id FROM stored) THEN 'deleted' ELSE 'not found' END FROM safe""")
def _(load):
    labelled = load("labels").filter("quality = 1").select(F.col("doc_id").alias("key"))
    ids = payloads(load).join(labelled, "key", "left_semi").select("doc_id").unionByName(
        load("benchmark").select(F.concat(F.lit("missing "), "item_id").alias("doc_id")))
    path = saved(load)
    report = X.delete_extractions(load.spark, path, ids)
    remaining = X.load_extractions(load.spark, path)
    return remaining.select("safe_id", F.lit("remaining").alias("outcome")).unionByName(report.select(
        F.col("doc_id").alias("safe_id"), F.when(F.col("deleted"), "deleted").otherwise("not found").alias("outcome")))


# ---- tables in and out ------------------------------------------------------------------------


@query("read_data_tables", """WITH cells AS (
  SELECT 'orders' AS table_id, 'o_orderkey' AS column_name, CAST(o_orderkey AS VARCHAR) AS value FROM orders
  UNION ALL SELECT 'orders', 'o_orderpriority', CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_orderpriority END FROM orders
  UNION ALL SELECT 'orders', 'price', CASE WHEN o_totalprice < 50000 THEN 'c' ELSE CAST(o_totalprice AS VARCHAR) END FROM orders
  UNION ALL SELECT 'documents', 'doc_id', CAST(doc_id AS VARCHAR) FROM documents
  UNION ALL SELECT 'documents', 'text', text FROM documents)
SELECT table_id, column_name, count(*) AS n_rows, count(value) AS n_non_null, count(DISTINCT value) AS n_distinct FROM cells GROUP BY ALL""")
def _(load):
    """Write two tables as CSV, read them back as text cells."""
    folder = new_folder(load.spark, "csv")
    load("orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 300000, "N/A").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_totalprice") < 50000, "c").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
    ).write.csv(f"{folder}/orders.csv", header=True, escape='"')
    # a file is read by one task: files of a bounded number of texts
    load("documents").select("doc_id", "text").write.option("maxRecordsPerFile", TEXTS_PER_FILE).csv(
        f"{folder}/documents.csv", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells = read_data_tables(load.spark, [f"{folder}/orders.csv", f"{folder}/documents.csv"])
    return column_stats(value_counts(cells)).select("table_id", "column_name", "n_rows", "n_non_null", "n_distinct")


@query("export_results", f"""WITH {ERRORS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY headline_no, csv_file) AS no FROM checked)
SELECT report AS pdf_filename, count(*) AS total_headlines, count(*) FILTER (WHERE error IS NULL) AS successful_extractions,
  count(error) AS failed_extractions,
  string_agg(no || ':' || CASE WHEN error IS NULL THEN 'success:1' ELSE 'error:' || error END, ';' ORDER BY no) AS entries
FROM numbered GROUP BY 1""")
def _(load):
    """Write the results of every report as JSON and read them back."""
    from statwitness.operators.ordered import row_number

    checked = O.mapping_errors(pairs(load), known_tables(load))
    blocked = checked.withColumn("block", F.floor(F.col("pos") / 1000))
    numbered = row_number(blocked, ["pdf_filename"], "block", [F.col("pos"), F.col("csv_file")], "extraction_number")
    results = numbered.select(
        "pdf_filename", "extraction_number", "headline_text", F.get("paragraphs", 0).alias("paragraph"),
        F.col("csv_file").alias("csv_filename"), "error",
        F.array(F.create_map(F.lit("file"), "csv_file")).alias("pivot_table"), F.lit(1).alias("row_count"),
        F.array(F.lit("file")).alias("columns_selected"), F.create_map(F.lit("file"), F.array("csv_file")).alias("filters_applied"),
        F.lit(0.8).alias("confidence"), F.lit(CREATED).alias("extracted_at"))
    path = new_folder(load.spark, "results")
    exports.export_results(results, ["pdf_filename"], path)
    back = load.spark.read.schema(
        "pdf_filename string, total_headlines bigint, successful_extractions bigint, failed_extractions bigint, "
        "extractions array<struct<extraction_number bigint, status string, error string, metadata struct<row_count int>>>").json(path)
    shown = lambda e: F.concat(
        e["extraction_number"], F.lit(":"), e["status"], F.lit(":"), F.coalesce(e["error"], e["metadata"]["row_count"].cast("string")))
    return back.select("pdf_filename", "total_headlines", "successful_extractions", "failed_extractions",
                       F.array_join(F.transform("extractions", shown), ";").alias("entries"))


@query("export_tables_csv", f"""WITH {STATS},
rows AS (SELECT nation AS headline_id, time_period || ',' || returnflag || ',' || coalesce(quantity_average, '') || ',' || coalesce(taxed_percent, '') AS line
  FROM stats WHERE geographic_level = 'Local')
SELECT headline_id, line, count(*) AS n FROM rows GROUP BY ALL
UNION ALL SELECT DISTINCT headline_id, 'time_period,returnflag,quantity_average,"taxed, percent"', 1 FROM rows""")
def _(load):
    """One CSV per nation, written and read back as lines."""
    local = shipments(load).filter("geographic_level = 'Local'")
    tables = local.select(
        F.col("nation").alias("headline_id"), (F.col("time_period").cast("int") * 10 + F.ascii("returnflag")).alias("row_no"),
        F.create_map(F.lit("time_period"), "time_period", F.lit("returnflag"), "returnflag", F.lit("quantity_average"),
                     "quantity_average", F.lit("taxed, percent"), "taxed_percent").alias("record"))
    path = new_folder(load.spark, "tables")
    exports.export_tables_csv(tables, path)
    back = load.spark.read.schema("value string, headline_id string").text(path)
    return back.groupBy("headline_id", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))
