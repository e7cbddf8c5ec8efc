"""Feedback and streaming queries: every event is a reviewer's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness.operators import feedback as O, style as Y
from statwitness.plans.registry import query
from statwitness.plans.retrieve_queries import EXT
from statwitness.plans.verify_queries import ACC, accounts, extractions
from statwitness.session import materialise, new_folder
from statwitness.streaming.chunk_stream import read_index, stream_chunks, sync_index
from statwitness.streaming.feedback_stream import run_to_table, stream_agreement

_COMMENT = """CASE WHEN value > 60 THEN 'The TIME period is mixed up' WHEN event_type = 'error' THEN 'Suppression marker lost, filter fine'
  WHEN event_type = 'click' THEN 'Wrong filter used' WHEN event_type = 'purchase' THEN 'Column is missing'
  WHEN event_type = 'signup' THEN 'Wrong year' WHEN event_type = 'view' AND value < 1 THEN NULL ELSE 'Looks odd' END"""


def feedback(load) -> DataFrame:
    return load("events").select(
        F.col("event_id").alias("feedback_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("ext_"), "user_id").alias("extraction_id"), F.concat(F.lit("Headline "), F.col("user_id") % 20).alias("headline_text"),
        F.when(F.col("event_type").isin("error", "view"), "style").otherwise("numerical").alias("agent"),
        F.expr(_COMMENT).alias("user_comment"), (F.col("value") > 20).alias("agree"), "value", F.weekofyear("ts").alias("week"))


FB = f"""fb AS (SELECT event_id AS feedback_id, ts, 'Headline ' || user_id % 20 AS headline_text, value, value > 20 AS agree,
  CASE WHEN event_type IN ('error','view') THEN 'style' ELSE 'numerical' END AS agent, {_COMMENT} AS user_comment, weekofyear(ts) AS week FROM events),
typed AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(user_comment, '')), 'suppression|marker') THEN 'suppression_marker_error'
  WHEN contains(lower(coalesce(user_comment, '')), 'filter') THEN 'wrong_filter' WHEN contains(lower(coalesce(user_comment, '')), 'column') THEN 'wrong_columns'
  WHEN regexp_matches(lower(coalesce(user_comment, '')), 'year|time') THEN 'time_period_mismatch' ELSE 'other' END AS error_type FROM fb)"""


@query("categorize_feedback", f"WITH {FB} SELECT feedback_id, error_type FROM typed")
def _(load):
    return O.categorize_feedback(feedback(load)).select("feedback_id", "error_type")


@query("feedback_patterns", f"""WITH {FB}, e AS (SELECT error_type AS name, count(*) AS n FROM typed GROUP BY 1)
SELECT 'total' AS section, 'all' AS name, count(*) AS n, CAST(NULL AS BIGINT) AS rank FROM fb
UNION ALL SELECT 'error', name, n, NULL FROM e
UNION ALL SELECT 'top_error', name, n, rk FROM (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS rk FROM e) WHERE rk <= 5
UNION ALL SELECT 'headline', headline_text, count(*), NULL FROM fb GROUP BY 2""")
def _(load):
    return O.feedback_patterns(feedback(load))


@query("guidance_triggers", f"""WITH {FB}, e AS (SELECT error_type, count(*) AS n FROM typed GROUP BY 1)
SELECT error_type, n, CASE error_type WHEN 'suppression_marker_error' THEN 'suppression markers' ELSE 'time periods' END AS guidance
FROM e WHERE (error_type = 'suppression_marker_error' AND n > 5) OR (error_type = 'time_period_mismatch' AND n > 3)""")
def _(load):
    return O.guidance_triggers(O.feedback_patterns(feedback(load)))


@query("correction_diff", f"""WITH {ACC},
o AS (SELECT extraction_id, y, unnest(['price_average','urgent_percent']) AS column_name, unnest([price_average, urgent_percent]) AS value FROM acc WHERE k % 31 <> 0),
c AS (SELECT extraction_id, y, unnest(['price_average','urgent_percent']) AS column_name,
        unnest([CASE WHEN hidden THEN NULL ELSE st // 10 || '.' || st % 10 END, urgent_percent]) AS value FROM acc WHERE k % 29 <> 0)
SELECT coalesce(o.extraction_id, c.extraction_id) AS extraction_id, coalesce(o.y, c.y) AS row_no, coalesce(o.column_name, c.column_name) AS column_name,
  CASE WHEN o.y IS NULL THEN 'added' WHEN c.y IS NULL THEN 'removed' ELSE 'changed' END AS change, o.value AS old_value, c.value AS new_value
FROM o FULL JOIN c ON o.extraction_id = c.extraction_id AND o.y = c.y AND o.column_name = c.column_name
WHERE o.y IS NULL OR c.y IS NULL OR o.value IS DISTINCT FROM c.value""")
def _(load):
    """The figures of the table against those of the text, as if the text were a correction."""
    rows = accounts(load)

    def cells(df, price):
        return df.select(F.concat(F.lit("ext_"), "k").alias("extraction_id"), F.col("y").alias("row_no"), F.explode(F.create_map(
            F.lit("price_average"), price, F.lit("urgent_percent"), F.col("urgent_percent"))).alias("column_name", "value"))

    corrected = F.expr("case when not hidden then concat(st div 10, '.', st % 10) end")
    return O.correction_diff(cells(rows.filter("k % 31 <> 0"), F.col("price_average")), cells(rows.filter("k % 29 <> 0"), corrected))


@query("agreement_rate", "WITH " + FB + " " + " UNION ALL ".join(
    f"SELECT CAST({by} AS VARCHAR) AS name, count(*) AS n, round(avg(CASE WHEN agree THEN 1.0 ELSE 0.0 END), 9) AS agreement, '{by}' AS \"by\" FROM fb GROUP BY 1"
    for by in ["agent", "headline_text", "week"]))
def _(load):
    return O.agreement_rate(feedback(load), "agent", "headline_text", "week").withColumn("agreement", F.round("agreement", 9))


@query("weighted_agreement", f"""WITH {FB},
p AS (SELECT headline_text, agree, row_number() OVER (PARTITION BY headline_text ORDER BY ts, feedback_id) AS i, count(*) OVER (PARTITION BY headline_text) AS n FROM fb)
SELECT headline_text, max(n) AS n, CASE WHEN max(n) >= 5 THEN round(sum(pow(0.9, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.1 END * CASE WHEN agree THEN 1 ELSE 0 END), 9) END AS weighted_agreement
FROM p GROUP BY 1""")
def _(load):
    return O.weighted_agreement(feedback(load), "headline_text").withColumn("weighted_agreement", F.round("weighted_agreement", 9))


@query("impact", f"""WITH {FB},
t AS (SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16')::DOUBLE AS ta, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16')::DOUBLE AS tb FROM fb),
m AS (SELECT 'pass_rate' AS measure, count(*) FILTER (WHERE agree AND ts >= TIMESTAMP '2024-01-16') AS a, count(*) FILTER (WHERE agree AND ts < TIMESTAMP '2024-01-16') AS b FROM fb
  UNION ALL SELECT error_type, count(*) FILTER (WHERE NOT agree AND ts >= TIMESTAMP '2024-01-16'), count(*) FILTER (WHERE NOT agree AND ts < TIMESTAMP '2024-01-16') FROM typed GROUP BY 1)
SELECT measure, round(b / tb, 9) AS before, round(a / ta, 9) AS after, CASE WHEN b > 0 THEN round((a / ta - b / tb) / (b / tb), 9) END AS relative_change FROM m, t""")
def _(load):
    r = lambda c: F.round(c, 9).alias(c)
    return O.impact(feedback(load), F.to_timestamp(F.lit("2024-01-16 00:00:00"))).select("measure", r("before"), r("after"), r("relative_change"))


_MEANS = """uses AS (SELECT event_type AS query_id, user_id AS vec_id, count(*) AS w FROM events GROUP BY ALL),
dims AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
means AS (SELECT query_id, i, sum(w * CAST(x AS DOUBLE)) / sum(w) AS m FROM uses JOIN dims USING (vec_id) GROUP BY ALL)"""


@query("similar_corrections", f"""WITH {_MEANS},
dist AS (SELECT query_id, vec_id AS id, round(sum((m - x) * (m - x)), 9) AS distance FROM means JOIN dims USING (i) GROUP BY query_id, vec_id)
SELECT query_id, id, rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) WHERE rank <= 5""")
def _(load):
    """For each kind of event, the corrections nearest to the mean vector of the users who sent it."""
    uses = load("events").groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("w"))
    dims = load("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    means = uses.join(dims, "vec_id").groupBy("query_id", "i").agg(
        (F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    queries = means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    vectors = load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return O.similar_corrections(queries, vectors).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query("run_metrics", f"WITH {FB} SELECT agent, count(*) AS n_runs, round(avg(value), 6) AS average_analysis_time, round(avg(1 / (1 + value)), 6) AS retrieval_relevance FROM fb GROUP BY 1")
def _(load):
    runs = feedback(load).select("agent", F.col("value").alias("analysis_seconds"), (1 / (1 + F.col("value"))).alias("relevance"))
    return O.run_metrics(runs, "agent").select(
        "agent", "n_runs", F.round("average_analysis_time", 6).alias("average_analysis_time"), F.round("retrieval_relevance", 6).alias("retrieval_relevance"))


# ---- streams ---------------------------------------------------------------------------------------


@query("stream_agreement", """WITH w AS (SELECT date_trunc('day', ts) AS d, count(*) AS n, count(*) FILTER (WHERE value > 20) AS n_agree FROM events GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, n, n_agree, round(n_agree::DOUBLE / n, 9) AS agreement FROM w
WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def _(load):
    """All events as a file stream, of one file or a folder of part files (a pattern names either). Days that may still
    receive late answers are not emitted yet."""
    events = load("events")
    stream = (
        load.spark.readStream.schema(events.schema).parquet(f"{load.sf_dir}/events.parque[t]")
        .select("ts", (F.col("value") > 20).alias("agree"))
    )
    out = new_folder(load.spark, "agreement")
    run_to_table(stream_agreement(stream), f"{out}/table", f"{out}/progress")
    table = load.spark.read.schema("window_start timestamp, window_end timestamp, n bigint, n_agree bigint, agreement double").parquet(f"{out}/table")
    return table.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "n_agree", F.round("agreement", 9).alias("agreement"))


@query("stream_chunks", f"""WITH {EXT} SELECT extraction_id || ':' || pos AS chunk_id, type, text FROM chunks""")
def _(load):
    """Extractions arrive twice; the chunk table holds every chunk once."""
    folder = new_folder(load.spark, "chunks")
    arriving = extractions(load).withColumn("ts", F.to_timestamp(F.lit("2024-01-15 10:30:00")))
    arriving.write.parquet(f"{folder}/extractions")
    arriving.write.mode("append").parquet(f"{folder}/extractions")
    stream = load.spark.readStream.schema(arriving.schema).parquet(f"{folder}/extractions")
    run_to_table(stream_chunks(stream), f"{folder}/table", f"{folder}/progress")
    table = "ts timestamp, chunk_id string, type string, text string, extraction_id string, headline string, page bigint"
    return load.spark.read.schema(table).parquet(f"{folder}/table").select("chunk_id", "type", "text")


FOLLOWED = EXT.replace("string_agg(paragraph, ' ' ORDER BY y) AS text", """string_agg(paragraph, ' ' ORDER BY y) ||
  CASE WHEN k % 3 = 0 THEN ' Revised.' WHEN k % 7 = 0 THEN ' Late.' ELSE '' END AS text""")


@query("follow_extractions", f"""WITH {FOLLOWED} SELECT extraction_id || ':' || pos AS chunk_id, type, text FROM chunks WHERE CAST(replace(extraction_id, 'ext_', '') AS BIGINT) % 5 <> 0""")
def _(load):
    """The index after three arrivals and a restart between them: all extractions; then revised and deleted ones; then versions that are
    older than the second arrival and count only where nothing newer has come."""
    folder = new_folder(load.spark, "index")
    base = materialise(extractions(load).withColumn("headline_page", F.col("headline_page").cast("bigint")))
    at = lambda minute: F.to_timestamp(F.lit(f"2024-01-15 10:{minute}:00"))
    said = lambda text: F.concat("paragraphs", F.array(F.lit(text)))
    k = F.col("custkey")
    arrivals = [
        base.withColumns({"ts": at("00"), "deleted": F.lit(False)}),
        base.filter((k % 3 == 0) | (k % 5 == 0)).withColumns({"paragraphs": said("Revised."), "ts": at("20"), "deleted": k % 5 == 0}),
        base.filter(k % 7 == 0).withColumns({"paragraphs": said("Late."), "ts": at("10"), "deleted": F.lit(False)})]
    for arriving in arrivals:
        arriving.write.mode("append").parquet(f"{folder}/extractions")
        sync_index(load.spark.readStream.schema(arriving.schema).parquet(f"{folder}/extractions"), f"{folder}/index", f"{folder}/progress")
    return read_index(load.spark, f"{folder}/index").select("chunk_id", "type", "text")
