"""Chunking and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness.functions import vectors as VX
from statwitness import params as P
from statwitness.operators import chunks as O, profile as PR, retrieve as R
from statwitness.operators.claims import split_sentences
from statwitness.plans.profile_queries import SAMPLES, counts
from statwitness.plans.registry import query
from statwitness.plans.structure_queries import LINES0, text_lines
from statwitness.plans.verify_queries import ACC, _SENT, extractions

# ---- chunks of documents ------------------------------------------------------------------------


@query("chunk_fixed", """WITH n AS (SELECT doc_id, text, length(text) AS len, greatest(1, CAST(ceil((length(text) - 100) / 400.0) AS BIGINT)) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, unnest(range(n)) AS chunk_no FROM n)
SELECT doc_id, chunk_no, substring(text, chunk_no * 400 + 1, 500) AS chunk FROM c""")
def _(load):
    return O.chunk_fixed(load("documents"), ["doc_id"], "text")


@query("chunk_words", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, (len(w) + 499) // 500 AS n FROM w WHERE len(w) > 0), s AS (SELECT *, (len(w) + n - 1) // n AS size FROM n),
c AS (SELECT doc_id, w, size, unnest(range(n)) AS chunk_no FROM s)
SELECT doc_id, chunk_no, len(w[chunk_no * size + 1 : chunk_no * size + size]) AS n_words, array_to_string(w[chunk_no * size + 1 : chunk_no * size + size], ' ') AS chunk FROM c""")
def _(load):
    return O.chunk_words(load("documents"), ["doc_id"], "text")


@query("chunk_by_headline", """WITH p AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS pos FROM p),
b AS (SELECT conv_id, turn, min(pos) AS a, max(pos) AS z FROM q GROUP BY ALL)
SELECT b.conv_id AS doc_id, b.turn AS section_no, string_agg(q.t, chr(10) || chr(10) ORDER BY q.pos) AS chunk
FROM b JOIN q ON q.conv_id = b.conv_id AND q.pos BETWEEN a - 2 AND z + 2 GROUP BY ALL""")
def _(load):
    """Every turn of a conversation is a section, its lines are the paragraphs."""
    sections = load("conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_no"), F.split("text", "\n").alias("paragraphs"))
    return O.chunk_by_headline(sections).drop("paragraphs")


_VOWELS = "aeio"


def doc_sentences(load) -> DataFrame:
    """Sentences of at most 1000 characters with a four-number embedding (counts of some vowels)."""
    parts = split_sentences(text_lines(load), ["doc_id", "line_no"], "line").select(
        "doc_id", "line_no", "sentence_no", F.posexplode(F.regexp_extract_all("sentence", F.lit("(?s).{1,1000}"), F.lit(0))).alias("piece", "text"))
    count = lambda v: (F.length("text") - F.length(F.replace("text", F.lit(v), F.lit("")))).cast("double")
    from statwitness.operators.ordered import row_number

    numbered = row_number(parts, ["doc_id"], "line_no", [F.col("sentence_no"), F.col("piece")], "pos")
    return numbered.select("doc_id", (F.col("pos") - 1).alias("pos"), "text", F.array(*map(count, _VOWELS)).alias("embedding"))


_VEC = ", ".join(f"CAST(length(text) - length(replace(text, '{v}', '')) AS DOUBLE)" for v in _VOWELS)
SEMANTIC = LINES0 + f""",
st AS (SELECT doc_id, line_no, unnest({_SENT.format('line')}) AS s, unnest(range(len({_SENT.format('line')}))) AS sentence_no FROM text_lines),
pc AS (SELECT doc_id, line_no, sentence_no, unnest(regexp_extract_all(s, '(?s).{{1,1000}}')) AS text, unnest(range(len(regexp_extract_all(s, '(?s).{{1,1000}}')))) AS piece FROM st),
sn AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sentence_no, piece) - 1 AS pos, text, length(text) AS len, [{_VEC}] AS e FROM pc),
lw AS (SELECT *, coalesce(list_dot_product(e, lag(e) OVER w) / nullif(sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(lag(e) OVER w, lag(e) OVER w)), 0), 0) < 0.7 AS low
  FROM sn WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query("chunk_semantic", f"""WITH RECURSIVE {SEMANTIC},
f AS (SELECT doc_id, pos, len AS state, 1 AS chunk_no FROM lw WHERE pos = 0
  UNION ALL
  SELECT l.doc_id, l.pos, CASE WHEN (low AND state >= 100) OR state + len > 1000 THEN len ELSE state + len END,
    chunk_no + CASE WHEN (low AND state >= 100) OR state + len > 1000 THEN 1 ELSE 0 END
  FROM f JOIN lw l ON l.doc_id = f.doc_id AND l.pos = f.pos + 1)
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, string_agg(text, ' ' ORDER BY pos) AS chunk, count(*) AS n_sentences, min(pos) AS first_pos
FROM f JOIN sn USING (doc_id, pos) GROUP BY ALL""")
def _(load):
    return O.chunk_semantic(doc_sentences(load))


# ---- chunks of extractions --------------------------------------------------------------------------

EXT = ACC + """,
ext AS (SELECT k, extraction_id, 'Orders of customer ' || k AS headline_text, k % 50 + 1 AS headline_page, string_agg(paragraph, ' ' ORDER BY y) AS text, count(*) AS n,
  string_agg(CASE WHEN row_no < 5 THEN '- time_period: ' || time_period || ', price_average: ' || price_average || ', urgent_percent: ' || urgent_percent ||
             ', standard_percent: ' || standard_percent END, chr(10) ORDER BY y) AS rows5,
  '{"customer":["' || k || '"],"time_period":[' || string_agg('"' || time_period || '"', ',' ORDER BY y) || ']}' AS filters,
  '["time_period","price_average","urgent_percent","standard_percent"]' AS cols FROM acc GROUP BY k, extraction_id),
chunks AS (SELECT extraction_id, headline_text AS headline, headline_page AS page, unnest(['semantic','table','metadata']) AS type, unnest([0, 1, 2]) AS pos, unnest([
  'Headline: ' || headline_text || chr(10) || chr(10) || 'Context: ' || text || chr(10) || chr(10) || 'Dimensions: customer, time_period' || chr(10) || chr(10) ||
    'Metrics: time_period, price_average, urgent_percent, standard_percent',
  'Headline: ' || headline_text || chr(10) || chr(10) || 'Table Data:' || chr(10) || rows5 || CASE WHEN n > 5 THEN chr(10) || '... (and ' || (n - 5) || ' more rows)' ELSE '' END,
  'Extraction ID: ' || extraction_id || chr(10) || chr(10) || 'Headline: ' || headline_text || ' (page ' || headline_page || ')' || chr(10) || chr(10) || 'Filters Applied: ' || filters ||
    chr(10) || chr(10) || 'Columns Selected: ' || cols || chr(10) || chr(10) || 'Row Count: ' || n || chr(10) || chr(10) || 'Generated Code Summary:' || chr(10) ||
    '- DataFrame filtering: ' || filters || chr(10) || '- Column projection: ' || cols]) AS text FROM ext)"""


@query("semantic_chunk", f"WITH {EXT} SELECT extraction_id, text FROM chunks WHERE type = 'semantic'")
def _(load):
    return extractions(load).select("extraction_id", O.semantic_chunk().alias("text"))


@query("table_chunk", f"WITH {EXT} SELECT extraction_id, text FROM chunks WHERE type = 'table'")
def _(load):
    return extractions(load).select("extraction_id", O.table_chunk().alias("text"))


@query("metadata_chunk", f"WITH {EXT} SELECT extraction_id, text FROM chunks WHERE type = 'metadata'")
def _(load):
    return extractions(load).select("extraction_id", O.metadata_chunk().alias("text"))


@query("explode_chunks", f"WITH {EXT} SELECT extraction_id || ':' || pos AS chunk_id, type, text, extraction_id, headline, page FROM chunks")
def _(load):
    return O.explode_chunks(extractions(load))


_TERMS = "list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), '\\s+'), lambda w: w <> '')"


@query("embed", f"""WITH {EXT},
keyed AS (SELECT extraction_id || ':' || pos AS chunk_id, text FROM chunks),
terms AS (SELECT chunk_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {P.EMBEDDING_DIMENSION} AS bin, count(*) AS tf
  FROM (SELECT chunk_id, unnest({_TERMS}) AS w FROM keyed) GROUP BY ALL),
idf AS (SELECT bin, ln(((SELECT count(*) FROM keyed) + 1)::DOUBLE / (count(*) + 1)) AS weight FROM terms GROUP BY bin),
parts AS (SELECT chunk_id, bin, tf * weight AS x, sqrt(sum(tf * weight * tf * weight) OVER (PARTITION BY chunk_id)) AS len FROM terms JOIN idf USING (bin))
SELECT chunk_id, {P.EMBEDDING_DIMENSION}::BIGINT AS dimension, round(coalesce(sqrt(sum(x / len * x / len)), 0), 6) AS length,
       round(coalesce(sum((bin + 1) * x / len), 0), 6) AS checksum
FROM keyed LEFT JOIN parts USING (chunk_id) GROUP BY 1""")
def _(load):
    """Vectors of all chunks: their length, and a sum over the positions."""
    vectors = R.embed(O.explode_chunks(extractions(load)))
    checksum = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return vectors.select("chunk_id", F.size("embedding").alias("dimension"), F.round(VX.norm(F.col("embedding")), 6).alias("length"),
                          F.round(checksum, 6).alias("checksum"))


# ---- search in the embeddings -------------------------------------------------------------------------


def centroids(load) -> DataFrame:
    """One query vector per label: the mean of the label's vectors."""
    return (
        load("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy(F.col("label").cast("bigint").alias("query_id"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vector"))
    )


def stored_vectors(load) -> DataFrame:
    return load("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("filter_value"))


CENTROIDS = """dims AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
means AS (SELECT CAST(label AS BIGINT) AS query_id, i, avg(CAST(x AS DOUBLE)) AS m FROM dims GROUP BY ALL)"""
HITS = CENTROIDS + """,
dist AS (SELECT query_id, vec_id AS id, CAST(label AS BIGINT) AS label, round(sum((m - x) * (m - x)), 9) AS distance FROM means JOIN dims USING (i) GROUP BY query_id, vec_id, label),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM dist) WHERE rank <= 5)"""


def hits(load) -> DataFrame:
    return R.top_k(centroids(load), stored_vectors(load))


@query("cosine_l2", f"""WITH {CENTROIDS},
s AS (SELECT vec_id, sum(m * x) AS dp, sum(m * m) AS mm, sum(CAST(x AS DOUBLE) * x) AS xx, sum((m - x) * (m - x)) AS l2 FROM dims JOIN means ON query_id = label AND means.i = dims.i GROUP BY vec_id)
SELECT vec_id, round(dp / (sqrt(mm) * sqrt(xx)), 6) AS cosine, round(l2, 6) AS l2 FROM s""")
def _(load):
    """Every vector against the centroid of its label."""
    own = load("embeddings").withColumn("query_id", F.col("label").cast("bigint")).join(centroids(load), "query_id")
    return own.select("vec_id", F.round(VX.cosine(F.col("vector"), F.col("embedding")), 6).alias("cosine"),
                      F.round(VX.l2_squared(F.col("vector"), F.col("embedding")), 6).alias("l2"))


@query("top_k", f"WITH {HITS} SELECT query_id, id, rank, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM hits")
def _(load):
    return hits(load).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))


@query("dedupe_hits", f"""WITH {HITS}
SELECT query_id, extraction_id, min(rank) AS rank, arg_min(id, rank) AS id FROM (SELECT *, id // 3 AS extraction_id FROM hits) GROUP BY ALL""")
def _(load):
    """Three neighbouring vectors stand for the three chunks of one extraction."""
    return R.dedupe_hits(hits(load).withColumn("extraction_id", F.floor(F.col("id") / 3))).select("query_id", "extraction_id", "rank", "id")


@query("filter_hits", f"""WITH {HITS},
own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rk FROM dist WHERE label = query_id)
SELECT query_id, id, rk AS rank, round(distance, 6) AS distance FROM own WHERE rk <= 5""")
def _(load):
    """Only vectors with the query's own label."""
    queries = centroids(load).withColumn("filter_value", F.col("query_id"))
    return R.filter_hits(queries, stored_vectors(load)).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query("rerank", f"""WITH {HITS},
s AS (SELECT h.query_id, h.id, h.rank, coalesce(len(list_intersect({_TOK.format('b.text')}, {_TOK.format('d.text')}))::DOUBLE / nullif(len({_TOK.format('b.text')}), 0), 0) AS score
  FROM hits h JOIN benchmark b ON b.item_id = h.query_id JOIN documents d ON d.doc_id = h.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM s)
SELECT query_id, id, rank, round(score, 6) AS score, new_rank FROM r WHERE new_rank <= 3""")
def _(load):
    """Second score: the share of the query's words found in the hit's document."""
    texts = load("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("hit_text"))
    questions = load("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    full = hits(load).join(questions, "query_id").join(texts, "id")
    return R.rerank(full, R.lexical_overlap(F.col("query_text"), F.col("hit_text"))).select(
        "query_id", "id", "rank", F.round("score", 6).alias("score"), "new_rank")


@query("column_index", f"""WITH {SAMPLES}
SELECT table_id, column_name, replace(column_name, '_', ' ') || coalesce(': ' || replace(sample_values, '|', ', '), '') AS text
FROM roles LEFT JOIN lists USING (table_id, col_no, column_name)""")
def _(load):
    return R.column_index(PR.column_profile(counts(load)))


@query("join_full", f"""WITH {HITS}, {EXT}
SELECT query_id, id, rank, 'ext_' || id AS extraction_id, headline_text, n AS row_count FROM hits JOIN ext ON extraction_id = 'ext_' || id""")
def _(load):
    """Vector number n belongs to the statement of customer n."""
    found = hits(load).withColumn("extraction_id", F.concat(F.lit("ext_"), "id"))
    return R.join_full(found, extractions(load)).select(
        "query_id", "id", "rank", "extraction_id", "headline_text", F.size("extracted_table").alias("row_count"))
