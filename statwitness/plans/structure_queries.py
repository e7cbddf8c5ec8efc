"""Structure queries: every text of documents laid out as pages of positioned words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from statwitness.operators import structure as O
from statwitness.plans.registry import query

LINES_PER_PAGE = 20
STYLES = [(16.0, "Arial-Bold"), (12.0, "Arial-BoldMT"), (14.5, "Arial"), (11.75, "Arial-Bold"), (12.0, "Arial"), (20.0, "Calibri")]


def text_lines(load) -> DataFrame:
    return load("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(
        "doc_id", "line_no", "line", (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("int").alias("page"),
        ((F.col("doc_id") + F.col("line_no")) % 6).alias("style"))


def paged_lines(load) -> DataFrame:
    """Text lines where their page is put together."""
    chars = load("documents").agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return O.spread_pages(text_lines(load), chars)


def glyphs(load) -> DataFrame:
    """One glyph run per word; size, font and position follow from document, line and word number."""
    words = paged_lines(load).select("*", F.posexplode(F.split("line", " ")).alias("word_no", "word"))
    style, word_no = F.col("style"), F.col("word_no")
    size = F.lit(STYLES[-1][0])
    font = F.lit(STYLES[-1][1])
    for i, (s, f) in list(enumerate(STYLES))[-2::-1]:
        size = F.when(style == i, s).otherwise(size)
        font = F.when(style == i, f).otherwise(font)
    top = (
        30.0 * (F.col("line_no") % LINES_PER_PAGE) + 4.0 * ((F.col("doc_id") + F.col("line_no")) % 3)
        + F.when(word_no % 7 == 6, 1.0).otherwise(0.5))
    return words.select(
        F.col("doc_id"), "page", (F.col("line_no").cast("bigint") * 100000 + word_no).alias("glyph_no"),
        F.concat("word", F.lit(" ")).alias("text"),
        F.when(word_no % 5 == 4, 0.0).otherwise(size).alias("size"),
        F.when(word_no % 3 == 0, "Times").otherwise(font).alias("font"),
        top.alias("top"), (word_no * 10.0).alias("x0"))


def page_texts(load) -> DataFrame:
    """Page texts; lines of one style are followed by an empty line, so there are paragraphs."""
    shown = F.concat("line", F.when(F.col("style") == 3, "\n").otherwise(""))
    return paged_lines(load).groupBy("doc_id", "page").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", shown.alias("s")))), lambda x: x["s"]), "\n").alias("text"))


def headlines(load) -> DataFrame:
    return O.find_headlines(glyphs(load))


LINES0 = """text_lines AS (
  SELECT doc_id, line_no, line, line_no // 20 + 1 AS page, (doc_id + line_no) % 6 AS style FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no
    FROM documents))"""
GLYPHS = LINES0 + """,
words AS (SELECT *, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS word_no FROM text_lines),
glyphs AS (
  SELECT doc_id, page, line_no * 100000 + word_no AS glyph_no, word || ' ' AS text,
    CASE WHEN word_no % 5 = 4 THEN 0.0 ELSE [16.0, 12.0, 14.5, 11.75, 12.0, 20.0][style + 1] END::DOUBLE AS size,
    CASE WHEN word_no % 3 = 0 THEN 'Times' ELSE ['Arial-Bold','Arial-BoldMT','Arial','Arial-Bold','Arial','Calibri'][style + 1] END AS font,
    (30.0 * (line_no % 20) + 4.0 * ((doc_id + line_no) % 3) + CASE WHEN word_no % 7 = 6 THEN 1.0 ELSE 0.5 END)::DOUBLE AS top,
    (word_no * 10.0)::DOUBLE AS x0 FROM words)"""
_strip = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+|[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+$', '', 'g')"
_nwords = lambda c: f"len(list_filter(regexp_split_to_array({c}, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+'), lambda w: w <> ''))"
LINES = GLYPHS + f""",
placed AS (SELECT *, CAST(round_even(top / 2, 0) * 2 AS BIGINT) AS y FROM glyphs),
fonts AS (SELECT doc_id, page, y, font, count(*) AS n, min(x0) AS first FROM placed GROUP BY ALL),
font1 AS (SELECT doc_id, page, y, font FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, y ORDER BY n DESC, first) AS rk FROM fonts) WHERE rk = 1),
lines AS (
  SELECT p.doc_id, p.page, p.y, {_strip("string_agg(text, '' ORDER BY x0, glyph_no)")} AS text,
         avg(size) FILTER (WHERE size > 0) AS avg_size, any_value(f.font) AS font,
         contains(lower(any_value(f.font)), 'bold') AS is_bold
  FROM placed p JOIN font1 f USING (doc_id, page, y) GROUP BY p.doc_id, p.page, p.y)"""
SPACED = LINES + """,
spaced0 AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS py FROM lines
            WHERE length(text) >= 5 AND avg_size IS NOT NULL),
spaced AS (SELECT *, CAST(CASE WHEN py IS NULL OR py = 0 THEN 0 ELSE y - py END AS BIGINT) AS spacing FROM spaced0)"""
CANDIDATES = SPACED + f""",
cand AS (SELECT * FROM spaced WHERE avg_size >= 11.5 AND NOT (avg_size BETWEEN 14 AND 15 AND NOT is_bold)
  AND NOT (avg_size < 13 AND NOT is_bold) AND NOT (avg_size < 13 AND is_bold AND {_nwords('text')} > 10)
  AND NOT (spacing > 0 AND spacing < 25))"""
_PATTERN = ("regexp_matches({0}, '^([A-Z].*|\\d+\\..*|(Chapter|Section|Part)\\s+\\d+|.*Summary$|.*Results$|.*Analysis$|"
            ".*Methodology$|.*Introduction$|.*Conclusion$|.*Overview$|.*Discussion$|.*Findings$|.*Background.*|.*Key.*|About\\s+the.*)')")
_VALID = (f"({_nwords('text')} BETWEEN 2 AND 10 AND length(text) >= 5 "
          "AND NOT regexp_matches(lower(text), '(, with an|and key|in the|by the|of the|for the|to the|from the|, and|, followed)$') "
          f"AND ({_PATTERN.format('text')} OR regexp_matches(text, '^\\p{{Lu}}')) "
          "AND NOT (upper(text) = text AND lower(text) <> text) AND NOT (lower(text) = text AND upper(text) <> text))")
_CONF = (f"least(100, 50 + CASE WHEN avg_size >= 16 THEN 30 WHEN avg_size >= 12 THEN 20 ELSE 0 END "
         f"+ CASE WHEN {_nwords('text')} BETWEEN 2 AND 8 THEN 10 ELSE 0 END + CASE WHEN {_PATTERN.format('text')} THEN 10 ELSE 0 END "
         "+ CASE WHEN is_bold THEN 15 ELSE 0 END + CASE WHEN spacing >= 30 THEN 15 WHEN spacing >= 25 THEN 10 ELSE 0 END) / 100.0::DOUBLE")
_LEVEL = "CAST(CASE WHEN avg_size >= 16 THEN 1 WHEN avg_size >= 12 THEN 2 ELSE 3 END AS BIGINT)"
HEADLINES = CANDIDATES + f""",
headlines AS (SELECT *, {_LEVEL} AS level, {_CONF} AS confidence,
  row_number() OVER (PARTITION BY doc_id ORDER BY page, y) AS headline_no FROM cand WHERE {_VALID})"""
PAGES = """page_texts AS (SELECT doc_id, page, string_agg(line || CASE WHEN style = 3 THEN chr(10) ELSE '' END, chr(10) ORDER BY line_no) AS text
  FROM text_lines GROUP BY ALL),
bodies AS (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY page) FILTER (WHERE length(text) > 0), '') AS body_text,
  count(*) AS total_pages FROM page_texts GROUP BY ALL)"""
_PARAS = (f"list_filter(list_transform(regexp_split_to_array({_strip('section')}, '\\n\\n+'), lambda p: {_strip('p')}), lambda p: p <> '')")
SECTIONS = HEADLINES + ", " + PAGES + f""",
nexts AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY headline_no) AS next_text FROM headlines),
starts AS (SELECT n.*, body_text, strpos(body_text, n.text) AS s, strpos(body_text, n.text) + length(n.text) AS after FROM nexts n JOIN bodies USING (doc_id)),
ends AS (SELECT *, CASE WHEN next_text IS NULL THEN 0 ELSE strpos(substring(body_text, after), next_text) END AS e FROM starts),
cuts AS (SELECT *, CASE WHEN e = 0 THEN substring(body_text, after) ELSE substring(body_text, after, e - 1) END AS section FROM ends),
sections AS (SELECT *, CASE WHEN s = 0 THEN '' ELSE array_to_string({_PARAS}, '¶') END AS paragraphs FROM cuts)"""


@query("read_glyphs", f"""WITH {GLYPHS}
SELECT doc_id, page, count(*) AS n_glyphs, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(x0) AS max_x0, max(size) AS max_size
FROM glyphs GROUP BY ALL""")
def _(load):
    """Write the glyph table to the shared folder, read it back with its fixed schema."""
    from statwitness.session import new_folder
    from statwitness.sources.glyphs import read_glyphs

    path = new_folder(load.spark, "glyphs")
    glyphs(load).write.parquet(path)
    return read_glyphs(load.spark, path, id_type="bigint").groupBy("doc_id", "page").agg(
        F.count(F.lit(1)).alias("n_glyphs"), F.sum(F.length("text")).alias("n_chars"),
        F.max("x0").alias("max_x0"), F.max("size").alias("max_size"))


@query("document_text", f"WITH {LINES0}, {PAGES} SELECT doc_id, body_text, total_pages FROM bodies")
def _(load):
    return O.document_text(page_texts(load))


@query("report_table_cells", f"""WITH {GLYPHS}
SELECT doc_id, page, 0::BIGINT AS table_no, line_no % 20 AS row_no, word_no AS col_no, word AS value FROM words""")
def _(load):
    """Each page as one table: a row per line, a cell per word."""
    rows = text_lines(load).groupBy("doc_id", "page").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", F.split("line", " ").alias("cells")))),
        lambda r: r["cells"]).alias("t"))
    return O.report_table_cells(rows.select("doc_id", "page", F.array("t").alias("tables")))


@query("document_id", """SELECT doc_id, 'report ' || doc_id || '.v' || '_' ||
  strftime(TIMESTAMP '2024-01-31 23:00:00' + to_seconds(doc_id), '%Y%m%d%H%M%S') AS document_id FROM documents""")
def _(load):
    path = F.concat(F.lit("/reports/"), "source", F.lit("/report "), "doc_id", F.lit(".v.pdf"))
    at = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-31 23:00:00"))) + F.col("doc_id"))
    return load("documents").select("doc_id", O.document_id(path, at).alias("document_id"))


@query("glyphs_to_lines", f"WITH {LINES} SELECT doc_id, page, y, text, round(avg_size, 6) AS avg_size FROM lines")
def _(load):
    return O.glyphs_to_lines(glyphs(load)).select("doc_id", "page", "y", "text", F.round("avg_size", 6).alias("avg_size"))


@query("dominant_font", f"WITH {LINES} SELECT doc_id, page, y, font, is_bold FROM lines")
def _(load):
    return O.glyphs_to_lines(glyphs(load)).select("doc_id", "page", "y", "font", "is_bold")


@query("line_spacing", f"WITH {SPACED} SELECT doc_id, page, y, spacing FROM spaced")
def _(load):
    return O.line_spacing(O.glyphs_to_lines(glyphs(load))).select("doc_id", "page", "y", "spacing")


@query("headline_candidates", f"WITH {CANDIDATES} SELECT doc_id, page, y, text, is_bold, spacing FROM cand")
def _(load):
    return O.headline_candidates(O.line_spacing(O.glyphs_to_lines(glyphs(load)))).select(
        "doc_id", "page", "y", "text", "is_bold", "spacing")


@query("is_valid_headline", f"WITH {LINES} SELECT doc_id, page, y, text, {_VALID} AS valid FROM lines")
def _(load):
    return O.glyphs_to_lines(glyphs(load)).select(
        "doc_id", "page", "y", "text", O.is_valid_headline(F.col("text")).alias("valid"))


@query("headline_confidence", f"WITH {SPACED} SELECT doc_id, page, y, {_CONF} AS confidence FROM spaced")
def _(load):
    return O.line_spacing(O.glyphs_to_lines(glyphs(load))).select("doc_id", "page", "y", O.headline_confidence(
        F.col("text"), F.col("avg_size"), F.col("is_bold"), F.col("spacing")).alias("confidence"))


@query("headline_level", f"WITH {SPACED} SELECT doc_id, page, y, {_LEVEL} AS level FROM spaced")
def _(load):
    return O.line_spacing(O.glyphs_to_lines(glyphs(load))).select(
        "doc_id", "page", "y", O.headline_level(F.col("avg_size")).alias("level"))


@query("number_headlines", f"WITH {HEADLINES} SELECT doc_id, 'h' || headline_no AS id, page, y, text FROM headlines")
def _(load):
    return headlines(load).select("doc_id", "id", "page", "y", "text")


@query("section_paragraphs", f"""WITH {SECTIONS}
SELECT doc_id, headline_no, CASE WHEN paragraphs = '' THEN 0 ELSE len(string_split(paragraphs, '¶')) END AS n_paragraphs, paragraphs FROM sections""")
def _(load):
    """Headlines are here whole lines of the documents."""
    out = O.section_paragraphs(headlines(load), page_texts(load))
    return out.select("doc_id", "headline_no", F.size("paragraphs").alias("n_paragraphs"),
                      F.array_join("paragraphs", "¶").alias("paragraphs"))


@query("extract_headlines", f"""WITH {SECTIONS}
SELECT doc_id, 'h' || headline_no AS id, text, level, page, confidence, is_bold, spacing, paragraphs FROM sections""")
def _(load):
    out = O.extract_headlines(glyphs(load), page_texts(load))
    return out.select("doc_id", "id", "text", "level", "page", "confidence", "is_bold", "spacing",
                      F.array_join("paragraphs", "¶").alias("paragraphs"))


@query("headlines_on_page", f"WITH {HEADLINES} SELECT doc_id, 'h' || headline_no AS id, text FROM headlines WHERE page = 2")
def _(load):
    return O.headlines_on_page(headlines(load), 2).select("doc_id", "id", "text")


@query("headline_tree", f"""WITH {HEADLINES}
SELECT doc_id, headline_no, repeat('  ', level - 1) || text || ' (H' || level || ', page ' || page || ')' AS label FROM headlines""")
def _(load):
    return O.headline_tree(headlines(load)).select("doc_id", "headline_no", "label")


@query("parent_headline", f"""WITH {HEADLINES}
SELECT doc_id, 'h' || headline_no AS id, level,
  CASE level WHEN 2 THEN last_value(CASE WHEN level = 1 THEN 'h' || headline_no END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY headline_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    WHEN 3 THEN last_value(CASE WHEN level <= 2 THEN 'h' || headline_no END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY headline_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_id
FROM headlines""")
def _(load):
    return O.parent_headline(headlines(load)).select("doc_id", "id", "level", "parent_id")
