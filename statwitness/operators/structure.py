"""Document structure: glyphs to lines, headlines, sections and their hierarchy.

Input contract: glyphs(doc_id, page, glyph_no, text, size, font, top, x0) and pages(doc_id, page, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statwitness import params as P
from statwitness.functions import text as T
from statwitness.operators import ordered
from statwitness.session import materialise

LINE = ["doc_id", "page", "y"]
PAGES_PER_BLOCK = 64
AROUND_BLANK = r"(?s)(?=(.{3} .{3}))"
CHARS_PER_TASK = 4_000_000  # of page texts that are laid out as glyphs, rows of many times that size


def line_position(top: Column) -> Column:
    """Two-point grid with half-to-even rounding."""
    return (F.bround(top / 2) * 2).cast("int")


def dominant_font(glyphs: Column) -> Column:
    """Most frequent font of the ordered glyphs; among equals the one met first from the left."""
    fonts = F.array_distinct(F.transform(glyphs, lambda g: g["font"]))
    ranked = F.transform(fonts, lambda f, i: F.struct(
        F.size(F.filter(glyphs, lambda g: g["font"] == f)).alias("n"), (-i).alias("first"), f.alias("font")))
    return F.array_max(ranked)["font"]


def spread_pages(rows: DataFrame, chars: int) -> DataFrame:
    """Rows dealt by report and page over as many tasks as ``chars`` characters of text need.

    Glyphs made from such rows are where their line and page are put together: they are not shuffled, and a task's glyphs fit its memory.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-chars // CHARS_PER_TASK)), "doc_id", "page")


def glyphs_to_lines(glyphs: DataFrame) -> DataFrame:
    """One row per printed line: text, average size, dominant font, bold flag. Glyphs that are already dealt by report and page
    (``spread_pages``) stay where they are."""
    ordered_glyphs = F.array_sort(F.collect_list(F.struct("x0", "glyph_no", "text", "font")))
    lines = glyphs.withColumn("y", line_position(F.col("top"))).groupBy(*LINE).agg(
        ordered_glyphs.alias("g"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("avg_size"))
    return lines.select(
        *LINE, T.strip(F.array_join(F.transform("g", lambda g: g["text"]), "")).alias("text"),
        "avg_size", dominant_font(F.col("g")).alias("font"),
    ).withColumn("is_bold", F.contains(F.lower("font"), F.lit("bold")))


def line_spacing(lines: DataFrame) -> DataFrame:
    """Distance to the previous kept line of the page. Short or size-less lines are dropped first.

    A page has at most page height / 2 distinct positions, so the window group is small.
    """
    kept = lines.filter((F.length("text") >= P.MIN_CHARS) & F.col("avg_size").isNotNull())
    before = F.lag("y").over(W.partitionBy("doc_id", "page").orderBy("y"))
    return kept.withColumn("_p", before).withColumn(
        "spacing", F.when(F.col("_p").isNull() | (F.col("_p") == 0), 0).otherwise(F.col("y") - F.col("_p"))
    ).drop("_p")


def headline_candidates(lines: DataFrame) -> DataFrame:
    """Lines whose size, weight and spacing allow a headline."""
    size, bold, spacing = F.col("avg_size"), F.col("is_bold"), F.col("spacing")
    low, high = P.BODY_BAND
    return lines.filter(
        (size >= P.HEADLINE_MIN_SIZE)
        & ~(size.between(low, high) & ~bold)
        & ~((size < P.SMALL_BOLD_BELOW) & ~bold)
        & ~((size < P.SMALL_BOLD_BELOW) & bold & (T.word_count(F.col("text")) > P.MAX_WORDS))
        & ~((spacing > 0) & (spacing < P.MIN_SPACING)))


def is_valid_headline(text: Column) -> Column:
    """Length, wording and letter case of a headline."""
    words = T.word_count(text)
    lowered = F.lower(T.strip(text))
    unfinished = F.lit(False)
    for ending in P.UNFINISHED_ENDINGS:
        unfinished = unfinished | F.endswith(lowered, F.lit(ending))
    starts_well = T.any_pattern(T.strip(text), P.HEADLINE_PATTERNS) | text.rlike(r"^\p{Lu}")
    return F.coalesce(
        words.between(P.MIN_WORDS, P.MAX_WORDS) & (F.length(text) >= P.MIN_CHARS) & ~unfinished
        & starts_well & ~T.is_all_upper(text) & ~T.is_all_lower(text), F.lit(False))


def headline_confidence(text: Column, size: Column, bold: Column, spacing: Column) -> Column:
    """Score in hundredths, so no rounding drift."""
    points = (
        F.lit(50)
        + F.when(size >= P.H1_MIN_SIZE, 30).when(size >= P.H2_MIN_SIZE, 20).otherwise(0)
        + F.when(T.word_count(text).between(2, 8), 10).otherwise(0)
        + F.when(T.any_pattern(T.strip(text), P.HEADLINE_PATTERNS), 10).otherwise(0)
        + F.when(bold, 15).otherwise(0)
        + F.when(spacing >= P.WIDE_SPACING, 15).when(spacing >= P.MIN_SPACING, 10).otherwise(0)
    )
    return F.least(points, F.lit(100)) / 100.0


def headline_level(size: Column) -> Column:
    return F.when(size >= P.H1_MIN_SIZE, 1).when(size >= P.H2_MIN_SIZE, 2).otherwise(3)


def number_headlines(headlines: DataFrame) -> DataFrame:
    """h1, h2, ... in reading order; numbered inside each page, then shifted by the pages before."""
    numbered = ordered.row_number(headlines, ["doc_id"], "page", [F.col("y")], "headline_no")
    return numbered.withColumn("id", F.concat(F.lit("h"), F.col("headline_no")))


def document_text(pages: DataFrame) -> DataFrame:
    """Non-empty page texts joined by newlines, and the page count. A report is one text value."""
    kept = F.when(F.length("text") > 0, F.struct("page", "text"))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda p: p["text"]), "\n").alias("body_text"),
        F.count(F.lit(1)).alias("total_pages"))


def report_table_cells(page_tables: DataFrame) -> DataFrame:
    """Cells of the tables found on each page: (doc_id, page, table_no, row_no, col_no, value)."""
    return (
        page_tables.select("doc_id", "page", F.posexplode("tables").alias("table_no", "t"))
        .select("doc_id", "page", "table_no", F.posexplode("t").alias("row_no", "r"))
        .select("doc_id", "page", "table_no", "row_no", F.posexplode("r").alias("col_no", "value"))
    )


def _paragraphs(section: Column) -> Column:
    parts = F.split(T.strip(section), r"\n\n+")
    return F.filter(F.transform(parts, T.strip), lambda p: p != "")


def _marks(text: Column) -> Column:
    """Hashes of the seven characters around each blank: a text that contains a phrase has all marks of the phrase."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(AROUND_BLANK), F.lit(1))), lambda m: F.xxhash64(m))


def numbered_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, n, page_text): the pages that have text, counted from 1 in each report."""
    kept = pages.filter(F.length("text") > 0).select(
        "doc_id", "page", F.col("text").alias("page_text"), F.floor(F.col("page") / PAGES_PER_BLOCK).alias("_block"))
    return ordered.row_number(kept, ["doc_id"], "_block", [F.col("page"), F.col("page_text")], "n").select("doc_id", "n", "page_text")


def phrase_places(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, n, phrase, at): the first place of each phrase on every page of its report that contains it.

    phrases(doc_id, phrase) without repeats, texts as ``numbered_pages`` gives them. A phrase meets pages by the rarest of its marks; one
    whose marks are not all in the report meets none. Phrases without marks (one word, say) are looked up on all pages of their report.
    Of the pages' marks, those that some phrase of the report has are written once; the others go no further than the first shuffle.
    """
    none = F.lit(0).cast("long")
    own = _marks(F.col("phrase"))
    sought = materialise(phrases.select("doc_id", "phrase", F.explode(F.when(F.size(own) > 0, own).otherwise(F.array(none))).alias("mark")))
    asked = texts.join(sought.select("doc_id").distinct(), "doc_id", "left_semi")
    marks = materialise(asked.select("doc_id", "n", F.explode(F.array_append(_marks(F.col("page_text")), none)).alias("mark")).join(
        sought.select("doc_id", "mark").distinct().hint("merge"), ["doc_id", "mark"], "left_semi"))
    often = marks.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("pages"))
    index = sought.join(often, ["doc_id", "mark"], "left").groupBy("doc_id", "phrase").agg(
        F.min(F.struct(F.coalesce("pages", none).alias("pages"), "mark")).alias("k")).select("doc_id", "phrase", F.col("k.mark").alias("mark"))
    met = marks.join(index, ["doc_id", "mark"]).select("doc_id", "n", "phrase")
    return met.join(texts, ["doc_id", "n"]).select(
        "doc_id", "n", "phrase", F.position(F.col("phrase"), F.col("page_text")).cast("long").alias("at")).filter(F.col("at") > 0)


def section_paragraphs(headlines: DataFrame, pages: DataFrame) -> DataFrame:
    """Paragraphs between the first place of a headline in its report and the next place of the headline that follows it.

    headlines(doc_id, page, y, headline_no, text, ...), pages(doc_id, page, text). Sections run over the non-empty pages joined by
    newlines; a headline stands on one page. A headline that the report's text does not contain, or without text, has no paragraphs; a
    section whose next headline is not found behind it goes to the end.

    Places come from an index of the pages, and each page is cut once for every section that runs over it, so the cost follows the
    text and the sections, not headlines times text.
    """
    following = ordered.next_value(headlines, ["doc_id"], "page", [F.col("y")], F.col("text"), "_next").withColumn(
        "_next", F.coalesce("_next", F.lit("")))
    texts = materialise(numbered_pages(pages))
    phrases = headlines.filter(F.length("text") > 0).select("doc_id", F.col("text").alias("phrase")).distinct()
    places = materialise(phrase_places(phrases, texts))

    first = places.groupBy("doc_id", F.col("phrase").alias("text")).agg(F.min(F.struct("n", "at")).alias("_s"))
    starts = following.select("doc_id", "text", "_next").distinct().join(first, ["doc_id", "text"]).select(
        "doc_id", "text", "_next", F.col("_s.n").alias("n"), (F.col("_s.at") + F.length("text")).alias("after"))
    # the end on the page of the start
    here = F.when(F.col("_next") != "", F.position(F.col("_next"), F.col("page_text"), F.col("after").cast("int"))).cast("long")
    near = materialise(starts.join(texts, ["doc_id", "n"]).select(*starts.columns, here.alias("here")))
    # else the first place on a later page: pages in falling order, questions before the places of their page
    asked = near.filter((F.col("_next") != "") & (F.col("here") == 0)).select("doc_id", F.col("_next").alias("phrase"), "n").distinct()
    both = asked.withColumn("at", F.lit(None).cast("long")).unionByName(places).withColumn("_block", F.floor(-F.col("n") / PAGES_PER_BLOCK))
    placed = F.col("at").isNotNull()
    later = ordered.last_before(both, ["doc_id", "phrase"], "_block", [-F.col("n"), placed], {"later": F.when(placed, F.struct("n", "at"))}).filter(
        ~placed).select("doc_id", F.col("phrase").alias("_next"), "n", "later")

    last = texts.groupBy("doc_id").agg(F.max("n").alias("last"))
    found_here = F.col("here") > 0
    spans = near.join(later, ["doc_id", "_next", "n"], "left").join(last, "doc_id").select(
        "doc_id", "text", "_next", "after", F.col("n").alias("from"),
        F.when(found_here, F.col("n")).otherwise(F.coalesce("later.n", "last")).alias("to"),
        F.when(found_here, F.col("here")).otherwise(F.col("later.at")).alias("stop"))
    over = spans.withColumn("n", F.explode(F.sequence("from", "to"))).join(texts, ["doc_id", "n"])
    begin = F.when(F.col("n") == F.col("from"), F.col("after")).otherwise(1)
    end = F.when(F.col("n") == F.col("to"), F.col("stop"))
    piece = F.substring("page_text", begin.cast("int"), (F.coalesce(end, F.length("page_text") + 1) - begin).cast("int"))
    sections = over.groupBy("doc_id", "text", "_next").agg(F.array_sort(F.collect_list(F.struct("n", piece.alias("piece")))).alias("_p")).select(
        "doc_id", "text", "_next", _paragraphs(F.array_join(F.transform("_p", lambda p: p["piece"]), "\n")).alias("paragraphs"))
    return following.join(sections, ["doc_id", "text", "_next"], "left").select(*headlines.columns, F.coalesce(
        "paragraphs", F.array().cast("array<string>")).alias("paragraphs"))


def find_headlines(glyphs: DataFrame) -> DataFrame:
    """Numbered headlines with level and confidence, without their paragraphs."""
    text = F.col("text")
    valid = headline_candidates(line_spacing(glyphs_to_lines(glyphs))).filter(is_valid_headline(text))
    scored = valid.withColumns({
        "level": headline_level(F.col("avg_size")),
        "confidence": headline_confidence(text, F.col("avg_size"), F.col("is_bold"), F.col("spacing")),
    })
    # Few lines are headlines: written once, they are numbered without reading the glyphs again.
    return number_headlines(materialise(scored))


def extract_headlines(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """The whole chain: glyphs and page texts to headlines with paragraphs."""
    return section_paragraphs(find_headlines(glyphs), pages)


def headlines_on_page(headlines: DataFrame, page: int) -> DataFrame:
    return headlines.filter(F.col("page") == page)


def headline_tree(headlines: DataFrame) -> DataFrame:
    """Indented label per headline, two blanks per level."""
    label = F.concat(
        F.repeat(F.lit("  "), F.col("level") - 1), F.col("text"), F.lit(" (H"), F.col("level"),
        F.lit(", page "), F.col("page"), F.lit(")"))
    return headlines.withColumn("label", label)


def parent_headline(headlines: DataFrame) -> DataFrame:
    """The nearest earlier headline of a higher level."""
    level, number = F.col("level"), F.col("id")
    held = ordered.last_before(
        headlines, ["doc_id"], "page", [F.col("y")],
        {"last_h1": F.when(level == 1, number), "last_h2": F.when(level <= 2, number)})
    return held.withColumn(
        "parent_id", F.when(level == 2, F.col("last_h1")).when(level == 3, F.col("last_h2"))
    ).drop("last_h1", "last_h2")


def document_id(path: Column, parsed_at: Column) -> Column:
    """File name without .pdf, then the parse time."""
    name = F.replace(F.regexp_extract(path, r"[^/]*$", 0), F.lit(".pdf"), F.lit(""))
    return F.concat_ws("_", name, F.date_format(parsed_at, "yyyyMMddHHmmss"))
