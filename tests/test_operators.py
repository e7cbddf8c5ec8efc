"""Operators on small inline rows: edge cases and worked examples."""

import random
import re

import pytest
from pyspark.sql import Window as W, functions as F

from statwitness.functions import text as T
from statwitness.operators import claims, extract as E, mapping as M, ordered, profile as P, structure as S, style, verify as V


def profile_of(spark, values, name="col"):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` string")
    return P.column_profile(P.value_counts(P.long_values(df, "t"))).first()


# ---- profiling ------------------------------------------------------------------------------------


@pytest.mark.parametrize("values, kind, role", [
    (["20.5", "c", "21.0", "22.5", "z", "23.0"], "text", "metric"),
    ([f"v{i}" for i in range(49)], "text", "filter"),
    ([f"v{i}" for i in range(50)], "text", "identifier"),
    (["1", "2", "3"] + ["x%d" % i for i in range(7)], "text", "metric"),
    (["1", "2"] + ["x%d" % i for i in range(8)], "text", "filter"),
    (["1", "1", "2", "2"], "int", "filter"),
    (["1", "2", "3", "3", "3"], "int", "metric"),
    ([None, "NA", ""], "float", "filter"),
    (["1", None, "2"], "float", "metric"),
    (["True", "False"], "bool", "unknown"),
    (["1d", "5f", "0x1"], "text", "filter"),
])
def test_roles(spark, values, kind, role):
    row = profile_of(spark, values)
    assert (row.kind, row.role) == (kind, role)


def test_samples(spark):
    assert profile_of(spark, ["b", "a", "b", "c", None]).sample_values == ["b", "a", "c"]
    assert len(profile_of(spark, [f"v{i:02}" for i in range(20)]).sample_values) == 20
    assert profile_of(spark, [f"v{i:02}" for i in range(21)]).sample_values == [f"v{i:02}" for i in range(10)]
    assert profile_of(spark, [f"v{i:02}" for i in range(21)], "update_flag").sample_values == [f"v{i:02}" for i in range(21)]
    assert profile_of(spark, ["202223", "202122", "202223"], "time_period").sample_values == ["202122", "202223"]
    assert profile_of(spark, ["9", "10"], "year").sample_values == ["9", "10"]
    assert profile_of(spark, ["1", "2"]).sample_values is None


def test_suppression_and_aggregate(spark):
    df = spark.createDataFrame([("c", "Total"), ("1", "Boys"), ("c", "Girls"), (".", "Total")], "m string, sex string")
    vc = P.value_counts(P.long_values(df, "t"))
    assert {(r.column_name, r.marker): r.n for r in P.suppression_profile(vc).collect()} == {("m", "c"): 2, ("m", "."): 1}
    stats = P.infer_column_role(P.column_stats(vc))
    assert [r.aggregate_value for r in P.aggregate_value(P.sample_values(vc, stats), stats).collect()] == ["Total"]


def test_approximate_stats_agree_on_small_data(spark):
    df = spark.createDataFrame([(str(i % 7), "x") for i in range(50)], "a string, b string")
    cells = P.long_values(df, "t")
    pick = lambda d: {r.column_name: (r.n_rows, r.n_distinct, r.kind) for r in d.collect()}
    assert pick(P.approximate_column_stats(cells)) == pick(P.column_stats(P.value_counts(cells)))


# ---- extraction: the boys and girls example -----------------------------------------------------------

ROWS = [("202122", "Boys", "20.0", "95"), ("202122", "Girls", "19.6", "97"), ("202223", "Boys", "20.4", "95"), ("202223", "Girls", "19.9", "97"),
        ("202324", "Boys", "20.9", "95"), ("202324", "Girls", "20.4", "97"), ("202425", "Boys", "21.2", "95"), ("202425", "Girls", "20.7", "c")]
PARAGRAPH = ("Of eligible pupils in year 4, a slightly larger proportion of girls took the check than boys (97% and 95% respectively). "
             "Of pupils who took the check, the average score for girls was 19.6 while the average score for boys was 20.0.")


def school_table(spark):
    rows = [(t, s, g, a, p, i) for i, (t, s, a, p) in enumerate(ROWS) for g in ["National", "Regional"]]
    rows += [(t, "Total", "National", "20.2", "96", 100 + i) for i, (t, *_r) in enumerate(ROWS[::2])]
    return spark.createDataFrame(rows, "time_period string, sex string, geographic_level string, mtc_score_average string, completed_check_pupil_percent string, n int")


LABELS = [("mtc_score_average", "Average attainment score"), ("completed_check_pupil_percent", "Percentage of eligible pupils who took the check")]


def test_worked_pivot(spark):
    metrics = ["mtc_score_average", "completed_check_pupil_percent"]
    df = E.filter_aggregate_scope(E.filter_in(school_table(spark), "sex", ["Boys", "Girls"]), {"geographic_level": "National", "sex": "Total"}, ["sex"])
    wide = E.pivot_first(E.melt(E.project(df, ["sex", "time_period", "n", *metrics]), ["sex", "time_period", "n"], metrics),
                         ["metric", "time_period"], "sex", ["Boys", "Girls"], ["n"])
    shown = E.format_percent(E.label_metrics(wide, spark.createDataFrame(LABELS, "metric string, label string")), ["Boys", "Girls"])
    rows = [tuple(r) for r in E.blank_repeats(shown, [], "metric", ["time_period"]).orderBy("metric", "time_period").select(
        "label", "time_period", "Boys", "Girls").collect()]
    assert rows[0] == ("Percentage of eligible pupils who took the check", "202122", "95%", "97%")
    assert rows[3] == ("", "202425", "95%", "c")
    assert rows[4] == ("Average attainment score", "202122", "20", "19.6")
    assert rows[7] == ("", "202425", "21.2", "20.7")


def test_worked_extraction_end_to_end(spark):
    table = school_table(spark)
    profile = P.column_profile(P.value_counts(P.long_values(table.drop("n"), "mtc")))
    heads = spark.createDataFrame([("h1", "mtc", PARAGRAPH), ("h2", "mtc", "Nothing to see"), ("h3", "none", PARAGRAPH)], "headline_id string, table_id string, paragraph string")
    phrases = spark.createDataFrame([("average score", "mtc_score_average"), ("took the check", "completed_check_pupil_percent"), ("pupils", "absent")], "phrase string, metric string")
    metrics = E.match_metrics(heads, phrases, profile)
    samples = profile.filter("role = 'filter'").select("table_id", "column_name", F.explode("sample_values").alias("value"))
    breakdowns = E.choose_breakdown(E.match_filter_values(heads, samples))
    assert [(r.headline_id, r.column_name, r["values"]) for r in breakdowns.collect()] == [("h1", "sex", ["Boys", "Girls"])]
    aggregates = spark.createDataFrame([("mtc", "geographic_level", "National"), ("mtc", "sex", "Total")], "table_id string, column_name string, aggregate_value string")
    specs = E.build_specs(heads, metrics, breakdowns, aggregates)
    assert {r.headline_id: r.error for r in specs.collect()} == {"h1": None, "h2": "No metric found", "h3": "No metric found"}
    pairs = [x for c in table.columns if c != "n" for x in (F.lit(c), F.col(c))]
    data = table.select(F.lit("mtc").alias("table_id"), F.col("n").cast("string").alias("row_no"), F.create_map(*pairs).alias("values"))
    out = E.extract_tables(specs, data, spark.createDataFrame(LABELS, "metric string, label string"), "time_period")
    got = {(r.headline_id, r.metric, r.time_value): r.cells for r in out.collect()}
    assert len(got) == 8 and got[("h1", "completed_check_pupil_percent", "202122")] == {"Boys": "95%", "Girls": "97%"}


def test_filters_from_code(spark):
    code = "a = df[df['sex'].isin(['Boys', \"Girls\"])]\nb = df.year.isin([2022, 2023])\nc = df[df[\"sex\"].isin(['Total'])]"
    got = spark.createDataFrame([(code,)], "code string").select(E.filters_applied(F.col("code")).alias("f")).first().f
    assert got == {"sex": ["Total"], "year": ["2022", "2023"]}


def test_confidence(spark):
    rows = spark.createDataFrame([(0, 0), (5, 1), (8, 4), (12, 4), (60, 4), (12, 11)], "r int, c int")
    assert [x[0] for x in rows.select(E.confidence(F.col("r"), F.col("c"))).collect()] == [0.5, 0.7, 0.8, 1.0, 0.9, 0.9]


# ---- structure -----------------------------------------------------------------------------------------


def test_lines_and_spacing(spark):
    def line(y, text, size, font):
        return [("d", 1, int(y * 100 + i), c, size, font, float(y), float(i)) for i, c in enumerate(text)]

    glyphs = line(10, "Executive Summary", 16.0, "A-Bold") + line(30, "abc", 16.0, "A") + line(60, "Key findings here", 12.0, "A-Bold") + line(80, "Too close to it", 12.0, "A-Bold")
    glyphs += [("d", 1, 9000 + i, c, 16.0, f, 101.0, float(i)) for i, (c, f) in enumerate(zip("Mixed fonts", ["X", "Y"] * 6))]
    df = spark.createDataFrame(glyphs, "doc_id string, page int, glyph_no int, text string, size double, font string, top double, x0 double")
    rows = {r.text: r for r in S.line_spacing(S.glyphs_to_lines(df)).collect()}
    assert "abc" not in rows and rows["Executive Summary"].spacing == 0
    assert rows["Key findings here"].spacing == 50 and rows["Too close to it"].spacing == 20
    assert rows["Mixed fonts"].y == 100 and rows["Mixed fonts"].font == "X"  # 50.5 rounds to even
    heads = {r.text: (r.id, r.level, r.confidence) for r in S.find_headlines(df).collect()}
    assert heads == {"Executive Summary": ("h1", 1, 1.0), "Key findings here": ("h2", 2, 1.0)}


@pytest.mark.parametrize("text, ok", [
    ("Executive Summary", True), ("Summary", False), ("1. Introduction", True), ("London was highest, with an", False), ("ALL CAPS LINE", False),
    ("all lower line", False), ("one Two Three Four Five Six Seven Eight Nine Ten", False), ("One Two Three Four Five Six Seven Eight Nine Ten Eleven", False),
    ("About the data", True), ("A b", False), ("the Key figures", True)])
def test_valid_headline(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(S.is_valid_headline(F.col("t"))).first()[0] is ok


def test_sections(spark):
    heads = spark.createDataFrame([("d", 1, 0, 1, "Intro here"), ("d", 1, 50, 2, "Next part"), ("d", 2, 0, 3, "Not there")], "doc_id string, page int, y int, headline_no int, text string")
    pages = spark.createDataFrame([("d", 1, "Intro here\npara one\n\n\n para two \nNext part\nend")], "doc_id string, page int, text string")
    got = {r.headline_no: r.paragraphs for r in S.section_paragraphs(heads, pages).collect()}
    assert got == {1: ["para one", "para two"], 2: ["end"], 3: []}


def test_sections_equal_a_search_of_the_whole_text(spark):
    """Repeated and overlapping headlines, words of one letter, headlines inside paragraphs, empty pages, reports without pages or headlines."""
    rng = random.Random(5)
    words = ["aaa", "aa", "a", "aba bab", "long words here", "b aab", "\n", "\n\n", "über Maß", "Ω😀 xyz abc"]
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    pages, heads = [], []
    for d in range(40):
        pages += [(d, p, rng.choice([None, "", text(4), text(12)])) for p in rng.sample(range(200), rng.randint(0, 9))]
        heads += [(d, no // 3, no % 3, no + 1, text(3).replace("\n", "").strip()) for no in range(rng.randint(0, 12))]
    heads = [h for h in heads if h[4]]
    expected = {}
    for i, (d, page, y, no, head) in enumerate(heads):
        body = "\n".join(t for _, _, t in sorted((x for x in pages if x[0] == d and x[2]), key=lambda x: x[1]))
        start, behind = body.find(head), heads[i + 1][4] if i + 1 < len(heads) and heads[i + 1][0] == d else None
        stop = body.find(behind, start + len(head)) if behind else -1
        section = "" if start < 0 else body[start + len(head):stop if stop >= 0 else None]
        expected[d, no] = [p.strip() for p in re.split(r"\n\n+", section.strip()) if p.strip()]
    got = S.section_paragraphs(
        spark.createDataFrame(heads, "doc_id long, page int, y int, headline_no int, text string"),
        spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()
    assert len(got) == len(heads) and {(r.doc_id, r.headline_no): r.paragraphs for r in got} == expected


def test_parents(spark):
    rows = [("d", 1, 0, 1), ("d", 1, 10, 2), ("d", 2, 0, 3), ("d", 3, 0, 2), ("d", 3, 10, 3), ("d", 4, 0, 1)]
    df = S.number_headlines(spark.createDataFrame(rows, "doc_id string, page int, y int, level int"))
    assert {r.id: r.parent_id for r in S.parent_headline(df).collect()} == {"h1": None, "h2": "h1", "h3": "h2", "h4": "h1", "h5": "h4", "h6": None}


# ---- ordered helpers equal plain windows -----------------------------------------------------------------


def test_blocked_windows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.hash("id") % 50).alias("v")).withColumn("b", F.floor(F.col("o") / 17))
    w = W.partitionBy("k").orderBy("o")
    out = ordered.running_sum(df, ["k"], "b", [F.col("o")], F.col("v"), "s")
    out = ordered.next_value(out, ["k"], "b", [F.col("o")], F.col("v"), "nx")
    out = ordered.previous_value(out, ["k"], "b", [F.col("o")], {"pv": "v"})
    out = ordered.last_before(out, ["k"], "b", [F.col("o")], {"lb": F.when(F.col("v") > 40, F.col("v"))})
    plain = out.select(
        (F.sum("v").over(w) == F.col("s")).alias("a"), F.lead("v").over(w).eqNullSafe(F.col("nx")).alias("b"), F.lag("v").over(w).eqNullSafe(F.col("pv")).alias("c"),
        F.last(F.when(F.col("v") > 40, F.col("v")), True).over(w.rowsBetween(W.unboundedPreceding, -1)).eqNullSafe(F.col("lb")).alias("d"))
    assert plain.filter("not (a and b and c and d)").count() == 0 and plain.count() == 500


# ---- mapping, claims, verification, style -------------------------------------------------------------------


def test_shared_key_shares_choice(spark):
    long = "x" * 60
    heads = spark.createDataFrame([("r", 1, long + "1", 1), ("r", 2, long + "2", 1), ("r", 3, "other", 1)], "report string, headline_no int, text string, page int")
    choices = spark.createDataFrame([("r", "h1_" + "x" * 50, "b.csv"), ("r", "h1_" + "x" * 50, "a.csv")], "report string, key string, csv_file string")
    assert sorted((r.headline_no, r.csv_files) for r in M.map_headlines(heads, choices).collect()) == [(1, ["a.csv", "b.csv"]), (2, ["a.csv", "b.csv"])]


def test_worked_claims(spark):
    paragraphs = spark.createDataFrame([("e", 0, PARAGRAPH)], "extraction_id string, p int, text string")
    vocabulary = spark.createDataFrame([("e", [("completed_check_pupil_percent", "took the check"), ("mtc_score_average", "average score")], [("Girls", "girls"), ("Boys", "boys")])],
                                       "extraction_id string, metrics array<struct<name string, mention string>>, values array<struct<name string, mention string>>")
    out = claims.link_claims(claims.split_sentences(paragraphs, ["extraction_id", "p"], "text"), vocabulary, ["p"])
    got = {(r.raw, r.metric, r.filter_value, r.value_method) for r in out.collect()}
    assert ("97%", "completed_check_pupil_percent", "Girls", "respectively") in got and ("95%", "completed_check_pupil_percent", "Boys", "respectively") in got
    assert ("19.6", "mtc_score_average", "Girls", "nearest") in got and ("20.0", "mtc_score_average", "Boys", "nearest") in got
    cells = spark.createDataFrame([("e", "completed_check_pupil_percent", "Girls", 0, "97"), ("e", "completed_check_pupil_percent", "Boys", 0, "94"), ("e", "mtc_score_average", "Girls", 0, "c")],
                                  "extraction_id string, metric string, filter_value string, row_no int, value string")
    status = {r.raw: r.status for r in V.verify_claims(out, cells).collect()}
    assert (status["97%"], status["95%"], status["19.6"]) == ("PASS", "FAIL", "UNMATCHED")


def test_substring_and_number_modes(spark):
    ext = spark.createDataFrame([("e", ["girls scored 19.6, 97% took part"], [{"score_average": "9.6"}, {"score_average": "97.0"}, {"score_average": "c"}])],
                                "extraction_id string, paragraphs array<string>, extracted_table array<map<string,string>>")
    assert [r.verified for r in V.verify_cells(ext, "substring").orderBy("row_no").collect()] == [True, False, True]
    assert [r.verified for r in V.verify_cells(ext).orderBy("row_no").collect()] == [False, True, False]


def test_style_checks(spark):
    ext = spark.createDataFrame([
        ("a", ["data suppressed"], [{"time_period": "202223", "x_percent": "97"}, {"time_period": "2022-23", "x_percent": "0.9"}]),
        ("b", ["data suppressed"], [{"time_period": "202223", "x_percent": "c"}, {"time_period": "202324", "x_percent": "101"}]),
        ("c", ["fine"], [{"x": "1"}])], "extraction_id string, paragraphs array<string>, extracted_table array<map<string,string>>")
    cells = style.all_cells(ext)
    report = style.style_report(style.check_unit_consistency(cells), style.check_suppression_markers(ext), style.check_time_format(cells))
    assert {r.extraction_id: r.failed_checks for r in report.collect()} == {"a": ["suppression_markers", "time_format"], "b": ["unit_consistency"], "c": []}


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a b\t",)], "t string")
    assert df.select(T.strip(F.col("t")), T.word_count(F.col("t"))).first()[:] == ("a b", 2)
    nums = spark.createDataFrame([(x,) for x in ["1", "-2.5e3", " 7 ", "1d", "NaN", "c", "1,000"]], "t string")
    assert [r[0] for r in nums.select(T.to_number(F.col("t"))).collect()] == [1.0, -2500.0, 7.0, None, None, None, None]


def test_time_samples_are_whole_and_in_their_order(spark):
    from statwitness.operators import profile as O

    rows = [(i, f"{20000 - i}") for i in range(12_000)]
    cells = O.long_values(spark.createDataFrame(rows, "a int, period string").withColumn("a", F.col("a").cast("string")), "t")
    texts = O.long_values(spark.createDataFrame([("n/k",), ("9",), ("10",)], "month string"), "u")
    flags = O.long_values(spark.createDataFrame([("true",), ("FALSE",)], "ok string"), "v")
    got = {(r.table_id, r.column_name): r for r in O.column_profile(O.value_counts(cells.union(texts).union(flags))).collect()}
    assert got["t", "period"].sample_values == [str(v) for v in sorted(20000 - i for i in range(12_000))]
    assert got["u", "month"].sample_values == ["10", "9", "n/k"]
    assert (got["v", "ok"].kind, got["v", "ok"].role) == ("bool", "unknown")


def test_claims_with_signs_and_whole_words(spark):
    from statwitness.operators import claims as C

    text = "The average score for women was 19.6, a change of -2.5 points; men had 18.0 in 2022-23. White British pupils had 5.5."
    found = C.extract_claims(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").orderBy("sentence_no", "pos").collect()
    assert [r.value for r in found] == [19.6, -2.5, 18.0, 2022.0, 23.0, 5.5]
    names = lambda *ns: [(n, n.lower()) for n in ns]
    vocabulary = spark.createDataFrame([("e", names("Score"), names("Men", "Women", "White", "White British"))],
                                       "extraction_id string, metrics array<struct<name:string,mention:string>>, values array<struct<name:string,mention:string>>")
    sentences = spark.createDataFrame([("e", i, s) for i, s in enumerate([text.split(";")[0], text.split(". ")[-1]])], "extraction_id string, sentence_no int, sentence string")
    linked = {r.raw: r.filter_value for r in C.link_claims(sentences, vocabulary, []).collect()}
    assert linked["19.6"] == "Women" and linked["5.5"] == "White British"


def test_a_claim_is_one_row_and_open_dimensions_are_ambiguous(spark):
    claims = spark.createDataFrame([("e", "score", "Girls", "19.6", 19.6, 1), ("e", "score", "Boys", "7", 7.0, 0), ("e", "score", "All", "9", 9.0, 0)],
                                   "extraction_id string, metric string, filter_value string, raw string, stated double, decimals int")
    cells = spark.createDataFrame([("e", "score", "Girls", i, v) for i, v in enumerate(["19.6", "19.0", "18.8", "18.1"])] + [("e", "score", "Boys", 4, "8")],
                                  "extraction_id string, metric string, filter_value string, row_no int, value string")
    checked = V.verify_claims(claims, cells)
    assert {r.filter_value: (r.status, r.candidates) for r in checked.collect()} == {"Girls": ("AMBIGUOUS", 4), "Boys": ("FAIL", 1), "All": ("UNMATCHED", 0)}
    assert checked.count() == 3 and [r.filter_value for r in V.suggest_corrections(checked).collect()] == ["Boys"]


def test_extractions_without_cells_are_scored(spark):
    from statwitness.operators import score as Q, style as Y

    table = "extraction_id string, paragraphs array<string>, extracted_table array<map<string,string>>"
    ext = spark.createDataFrame([("good", ["Was 5.0."], [{"score_average": "5.0"}]), ("empty", ["x"], []), ("plain", ["x"], [{"name": "y"}])], table)
    cells = Y.all_cells(ext)
    style = Y.style_report(Y.check_unit_consistency(cells, ext), Y.check_suppression_markers(ext), Y.check_time_format(cells, extractions=ext))
    scores = Q.quality_score(V.numeric_report(V.verify_cells(ext), ext).drop("cell_reports"), style)
    d = Q.quality_dashboard(scores).first()
    assert (d.total, d.passed, d.failed) == (3, 1, 2) and Q.failed_extractions(scores).count() == 2


def test_semantic_chunks_with_a_sentence_above_the_maximum(spark):
    from statwitness.operators.chunks import chunk_semantic

    rng = [("d", i, "x" * (1200 if i == 3 else 60), [1.0, 0.0]) for i in range(9)]
    rows = spark.createDataFrame(rng, "doc_id string, pos bigint, text string, embedding array<double>")
    a, b = (sorted(map(str, chunk_semantic(rows, block_rows=n).collect())) for n in (2, 4096))
    assert a == b and len(a) == 3
