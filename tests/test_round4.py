"""What grows with the texts takes no way through the driver, however small its file seems."""

import os
import random

from pyspark.sql import functions as F

from statwitness.operators import claims as C, extract as E, sketches as K, structure as S, style as Y
from statwitness.operators.phrases import phrase_hits
from statwitness.plans import mapping_queries, structure_queries as Q
from statwitness.plans.registry import REGISTRY
from statwitness.sources.tables import read_data_tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_remainders_of_words_are_not_broadcast(spark):
    said = spark.createDataFrame([(1, "organise organize colour"), (1, "organize data-set dataset dataset"), (2, "organise")], "conv_id bigint, text string")
    found = Y.term_variants(said, ["conv_id"], "text")
    assert "Broadcast" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [
        (1, "spacing", "dataset", "data-set", 2, 1), (1, "spelling", "organize", "organise", 2, 1)]


def test_parts_of_texts_are_not_broadcast(spark):
    texts = spark.createDataFrame([(1, "t", "The north and the south"), (2, "t", "South of it"), (3, "u", "north")], "headline_id bigint, table_id string, paragraph string")
    phrases = spark.createDataFrame([("t", "north", "N"), ("t", "south", "S")], "table_id string, phrase string, hit string")
    for whole in (True, False):
        found = phrase_hits(texts, phrases, ["headline_id"], "paragraph", whole)
        assert "Broadcast" not in plan(found)
        assert sorted(map(tuple, found.collect())) == [(1, "t", "N"), (1, "t", "S"), (2, "t", "S")]


def test_headlines_meet_their_tables_by_a_shuffled_join(spark):
    specs = spark.createDataFrame(
        [(h, "t", ["m"], ["c"], [["x"], ["y"]], [], None) for h in (1, 2)],
        "headline_id bigint, table_id string, metrics array<string>, columns array<string>, keys array<array<string>>, "
        "scope array<struct<column_name string, aggregate_value string>>, error string")
    data = spark.createDataFrame([("t", "1", {"c": "x", "m": "1", "p": "2020"}), ("t", "2", {"c": "y", "m": "2", "p": "2020"})],
                                 "table_id string, row_no string, values map<string,string>")
    found = E.extract_tables(specs, data, spark.createDataFrame([], "metric string, label string"), "p")
    assert "BroadcastHashJoin [spec_id" not in plan(found) and "SortMergeJoin [spec_id" in plan(found)
    assert sorted((r["headline_id"], r["cells"]["x"], r["cells"]["y"]) for r in found.collect()) == [(1, "1", "2"), (2, "1", "2")]


class Documents:
    """Reads one made-up table."""

    def __init__(self, spark, rows):
        self.spark, self.rows = spark, rows

    def __call__(self, table):
        return self.spark.createDataFrame(self.rows, "doc_id bigint, text string")


def test_glyphs_are_put_together_where_they_are(spark):
    load = Documents(spark, [(1, "Key Findings here\nsome other words"), (1, "Key Findings here"), (None, "one line"), (2, None)])
    lines = S.line_spacing(S.glyphs_to_lines(Q.glyphs(load)))
    assert "ENSURE_REQUIREMENTS" not in plan(lines) and "ENSURE_REQUIREMENTS" not in plan(Q.page_texts(load))
    assert {(r["doc_id"], r["text"]) for r in lines.collect()} == {(1, "Key Key Findings Findings here here"), (1, "some other words"), (None, "one line")}


def test_tasks_follow_the_amount_of_text(spark):
    rows = spark.createDataFrame([(1, 1)], "doc_id bigint, page int")
    assert S.spread_pages(rows, 0).rdd.getNumPartitions() == 4
    assert S.spread_pages(rows, 9 * S.CHARS_PER_TASK + 1).rdd.getNumPartitions() == 10


def test_places_against_a_search_of_every_page(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "ab", "Key", "part", "of the", "x y z", "Findings"])
    pages = [(d, n, " ".join(word() for _ in range(rng.randint(0, 12)))) for d in range(6) for n in range(1, 5)]
    phrases = sorted({(d, " ".join(word() for _ in range(rng.randint(1, 3)))) for d in range(4) for _ in range(8)})
    found = S.phrase_places(spark.createDataFrame(phrases, "doc_id bigint, phrase string"), spark.createDataFrame(pages, "doc_id bigint, n bigint, page_text string"))
    assert sorted(map(tuple, found.collect())) == sorted((d, n, p, t.find(p) + 1) for d, n, t in pages for e, p in phrases if d == e and p in t)


def test_summaries_count_their_cells_once(spark):
    cells = spark.createDataFrame([("t", 1, "c", v) for v in ("1", "1", "x", None)], "table_id string, col_no int, column_name string, value string")
    columns, values = K.summarise(cells, F.lit(0), listed=1)
    assert "ExistingRDD" not in plan(columns) + plan(values) and "LocalTableScan" not in plan(columns) + plan(values)
    assert [(r.n_rows, r.n_non_null, r.n_numeric, r.left_out) for r in columns.collect()] == [(4, 3, 2, 1)]
    assert [(r.value, r.n, r.left_out) for r in values.collect()] == [("1", 2, 1)]


def test_written_texts_are_read_in_files_of_a_bounded_number(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, f"text\n{i}") for i in range(5)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 2.0, "a")], "o_orderkey bigint, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    paths = []
    monkeypatch.setattr(mapping_queries, "TEXTS_PER_FILE", 2)
    monkeypatch.setattr(mapping_queries, "read_data_tables", lambda s, p: paths.extend(p) or read_data_tables(s, p))
    rows = REGISTRY["read_data_tables"].build(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows if r["table_id"] == "documents"} == {("documents", "doc_id", 5, 5, 5), ("documents", "text", 5, 5, 5)}
    assert sum(f.endswith(".csv") for f in os.listdir(paths[1].removeprefix("file:"))) == 3


def test_mentions_are_made_words_once_and_not_per_number(spark):
    """No mention is cleaned of its marks behind the join, where each number of a sentence meets it; marks, repeated and missing mentions as before."""
    entries = "array<struct<name string, mention string>>"
    vocabulary = spark.createDataFrame([("e", [("p", "average price"), ("u", "urgent"), ("n", None)], [("2023-24", "2023-24"), ("2022", "2022"), ("2022", "2022")]), ("f", None, [])],
                                       f"extraction_id string, metrics {entries}, values {entries}")
    sentences = spark.createDataFrame([("e", 0, "In 2022 the average-price was 5.5 while later urgent 7%."), ("e", 1, "In 2023/24: urgent 8, average price 9."), ("f", 0, "Urgent 3.")],
                                      "extraction_id string, sentence_no int, sentence string")
    out = C.link_claims(sentences, vocabulary, [])
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "_nearest" not in above and "regexp_replace(lambda" not in above, above
    got = {(r.extraction_id, r.raw): (r.metric, r.filter_value) for r in out.collect()}
    assert got[("e", "5.5")] == ("p", "2022") and got[("e", "7%")] == ("u", "2022") and got[("e", "8")] == ("u", "2023-24")
    assert got[("f", "3")] == (None, None)
