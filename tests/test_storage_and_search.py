"""Storage, chunks, search and streams on small data, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statwitness.operators import chunks, mapping, retrieve as R
from statwitness.session import new_folder
from statwitness.sources import extractions as X, mappings as MP, tables


def test_save_load_list_delete(spark):
    path = new_folder(spark, "store")
    assert X.load_extractions(spark, path, ["nonexistent_doc"]).count() == 0
    df = lambda rows: spark.createDataFrame(rows, "doc_id string, data struct<headlines array<string>>")
    X.save_extractions(df([("test_doc", (["a"],)), ("test doc/with spaces", (["b"],)), ("doc_001", (["c"],))]), path, F.lit("2024-01-01"))
    X.save_extractions(df([("doc_001", (["new"],))]), path, F.lit("2024-01-02"))
    stored = X.load_extractions(spark, path)
    assert {r.safe_id for r in stored.collect()} == {"test_doc", "test_doc_with_spaces", "doc_001"}
    one = X.load_extractions(spark, path, ["doc_001"]).collect()
    assert len(one) == 1 and one[0].document == '{"doc_id":"doc_001","timestamp":"2024-01-02","version":"1.0","data":{"headlines":["new"]}}'
    assert X.load_extractions(spark, path, []).count() == 0
    listing = X.list_extractions(stored)
    assert {r.filename for r in listing.collect()} == {"test_doc.json", "test_doc_with_spaces.json", "doc_001.json"}
    assert X.storage_stats(listing).first().total_files == 3
    gone = spark.createDataFrame([("test doc/with spaces",), ("nope",)], "doc_id string")
    assert {r.doc_id: r.deleted for r in X.delete_extractions(spark, path, gone).collect()} == {"test doc/with spaces": True, "nope": False}
    assert {r.safe_id for r in X.load_extractions(spark, path).collect()} == {"test_doc", "doc_001"}
    assert X.delete_extractions(spark, path, gone).filter("deleted").count() == 0
    X.save_extractions(df([("test doc/with spaces", (["back"],))]), path, F.lit("2024-01-03"))
    assert X.load_extractions(spark, path).count() == 3
    X.compact_extractions(spark, path, f"{path}-compact")
    assert sorted(map(tuple, X.load_extractions(spark, f"{path}-compact").collect())) == sorted(map(tuple, X.load_extractions(spark, path).collect()))
    plan = X.list_extractions(X.load_extractions(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert "document" not in plan.split("Relation")[0]  # bodies are not carried


def test_save_without_envelope_and_file_listing(spark):
    path = new_folder(spark, "plain")
    df = spark.createDataFrame([("d", (["a"],))], "doc_id string, data struct<headlines array<string>>")
    X.save_extractions(df, path, F.lit("t"), include_metadata=False)
    assert X.load_extractions(spark, path).first().document == '{"headlines":["a"]}'
    folder = new_folder(spark, "files")
    df.select(F.to_json("data").alias("value")).coalesce(1).write.text(folder, lineSep="\n")
    assert X.list_files(spark, folder).count() == 0  # only .json files are listed


def test_mappings_missing_and_snapshot(spark):
    missing = MP.read_mappings(spark, new_folder(spark, "absent")).collect()
    assert len(missing) == 1 and missing[0].error.startswith("Mapping file not found")
    rows = spark.createDataFrame([("r.pdf", i, f"t{i}", 1, ["p"], ["a.csv"]) for i in range(1, 2502)],
                                 "pdf_filename string, headline_no int, headline_text string, headline_page int, paragraphs array<string>, csv_files array<string>")
    docs = MP.mapping_documents(rows, F.lit("2024-01-01"))
    path = new_folder(spark, "snap")
    MP.write_mappings(docs, path, snapshot=True)
    back = MP.read_mappings(spark, path)
    assert [r.n for r in back.select(F.size("mappings").alias("n")).collect()] == [2501]  # one document at any number
    assert mapping.explode_mapping(back).count() == 2501


def test_csv_tables(spark):
    folder = new_folder(spark, "csv") + "/t.csv"
    spark.createDataFrame([("1", 'a "quoted", b'), ("NA", "c"), ("x", None)], "n string, t string").coalesce(1).write.csv(folder, header=True, escape='"')
    got = {(r.column_name, r.value) for r in tables.read_data_tables(spark, [folder]).collect()}
    assert got == {("n", "1"), ("n", None), ("n", "x"), ("t", 'a "quoted", b'), ("t", "c"), ("t", None)}


def brute_chunks(sentences):
    out, state, before = [], 0, None
    for text, e in sentences:
        n = np.linalg.norm(e) * (np.linalg.norm(before) if before is not None else 0)
        low = (np.dot(e, before) / n if n else 0.0) < 0.7
        if state == 0 or (low and state >= 100) or state + len(text) > 1000:
            out.append([]), (state := len(text))
        else:
            state += len(text)
        out[-1].append(text)
        before = e
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("block_rows", [4, 7, 4096])
def test_semantic_chunks_in_blocks(spark, block_rows):
    rnd = random.Random(5)
    docs = {d: [("s" * rnd.choice([1, 20, 60, 150, 400, 1000]), [float(rnd.random() < 0.5), float(rnd.random() < 0.8)]) for _ in range(rnd.choice([1, 4, 40, 90]))] for d in range(6)}
    docs[9] = [("same line", [1.0, 1.0])] * 300  # no place where a break is certain
    rows = [(d, i, t, e) for d, s in docs.items() for i, (t, e) in enumerate(s)]
    df = spark.createDataFrame(rows, "doc_id bigint, pos bigint, text string, embedding array<double>")
    got = {}
    for r in chunks.chunk_semantic(df, block_rows).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {d: brute_chunks(s) for d, s in docs.items()}


def test_fixed_chunks_restore_text(spark):
    texts = ["", "x", "é" * 399, "ab" * 250, "".join(chr(97 + i % 26) for i in range(1001)), "\U0001f600" * 905, "a\nb" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in chunks.chunk_fixed(df, ["id"], "text").orderBy("id", "chunk_no").collect():
        assert len(r.chunk) <= 500
        got[r.id] = r.chunk if r.chunk_no == 0 else got[r.id] + r.chunk[100:]
    assert got == {i: t for i, t in enumerate(texts) if t}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 3, size=(400, 6)).astype(float)  # many equal distances and copies
    q = rng.integers(0, 3, size=(23, 6)).astype(float)
    vectors = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "id bigint, vector array<float>, filter_value bigint").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(q)], "query_id bigint, vector array<double>, filter_value bigint")

    def brute(filtered):
        out = {}
        for i, x in enumerate(q):
            d = ((v - x) ** 2).sum(axis=1)
            ids = [j for j in range(len(v)) if not filtered or j % 4 == i % 4]
            out[i] = sorted(ids, key=lambda j: (d[j], j))[:5]
        return out

    def found(hits):
        out = {}
        for r in hits.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.id)
        return out

    assert found(R.top_k(queries, vectors)) == brute(False)
    assert found(R.top_k(queries, vectors, block_rows=6)) == brute(False)  # several scans
    assert found(R.filter_hits(queries, vectors)) == brute(True)
    assert R.top_k(queries.limit(0), vectors).count() == 0


def test_suggestions_against_all_pairs(spark):
    rnd = random.Random(1)
    words = ["rate", "of", "the", "score", "boys", "girls", "year"]
    heads = [(i, " ".join(rnd.sample(words, rnd.randint(1, 6)))) for i in range(60)]
    cols = [(f"c{i:02}", "_".join(rnd.sample(words, rnd.randint(1, 6)))) for i in range(40)]
    out = mapping.suggest_mappings(spark.createDataFrame(heads, "headline_id int, text string"), spark.createDataFrame(cols, "column_id string, text string").withColumn("text", F.replace("text", F.lit("_"), F.lit(" "))))
    want = set()
    for i, t in heads:
        a = set(t.split())
        sims = sorted(((-len(a & set(c.split("_"))) / (len(a) * len(c.split("_"))) ** 0.5, cid) for cid, c in cols))
        want |= {(i, cid) for s, cid in sims[:3] if -s >= 0.8 - 1e-12}
    assert {(r.headline_id, r.column_id) for r in out.collect()} == want


def test_embed_is_unit_length_and_repeatable(spark):
    df = spark.createDataFrame([(1, "average score for girls"), (2, "average score for boys"), (3, "")], "id int, text string")
    a = {r.id: r.embedding for r in R.embed(df, dimension=64).collect()}
    b = {r.id: r.embedding for r in R.embed(df.repartition(3), dimension=64).collect()}
    assert a == b and len(a[1]) == 64 and abs(np.linalg.norm(a[1]) - 1) < 1e-5 and np.linalg.norm(a[3]) == 0


def test_csv_values_with_line_breaks(spark, tmp_path):
    from statwitness.sources.tables import read_data_tables

    (tmp_path / "t.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    cells = {(r.column_name, r.value) for r in read_data_tables(spark, [str(tmp_path / "t.csv")]).collect()}
    assert cells == {("a", "1"), ("b", "two\nlines"), ("a", "2"), ("b", "x")}


def test_glyphs_keep_text_ids(spark, tmp_path):
    from statwitness.sources.glyphs import read_glyphs

    (tmp_path / "g.json").write_text('{"doc_id": "report a", "page": 1, "glyph_no": 1, "text": "x", "size": 9.0, "font": "f", "top": 1.0, "x0": 0.0}\n')
    assert [r.doc_id for r in read_glyphs(spark, str(tmp_path / "g.json"), "json").collect()] == ["report a"]


def test_stream_over_a_folder_of_part_files(spark):
    from statwitness.plans import all_queries

    root = new_folder(spark, "folder-tables")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{root}/events.parquet")
    build = all_queries()["stream_agreement"].build
    folder, single = (sorted(map(tuple, build(spark, d).collect())) for d in (root, "/root/testdata/sf0.001"))
    assert folder == single and folder


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from statwitness.session import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
