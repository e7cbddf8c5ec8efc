"""Nearest neighbours by pivots, one CSV scan, phrase index, stated amounts, spelling variants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statwitness.operators import extract as E, neighbours as N, style as Y, verify as V
from statwitness.operators.phrases import phrase_hits
from statwitness.sources.tables import read_data_tables


def vectors_of(spark, v, name="id", parts=4):
    return spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], f"{name} bigint, vector array<double>, filter_value bigint").repartition(parts)


def brute(q, v, k, filtered=False):
    out = {}
    for i, x in enumerate(q):
        d = np.round(((v - x) ** 2).sum(axis=1), 9)
        out[i] = sorted((d[j], j) for j in range(len(v)) if not filtered or j % 3 == i % 3)[:k]
    return out


def found(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.distance, r.id))
    return out


@pytest.mark.parametrize("pivots, block_rows, pack_rows", [(1, 7, 5), (9, 11, 3), (64, 4096, 2048)])
def test_nearest_is_exact_in_clusters_and_copies(spark, pivots, block_rows, pack_rows):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(5, 8)) * 9
    v = np.concatenate([centers[rng.integers(0, 5, 150)] + rng.normal(size=(150, 8)), np.tile(centers[0], (120, 1))])  # one point holds nearly half
    q = np.concatenate([centers + 0.1, rng.normal(size=(4, 8)) * 20, centers[:1]])
    for filtered in (False, True):
        got = found(N.nearest(vectors_of(spark, q, "query_id", 2), vectors_of(spark, v), 6, filtered, pivots, block_rows, pack_rows))
        want = brute(q, v, 6, filtered)
        assert {i: [j for _, j in g] for i, g in got.items()} == {i: [j for _, j in w] for i, w in want.items()}


def test_nearest_visits_few_partitions(spark):
    """Far clusters are not visited: the cells that queries meet hold a small part of the vectors."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(16, 6)) * 100
    v = np.concatenate([c + rng.normal(size=(40, 6)) for c in centers])
    parts = N._partitioned(vectors_of(spark, v).select("id", F.lit(0).alias("part"), "vector"), N.choose_pivots(vectors_of(spark, v), 32))
    got = found(N.nearest(vectors_of(spark, centers[:2], "query_id", 1), vectors_of(spark, v), 3, pivots=32))
    assert {j // 40 for g in got.values() for _, j in g} == {0, 1} and parts.select("pivot").distinct().count() <= 32


def test_nearest_edge_cases(spark):
    v = vectors_of(spark, np.eye(3))
    q = vectors_of(spark, np.eye(3)[:1], "query_id")
    assert found(N.nearest(q, v.limit(0), 2)) == {} and found(N.nearest(q.limit(0), v, 2)) == {}
    assert [j for _, j in found(N.nearest(q, v, 10))[0]] == [0, 1, 2]  # fewer than k
    nulls = v.unionByName(spark.createDataFrame([(9, None, 0)], v.schema))
    assert [j for _, j in found(N.nearest(q, nulls, 10))[0]] == [0, 1, 2]
    assert found(N.nearest(q.withColumn("filter_value", F.lit(77)), v, 2, filtered=True)) == {}


def test_many_tables_of_different_columns_in_one_scan(spark, tmp_path):
    want = set()
    for i in range(300):
        names = [f"c{j}" for j in range(1 + i % 5)]
        rows = [[f"{i}.{j}.{r}" for j in range(len(names))] for r in range(2)]
        (tmp_path / f"t{i}.csv").write_text("\n".join(",".join(x) for x in [names, *rows]) + "\n")
        want |= {(f"t{i}", j + 1, n, row[j]) for row in rows for j, n in enumerate(names)}
    cells = read_data_tables(spark, [str(tmp_path / f"t{i}.csv") for i in range(300)])
    plan = cells._jdf.queryExecution().toString()
    assert "Union" not in plan
    assert {tuple(r) for r in cells.collect()} == want


def test_awkward_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y, z",,x\n1,"two\nlines, ""quoted""",,"say ""hi"""\n\n"",NA,4\n5,"",6,7,8\n')
    (tmp_path / "one.csv").write_text('only\n"a, b"\nc\n')
    (tmp_path / "empty.csv").write_text("p,q\n")
    folder = tmp_path / "parts"
    spark.createDataFrame([(i, f"v {i}") for i in range(20)], "k int, v string").repartition(4).write.csv(str(folder), header=True)
    paths = [str(tmp_path / n) for n in ("a.csv", "one.csv", "empty.csv")] + [str(folder)]
    for multi_line in (True, False):
        rows = read_data_tables(spark, paths, multi_line).collect()
        by = {}
        for r in rows:
            by.setdefault((r.table_id, r.col_no, r.column_name), []).append(r.value)
        assert sorted(by[("one", 1, "only")]) == ["a, b", "c"] and not any(k[0] == "empty" for k in by)
        assert sorted(by[("parts", 1, "k")], key=int) == [str(i) for i in range(20)] and len(by[("parts", 2, "v")]) == 20
        if multi_line:
            shown = lambda k: sorted(map(str, by[k]))
            assert shown(("a", 1, "x0")) == ["1", "5", "None"] and shown(("a", 2, "y, z")) == ["None", "None", 'two\nlines, "quoted"']
            assert shown(("a", 3, "_c2")) == ["4", "6", "None"] and shown(("a", 4, "x3")) == ["7", "None", 'say "hi"']


def test_phrases_against_all_pairs(spark):
    rng = random.Random(6)
    words = ["score", "scores", "average", "av", "a", "the", "check-in", "Boys", "c", "rate_1"]
    texts = [(i, f"t{i % 3}", " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(120)]
    phrases = [(f"t{i % 3}", " ".join(rng.choices(words, k=rng.randint(1, 3)))[rng.randint(0, 2):]) for i in range(60)] + [("t0", "a"), ("t1", "-"), ("t9", "score")]
    df = spark.createDataFrame(texts, "id int, table_id string, text string")
    sought = spark.createDataFrame(phrases, "table_id string, phrase string").withColumn("hit", F.col("phrase"))
    import re

    blank = lambda s: " " + re.sub(r"[^\w]+", " ", s.lower()).strip() + " "
    for whole in (False, True):
        got = {(r.id, r.table_id, r.hit) for r in phrase_hits(df, sought, ["id"], "text", whole).collect()}
        want = {(i, t, p) for i, t, x in texts for u, p in phrases if t == u and (blank(p) in blank(x) and blank(p).strip() if whole else p.lower() in x.lower())}
        assert got == want


def test_no_vocabulary_in_the_text_rows(spark):
    heads = spark.createDataFrame([("h", "t", "average score")], "headline_id string, table_id string, paragraph string")
    phrases = spark.createDataFrame([("average score", "m")], "phrase string, metric string")
    columns = spark.createDataFrame([("t", "m")], "table_id string, column_name string")
    assert "collect_set" not in E.match_metrics(heads, phrases, columns)._jdf.queryExecution().toString()


@pytest.mark.parametrize("direction, amount, unit, decimals, status", [
    ("higher", 0.4, "points", 1, "PASS"),  # 20.04 - 19.56 is 0.48, but 20.0 - 19.6 is 0.4
    ("higher", 0.6, "points", 1, "PASS"), ("higher", 0.7, "points", 1, "FAIL"), ("lower", 0.4, "points", 1, "FAIL"),
    ("higher", None, "points", None, "PASS"), ("higher", 2.0, "percent", 0, "PASS"), ("higher", 4.0, "percent", 0, "FAIL"), ("equal", None, "points", None, "FAIL")])
def test_stated_differences(spark, direction, amount, unit, decimals, status):
    table = spark.createDataFrame([("k", "Boys", 20.04), ("k", "Girls", 19.56)], "key string, sex string, v double")
    claim = spark.createDataFrame([("k", "Boys", "Girls", direction, amount, unit, decimals)], "key string, group_a string, group_b string, direction string, amount double, unit string, decimals int")
    assert V.verify_difference(claim, table, ["key"], "sex", F.col("v"), mean_decimals=1).first().status == status


def test_means_and_shares_of_rounded_figures(spark):
    table = spark.createDataFrame([("k", 19.6, 3.0), ("k", 20.1, 7.0)], "key string, v double, w double")
    claim = lambda x, d: spark.createDataFrame([("k", x, d)], "key string, stated double, decimals int")
    assert V.verify_mean(claim(19.89, 2), table, ["key"], F.col("v")).first().status == "FAIL"
    assert V.verify_mean(claim(19.89, 2), table, ["key"], F.col("v"), table_decimals=1).first().status == "PASS"
    part = F.when(F.col("w") < 5, F.col("w"))
    assert V.verify_percentage(claim(33.0, 0), table, ["key"], part, F.col("w")).first().status == "FAIL"
    assert V.verify_percentage(claim(33.0, 0), table, ["key"], part, F.col("w"), table_decimals=0).first().status == "PASS"


def test_cell_evidence_and_row(spark):
    ext = spark.createDataFrame([("e", ["First 1.0. Girls scored 19.6 then.", "Again 19.6."], [{"score_average": "19.6", "sex": "Girls"}])],
                                "extraction_id string, paragraphs array<string>, extracted_table array<map<string,string>>")
    for mode in ("number", "substring"):
        (r,) = V.verify_cells(ext, mode).collect()
        assert (r.verified, r.evidence, r.row_filters) == (True, "Girls scored 19.6 then.", {"sex": "Girls"})


def test_variants_without_a_list(spark):
    text = "The dataset is large. A data set, the data-set and the dataset; a data, set. Colour and colour but color. Pupils or pupil. Attainment and attainmnet."
    got = {(r.kind, r.term, r.variant, r.n_term, r.n_variant) for r in Y.term_variants(spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, t string"), ["d"], "t", 5).collect()}
    assert got == {("spacing", "dataset", "data set", 2, 1), ("spacing", "dataset", "data-set", 2, 1), ("spelling", "colour", "color", 2, 1)}


def test_united_profiles(spark):
    from statwitness.operators import sketches as S

    rng = random.Random(8)
    cells = [("t", 1, "c", v if v != "v0" else None) for v in rng.choices([f"v{i}" for i in range(400)], weights=[1 / (i + 1) for i in range(400)], k=6000)]
    df = spark.createDataFrame([(i % 5, *c) for i, c in enumerate(cells)], "part int, table_id string, col_no int, column_name string, value string")
    columns, values = S.summarise(df, F.col("part"), listed=30)
    one = S.united_columns(columns).first()
    true = {}
    for *_, v in cells:
        true[v] = true.get(v, 0) + 1
    assert (one.n_rows, one.n_non_null) == (6000, 6000 - true[None]) and abs(one.n_distinct - (len(true) - 1)) <= (len(true) - 1) * S.distinct_error() + 1
    for r in S.united_values(columns, values).collect():
        assert r.n_low <= true[r.value] <= r.n_high
    del true[None]
    best = sorted(true, key=lambda v: (-true[v], v))
    got = S.frequent_values(columns, values, 3).collect()
    assert {r.value for r in got if r.certain} <= set(best[:3]) and got[0].certain
