"""The registered queries on the smallest tables: against their SQL, or against plain versions; and the pipeline stage by stage."""

import collections
import re
import zlib

import duckdb
import pytest
from oracle import compare, connect

from statwitness.llm import minhash
from statwitness.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def rows(con, sql):
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], SQL[name]) == []


def test_thirteen_queries(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_classifiers_on_held_out_rows(spark, con):
    lang = {r.doc_id: r for r in QUERIES["op7_language"](spark, SF).collect()}
    truth = rows(con, "select doc_id, lang from documents")
    assert len(lang) == len(truth)
    held = [(d, v) for d, v in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert {d for d, r in lang.items() if r.held_out} == {d for d, _ in held}
    assert sum(lang[d].lang_pred == v for d, v in held) >= 0.9 * len(held)
    tox = QUERIES["op5_toxicity"](spark, SF).collect()
    assert len(tox) == len(truth) and all((r.predicted == 1) == (r.score >= 0.5) for r in tox)
    assert {r.doc_id for r in tox if r.held_out} == {d for d, _ in truth if zlib.crc32(str(d).encode()) % 5 == 0}


def test_base_secrets(spark, con):
    got = {r.doc_id: r for r in QUERIES["op2_secrets"](spark, SF).collect()}
    for d, t in rows(con, "select doc_id, coalesce(text, '') from documents"):
        hexes = [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        keys = [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        assert (got[d].n_hex, got[d].n_access) == (len(hexes), len(keys))


def test_pipeline_stages(spark, con):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        before = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
        out = P.materialise(stage(spark, docs, SF))
        after = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        assert set(after) <= set(before), name
        if name != "token_files":
            assert out.columns == columns
        if name in ("toxicity", "decontamination"):
            assert len(after) >= 0.7 * len(before) and all(before[d] == n for d, n in after.items()), name
        if name == "near_duplicates":
            again = minhash.near_duplicates(out).documents
            assert again.filter("not kept").count() == 0
        if name == "token_files":
            assert after == before and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        docs = out
    assert duckdb.__version__
