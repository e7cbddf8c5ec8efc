"""Registered queries against their SQL. A sample by default; ALL_QUERIES=1 runs every one."""

import os

import pytest
from oracle import compare, connect

from statwitness.plans import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["column_stats", "get_sample_values", "pivot_first", "extract_tables", "filters_applied", "glyphs_to_lines",
          "extract_headlines", "parent_headline", "map_headlines", "suggest_mappings", "save_extractions", "export_results",
          "link_claims", "verify_claims", "style_report", "quality_score", "chunk_by_headline", "chunk_semantic", "top_k",
          "explode_chunks", "weighted_agreement", "impact", "stream_agreement", "stream_chunks"]
NAMES = sorted(all_queries()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    q = all_queries()[name]
    assert compare(spark, con, SF, name, q.build, q.sql) == []


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 110
