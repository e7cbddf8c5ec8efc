"""The chunk index over new, changed, deleted and late extractions, in several runs from one checkpoint."""

import datetime as dt

import pytest

from statwitness.operators.chunks import explode_chunks
from statwitness.streaming import chunk_stream as S

SCHEMA = ("extraction_id string, headline_text string, headline_page int, paragraphs array<string>, extracted_table array<map<string,string>>, "
          "filters_applied map<string,array<string>>, columns_selected array<string>, ts timestamp, deleted boolean")


def version(i, at, text="text", page=1, deleted=False):
    return (i, f"Headline {i}", page, [text], [{"a": "1"}], {"sex": ["Boys"]}, ["a"], dt.datetime(2024, 1, 1, at), deleted)


class Index:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def arrive(self, *versions):
        self.spark.createDataFrame(list(versions), SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in")
        S.sync_index(stream, f"{self.folder}/index", f"{self.folder}/progress")

    def chunks(self, path="index"):
        return {r.chunk_id: r for r in S.read_index(self.spark, f"{self.folder}/{path}").collect()}

    def changes(self):
        log = self.spark.read.parquet(f"{self.folder}/index")
        last = log.agg({"batch": "max"}).first()[0]
        return sorted((r.op, r.chunk_id) for r in log.filter(f"batch = {last}").collect())

    def wanted(self, *versions):
        rows = self.spark.createDataFrame(list(versions), SCHEMA)
        return {r.chunk_id: r.text for r in explode_chunks(rows).collect()}


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, tmp_path)


def test_new_changed_deleted_and_late_versions(index):
    a, b = version("a", 1), version("b", 1)
    index.arrive(a, b)
    assert {k: r.text for k, r in index.chunks().items()} == index.wanted(a, b) and len(index.changes()) == 6
    # a change of the paragraphs touches one chunk of three; the same version again touches none
    a2 = version("a", 3, text="other text")
    index.arrive(a2, b)
    assert index.changes() == [("upsert", "a:0")]
    assert {k: r.text for k, r in index.chunks().items()} == index.wanted(a2, b)
    # deleted, and a version from before the deletion that comes late
    index.arrive(version("b", 5, deleted=True))
    assert index.changes() == [("delete", f"b:{i}") for i in range(3)] and set(index.chunks()) == {"a:0", "a:1", "a:2"}
    index.arrive(version("b", 4, text="late"), version("a", 2, text="late"))
    assert {k: r.text for k, r in index.chunks().items()} == index.wanted(a2)
    # comes back with a newer version
    b6 = version("b", 6)
    index.arrive(b6)
    assert {k: r.text for k, r in index.chunks().items()} == index.wanted(a2, b6)
    S.compact_index(index.spark, f"{index.folder}/index", f"{index.folder}/small")
    assert index.chunks("small").keys() == index.chunks().keys()


def test_versions_of_one_batch_and_equal_times(index):
    index.arrive(version("a", 2, text="two"), version("a", 1, text="one"), version("b", 1), version("b", 1, deleted=True), version("c", 1, page=None))
    got = index.chunks()
    assert "two" in got["a:0"].text and not any(k.startswith("b") for k in got) and got["c:0"].page is None
    index.arrive(version("c", 2, page=7))
    assert {r.page for k, r in index.chunks().items() if k.startswith("c")} == {7}
