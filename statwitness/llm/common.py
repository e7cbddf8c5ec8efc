"""Helpers the operators share: words, shingles, blocks of Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from statwitness.session import materialise

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
NON_SPACE = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A column by its exact name, also where the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_column(name: str) -> Column:
    """Null counts as empty."""
    return F.coalesce(column(name).cast("string"), F.lit(""))


def row_keys(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, text of every row, where id tells rows of different texts apart though they share their id or have none. It is
    ordered as the ids are, those that are null last."""
    return docs.select(F.struct(column(doc_id).isNull().alias("missing"), column(doc_id).alias("id"), _text_digest(text).alias("digest")).alias("id"),
                       column(text).cast("string").alias("text"))


def _text_digest(text: str) -> Column:
    return F.unhex(F.md5(column(text).cast("string")))


def without(docs: DataFrame, gone: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows of ``docs`` whose ``row_keys`` id is not among the column ``id`` of ``gone``, with all their columns."""
    gone = gone.select(F.col("id.id").alias("gone_id"), F.col("id.digest").alias("gone_digest")).distinct()
    return docs.join(gone, column(doc_id).eqNullSafe(F.col("gone_id")) & _text_digest(text).eqNullSafe(F.col("gone_digest")), "left_anti")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


PART_BYTES = 4 << 20  # of a batch that are Python objects at once


def map_rows(df: DataFrame, fn: Callable[[list], list], columns: list[str], schema: str) -> DataFrame:
    """``fn`` turns the lists of ``columns`` of a part of an Arrow batch into lists of the output columns, row by row."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                out = fn(*[part.column(c).to_pylist() for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, target.types)], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def parts_of(batch: pa.RecordBatch, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes, at least one row each."""
    rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


# --- hashing words and shingles ---------------------------------------------------------------

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered; the memory is emptied when it grows past its bound."""

    BOUND = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of the whole text. A text of fewer words has one
    shingle, its whole word sequence; a text without words has none."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = word_hashes(ws)
    n = min(k, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = mix64(acc * _M1 + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


__all__ = ["LOWER", "NON_SPACE", "SPACE", "column", "map_rows", "materialise", "mix64", "row_keys", "shingle_set", "text_column", "without", "word_hashes", "words"]
