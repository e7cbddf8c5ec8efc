"""Spelling variant grouping by permuterm rotations.

The vocabulary is counted from whole texts. Every word is marked with a terminator and rotated: ``a|b`` gives ``b$a``. Words that
differ in one code point, at the same place, have rotations that are equal but for the last code point; a word that
lacks that code point has the rotation without it. So each rotation is sorted twice, whole and without its last code point
(the edited one), and the members of a run of equal prefixes are near each other: at most one whole rotation, and one
for every letter that fits the gap. A run is no longer than the alphabet plus one, however the words are spread. Runs
are scanned in order of frequency: each member learns how many others there are and the best of them; pairs are never
written. A deletion inside a doubled letter is met in several runs and counts in the first.

A word's form is its near word of largest count, if that is at least ``factor`` times its own; counts grow along a chain of
forms, so the roots come from pointer doubling in a few rounds over written tables, in which words that have
arrived take no further part.

Defined results: null text has no words; a null id counts as empty text in the hash that perturbs spellings; repeated rows count
each; a word of any length is a word; ties between near words go to the smallest in code-point order; a table without words gives no
rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from statwitness.llm.common import column, materialise

MARK = "$"  # no letter, so it cannot occur in a word
FLUSH = 300_000  # different words that a task holds before it sends its counts
# Latin-1 bytes: A-Z to a-z; a-z and C0-FF stay; the rest separates runs
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def perturbed(doc_id: str, run: bytes, one_in: int) -> bytes:
    """The run (Latin-1), without one code point where the hash of id and run says so."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), crc32(f"{doc_id}:".encode("utf-8", "surrogatepass")))
    if one_in and h % one_in == 0:
        at = h % len(run)
        return run[:at] + run[at + 1:]
    return run


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, one_in: int = 97, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: runs of Latin letters in lower case (A-Z only), long and frequent enough. One spelling in ``one_in`` per
    document loses a code point (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter((t or "").encode("latin-1", "replace").translate(_RUNS).split()).items():
                    word = perturbed(i, word, one_in)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= FLUSH:
                    yield counted()
        yield counted()

    rows = docs.select(F.coalesce(column(doc_id).cast("string"), F.lit("")).alias("id"), column(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def rotations(words: DataFrame) -> DataFrame:
    """word, n, prefix, whole, counted: every rotation once whole and once without its last letter. ``counted`` is false where
    the letter left out repeats the one before it, so that its pair with the shorter word is found elsewhere."""
    length = F.length("word")
    at = words.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("at"))
    head, tail = F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 1, length)
    rotated = at.select("word", "n", "at", F.concat(tail, F.lit(MARK), head).alias("rotation"))
    # the rotation that starts after letter ``at`` ends with it; the one at 0 ends with the mark
    left_out, earlier = F.substring("word", F.col("at"), F.lit(1)), F.substring("word", F.col("at") - 1, F.lit(1))
    shorter = F.struct(F.substring("rotation", F.lit(1), length).alias("prefix"), F.lit(False).alias("whole"), ((F.col("at") == 1) | (left_out != earlier)).alias("counted"))
    full = F.struct(F.col("rotation").alias("prefix"), F.lit(True).alias("whole"), F.lit(True).alias("counted"))
    return rotated.select("word", "n", F.explode(F.when(F.col("at") > 0, F.array(full, shorter)).otherwise(F.array(full))).alias("r")).select("word", "n", "r.*")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best (n, word of the near word of largest count; null without one): a row per word."""
    run = W.partitionBy("prefix").orderBy(F.desc("n"), "word")
    every = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("down"), F.col("word").alias("word"))
    scanned = rotations(words).withColumns({
        "members": F.count("*").over(every), "shorts": F.count_if("whole").over(every), "links": F.count_if(~F.col("whole") & F.col("counted")).over(every),
        "place": F.row_number().over(run), "first": F.first(one).over(every), "next": F.lead(one).over(run)})
    found = scanned.filter(F.col("members") > 1).select(
        "word", "n",
        F.when(F.col("whole"), F.col("links")).otherwise(F.col("members") - F.col("shorts") - 1 + F.when(F.col("counted"), F.col("shorts")).otherwise(0)).alias("near"),
        F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("first")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("bigint").alias("near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    return found.unionByName(alone).groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form (form never null): the last word of each chain of forms."""
    table = materialise(forms.select("word", F.col("form").alias("to"), F.lit(False).alias("done")))
    while table.filter(~F.col("done")).limit(1).count():
        going = table.filter(~F.col("done")).alias("a")
        step = going.join(table.alias("b"), F.col("a.to") == F.col("b.word"), "left").select(
            "a.word", F.coalesce("b.to", "a.to").alias("to"), F.coalesce("b.done", F.lit(True)).alias("done"))
        table = materialise(step.unionByName(table.filter("done")))
    return table.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame, factor: int = 2, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word of the vocabulary."""
    near = near_words(materialise(count_words(docs, **options)))
    is_form = -F.col("best.down") >= factor * F.col("n")
    judged = materialise(near.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.down")).alias("form_n")))
    chained = judged.filter("form is not null").join(roots(judged.filter("form is not null")), "word")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return chained.select(*columns).unionByName(judged.filter("form is null").withColumn("root", F.col("word")).select(*columns))


SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) r(i))),
runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
    FROM documents) GROUP BY ALL),
b AS (
  SELECT *, doc_id::VARCHAR || ':' || w AS k FROM runs),
h AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(k)::BIGINT), lambda i: ('0x' || substr(hex(encode(k)), (2 * i + 1)::INT, 2))::BIGINT)),
                               lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) AS h FROM b, tab),
p AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM p WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM v, unnest(range(1, length(word) + 1)) u(i)),
pairs AS (
  SELECT DISTINCT a, b, bn FROM (
    SELECT x.word AS a, y.word AS b, y.n AS bn FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
    UNION ALL SELECT x.word, y.word, y.n FROM cut x JOIN v y ON x.rest = y.word
    UNION ALL SELECT y.word, x.word, x.n FROM cut x JOIN v y ON x.rest = y.word)),
best AS (
  SELECT a, count(*) AS n_near, arg_min(b, (-bn, b)) AS b, max(bn) AS bn FROM pairs GROUP BY a),
f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n
  FROM v LEFT JOIN best ON a = word),
chain AS (
  SELECT word, word AS at, 0 AS step FROM f
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(c.at, c.step) FROM chain c WHERE c.word = f.word) AS root, n, n_near, form_n FROM f
"""
