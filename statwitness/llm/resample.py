"""Target-distribution importance resampling: draw the documents that look most like a target corpus.

Features are runs of one to three words, hashed into ``BUCKETS`` buckets. Two counts per bucket, one over the documents and one
over the target, give a gain per bucket; a document's weight is the sum of the gains of its features, looked up in one array of
``BUCKETS`` numbers, the only thing that is broadcast. Weight plus Gumbel noise from a hash of the id is the score, and
the highest scores are a weighted draw without replacement.

The draw is a distributed quickselect: rows are ordered by a composite key (score down, id up, then what tells repeated rows
apart); each round picks ``PIVOTS`` random keys among the candidates, counts the candidates below, equal to and
between them, and keeps those between the two neighbours of the k-th key, until a pivot is the k-th key itself. Candidates
shrink by about ``PIVOTS`` each round and are written each time, so all rounds together read little more than one pass. Only the winners
are sorted: by ranges of the key, numbered inside each range, with the sizes of the ranges before added.

Defined results: null text has no words, no features and weight 0; a null id hashes as empty text and sorts last among
equal scores; repeated rows are rows of their own, drawn and ranked each; documents with fewer than ``min_words`` words are scored but
never drawn; an empty target or table gives weights from the smoothing alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from statwitness.llm.common import column, map_rows, materialise

BUCKETS = 10_000
PIVOTS = 15
PIECE = 1 << 20
# A-Z to a-z; digits, a-z and all bytes of other characters stay; the rest separates words
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, a bounded list at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def feature_buckets(words: list[bytes], known: int, buckets: int) -> np.ndarray:
    """Buckets of the runs of one to three words that end after the first ``known`` words."""
    one = list(map(crc32, words))
    spaced = [b" " + w for w in words]
    two = list(map(crc32, spaced[1:], one))
    three = list(map(crc32, spaced[2:], two))
    hashes = one[known:] + two[max(known - 1, 0):] + three[max(known - 2, 0):]
    return np.fromiter(hashes, np.int64, len(hashes)) % buckets


def bucket_pieces(text: str | None, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of the text: number of new words, buckets of the features that end in it."""
    carry: list[bytes] = []
    for words in word_pieces(text):
        held = carry + words
        yield len(words), feature_buckets(held, len(carry), buckets)
        carry = held[-2:]


def bucket_counts(texts: DataFrame, text: str, buckets: int) -> DataFrame:
    """bucket, n: features of all texts. Each task sends one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for _, found in bucket_pieces(t, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    counted = texts.select(column(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, an array of ``buckets`` whole numbers."""
    s, t = bucket_counts(docs, text, buckets).withColumnRenamed("n", "s"), bucket_counts(target, target_text, buckets).withColumnRenamed("n", "t")
    counts = np.zeros((2, buckets))
    for r in s.join(t, "bucket", "full").fillna(0, ["s", "t"]).collect():  # ``buckets`` rows at most
        counts[:, r["bucket"]] = r["s"], r["t"]
    (s_of, t_of), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(1000 * np.log((t_of + 1) * (all_s + buckets) / ((s_of + 1) * (all_t + buckets)))).astype(np.int64)


def gumbel_noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, fixed by the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", doc_id: str = "doc_id", seed: int = 42) -> DataFrame:
    """id, n_words, n_features, weight, score: a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def fn(ids, texts):
        gain = shared.value
        n_words, n_features, weights = [], [], []
        for t in texts:
            words = features = weight = 0
            for n, found in bucket_pieces(t, len(gain)):
                words += n
                features += len(found)
                weight += int(gain[found].sum())
            n_words.append(words)
            n_features.append(features)
            weights.append(weight)
        return ids, n_words, n_features, weights

    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    weighed = map_rows(rows, fn, ["id", "text"], f"id {dict(rows.dtypes)['id']}, n_words bigint, n_features bigint, weight bigint")
    return weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed))


KEY = ("down", "missing", "id", "n_features", "row")


def _key() -> Column:
    return F.struct(*KEY)


def kth_key(candidates: DataFrame, k: int, pivots: int = PIVOTS) -> Column:
    """The k-th smallest (from 1) of the different keys (columns ``KEY``) in a written table, as a literal struct."""
    kinds = dict(candidates.dtypes)
    turn = 0
    while True:
        turn += 1
        drawn = candidates.select(*KEY).orderBy(F.xxhash64("row", F.lit(turn))).limit(pivots)
        bounds = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in KEY]) for r in drawn.orderBy(*KEY).collect()]  # ``pivots`` rows
        above = lambda test: sum((test(p).cast("int") for p in bounds[1:]), test(bounds[0]).cast("int"))
        key = _key()
        cells = candidates.select(above(lambda p: p < key).alias("lower"), above(lambda p: p <= key).alias("upto")).groupBy("lower", "upto").count()
        before = 0
        for cell in sorted(cells.collect()):  # at most 2 * pivots + 1 rows
            if before + cell["count"] >= k:
                break
            before += cell["count"]
        if cell["upto"] > cell["lower"]:
            return bounds[cell["lower"]]
        k -= before
        inside = F.lit(True)
        if cell["lower"] > 0:
            inside = inside & (key > bounds[cell["lower"] - 1])
        if cell["lower"] < len(bounds):
            inside = inside & (key < bounds[cell["lower"]])
        candidates = materialise(candidates.filter(inside))


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` from 1 by key: sorted in ranges, numbered in each, ranges added up."""
    place = F.monotonically_increasing_id()  # number of the range above 33 bits of position
    placed = materialise(winners.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", place))
    placed = placed.withColumns({"part": F.shiftright("place", 33), "at": F.col("place").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row per range
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.select("part", before.alias("before")), "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("place", "part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, text: str = "text", doc_id: str = "doc_id",
             target_text: str = "text", buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """id, n_words, n_features, weight, score, rank: ``percent`` of the documents of ``min_words`` words or more are
    drawn and ranked by score, the rank of all others is null."""
    gains = bucket_gains(docs, target, text, target_text, buckets)
    keyed = weigh(docs, gains, text, doc_id, seed).withColumns({
        "down": -F.col("score"), "missing": F.col("id").isNull(), "row": F.monotonically_increasing_id()})
    scored = materialise(keyed)
    eligible = scored.filter(F.col("n_words") >= min_words)
    k = percent * eligible.count() // 100
    columns = ["id", "n_words", "n_features", "weight", "score"]
    if k == 0:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    drawn = (F.col("n_words") >= min_words) & (_key() <= kth_key(eligible, k))
    won = ranked(scored.filter(drawn)).select(*columns, F.col("rank").cast("bigint").alias("rank"))
    return won.unionByName(scored.filter(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, with the columns of ``docs``. Rows that share an id are drawn together."""
    doc_id = options.get("doc_id", "doc_id")
    won = resample(docs, target, **options).filter("rank is not null").select(F.col("id").alias("_drawn")).distinct()
    return docs.join(won, column(doc_id).eqNullSafe(F.col("_drawn")), "left_semi")


SQL = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) r(i))),
texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (
  SELECT side, id, unnest(list_concat(
    ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS feature FROM w),
b AS (
  SELECT feature, list_transform(range(strlen(feature)::BIGINT), lambda i: ('0x' || substr(hex(encode(feature)), (2 * i + 1)::INT, 2))::BIGINT) AS bs
  FROM (SELECT DISTINCT feature FROM f)),
h AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, bs), lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295) % 10000 AS bucket FROM b, tab),
c AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN h USING (feature) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
d AS (
  SELECT id AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN h USING (feature) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
e AS (
  SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('42:' || w.id::VARCHAR), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN d ON d.doc_id = w.id WHERE side = 0),
s AS (
  SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_words >= 20)
SELECT s.doc_id, n_features, weight, score,
       CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM r) THEN rank END::BIGINT AS rank
FROM s LEFT JOIN r ON r.doc_id = s.doc_id
"""
