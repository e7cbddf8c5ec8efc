"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled texts in the tasks that read them and sums the counts per
(language, bin) in a shuffle. The log-probability matrix has one row per language and ``BINS`` columns, so its size
is bounded by the number of languages (checked against ``MAX_LANGS``); it is broadcast, and whole texts are scored in batches:
sparse counts of a text (its distinct bins) times the matrix, in numpy.

Defined results: null text, and text without a letter, is ``und`` with score 0; a table without any labelled text leaves
every text ``und``; null ids and repeated rows are rows like others; very long texts are counted in pieces of
``PIECE`` characters, all of them.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from statwitness.llm.common import column, map_rows, mix64

BINS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 3000  # expected number of training texts per language
MAX_LANGS = 500
SMOOTHING = 0.5
PIECE = 1 << 20
UNKNOWN = "und"
_GAP = re.compile(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins of the text's character n-grams and their counts; letters in lower case, other characters as
    one kind of gap."""
    total = np.zeros(BINS, np.int64)
    text = _GAP.sub(" ", text.lower())
    overlap = max(ORDERS) - 1
    for at in range(0, len(text), PIECE):
        # n-grams over the border belong to the later piece
        before = min(at, overlap)
        points = np.frombuffer(text[at - before : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for n in ORDERS:
            if len(points) < n:
                continue
            code = points[: len(points) - n + 1].copy()
            for i in range(1, n):
                code = code * np.uint64(0x110001) + points[i : len(points) - n + 1 + i]
            bins = (mix64(code + np.uint64(n)) % np.uint64(BINS)).astype(np.int64)[max(0, before - n + 1):]
            total += np.bincount(bins, minlength=BINS)
    used = np.nonzero(total)[0]
    return used, total[used]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (language x bin, then one column of log-priors) from rows (key, text, lang).

    The sample: of each language's rows those whose hashed key falls in its share, ``per_lang`` rows expected."""
    sizes = labelled.filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: is the lang column a language code?")
    if not sizes:
        return [], np.zeros((0, BINS + 1), np.float32)
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_lang / r["n"]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (draw < share))

    def fn(langs, texts):
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(langs, texts):
            used, counts = ngram_counts(text)
            sums.setdefault(lang, np.zeros(BINS, np.int64))[used] += counts
        out = [(lang, int(b), int(s[b])) for lang, s in sums.items() for b in np.nonzero(s)[0]]
        return list(zip(*out)) if out else ([], [], [])

    counted = map_rows(sample, fn, ["lang", "text"], "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    langs = [r["lang"] for r in sizes]
    counts = np.full((len(langs), BINS), SMOOTHING)
    table = counted.toPandas()  # at most languages x BINS rows
    counts[table["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy(dtype=np.int64), table["bin"].to_numpy(dtype=np.int64)] += table["n"].to_numpy()
    prior = np.array([r["n"] for r in sizes], float)
    logs = np.log(counts) - np.log(counts.sum(1, keepdims=True))
    return langs, np.hstack([logs, np.log(prior / prior.sum())[:, None]]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, lang_pred, score: the language of highest posterior and that posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(ids, texts):
        langs, logs = shared.value
        names, scores = [], []
        for t in texts:
            if not langs or not has_letter(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            used, counts = ngram_counts(t)
            ll = logs[:, used].astype(np.float64) @ counts + logs[:, -1]
            p = np.exp(ll - ll.max())
            best = int(np.argmax(p))
            names.append(langs[best])
            scores.append(float(p[best] / p.sum()))
        return ids, names, scores

    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    return map_rows(rows, fn, ["id", "text"], f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part
