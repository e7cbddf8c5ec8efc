"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters and digits to the Latin letters they stand for, invisible characters
dropped, everything between words one space), and the lexicon is matched in one Aho-Corasick pass over the whole text.
An entry is a whole word or a word beginning. Hits inside an exception phrase do not count. The weights of the hits are
summed with falling returns for repeats, divided by the logarithm of the length in words, and a logistic curve turns that into a score.

The lexicon is learned from a bounded sample of labelled texts (``SAMPLE_TOXIC``, ``SAMPLE_CLEAN`` rows expected): words
and word beginnings whose share of toxic texts is significantly above the base rate, weighted by their log odds.
Near copies in the sample count once, so that a group of copies cannot make its words toxic. ``SEED`` entries hold
without any labels.

Defined results: null and empty texts score as texts without a hit; a table without labels uses the seed; null ids and
repeated rows are rows like others; ties of the cut are resolved towards clean.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from statwitness.llm.common import column, map_rows, materialise, shingle_set

# --- fixed values: letters and digits that stand for Latin letters ---
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ɡ": "g", "ɑ": "a", "ı": "i", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k",
    "τ": "t", "υ": "u", "ε": "e", "η": "n", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
INVISIBLE = "­​‌‍⁠﻿"
SEED = {"idiot": 3.0, "moron": 3.0, "stupid": 3.0, "scum": 3.0, "worthless": 3.0, "pathetic": 3.0, "disgusting": 3.0, "loser": 3.0}
EXCEPTIONS = ("idiot proof", "stupid question", "pond scum", "trash can", "trash bin", "clown fish", "sore loser", "disgusting smell")

SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
MIN_PREFIX, MAX_PREFIX = 4, 8
MAX_CANDIDATES = 50_000  # word forms the driver chooses from, by number of toxic texts
MIN_SHARE = 0.6
ERROR_RATE = 0.01

_FOLD = str.maketrans({**LOOK_ALIKES, **dict.fromkeys(INVISIBLE)})
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    return _WORD.findall((text or "").lower().translate(_FOLD))


class Lexicon(NamedTuple):
    entries: dict[str, float]  # 'word ' for a whole word, 'word' for a beginning
    cut: float
    slope: float
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    """One automaton for entries and exception phrases, over the text ' word word ... '."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list] = {}
        for entry, weight in lexicon.entries.items():
            held.setdefault(" " + entry, [None, False])[0] = (entry, weight)
        for phrase in lexicon.exceptions:
            held.setdefault(" " + " ".join(fold(phrase)) + " ", [None, False])[1] = True
        for text, (hit, exempt) in held.items():
            self.automaton.add_word(text, (len(text), hit, exempt))
        if held:
            self.automaton.make_automaton()

    def evidence(self, text: str | None) -> float:
        """Weighted hits by length: the sum over entries of weight x (1 + log2 hits) over log2 of the words."""
        ws = fold(text)
        if not ws or not len(self.automaton):
            return 0.0
        found, exempt = [], []
        for end, (length, hit, is_exempt) in self.automaton.iter(" " + " ".join(ws) + " "):
            if is_exempt:
                exempt.append((end - length + 1, end))
            if hit:
                found.append((end - length + 1, hit))
        counts: dict[tuple, int] = {}
        for at, hit in found:
            # a hit begins at the space before its word; it is exempt inside a phrase, from the phrase's own first space on
            if not any(a <= at < e for a, e in exempt):
                counts[hit] = counts.get(hit, 0) + 1
        return sum(w * (1 + math.log2(n)) for (_, w), n in counts.items()) / math.log2(2 + len(ws))

    def score(self, text: str | None) -> float:
        z = self.lexicon.slope * (self.evidence(text) - self.lexicon.cut)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


_matchers: dict[int, Matcher] = {}


def _candidates(text: str | None) -> list[str]:
    out = set()
    for w in set(fold(text)):
        if len(w) >= 3:
            out.add(w + " ")
        out.update(w[:n] for n in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1))
    return list(out)


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, tried: int) -> dict[str, float]:
    """Entries from (form, toxic texts, all texts): share above ``MIN_SHARE`` and, by Chernoff's bound, not by
    chance among all forms tried. Of forms where one begins another the most significant stays, the longer one if equal."""
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    ranked = []
    for form, t, n in counts:
        share = t / n
        if share < max(MIN_SHARE, base + 1e-9):
            continue
        kl = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)
        if n * kl >= math.log(max(tried, 1) / ERROR_RATE):
            weight = math.log((t + 0.5) / (toxic + 1)) - math.log((n - t + 0.5) / (clean + 1))
            ranked.append((-n * kl, -len(form), form, weight))
    # two entries are related if one text begins the other; both then share the shorter one as a beginning
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    for _, _, form, weight in sorted(ranked):
        if form in beginnings or any(form[:n] in chosen for n in range(1, len(form) + 1)):
            continue
        chosen[form] = weight
        beginnings.update(form[:n] for n in range(1, len(form) + 1))
    return chosen


def best_cut(points: list[tuple[float, int]]) -> tuple[float, float]:
    """The evidence level with the best F1 on labelled points, halfway to the next lower level, and a slope that
    puts the neighbouring levels clearly on their sides."""
    levels = sorted({x for x, y in points if y} - {0.0})
    total = sum(y for _, y in points)
    if not levels:
        return 0.25, 12.0
    points = sorted(points, reverse=True)
    best, cut, i, tp, fp = -1.0, levels[0], 0, 0, 0
    for level in reversed(levels):
        while i < len(points) and points[i][0] >= level:
            tp, fp, i = tp + points[i][1], fp + 1 - points[i][1], i + 1
        f1 = 2 * tp / (tp + fp + total)
        if f1 >= best:
            best, cut = f1, level
    lower = max([x for x, _ in points if x < cut], default=0.0)
    middle = (cut + lower) / 2
    return middle, 4 / max(cut - middle, 0.02)


def train(texts: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, clean_rows: int = SAMPLE_CLEAN) -> Lexicon:
    """A lexicon from texts(key, text) and labels(key, toxic 0/1). Rows without a label are not used.

    The sample is drawn among the keys; only its few texts, as many as the two bounds say, are fetched and stored."""
    labelled = texts.select("key").join(labels.filter(F.col("toxic").isin(0, 1)).select("key", F.col("toxic").cast("int").alias("toxic")), "key").distinct()
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = lambda n, rows: min(1.0, rows / n) if n else 0.0
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit("toxicity sample")), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.filter(draw < F.when(F.col("toxic") == 1, share(sizes.get(1), toxic_rows)).otherwise(share(sizes.get(0), clean_rows)))
    sample = materialise(texts.join(F.broadcast(chosen), "key").select("key", "text", "toxic"))  # about toxic_rows + clean_rows keys

    def describe(keys, texts, marks):
        near = []
        for t in texts:
            s = shingle_set(t, 3)
            near.append(int(s[0]) - (1 << 63) if len(s) else 0)  # the smallest shingle hash: near copies share it
        return near, [int(m) for m in marks], [_candidates(t) for t in texts]

    once = map_rows(sample, describe, ["key", "text", "toxic"],
                    "near bigint, toxic int, forms array<string>").groupBy("near", "toxic").agg(F.min_by("forms", F.size("forms")).alias("forms"))
    forms = once.select("toxic", F.explode("forms").alias("form")).groupBy("form").agg(F.sum("toxic").cast("bigint").alias("t"), F.count("*").alias("n"))
    totals = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = forms.filter(f"t >= 3 and t >= {MIN_SHARE} * n").orderBy(F.desc("t"), "form").limit(MAX_CANDIDATES).collect()
    # every form seen in three toxic texts is a trial; their number is bounded by the sample
    tried = forms.filter("t >= 3").count()
    learned = choose([(r["form"], r["t"], r["n"]) for r in rows], totals.get(1, 0), totals.get(0, 0), tried)
    seed = {w + " ": v for w, v in SEED.items() if not any((w + " ")[:n] in learned for n in range(1, len(w) + 2))}
    draft = Lexicon({**seed, **learned}, 0.0, 1.0)

    def levels(texts, marks):
        m = Matcher(draft)
        return [m.evidence(t) for t in texts], [int(v) for v in marks]

    points = map_rows(sample, levels, ["text", "toxic"], "level double, toxic int").collect()
    cut, slope = best_cut([(r["level"], r["toxic"]) for r in points])
    return draft._replace(cut=cut, slope=slope)


def score_udf(lexicon: Lexicon):
    """A column function text -> score, Arrow batches."""

    @F.pandas_udf("double")
    def score(texts):
        key = id_of
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(lexicon)
        return texts.map(_matchers[key].score, na_action=None).astype("float64")

    id_of = hash((tuple(sorted(lexicon.entries.items())), lexicon.cut, lexicon.slope, lexicon.exceptions))
    return score


def score_texts(docs: DataFrame, lexicon: Lexicon, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, score and predicted (1 from 0.5 on) per row."""
    scored = docs.select(column(doc_id).alias("id"), score_udf(lexicon)(column(text).cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns."""
    return docs.filter(score_udf(lexicon)(column(text).cast("string")) < 0.5)
