"""Importance resampling, spelling variants and language-model scores against plain versions, and their edge cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statwitness.llm import mixlm, resample, variants
from statwitness.llm.common import words as lower_words
from statwitness.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} the" for i in range(60_000))
SCHEMA = "doc_id bigint, text string, score string, rank string, word string, n string, row string"


def documents(spark, texts):
    """Rows (id, text) with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "s", "r", "w", "n", "x") for i, t in texts], SCHEMA)


# --- importance resampling ---------------------------------------------------------------------


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text).split(" ")


def plain_features(text):
    ws = [w for w in plain_words(text) if w]
    return len(ws), [" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def plain_resample(docs, target, percent=5, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = collections.Counter(bucket(f) for _, t in docs for f in plain_features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, text in docs:
        n, fs = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    won = able[: percent * len(able) // 100]
    ranked = [(*r, k + 1) for k, r in enumerate(won)]
    for r in won:
        rows.remove(r)
    return sorted(ranked + [(*r, None) for r in rows], key=str)


def some_texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "d3lta", "épsilon", "zeta", "eta", "theta", "naïve", "日本"]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 21, 60]))) + rng.choice(["", ".", "-x"]) for _ in range(n)]


def resampled(spark, docs, target, **options):
    out = resample.resample(documents(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), **options)
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_resample_against_plain_version(spark):
    docs = list(enumerate(some_texts(300)))
    docs += [(None, docs[5][1]), (None, None), (900, None), (901, ""), (902, LONG), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(1000, docs[4][1])] * 40
    target = ["alpha gamma naïve theta", None, "zeta eta"]
    for percent in (5, 50, 100, 0):
        assert resampled(spark, docs, target, percent=percent) == plain_resample(docs, target, percent)


def test_resample_empty_tables(spark):
    assert resampled(spark, [], ["a b c"]) == []
    docs = list(enumerate(some_texts(45, 5)))
    assert resampled(spark, docs, [], percent=40) == plain_resample(docs, [], 40)


def test_drawn_documents_keep_their_columns(spark):
    docs = documents(spark, list(enumerate(some_texts(80))))
    target = spark.createDataFrame([("alpha",)], "text string")
    drawn = resample.draw(docs, target, percent=20)
    won = {r.id for r in resample.resample(docs, target, percent=20).filter("rank is not null").collect()}
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == won and won


def test_kth_key_among_equal_scores(spark):
    keys = spark.range(5000).select(F.lit(0).alias("down"), F.lit(False).alias("missing"), (F.col("id") % 7).alias("id"), F.lit(1).alias("n_features"), F.col("id").alias("row"))
    keys = resample.materialise(keys)
    want = sorted((r.id, r.row) for r in keys.collect())
    for k in (1, 2, 2500, 4999, 5000):
        kth = keys.limit(1).select(resample.kth_key(keys, k).alias("k")).first().k
        assert (kth.id, kth.row) == want[k - 1]


def test_features_across_pieces(monkeypatch):
    text = "aa bb cc dd ee ff gg hh " * 40
    whole = sorted(np.concatenate([b for _, b in resample.bucket_pieces(text, 10_000)]).tolist())
    monkeypatch.setattr(resample, "PIECE", 10)
    cut = sorted(np.concatenate([b for _, b in resample.bucket_pieces(text, 10_000)]).tolist())
    assert whole == cut == sorted(zlib.crc32(f.encode()) % 10_000 for f in plain_features(text)[1])


# --- spelling variants ---------------------------------------------------------------------------


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, factor=2):
    near = {w: [v for v in counts if edit_one(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def plain_counts(docs, one_in=97, min_length=5, min_count=3):
    import re

    counts = collections.Counter()
    for i, t in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= min_length
    return {w: n for w, n in counts.items() if n >= min_count}


def test_variants_against_plain_version(spark):
    rng = random.Random(11)
    letters = "abé"
    base = ["".join(rng.choices(letters, k=rng.choice([5, 6, 7]))) for _ in range(60)]
    docs = []
    for i in range(120):
        docs.append((i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(base, weights=[1 / (k + 1) for k in range(60)], k=60)) + " ÷x×y 12aaaaa_bbbbb"))
    docs += [(None, "aaaaa aaaab"), (500, None), (501, ""), (502, "  "), (3, docs[3][1]), (3, docs[3][1]), (503, LONG + " aaaab" * 9), (504, "b" * 5000 + " " + ("b" * 4999 + " ") * 2), (505, ("b" * 5000 + " ") * 3)]
    for one_in in (97, 3, 0):
        counts = plain_counts(docs, one_in)
        got = sorted(tuple(r) for r in variants.variants(documents(spark, docs), one_in=one_in).collect())
        assert got == plain_variants(counts) and len(got) > 50


def test_variant_chains_and_ties(spark):
    counts = {"aaaab": 3, "aaabb": 6, "aabbb": 12, "abbbb": 24, "bbbbb": 48, "bbbbbb": 96, "ccccc": 5, "ccccd": 10, "cccce": 10, "zzzzz": 3}
    docs = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = {r.word: r for r in variants.variants(documents(spark, docs), one_in=0).collect()}
    assert got["aaaab"].root == "bbbbbb" and got["bbbbb"].form == "bbbbbb" and got["bbbbbb"].form is None
    assert got["ccccc"].form == "ccccd" and got["zzzzz"].n_near == 0 and got["zzzzz"].root == "zzzzz"
    assert variants.variants(documents(spark, [(1, None), (2, "")])).collect() == []
    assert variants.variants(documents(spark, [])).collect() == []


def test_no_pairs_are_written(spark):
    """All words that fit one gap: rows of the scan grow with the words, not with their pairs."""
    docs = [(1, " ".join(f"abcd{chr(c)}" for c in range(ord("a"), ord("z") + 1) for _ in range(3)))]
    words = variants.count_words(documents(spark, docs), one_in=0)
    assert variants.rotations(words).count() == 26 * (6 + 5)
    assert [r.n_near for r in variants.near_words(words).collect()] == [25] * 26


# --- language-model scores -------------------------------------------------------------------------


def plain_base(docs, fold):
    tokens = [lower_words(t) + [None] for _, t in docs]
    counts = collections.Counter(w for ws, f in zip(tokens, fold) if f for w in ws)
    n, v = sum(counts.values()), len(counts)
    return n, v, [(len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) if n else None) for ws in tokens]


def lm_documents():
    rng = random.Random(2)
    pool = ["the", "of", "a", "der", "und"] + ["".join(rng.choices(["th", "en", "ion", "sch", "at"], k=rng.choice([1, 2, 3]))) for _ in range(120)]
    docs = [(i, " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=80))) for i in range(150)]
    return docs + [(None, "The end"), (700, None), (701, ""), (702, " \t\n"), (703, "x" * 200_000 + " the"), (704, LONG), (5, docs[5][1]), (5, docs[5][1]), (705, "héé 日本 \U0001F600")]


@pytest.fixture(scope="module")
def learned(spark):
    docs = documents(spark, lm_documents())
    parts = mixlm.base_parts(F.col("doc_id"), 10)
    return docs, mixlm.learn(docs, F.when(parts == 0, 0).when(parts == 9, 2).otherwise(1))


def fold_of(i):
    return {0: 0, 9: 2}.get(zlib.crc32(("" if i is None else str(i)).encode()) % 10, 1)


def test_base_scores_against_plain_version(spark, learned):
    docs, model = learned
    rows = lm_documents()
    n, v, want = plain_base(rows, [fold_of(i) for i, _ in rows])
    assert (model.train_tokens, model.train_words) == (n, v)
    got = mixlm.score(docs, model).collect()
    key = lambda i, m, k, b: (str(i), m, k, round(b, 6))
    assert sorted(key(r.id, r.n_tokens, r.n_known, r.base_score) for r in got) == sorted(key(i, *w) for (i, _), w in zip(rows, want))
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    same = [r.score for r in got if r.id == 5]
    assert len(same) == 3 and len(set(same)) == 1
    empty = {r.score for r in got if r.id in (700, 701, 702)}
    assert len(empty) == 1


def test_head_and_rest_give_the_same_scores(spark, learned):
    docs, model = learned
    a, b = ({(str(r.id), r.n_tokens): r for r in mixlm.score(docs, model, head=h).collect()} for h in (0, mixlm.HEAD))
    assert a.keys() == b.keys()
    for k, r in a.items():
        assert r.n_known == b[k].n_known and r.score == pytest.approx(b[k].score) and r.base_score == pytest.approx(b[k].base_score)


def slow_bits(token, frequent, tables, model):
    """One bit after the other, in Python numbers."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m64
        return x ^ (x >> 31)

    p = 0x9E3779B97F4A7C15
    data, bits = token + b" ", 0.0
    for i, byte in enumerate(data):
        contexts, near = [], 0
        for order in range(1, 5):
            near = (near * 257 + (data[i - order] if i >= order else 32)) & m64
            contexts.append(mix((near * p + order) & m64))
        power, total = 1, 0
        for b in data[:i]:
            power = power * 0xD1342543DE82EF95 & m64
            total = (total + (b + 1) * power) & m64
        contexts.append(mix((total + i * p) & m64))
        contexts.append(mix(contexts[-1] ^ ((frequent + 1) * p & m64)))
        node = 1
        for at in range(8):
            states = [int(tables[k][(((c + node * 0xBF58476D1CE4E5B9) & m64) >> 42) & (mixlm.SLOTS - 1)]) for k, c in enumerate(contexts)]
            x = [float(model.odds[k][s]) for k, s in enumerate(states)] + [0.3]
            gates = states[-2] // mixlm.ODDS * mixlm.AMOUNTS + states[-1] // mixlm.ODDS, min(i, 7) * 8 + at
            total = sum(float(model.weights[0][gates[0], k] + model.weights[1][gates[1], k]) * v for k, v in enumerate(x))
            total = max(-14.0, min(14.0, total))
            total += float(model.refined[data[i - 1] if i else 32, max(0, min(mixlm.BUCKETS - 1, int((total + 8) * (mixlm.BUCKETS / 16))))]) / 2
            bit = byte >> (7 - at) & 1
            bits += math.log1p(math.exp(-total if bit else total)) / math.log(2)
            node = node * 2 + bit
    return bits


def test_scores_against_one_bit_after_the_other(learned):
    _, learned = learned
    tokens = [b"", b"the", b"then", b"schen", b"xyzzy" * 5, "héé".encode(), b"a"]
    owner, frequent = np.array([0, 1, 1, 2, 3, 4, 5, 6, 6]), np.array([0, 0, 3, 1, 2, 0, 5, 1, mixlm.FREQUENT])
    fast = mixlm.bits_of(mixlm.spread(tokens, owner, frequent), len(owner), learned.tables.array, learned.model)
    slow = [slow_bits(tokens[o], int(f), learned.tables.array, learned.model) for o, f in zip(owner, frequent)]
    assert fast == pytest.approx(slow, rel=1e-3)


def test_probabilities_of_next_bytes_add_up(learned):
    """All bytes after one beginning share its probability: what a token costs up to a byte is a proper code."""
    _, learned = learned
    tokens = [b"th" + bytes([b]) for b in range(256) if b != 32]

    def cost(ts):
        pairs = mixlm.spread(ts, np.arange(len(ts)), np.ones(len(ts), np.int64))
        keep = pairs.coded.place < 3  # without the space that ends the token
        cut = mixlm.Pairs(pairs.coded, pairs.byte[keep], pairs.pair[keep], pairs.frequent[keep])
        return mixlm.bits_of(cut, len(ts), learned.tables.array, learned.model)

    two = mixlm.spread([b"th"], np.zeros(1, np.int64), np.ones(1, np.int64))
    three = float(mixlm.bits_of(two, 1, learned.tables.array, learned.model)[0])  # t, h, space
    beginning = mixlm.Pairs(two.coded, two.byte[:2], two.pair[:2], two.frequent[:2])
    share = 2 ** -float(mixlm.bits_of(beginning, 1, learned.tables.array, learned.model)[0])
    assert sum(2.0 ** -cost(tokens)) + 2.0 ** -three == pytest.approx(share, rel=1e-4)


def test_tables_hold_the_counts(spark):
    rows = [(b"the", [(0, 3, 1, 5), (2, 1, 0, 1)]), (b"then", [(0, 2, 0, 2)]), (b"", [(0, 4, 4, 9)]), (b"once", [(1, 1, 0, 1)])]
    vocabulary = spark.createDataFrame([(w, [dict(zip(("frequent", "a", "b", "n"), u)) for u in uses]) for w, uses in rows],
                                       "word binary, uses array<struct<frequent:int,a:bigint,b:bigint,n:bigint>>").repartition(2)
    counts = np.zeros((2, mixlm.ORDERS, mixlm.SLOTS * 2), np.int64)
    for r in mixlm.table_blocks(vocabulary).collect():
        at = slice(r.block * mixlm.BLOCK * 2, (r.block + 1) * mixlm.BLOCK * 2)
        counts[0, r.order, at] += mixlm._unpack(r.a)
        counts[1, r.order, at] += mixlm._unpack(r.b)
    bits = lambda w: 8 * (len(w) + 1)
    for order in range(mixlm.ORDERS - 2):
        assert counts[0, order].sum() == sum(bits(w) * u[1] for w, uses in rows for u in uses)
        assert counts[1, order].sum() == sum(bits(w) * u[2] for w, uses in rows for u in uses)
    assert counts[0, -2].sum() == sum(bits(w) * u[1] for w, uses in rows for u in uses if w != b"once")
    assert counts[0, -1].sum() == sum(bits(w) * u[1] for w, uses in rows for u in uses if u[1] + u[2] > 1)


def test_scores_without_training_and_of_an_empty_table(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    got = {r.id: r for r in mixlm.score(docs, mixlm.learn(docs, F.lit(0))).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].base_score is None and got[1].score == pytest.approx(5 * 8 * -math.log10(2), rel=0.3)
    none = documents(spark, [])
    assert mixlm.score(none, mixlm.learn(none, F.lit(1))).collect() == []


def test_lm_query(spark):
    got = QUERIES["op13_lm_scores"](spark, SF)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, _, want = plain_base(rows, [fold_of(i) for i, _ in rows])
    found = {r.doc_id: r for r in got.collect()}
    for (i, _), (m, known, base) in zip(rows, want):
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold_of(i) == 0, m, known, n) and r.base_score == pytest.approx(base)
