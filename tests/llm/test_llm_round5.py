"""Findings of round 3 on the training-data operators."""

import math
import random
import sys

import numpy as np
import pytest

from statwitness.llm import decontaminate, minhash, mixlm
from statwitness.llm.common import map_rows, shingle_set


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_areas_without_an_items_words_are_not_aligned(monkeypatch):
    """Shares are those of ``judge``, and only areas that hold enough of an item's words are aligned with it."""
    rng = random.Random(4)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([3, 4, 14, 30, 64, 65, 150])]
    docs = [prose(rng, rng.randrange(0, 300)) for _ in range(60)]
    for d in range(0, 60, 3):
        item = items[d % 7][1].split()
        at = rng.randrange(len(docs[d]) + 1)
        docs[d][at:at] = [x for x in item if rng.random() > 0.2]
    hashes = [decontaminate.hashes_of(" ".join(w)) for w in docs]
    idf = np.ones(decontaminate.BINS)
    _, q = decontaminate.prepare(items, idf, np.zeros((decontaminate.BINS, 4), np.float32))
    chunk = decontaminate.Chunk(hashes)
    every = [(d, i, s, min(s + size, len(h))) for d, h in enumerate(hashes) if len(h)
             for i, size in enumerate(decontaminate.WINDOWS[t][0] for t in q.tier) for s in range(0, max(1, len(h) - size // 2), 8)]
    best = {}
    for d, i, s, e in every:
        if (share := decontaminate.judge(q.hashes[i], hashes[d], s, e)) > best.get((d, i), 0):
            best[d, i] = share
    aligned, lcs = [], decontaminate.lcs_marked
    monkeypatch.setattr(decontaminate, "lcs_marked", lambda n, marks: aligned.append(n) or lcs(n, marks))
    candidates = tuple(np.array(every).T)
    for some in (candidates, decontaminate.plausible(chunk, candidates, q, decontaminate.rare_places(chunk, q))):
        aligned.clear()
        found = decontaminate.best_item(chunk, some, q)
        assert {(d, i): s for d, r in found.items() for i, s in r.items()} == best and len(best) > 10
        assert len(aligned) < len(every) / 10
    assert decontaminate.best_item(chunk, decontaminate.complete(chunk, q, decontaminate.rare_places(chunk, q)), q) == found


def test_copies_that_hang_together_below_the_threshold_are_not_paired_one_by_one(spark, monkeypatch):
    """Copies of one text that is not there, most of them too far from each other; links and components are those of all pairs."""
    rng = random.Random(6)
    base = prose(rng, 150, 10**6)
    texts = []
    for _ in range(160):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 3, 4, 4, 4])):
            w[at] = f"p{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [set(shingle_set(t, 3).tolist()) for t in texts]
    links = [(i, j) for j in range(160) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    component = list(range(160))
    for _ in range(160):
        for i, j in links:
            component[i] = component[j] = min(component[i], component[j])
    asked, verify = [], minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, sets: asked.append(pairs.count()) or verify(pairs, sets))
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 3, 85).documents.collect()
    assert {r.id: r.component_id for r in found} == dict(enumerate(component))
    assert 1 < len(set(component)) < 150 and sum(asked) < 2000, (len(set(component)), sum(asked), len(links))


def test_a_batch_becomes_python_objects_in_parts(spark):
    """Texts of a batch that is larger than a part; a row larger than a part stays whole; empty batches."""
    def sizes(ids, texts):
        total = sum(map(len, texts))
        return ids, [len(t) for t in texts], [total] * len(ids)

    docs = spark.range(200).coalesce(1).selectExpr("id", "repeat('x', case when id = 150 then 9000000 else 100000 end) as text")
    rows = map_rows(docs, sizes, ["id", "text"], "id bigint, n bigint, total bigint").collect()
    assert [(r.id, r.n) for r in rows] == [(i, 9000000 if i == 150 else 100000) for i in range(200)]
    assert max(r.total for r in rows if r.id < 100) < 8_000_000, max(r.total for r in rows)
    assert map_rows(docs.filter("id < 0"), sizes, ["id", "text"], "id bigint, n bigint, total bigint").collect() == []


def stream_bits(text, learned):
    """Bits of a text, one bit after the other; contexts of bytes reach over the starts of tokens, to the start of the text."""
    model, tables, m64 = learned.model, learned.tables.array, (1 << 64) - 1

    def mix(x):
        return int(mixlm.mix64(np.array([x & m64], np.uint64))[0])

    p, frequent, stream, bits = 0x9E3779B97F4A7C15, 0, b" " * 5, 0.0
    for token in [*text.encode().lower().split(), b""]:
        for i, byte in enumerate(token + b" "):
            contexts, near = [], 0
            for order in range(1, 5):
                near = near * 257 + stream[-order] & m64
                contexts.append(mix(near * p + order))
            so_far = sum((b + 1) * pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k, b in enumerate(token[:i]))
            contexts.append(mix(so_far + i * p))
            contexts.append(mix(contexts[-1] ^ ((frequent + 1) * p & m64)))
            node = 1
            for at in range(8):
                states = [int(tables[k][((c + node * 0xBF58476D1CE4E5B9 & m64) >> 42) & (mixlm.SLOTS - 1)]) for k, c in enumerate(contexts)]
                gates = states[-2] // mixlm.ODDS * mixlm.AMOUNTS + states[-1] // mixlm.ODDS, min(i, 7) * 8 + at
                x = [float(model.odds[k][s]) for k, s in enumerate(states)] + [0.3]
                total = max(-14.0, min(14.0, sum(float(model.weights[0][gates[0], k] + model.weights[1][gates[1], k]) * v for k, v in enumerate(x))))
                total += float(model.refined[stream[-1], max(0, min(mixlm.BUCKETS - 1, int((total + 8) * (mixlm.BUCKETS / 16))))]) / 2
                bit = byte >> (7 - at) & 1
                bits += math.log1p(math.exp(-total if bit else total)) / math.log(2)
                node = node * 2 + bit
            stream += bytes([byte])
        frequent = learned.frequent.index(token) + 1 if token in learned.frequent else frequent
    return bits


def test_contexts_reach_over_the_starts_of_tokens(spark):
    """the score of a text is that of its bytes one after the other, and what a token costs depends on the bytes before it."""
    rng = random.Random(3)
    follows = {"abra": "cadabra", "hocus": "pocus", "x": "ray", "of": "the", "é": "日本"}
    rows = [(i, " ".join(w for _ in range(40) for w in (lambda k: (k, follows[k]))(rng.choice(list(follows))))) for i in range(120)]
    rows += [(200, "x x x ray abra pocus of hocus cadabra"), (201, "é\x00 a"), (202, None), (203, "ab"), (204, "new nx of newest of")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fold = (docs.doc_id % 5 == 0).cast("int") + 1
    learned = mixlm.learn(docs, fold)
    for head in (mixlm.HEAD, 20, 0):
        got = {r.id: r.score for r in mixlm.score(docs.filter("doc_id >= 196 or doc_id < 4"), learned, head=head).collect()}
        assert got == {i: pytest.approx(-math.log10(2) * stream_bits(t or "", learned), rel=1e-3) for i, t in rows if i in got}
    one, other = (mixlm.spread([b"pocus"], np.zeros(1, np.int64), np.zeros(1, np.int64), np.frombuffer(b, np.uint8).reshape(1, 3)) for b in (b"cus", b"bra"))
    after, elsewhere = (float(mixlm.bits_of(p, 1, learned.tables.array, learned.model)[0]) for p in (one, other))
    assert after < elsewhere


def test_only_texts_that_are_asked_for_meet_their_classes(spark):
    """op3: of the rows, those of the wanted ids (null too) go into the join, and next to no others."""
    rows = spark.range(20_000).selectExpr("if(id = 7, null, id) as id", "concat('text ', id) as text")
    for keyed in (rows, rows.selectExpr("struct(id is null as missing, id, unhex(md5(text)) as digest) as id", "text")):
        wanted = keyed.filter("text in ('text 7', 'text 0') or text like '%999'").selectExpr("md5(text) as digest", "id as rep")
        n = wanted.count()
        found = minhash.likely(keyed, wanted)
        assert found.columns == ["id", "text"] and n == 22
        assert found.join(wanted, found.id.eqNullSafe(wanted.rep)).select("text").distinct().count() == n
        assert n <= found.count() < 100
        assert minhash.likely(keyed, wanted.limit(0)).count() == 0


def test_regions_around_rare_words_are_joined_at_once():
    """op10: what ``complete`` calls does not grow with the places of rare words, and its windows are those of regions joined one by one."""
    rng = random.Random(6)
    items = [(i, " ".join(prose(rng, n, 10**6))) for i, n in enumerate([5, 20, 70, 140])]
    _, q = decontaminate.prepare(items, np.ones(decontaminate.BINS), np.zeros((decontaminate.BINS, 4), np.float32))
    texts = [" ".join(rng.choice(items)[1] if rng.random() < 0.3 else " ".join(prose(rng, 40)) for _ in range(12)) for _ in range(20)]
    texts += ["", items[0][1], " ".join([items[0][1].split()[0]] * 20_000)]
    chunk = decontaminate.Chunk([decontaminate.hashes_of(t) for t in texts])
    place, item = rare = decontaminate.rare_places(chunk, q)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    found = decontaminate.complete(chunk, q, rare)
    sys.setprofile(None)
    assert len(place) > 20_000 and len(calls) < 10_000, (len(place), len(calls))
    # every window that ``judge`` accepts is there
    got = set(zip(*(c.tolist() for c in found[:3])))
    sizes = [decontaminate.WINDOWS[t][0] for t in q.tier]
    for d, h in enumerate(chunk.hashes[:-1]):
        for i, size in enumerate(sizes):
            for start in range(0, max(1, len(h) - size // 2), 8):
                if len(h) and decontaminate.judge(q.hashes[i], h, start, min(start + size, len(h))):
                    assert (d, i, start) in got
    assert len(got) > 20
