"""Benchmark decontamination by latent semantic retrieval.

Words of all documents are hashed once and stored. Passages give TF-IDF vectors over ``BINS`` hashed words; bins that
occur in more than ``COMMON`` of the passages tell passages of a language alike, not apart, and weigh nothing. A randomised decomposition of that matrix A is
computed over the whole corpus: one pass counts document frequencies, one pass sums A'A W for a random W of
``RANK + EXTRA`` columns task by task, and from that product alone the leading right singular vectors follow
(Nystroem). Only tables of ``BINS`` rows reach the driver, whatever the corpus.

Benchmark items are the stated queries. Their latent vectors are broadcast (their text is checked against
``MAX_QUERY_WORDS``), and every window of every document is compared with them by cosine in blocks. Windows have the two sizes of
``WINDOWS`` and overlap. A cosine in few dimensions has an error, and a lower share, a short or a long item can
fall under any cut, so the search is completed by a look-up of rare words that misses nothing: a match needs a certain number
of an item's words, so of its rarest words some must be in the text read around the window, and all windows where they are become
candidates (``complete``). A candidate (window, item) of the cosine search must be
able to hold enough of the item's words at all, which is checked on counts. Candidates are then decided by the longest
common subsequence of words around the window: a share of ``LCS_SHARE`` of the item is contamination; so is a
lower share of ``PARAPHRASE_SHARE`` if the item's answer, its last quarter, is found nearly whole (``ANSWER_SHARE``).

Defined results: words are lower-cased in A-Z and split at ASCII white space; null and empty texts and empty items match
nothing; repeated rows are judged alike; an empty benchmark leaves every document clean; an empty corpus gives no rows;
of equally good items the smallest id is named.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from statwitness.llm.common import column, map_rows, materialise, row_keys, without, words

BINS = 1 << 13
RANK, EXTRA = 64, 8
COMMON = 0.04  # share of passages above which a bin has no weight
PASSAGE = 48
STEP = 8  # words of a block; windows begin and end at blocks
WINDOWS = ((24, 8), (48, 16))  # words and step; items go with the first size that is at least 2/3 of their length
COSINE = 0.45
LCS_SHARE, PARAPHRASE_SHARE, ANSWER_SHARE = 0.7, 0.5, 0.8
MAX_QUERY_WORDS = 2_000_000
CHUNK_WORDS = 1 << 14  # words of documents worked on at once
BASIS_WORDS = 1 << 12  # as many as add to the basis at once: their rows stay in the processor's cache
TABLE = 1 << 20  # marks of words looked up at once
SLICE = 1 << 18  # words of candidates marked at once


def hashes_of(text: str | None) -> np.ndarray:
    """32-bit hashes of the words of a text."""
    ws = words(text)
    return np.fromiter(map(zlib.crc32, ws), np.uint32, len(ws))


def bins_of(hashes: np.ndarray) -> np.ndarray:
    """The top bits of a multiplied hash; 16-bit numbers, which sort by radix."""
    return ((hashes * np.uint32(0x9E3779B1)) >> np.uint32(33 - BINS.bit_length())).astype(np.uint16)


def _passages(n: int) -> np.ndarray:
    """Passage number of each of n words."""
    return np.arange(n) // PASSAGE


def hashed_words(docs: DataFrame) -> DataFrame:
    """id and the 32-bit hashes of its words as bytes, written once for the passes that follow."""

    def fn(ids, texts):
        return ids, [hashes_of(t).tobytes() for t in texts]

    return materialise(map_rows(docs, fn, ["id", "text"], f"id {dict(docs.dtypes)['id']}, words binary"))


def document_frequency(hashed: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each bin occurs, and how many passages there are."""

    def fn(docs):
        df, total = np.zeros(BINS, np.int64), 0
        for d in docs:
            b = bins_of(np.frombuffer(d, np.uint32))
            if len(b):
                pairs = np.sort(_passages(len(b)) * BINS + b)
                df += np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])] % BINS, minlength=BINS)
                total += -(-len(b) // PASSAGE)
        at = np.nonzero(df)[0]
        return np.append(at, BINS), np.append(df[at], total)

    rows = map_rows(hashed, fn, ["words"], "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # at most BINS + 1 rows
    out = np.zeros(BINS + 1, np.int64)
    out[rows["bin"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out[:BINS], int(out[BINS])


def weights_of(df: np.ndarray, passages: int) -> np.ndarray:
    return np.where(df > COMMON * passages, 0.0, np.log((1 + passages) / (1 + df)))


def latent_basis(hashed: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """BINS x rank: leading right singular vectors of the TF-IDF matrix of all passages."""
    width = rank + EXTRA
    omega = np.random.default_rng(seed).standard_normal((BINS, width)).astype(np.float32)
    shared = hashed.sparkSession.sparkContext.broadcast((omega * idf[:, None].astype(np.float32), idf > 0))

    def add(z, weighted, bins, passages):
        b, p = np.concatenate(bins), np.concatenate(passages)
        begin = np.nonzero(np.append(True, p[1:] != p[:-1]))[0]
        y = np.add.reduceat(weighted[b], begin, axis=0)  # a row of A W for each passage
        row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(b))))
        order = np.argsort(b, kind="stable")
        by_bin = b[order]
        first = np.nonzero(np.append(True, by_bin[1:] != by_bin[:-1]))[0]
        z[by_bin[first]] += np.add.reduceat(y[row[order]], first, axis=0)

    def run(batches):
        import pyarrow as pa

        weighted, used = shared.value
        z, bins, passages, size, number, some = np.zeros((BINS, width), np.float64), [], [], 0, 0, False
        for batch in batches:
            for d in batch.column("words").to_pylist():
                b = bins_of(np.frombuffer(d, np.uint32))
                keep = used[b]
                if keep.any():
                    bins.append(b[keep])
                    passages.append(_passages(len(b))[keep] + number)
                    number += -(-len(b) // PASSAGE)
                    size += len(bins[-1])
                    some = True
                if size >= BASIS_WORDS:
                    add(z, weighted, bins, passages)
                    bins, passages, size = [], [], 0
        if bins:
            add(z, weighted, bins, passages)
        if some:
            at = np.nonzero(z.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(z[at, i]) for i in range(width)]],
                                             names=["bin", *[f"z{i}" for i in range(width)]])

    schema = "bin int, " + ", ".join(f"z{i} double" for i in range(width))
    summed = hashed.select("words").mapInArrow(run, schema).groupBy("bin").agg(*[F.sum(f"z{i}").alias(f"z{i}") for i in range(width)])
    table = summed.toPandas()  # at most BINS rows
    z = np.zeros((BINS, width))
    if len(table):
        z[table["bin"].to_numpy(dtype=np.int64)] = table[[f"z{i}" for i in range(width)]].to_numpy(dtype=float) * idf[table["bin"].to_numpy(dtype=np.int64)][:, None]
    # A'A is about Z (W'Z)^-1 Z': its eigenvectors are the left singular vectors of Z C^-T with W'Z = C C'
    shift = 1e-6 * (np.linalg.norm(z) + 1e-9)
    z = z + shift * omega * (idf > 0)[:, None]
    core = omega.T.astype(float) @ z
    core = (core + core.T) / 2
    if not z.any():
        return np.zeros((BINS, rank), np.float32)  # nothing but common words
    values, vectors = np.linalg.eigh(core)
    keep = values > values.max() * 1e-10
    half = z @ (vectors[:, keep] / np.sqrt(values[keep]))
    u, _, _ = np.linalg.svd(half, full_matrices=False)
    return u[:, :rank].astype(np.float32)


class Queries(NamedTuple):
    ids: list  # item ids
    hashes: list[np.ndarray]  # words of the items, 32-bit
    lengths: np.ndarray  # of the items
    tier: np.ndarray  # which window size
    vectors: np.ndarray  # unit latent vectors
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted distinct hashes of rare words, where each one's items begin, the items
    least: np.ndarray  # how many of an item's rare words a match holds at least


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence of two sequences of numbers, one machine-word-parallel step per element of b."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judge(item: np.ndarray, doc: np.ndarray, start: int, end: int) -> float:
    """The share of the item found around the window [start, end) of the document if that is contamination, else 0."""
    n = len(item)
    margin = max(n - (end - start) // 2, n // 3, 8)
    area = doc[max(0, start - margin) : end + margin]
    share = lcs_length(item, area) / n
    if share >= LCS_SHARE:
        return share
    answer = item[-max(4, n // 4):]
    if share >= PARAPHRASE_SHARE and lcs_length(answer, area) >= ANSWER_SHARE * len(answer):
        return share
    return 0.0


def prepare(items: list[tuple], idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, Queries]:
    embedding = (basis * idf[:, None]).astype(np.float32)
    kept = [(i, hashes_of(t)) for i, t in items]
    kept = [(i, h) for i, h in kept if len(h)]
    vectors = np.zeros((len(kept), basis.shape[1]), np.float32)
    for r, (_, h) in enumerate(kept):
        v = embedding[bins_of(h)].sum(axis=0)
        vectors[r] = v / (np.linalg.norm(v) + 1e-12)
    tier = np.array([next((k for k, (w, _) in enumerate(WINDOWS) if 3 * w >= 2 * len(h)), len(WINDOWS) - 1) for _, h in kept], np.int64)
    hashes = [h for _, h in kept]
    rare, least = rare_words(hashes, tier, idf)
    return embedding, Queries([i for i, _ in kept], hashes, np.array([len(h) for h in hashes], np.int64), tier, vectors, rare, least)


def needed(n: int) -> int:
    """The fewest words of an item of n that ``judge`` can accept."""
    return next(m for m in range(1, n + 1) if m / n >= min(LCS_SHARE, PARAPHRASE_SHARE))


def reach(n: int, size: int) -> int:
    """No window of a size reads more words around it than this, see ``judge``."""
    return size + 2 * max(n, 8)


def rare_words(hashes: list[np.ndarray], tier: np.ndarray, idf: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Of n words of which a match holds m, all but m - t hold at least t of the match, whichever they are. For each item
    the rarest ones are taken, with the t that other text reaches least often."""
    share = np.where(idf > 0, np.exp(-idf), 1.0)  # of passages with the word
    pairs, least = [], np.ones(len(hashes), np.int64)
    for r, h in enumerate(hashes):
        n, m = len(h), needed(len(h))
        order = np.lexsort((h, share[bins_of(h)]))
        new = np.zeros(n, bool)
        new[np.unique(h[order], return_index=True)[1]] = True
        expected = np.cumsum(share[bins_of(h)][order] * new) * reach(n, WINDOWS[tier[r]][0]) / PASSAGE + 1e-9
        t = np.arange(1, m + 1)
        lam = expected[n - m + t - 1]
        least[r] = t[np.argmax(np.where(t > lam, t * np.log(t / lam) - t + lam, 0.0))]  # Chernoff's bound of a Poisson tail
        pairs += [(x, r) for x in np.unique(h[order[: n - m + least[r]]]).tolist()]
    table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    vocabulary, first = np.unique(table[:, 0], return_index=True)
    return (vocabulary.astype(np.uint32), np.append(first, len(table)), table[:, 1]), least


def windows(blocks: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and first block of every window of documents of so many blocks; the last window ends with the text."""
    last = np.maximum(blocks - size // STEP, 0)
    count = -(-last // (step // STEP)) + 1
    owner = np.repeat(np.arange(len(blocks)), count)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return owner, np.minimum(rank * (step // STEP), last[owner])


class Chunk:
    """Documents worked on at once, their words numbered."""

    def __init__(self, hashes: list[np.ndarray]):
        self.hashes = hashes
        self.lengths = np.array([len(h) for h in hashes], np.int64)
        self.offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths)])
        self.words = np.concatenate([*hashes, np.zeros(0, np.uint32)])
        self.distinct, self.number = np.unique(self.words, return_inverse=True)

    def marks(self, items: list[np.ndarray], width: int) -> np.ndarray:
        """Column by column of 64 places, for every item and number of a word, and one number that no word has: a bit for each
        place of the item where the word stands."""
        owner = np.repeat(np.arange(len(items)), [len(h) for h in items])
        place = np.concatenate([np.arange(len(h)) for h in items])
        every = np.concatenate(items)
        at = np.minimum(np.searchsorted(self.distinct, every), len(self.distinct) - 1)
        there = self.distinct[at] == every
        table = np.zeros((width, len(items) * (len(self.distinct) + 1)), np.uint64)
        np.bitwise_or.at(table, (place[there] // 64, owner[there] * (len(self.distinct) + 1) + at[there]),
                         np.uint64(1) << (place[there] % 64).astype(np.uint64))
        return table


def marked_areas(chunk: Chunk, q: Queries, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For candidates, words [low, high) against an item, some at a time: which ones, and the marks of their words (column, candidate, word)."""
    width = -(-q.lengths[item] // 64)
    numbers = len(chunk.distinct) + 1
    part = item // max(1, TABLE // numbers)
    order = np.lexsort((high - low, part, width))
    for group in np.split(order, np.nonzero(np.diff(width[order]) | np.diff(part[order]))[0] + 1) if len(order) else ():
        w = int(width[group[0]])
        members, row = np.unique(item[group], return_inverse=True)
        table = chunk.marks([q.hashes[i] for i in members], w)
        size = max(1, SLICE // (w * int(high[group[-1]] - low[group[-1]])))
        for at in range(0, len(group), size):
            some = group[at : at + size]
            where = low[some][:, None] + np.arange((high - low)[some].max())
            number = np.where(where < high[some][:, None], chunk.number[np.minimum(where, len(chunk.number) - 1)], numbers - 1)
            yield some, table[:, row[at : at + size][:, None] * numbers + number]


def held(marks: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """For candidates' marks: how many places of the item, from ``first`` on, have their word in the area. No common subsequence is longer."""
    places = np.bitwise_or.reduce(marks, axis=2)
    if first is not None:
        skipped = np.clip(first - 64 * np.arange(len(marks))[:, None], 0, 64)
        places = np.where(skipped < 64, places >> np.minimum(skipped, 63).astype(np.uint64), np.uint64(0))
    return np.bitwise_count(places).sum(axis=0, dtype=np.int64)


def as_numbers(marks: np.ndarray) -> list[int]:
    """Marks of one area (column, word), each as one number; words that the item does not have are left out."""
    marks = marks[:, marks.any(axis=0)]
    out = marks[0].tolist()
    for row in range(1, len(marks)):
        out = [x | y << (64 * row) for x, y in zip(out, marks[row].tolist())]
    return out


def lcs_marked(n: int, marks: list[int]) -> int:
    """``lcs_length`` of an item of n words and the words that have these marks."""
    full = (1 << n) - 1
    v = full
    for m in marks:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


Candidates = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # documents, items, starts, ends


def search(chunk: Chunk, embedding: np.ndarray, q: Queries, cosine: float = COSINE) -> Candidates:
    """Windows near an item in the latent space. An item of common words only has no direction there; all windows are its candidates."""
    out = [np.zeros((4, 0), np.int64)]
    places = np.nonzero(chunk.lengths)[0]
    if not len(places) or not q.ids:
        return tuple(out[0])
    lengths, offsets = chunk.lengths[places], np.append(chunk.offsets[places], chunk.offsets[-1])
    blocks = -(-lengths // STEP)
    first = np.concatenate([[0], np.cumsum(blocks)])
    begin = np.repeat(offsets[:-1] - first[:-1] * STEP, blocks) + np.arange(first[-1]) * STEP
    until = np.append(begin[1:], chunk.offsets[-1])
    bins, per_block = bins_of(chunk.words), embedding[bins_of(chunk.words[begin])]
    for k in range(1, STEP):  # the k-th words of the blocks
        more = np.nonzero(begin + k < until)[0]
        if len(more) == len(begin):
            per_block += embedding[bins[begin + k]]
        else:
            per_block[more] += embedding[bins[begin[more] + k]]
    sums = np.zeros((first[-1] + 1, embedding.shape[1]))
    np.cumsum(per_block, axis=0, dtype=np.float64, out=sums[1:])
    lost = ~q.vectors.any(axis=1)
    for k, (size, step) in enumerate(WINDOWS):
        items = np.nonzero(q.tier == k)[0]
        if not len(items):
            continue
        owner, block = windows(blocks, size, step)
        until = np.minimum(block + size // STEP, blocks[owner])
        x = (sums[until + first[owner]] - sums[block + first[owner]]).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        near = x @ q.vectors[items].T >= cosine
        near[:, lost[items]] = True
        w, i = np.nonzero(near)
        out.append(np.stack([places[owner[w]], items[i], block[w] * STEP, np.minimum(until[w] * STEP, lengths[owner[w]])]))
    return tuple(np.concatenate(out, axis=1))


def rare_places(chunk: Chunk, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Where rare words of items stand, by item and place."""
    vocabulary, first, items = q.rare
    if not len(vocabulary) or not len(chunk.words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # each distinct word is looked up once
    at = np.minimum(np.searchsorted(vocabulary, chunk.distinct), len(vocabulary) - 1)
    known = np.where(vocabulary[at] == chunk.distinct, at, -1)[chunk.number]
    hit = np.nonzero(known >= 0)[0]
    begin = first[known[hit]]
    count = first[known[hit] + 1] - begin
    place = np.repeat(hit, count)
    item = items[np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)]
    order = np.argsort(item, kind="stable")
    return place[order], item[order]


def plausible(chunk: Chunk, candidates: Candidates, q: Queries, rare: tuple[np.ndarray, np.ndarray]) -> Candidates:
    """The candidates whose area has as many rare words of the item as every match holds."""
    doc, item, start, end = candidates
    low, high = areas(chunk, candidates, q)
    place, owner = rare
    total = len(chunk.words) + 1
    keys = owner * total + place
    ok = np.searchsorted(keys, item * total + high) - np.searchsorted(keys, item * total + low) >= q.least[item]
    return doc[ok], item[ok], start[ok], end[ok]


def complete(chunk: Chunk, q: Queries, rare: tuple[np.ndarray, np.ndarray]) -> Candidates:
    """Of windows of the item's size that begin at blocks, all that ``judge`` could accept."""
    out = [np.zeros((4, 0), np.int64)]
    place, item = rare
    if not len(place):
        return tuple(out[0])
    lengths, offsets = chunk.lengths, chunk.offsets
    doc = np.searchsorted(offsets, place, side="right") - 1
    sizes = np.array([w for w, _ in WINDOWS])[q.tier]
    reaches = np.array([reach(len(h), w) for h, w in zip(q.hashes, sizes)])
    last = np.arange(len(place)) + q.least[item] - 1
    inside = last < len(place)
    last = np.minimum(last, len(place) - 1)
    ok = inside & (item[last] == item) & (doc[last] == doc) & (place[last] - place < reaches[item])
    doc, item, begins, ends = doc[ok], item[ok], (place - offsets[doc])[ok], (place[last] - offsets[doc])[ok]
    margin = np.maximum(q.lengths[item], 8)
    low = np.maximum(0, -(-(ends - sizes[item] - margin + 1) // STEP) * STEP)
    high = np.minimum(begins + margin, np.maximum(0, lengths[doc] - sizes[item] // 2 - 1)) // STEP * STEP
    some = low <= high
    doc, item, low, high = doc[some], item[some], low[some], high[some]
    if not len(doc):
        return tuple(out[0])
    # regions: first and last starts of windows of a document and an item; those that overlap are joined. Both ends grow with the place
    new = np.nonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1] + STEP)]))[0]
    doc, item, low, high = doc[new], item[new], low[new], high[np.append(new[1:], len(high)) - 1]
    # pieces of a few windows: what the text around all of them cannot hold, none of them holds
    span = np.maximum(q.lengths[item] // STEP, 8) * STEP
    count = (high - low) // span + 1
    region = np.repeat(np.arange(len(doc)), count)
    start = low[region] + (np.arange(len(region)) - (np.cumsum(count) - count)[region]) * span[region]
    doc, item, stop = doc[region], item[region], np.minimum(start + span[region] - STEP, high[region])
    margin = np.maximum(q.lengths[item], 8)
    low, high = offsets[doc] + np.maximum(start - margin, 0), offsets[doc] + np.minimum(stop + sizes[item] + margin, lengths[doc])
    fewest = np.array([needed(len(h)) for h in q.hashes])[item]
    for some, marks in marked_areas(chunk, q, item, low, high):
        for at in np.nonzero(held(marks) >= fewest[some])[0].tolist():
            k = some[at]
            if lcs_marked(len(q.hashes[item[k]]), as_numbers(marks[:, at])) >= fewest[k]:
                begin = np.arange(start[k], stop[k] + 1, STEP)
                out.append(np.stack([np.full(len(begin), doc[k]), np.full(len(begin), item[k]), begin, np.minimum(begin + sizes[item[k]], lengths[doc[k]])]))
    return tuple(np.concatenate(out, axis=1))


def areas(chunk: Chunk, candidates: Candidates, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """The words around each window that ``judge`` reads, as [low, high) of the chunk."""
    doc, item, start, end = candidates
    n = q.lengths[item]
    margin = np.maximum(np.maximum(n - (end - start) // 2, n // 3), 8)
    return chunk.offsets[doc] + np.maximum(start - margin, 0), chunk.offsets[doc] + np.minimum(end + margin, chunk.lengths[doc])


def best_item(chunk: Chunk, candidates: Candidates, q: Queries) -> dict[int, dict[int, float]]:
    """For each document the contaminating items and their shares, as ``judge`` has them. Where the words of the area, in whatever
    order, are too few for a match, there is none."""
    found: dict[int, dict[int, float]] = {}
    doc, item, start, end = candidates
    once = np.unique(item * (len(chunk.words) + 1) + chunk.offsets[doc] + start, return_index=True)[1]
    doc, item = doc[once], item[once]
    low, high = areas(chunk, (doc, item, start[once], end[once]), q)
    n = q.lengths[item]
    answer = np.minimum(n, np.maximum(n // 4, 4))
    for some, marks in marked_areas(chunk, q, item, low, high):
        most = held(marks) / n[some]
        may = (most >= LCS_SHARE) | ((most >= PARAPHRASE_SHARE) & (held(marks, (n - answer)[some]) >= ANSWER_SHARE * answer[some]))
        for at in np.nonzero(may)[0].tolist():
            k = some[at]
            d, i, size, last = int(doc[k]), int(item[k]), int(n[k]), int(answer[k])
            if found.get(d, {}).get(i, 0.0) < 1.0:
                area = as_numbers(marks[:, at])
                share = lcs_marked(size, area) / size
                if share >= LCS_SHARE or share >= PARAPHRASE_SHARE and lcs_marked(last, [m >> (size - last) for m in area]) >= ANSWER_SHARE * last:
                    found.setdefault(d, {})[i] = max(share, found.get(d, {}).get(i, 0.0))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
                 item_text: str = "text", rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``docs``: id, contaminated, n_items, item_id (the best one, null if none), share (of its words)."""
    spark = docs.sparkSession
    asked = benchmark.select(column(item_id).alias("item"), column(item_text).cast("string").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > 8 * MAX_QUERY_WORDS:
        raise ValueError(f"the benchmark has {size} characters; more than the broadcast bound. Split it into several calls")
    items = sorted(((r["item"], r["text"]) for r in asked.collect()), key=lambda r: (r[0] is None, r[0]))
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    hashed = hashed_words(rows)
    idf = weights_of(*document_frequency(hashed))
    basis = latent_basis(hashed, idf, rank)
    shared = spark.sparkContext.broadcast(prepare(items, idf, basis))
    types = {**dict(rows.dtypes), "item": dict(asked.dtypes)["item"]}

    def fn(ids, docs_words):
        embedding, q = shared.value
        results: list = [None] * len(ids)
        some: list[tuple[int, np.ndarray]] = []
        size = 0

        def work():
            chunk = Chunk([h for _, h in some])
            rare = rare_places(chunk, q)
            both = zip(plausible(chunk, search(chunk, embedding, q, cosine), q, rare), complete(chunk, q, rare))
            for d, per_item in best_item(chunk, tuple(map(np.concatenate, both)), q).items():
                results[some[d][0]] = per_item
            some.clear()

        for at, d in enumerate(docs_words):
            h = np.frombuffer(d, np.uint32)
            some.append((at, h))
            size += len(h)
            if size >= CHUNK_WORDS:
                work()
                size = 0
        if some:
            work()
        best = [max(r.items(), key=lambda x: (x[1], -x[0])) if r else None for r in results]
        return (ids, [r is not None for r in results], [len(r or ()) for r in results],
                [q.ids[b[0]] if b else None for b in best], [b[1] if b else 0.0 for b in best])

    return map_rows(hashed, fn, ["id", "words"], f"id {types['id']}, contaminated boolean, n_items bigint, item_id {types['item']}, share double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns. Each row is judged by its own text, also where
    ids are null or repeated."""
    found = contaminated(row_keys(docs, text, doc_id), benchmark, text="text", doc_id="id", **options)
    return without(docs, found.filter("contaminated"), text, doc_id)
