"""Near-duplicate detection by min-max hashing.

Every document becomes the set of its distinct word shingles. One permutation of the shingle hashes gives two signature
values, the minimum and the maximum; each matches between two documents with the probability of their Jaccard similarity, so
half the permutations give a signature of the same length. The signature is cut into bands of ``ROWS`` values, as
many bands as make a miss at the threshold rarer than ``MISS``.

Documents of equal sets are one class and are represented by one row from then on. Classes that share a band are
candidates. Candidates are never expanded into all pairs of a band: in each round a few members of a band are hubs, and
hubs meet the members that are not yet known to be in their component. Members of too different a size are left out, and so are those
whose sketches (one bit of each of ``SKETCH`` signature values) differ in more places than linked documents do but once in
``MISS`` cases. From the second round on, so are pairs that cannot have enough shingles in common by what both share with a third member
(``overlaps``), which decides most pairs of copies of one text that are near the threshold, and exactly so.
Rounds go on until every band is in one component or all its pairs are decided, so nothing is lost to a cap. Every link is confirmed on
the full sets of both documents. Components come from repeated star contraction.

Defined results: words are lower-cased in A-Z only and split at ASCII white space; a document with fewer words than a shingle has one shingle,
its word sequence; null, empty and blank texts have none, link with nothing and are kept; of a component the smallest
id stays; rows that repeat an id count as one document of several texts and stay or go together; null ids sort last,
and rows of a component without any id are all kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from statwitness.llm.common import column, map_rows, materialise, mix64, row_keys, shingle_set, without
from statwitness.operators.ordered import top_n

ROWS = 7  # signature values in a band
MISS = 1e-4  # chance that a pair at the threshold shares no band
HUB_GROWTH = 16  # hubs of a band in round i: HUB_GROWTH ** i
SKETCH = 1024  # signature values that give a bit to the sketch, a multiple of 64
ASKED_BITS = 1 << 26  # of the map that says whose texts are read again
MAP_BITS = 1 << 15  # of a row of that map, as bitmap_construct_agg has it


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def sketch_bound(threshold: float, values: int = SKETCH, miss: float = MISS) -> int:
    """Most differing bits of two sketches: a bit differs with probability (1 - J) / 2."""
    q = (1 - threshold) / 2
    below, term, d = 0.0, (1 - q) ** values, 0
    while below + term < 1 - miss:
        below += term
        d += 1
        term *= (values - d + 1) / d * q / (1 - q)
    return d


def differing(a: str, b: str) -> Column:
    """In how many bits two sketch columns differ."""
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH // 64)]
    return sum(words[1:], words[0])


class Signer:
    """Band keys and sketch of a shingle set."""

    COLUMNS = 1024  # shingles worked on at once

    def __init__(self, bands: int, rows: int = ROWS, sketch: int = SKETCH, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.sketch = bands, rows, sketch
        n = max(-(-bands * rows // 2), sketch // 2)
        self.factors = (rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1))[:, None]
        self.shifts = rng.integers(0, 1 << 64, n, np.uint64)[:, None]
        self.salts = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The minimum of the set under each permutation, then the maxima."""
        low = high = None
        for at in range(0, len(shingles), self.COLUMNS):
            v = self.factors * shingles[None, at : at + self.COLUMNS]
            v += self.shifts
            lo, hi = v.min(axis=1), v.max(axis=1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.stack([low, high])

    def describe(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sig = self.signature(shingles)
        half = -(-self.bands * self.rows // 2)
        # a permutation's minimum and maximum go to different bands
        values = sig[:, :half].reshape(-1)[: self.bands * self.rows].reshape(self.rows, self.bands).T
        mixed = mix64(values ^ self.salts)
        key = np.zeros(self.bands, np.uint64)
        for j in range(self.rows):
            key = mix64(key + mixed[:, j])
        bits = (mix64(sig[:, : self.sketch // 2].reshape(-1)) >> np.uint64(63)).astype(np.uint8)
        return key.view(np.int64), np.packbits(bits).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Near(NamedTuple):
    documents: DataFrame  # id, n_shingles, component_id, kept: a row per row
    links: DataFrame  # a, b: linked classes, with shared and joined sizes


def features(docs: DataFrame, k: int, threshold: float, text: str, doc_id: str) -> DataFrame:
    """id, set size, digest of the set, band keys, sketch; the last three null for the empty set."""
    signer = Signer(bands_for(threshold))

    def described(text):
        s = shingle_set(text, k)
        return (len(s), _digest(s), *signer.describe(s)) if len(s) else (0, None, None, None)

    def fn(ids, texts):
        # one set at a time: those of a batch together are as large as its texts
        rows = [described(t) for t in texts]
        return ids, *([row[i] for row in rows] for i in range(4))

    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    return map_rows(rows, fn, ["id", "text"], f"id {dict(rows.dtypes)['id']}, n bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def likely(rows: DataFrame, wanted: DataFrame, key: str = "id", among: str = "rep") -> DataFrame:
    """The rows whose ``key`` is in the column ``among`` of ``wanted``, and a few others whose hash meets the same bit of a map of fixed size."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(ASKED_BITS))
    bits = wanted.select(place(among).alias("_at")).select(F.floor(F.col("_at") / MAP_BITS).alias("_row"), (F.col("_at") % MAP_BITS).alias("_bit"))
    # one row of the map is made in one place: its rows are few and small, parts of them would be as large as the whole
    maps = bits.distinct().repartition("_row").groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    placed = rows.withColumn("_at", place(key)).withColumn("_row", F.floor(F.col("_at") / MAP_BITS))
    byte = F.conv(F.hex(F.expr(f"substring(_map, cast(_at % {MAP_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = placed.join(F.broadcast(maps), "_row").filter(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1)
    return met.select(*rows.columns)


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, text: str, doc_id: str) -> DataFrame:
    """digest and shingle set (sorted 64-bit hashes as bytes) of the wanted classes (digest, rep)."""
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    found = wanted.join(likely(rows, wanted), F.col("rep").eqNullSafe(F.col("id"))).select("digest", "text")

    def fn(digests, texts):
        out = []
        for d, t in zip(digests, texts):
            s = shingle_set(t, k)
            out.append((d, s.tobytes()) if _digest(s) == d else (None, None))
        return list(zip(*out)) if out else ([], [])

    return map_rows(found, fn, ["digest", "text"], "digest binary, shingles binary").filter("digest is not null").groupBy("digest").agg(F.first("shingles").alias("shingles"))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and the exact sizes of intersection and union of their sets."""
    both = (pairs.select("a", "b").join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a"))

    def fn(a, b, sa, sb):
        shared, joined, last, held = [], [], None, None
        for x, p, q in zip(a, sa, sb):
            if x != last:
                last, held = x, np.frombuffer(p, np.uint64)
            other = np.frombuffer(q, np.uint64)
            small, large = (held, other) if len(held) <= len(other) else (other, held)
            at = np.searchsorted(large, small)
            n = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            shared.append(n)
            joined.append(len(held) + len(other) - n)
        return a, b, shared, joined

    return map_rows(both, fn, ["a", "b", "sa", "sb"], "a binary, b binary, shared bigint, joined bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node of each connected component, by alternating star contraction. Each step keeps
    the components and brings nodes nearer to their smallest one; it ends when every node has one edge, to a node without any."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
            edges.select("v", F.lit(0), F.lit(1)))
        unfinished = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out > 0 and in > 0)")
        if unfinished.isEmpty():
            break
        # every neighbour above a node goes to the node's smallest neighbour
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # every neighbour below a node, and the node, go to the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def overlaps(members: DataFrame, sets: DataFrame) -> DataFrame:
    """What bounds the intersections of members, by digest: core, how many of its shingles some other member has too; ref, a member that
    shares a band with it, the same one for most copies of a text; mask, which shingles of ref it has; extra, how many shingles of its core ref
    does not have. Two members of one ref share at most the common bits of their masks and the smaller extra, others at most the smaller core."""
    asked = members.select("digest", "n").distinct().join(sets, "digest")

    def listed(digests, packed):
        owners, shingles = [], []
        for d, p in zip(digests, packed):
            found = np.frombuffer(p, np.int64)
            owners += [d] * len(found)
            shingles.append(found)
        return owners, np.concatenate(shingles) if shingles else []

    single = map_rows(asked, listed, ["digest", "shingles"], "digest binary, shingle bigint").groupBy("shingle").agg(
        F.count("*").alias("c"), F.min("digest").alias("digest")).filter("c = 1").groupBy("digest").agg(F.count("*").alias("own"))
    cores = materialise(asked.select("digest", "n").join(single, "digest", "left").select("digest", (F.col("n") - F.coalesce("own", F.lit(0))).alias("core")))
    # the member with most in common with the others: what it does not have, few others have
    placed = members.select("bucket", "digest").join(cores, "digest")
    most = placed.groupBy("bucket").agg(F.max(F.struct("core", F.col("digest").alias("ref"))).alias("most"))
    refs = placed.join(most, "bucket").groupBy("digest").agg(F.max("most")["ref"].alias("ref"))
    both = asked.select("digest", "shingles").join(cores, "digest").join(refs, "digest").join(
        sets.select(F.col("digest").alias("ref"), F.col("shingles").alias("of_ref")), "ref")

    def masked(digests, core, ref, shingles, of_ref):
        masks, extra = [], []
        for c, p, q in zip(core, shingles, of_ref):
            mine, other = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            there = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
            masks.append(np.packbits(np.append(there, np.zeros(-len(there) % 64, bool))).view(np.int64))
            extra.append(max(0, c - int(there.sum())))  # ref has its own shingles too, which are in no core
        return digests, core, ref, masks, extra

    return map_rows(both, masked, ["digest", "core", "ref", "shingles", "of_ref"], "digest binary, core bigint, ref binary, mask array<bigint>, extra bigint")


def undecided(members: DataFrame, threshold: int) -> DataFrame:
    """The members of bands that are in several components, without those whose core is too small for a link with any set as small as the
    smallest of the band: 100 * core >= threshold * (n + other - core) must hold."""
    lows = members.groupBy("bucket").agg(F.min("n").alias("fewest"))
    able = members.join(lows, "bucket").filter((100 + threshold) * F.col("core") >= threshold * (F.col("n") + F.col("fewest"))).drop("fewest")
    still = able.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    return able.join(still, "bucket")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, text: str = "text", doc_id: str = "doc_id") -> Near:
    """Documents linked where 100 * intersection >= ``threshold`` * union of their sets of ``k``-word shingles."""
    spark = docs.sparkSession
    share = threshold / 100
    feats = materialise(features(docs, k, share, text, doc_id))
    classes = materialise(feats.filter("digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    keyed = classes.select("digest", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "band", "digest")
    shared_keys = keyed.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    members = materialise(keyed.join(shared_keys, "bucket").join(classes.select("digest", "n", "sketch", "bands"), "digest"))
    wanted = members.select("digest").distinct().join(classes.select("digest", "rep"), "digest")
    sets = materialise(sets_of(docs, wanted, k, text, doc_id))
    empty_pairs = spark.createDataFrame([], "a binary, b binary, shared bigint, joined bigint")
    verified, comps, hubs_done, asked = empty_pairs, None, None, sets
    held = ["bucket", "band", "digest", "n", "core", "ref", "mask", "extra", "sketch", "bands", "component"]
    members, turn = members.withColumns({"component": F.col("digest"), "core": F.col("n"), "ref": F.lit(None).cast("binary"), "mask": F.lit(None).cast("array<bigint>"),
                                        "extra": F.lit(None).cast("bigint")}).select(*held), 0
    while True:
        if turn:
            # a band is decided when all its members that were no hubs are in one component
            placed = members.join(comps.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
            left = materialise(undecided(placed.join(hubs_done, ["bucket", "digest"], "left_anti"), threshold).select(*held))
            if left.isEmpty():
                break
            asked = likely(sets, left, "digest", "digest")
            bounded = left.drop("core", "ref", "mask", "extra").join(overlaps(left, asked), "digest")
            members = materialise(undecided(bounded, threshold).select(*held))
        if members.isEmpty():
            break
        if turn == 0:
            hubs = members.groupBy("bucket").agg(F.min(F.struct("digest", *[c for c in held[1:] if c not in ("band", "digest")])).alias("h")).select("bucket", "h.*")
        else:
            # members of small components first: they are the ones still undecided
            sized = members.join(members.groupBy("bucket", "component").agg(F.count("*").alias("size")), ["bucket", "component"])
            hubs = top_n(sized, ["bucket"], [F.col("size"), F.xxhash64("digest"), F.col("digest")], HUB_GROWTH**turn).select(*[c for c in held if c != "band"])
        hubs = materialise(hubs)
        h = hubs.select("bucket", F.col("digest").alias("h"), F.col("n").alias("hn"), F.col("core").alias("hcore"), F.col("ref").alias("href"), F.col("mask").alias("hmask"), F.col("extra").alias("hextra"), F.col("sketch").alias("hs"), F.col("bands").alias("hb"), F.col("component").alias("hc"))
        common = F.aggregate(F.zip_with("mask", "hmask", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda total, x: total + x)
        most = F.when(F.col("ref") == F.col("href"), common + F.least("extra", "hextra")).otherwise(F.least("core", "hcore"))
        # of two hubs of a band only the larger one meets the other
        marked = members.join(hubs.select("bucket", "digest", F.lit(True).alias("is_hub")), ["bucket", "digest"], "left")
        pairs = marked.join(h, "bucket").filter(
            (F.col("is_hub").isNull() | (F.col("digest") > F.col("h")))
            & (F.col("component") != F.col("hc")) & (100 * F.least("n", "hn") >= threshold * F.greatest("n", "hn"))
            & (differing("sketch", "hs") <= sketch_bound(share))
            # a pair is made in the first band that it shares, not in each
            & (F.array_position(F.zip_with("bands", "hb", lambda x, y: x == y), True) == F.col("band") + 1)
            & ((100 + threshold) * most >= threshold * (F.col("n") + F.col("hn"))))
        pairs = pairs.select(F.least("digest", "h").alias("a"), F.greatest("digest", "h").alias("b")).distinct()
        new = materialise(verify(pairs, asked))
        linked = 100 * F.col("shared") >= threshold * F.col("joined")
        verified = verified.union(new)
        if comps is None or not new.filter(linked).isEmpty():
            comps = components(verified.filter(linked))
        hubs_done = hubs.select("bucket", "digest") if hubs_done is None else materialise(hubs_done.union(hubs.select("bucket", "digest")))
        members = members.drop("component")
        turn += 1
    links = verified.filter(100 * F.col("shared") >= threshold * F.col("joined"))
    ids = classes.select("digest", "rep")
    if comps is not None:
        labelled = ids.join(comps.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
        smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
        ids = labelled.join(smallest, "component").select("digest", "component_id")
    else:
        ids = ids.select("digest", F.col("rep").alias("component_id"))
    ids = ids.withColumn("classed", F.lit(True))
    # a document without shingles is its own component
    out = feats.select("id", "n", "digest").join(ids, "digest", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("classed"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return Near(out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))), links)


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are one document where both id and text are the same."""
    found = near_duplicates(row_keys(docs, text, doc_id), k, threshold, "text", "id").documents
    return without(docs, found.filter(~F.col("kept")), text, doc_id)
