"""Language-model scores by logistic context mixing, bit by bit.

A text is a sequence of tokens, words in lower case (A-Z) and one end; a token is coded as its bytes and a space, the end
as the space alone, so the code words of a text form a proper prefix code and the probability of a text is that of its bits.
Each bit is predicted in six hashed contexts: the one to four bytes before it in the text, whichever tokens they belong to (spaces before its
start), all bytes of the token so far, and those together with the text's last frequent word (one of the ``FREQUENT`` most frequent short words,
which tells languages and registers apart). Every (context, bits of the byte so far) has a slot in the table of its context.

Four bytes reach over the start of a token from its first ``JOINT`` bytes only. So a token is coded in two parts: its joint, that is the ``JOINT``
bytes of text before it (but for the space between) with its first ``JOINT`` bytes, and the bytes behind those, which depend on the word alone.
Joints are few and frequent, so that the model meets every one of them once, as it does every word.

Learning, all of it over all training texts:

1. Tokens and joints are counted per (last frequent word, word or joint), in two folds of the documents.
2. Tasks over words and joints add the counts of both folds into tables of ``SLOTS`` slots and send the touched blocks; blocks are summed and
   turned into 16-bit states (quantised odds and amount). The size of the tables is fixed; what is sent to build them grows with the words.
   A token or pair met once teaches the short contexts only: its long contexts would fill the tables with paths never taken again.
3. On the smaller fold, with states of the larger one, each state gets the odds that were then seen (a table of states per context), so a context
   that was met once is believed as far as such contexts deserve.
4. Again on the smaller fold, in one pass over a stream in each task, weights gated by how often the two long contexts were met and by the
   place of the bit are learned online by gradient steps, and a last table (byte before, mixed odds) refines the mix adaptively. Tasks'
   weights are averaged by the mass they saw.

Scoring evaluates the model once per (last frequent word, word or joint) of the corpus. The most frequent pairs (``HEAD`` with words, twice as many with joints) are broadcast and
summed where the texts are read; the rest, each of bounded frequency, meets its texts in a join. The model is fixed while scoring, so that a score
depends on the text alone and a lost task is repeated alike. The baseline, add-0.1 unigram log-probability, uses the same counts.

Defined results: null and empty texts have one token, the end; a null id counts as empty text in the split; repeated rows are rows of their own; a
token of any length is coded whole; without training documents the baseline is null (its formula divides by zero) and the score is that of the
uniform model; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from statwitness.llm.common import column, materialise, mix64

FREQUENT = 6  # words that serve as context of the words after them
FREQUENT_BYTES = 6  # their greatest length
SLOTS = 1 << 22  # slots of a context's table
BLOCK = 1 << 12  # slots sent together
ORDERS = 6
JOINT = 3  # bytes of a token whose contexts reach over its start, and bytes before it that they reach
WORDS_PER_TABLE = 700_000  # words whose counts one task adds up before it sends its tables
HEAD = 1 << 19  # pairs of words that are broadcast, of at most HEAD_BYTES bytes each, and twice as many of joints
HEAD_BYTES = 64
SLICE = 1 << 23  # bytes of text whose tokens are counted together
JOINTS_HELD = 1 << 19  # joints (of a fold) whose counts a task adds up before it sends them
JOINT_ROWS = 1 << 16  # of them that become rows at once
JOINT_PARTS = 128  # parts by hash in which they are added
SCORED_SLICE = 1 << 21  # bytes of text scored together
BYTES = 1 << 17  # bytes coded at once
STEP_BYTES = 1 << 14  # bytes of a gradient step, while learning weights
ODDS, AMOUNTS = 128, 16  # levels of a state
STATES = ODDS * AMOUNTS
GATES = AMOUNTS * AMOUNTS, 8 * 8
BUCKETS = 64  # levels of mixed odds in the last table
END = b""
_P = np.uint64(0x9E3779B97F4A7C15)


def base_parts(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


# --- contexts and slots -----------------------------------------------------------------------


class Coded(NamedTuple):
    """Tokens as bytes, one after the other."""

    data: np.ndarray  # bytes
    token: np.ndarray  # number of the token of each byte
    place: np.ndarray  # position in the token
    starts: np.ndarray  # of the tokens
    before: np.ndarray | None = None  # tokens x JOINT: the bytes of text before each token and its space; None: spaces


def code(tokens: list[bytes], before: np.ndarray | None = None) -> Coded:
    data = np.frombuffer(b" ".join(tokens) + b" ", np.uint8)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    token = np.repeat(np.arange(len(tokens)), lengths)
    starts = np.cumsum(lengths) - lengths
    return Coded(data, token, np.arange(len(data)) - starts[token], starts, before)


def context_of(coded: Coded, order: int) -> np.ndarray:
    """Hash of the ``order`` + 1 bytes of text before each byte, or of all before it in its token for the last order."""
    if order == ORDERS - 2:
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(coded.place.max()) + 1, 0xD1342543DE82EF95, np.uint64))
            sums = np.cumsum((coded.data.astype(np.uint64) + np.uint64(1)) * powers[coded.place])
            before = np.concatenate([np.zeros(1, np.uint64), sums[:-1]])
            return mix64((before - before[coded.starts][coded.token]) + coded.place.astype(np.uint64) * _P)
    near = np.zeros(len(coded.data), np.uint64)
    for back in range(1, order + 2):
        before = np.full(len(coded.data), 32, np.uint64)
        before[back:] = coded.data[:-back] if back < len(coded.data) else 0
        before[coded.place < back] = 32
        if coded.before is not None:
            over = np.nonzero(coded.place < back - 1)[0]  # over the space, which stands at place -1
            before[over] = coded.before[coded.token[over], JOINT + 1 - back + coded.place[over]]
        near = near * np.uint64(257) + before
    return mix64(near * _P + np.uint64(order + 1))


def with_frequent(context: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return mix64(context ^ (frequent.astype(np.uint64) + np.uint64(1)) * _P)


def slots_of(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Slot of a context at a node of the byte's bit tree."""
    return ((context + node.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(42)).astype(np.int64) & (SLOTS - 1)


def batches_of(lengths: list[int], size: int) -> Iterator[slice]:
    """Runs of tokens of about ``size`` bytes."""
    at = total = 0
    for i, n in enumerate(lengths):
        total += n + 1
        if total >= size:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(lengths):
        yield slice(at, len(lengths))


class Places(NamedTuple):
    """Which bytes of a token a row of the vocabulary stands for."""

    low: int
    high: float

    def of(self, coded: Coded) -> np.ndarray:
        return (coded.place >= self.low) & (coded.place < self.high)


WHOLE, BEHIND, FIRST = Places(0, math.inf), Places(JOINT, math.inf), Places(0, JOINT)


class Pairs(NamedTuple):
    """(last frequent word, token) pairs of a run of tokens, spread to bytes."""

    coded: Coded
    byte: np.ndarray  # the pairs' bytes as positions in coded.data
    pair: np.ndarray  # number of the pair of each of them
    frequent: np.ndarray  # per byte


def spread(tokens: list[bytes], owner: np.ndarray, frequent: np.ndarray, before: np.ndarray | None = None, places: Places = WHOLE) -> Pairs:
    """owner: token number of each pair."""
    coded = code(tokens, before)
    lengths = np.bincount(coded.token, minlength=len(tokens))
    starts = np.cumsum(lengths) - lengths
    per_pair = lengths[owner]
    pair = np.repeat(np.arange(len(owner)), per_pair)
    inside = np.arange(len(pair)) - np.repeat(np.cumsum(per_pair) - per_pair, per_pair)
    byte = starts[owner][pair] + inside
    if places != WHOLE:
        kept = places.of(coded)[byte]
        byte, pair = byte[kept], pair[kept]
    return Pairs(coded, byte, pair, frequent[pair])


# --- 2. tables ----------------------------------------------------------------------------------


class Run(NamedTuple):
    """Some rows of the vocabulary: tokens with the bytes before them and the places that the rows stand for; owner, frequent and counts of both folds per pair."""

    tokens: list[bytes]
    before: np.ndarray | None
    places: Places
    owner: np.ndarray
    frequent: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def spread(self, kept: np.ndarray | slice = slice(None)) -> Pairs:
        return spread(self.tokens, self.owner[kept], self.frequent[kept], self.before, self.places)


def _kinds(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Places]]:
    """The words and the joints of a batch; words without joints stand for all of their bytes."""
    if "joint" not in batch.schema.names:
        yield batch, WHOLE
        return
    joint = batch.column("joint")
    for part, places in ((batch.filter(pc.invert(joint)), BEHIND), (batch.filter(joint), FIRST)):
        if part.num_rows:
            yield part, places


def _vocabulary_batches(batches: Iterator[pa.RecordBatch], size: int = BYTES) -> Iterator[Run]:
    for batch in batches:
        for part, places in _kinds(batch):
            tokens, before = part.column("word").to_pylist(), None
            if places == FIRST:
                before = np.frombuffer(b"".join(t[:JOINT] for t in tokens), np.uint8).reshape(-1, JOINT)
                tokens = [t[JOINT:] for t in tokens]
            uses = part.column("uses")
            offsets = uses.offsets.to_numpy() - uses.offsets[0].as_py()
            flat = uses.flatten()
            f, a, b = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("frequent", "a", "b"))
            for run in batches_of([len(t) for t in tokens], size):
                lo, hi = offsets[run.start], offsets[run.stop]
                owner = np.repeat(np.arange(run.stop - run.start), np.diff(offsets[run.start:run.stop + 1]))
                yield Run(tokens[run], None if before is None else before[run], places, owner, f[lo:hi], a[lo:hi], b[lo:hi])


def _bits(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    node = np.ones(len(data), np.int64)
    for at in range(8):
        bit = (data >> np.uint8(7 - at)).astype(np.int64) & 1
        yield at, node, bit
        node = node * 2 + bit


def _smallest(values: np.ndarray) -> np.ndarray:
    top = int(values.max())
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def _pack(values: np.ndarray) -> bytes:
    small = _smallest(values)
    return bytes([small.itemsize]) + zlib.compress(small.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"u{packed[0]}").astype(np.int64)


def rows_of(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select([c for c in ("joint", "word", "uses") if c in vocabulary.columns])


def table_blocks(vocabulary: DataFrame) -> DataFrame:
    """order, block, a, b: summed counts (slot x bit) of the touched blocks of each task, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # contexts one after the other, so a task holds one table; the words (not their bits) are kept meanwhile
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= WORDS_PER_TABLE:
                yield from sent(held)
                held = []
        if held:
            yield from sent(held)

    def sent(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for order in range(ORDERS):
            tables = np.zeros((2, SLOTS * 2), np.int64)
            for run in _vocabulary_batches(iter(held)):
                # joints teach the contexts that reach over a token's start, words the others
                if order >= ORDERS - 2 and run.places == FIRST:
                    continue
                trained = (run.a + run.b) > (order == ORDERS - 1)
                if not trained.any():
                    continue
                if order < ORDERS - 1:
                    coded = code(run.tokens, run.before)
                    context, data = context_of(coded, order), coded.data
                    counts = [np.bincount(run.owner, weights=c, minlength=len(run.tokens)).astype(np.int64) for c in (run.a, run.b)]
                    often = counts[0] + counts[1] > (order == ORDERS - 2)
                    counts = [(c * often)[coded.token] for c in counts]
                    kept = counts[0] + counts[1] > 0
                    if order < ORDERS - 2 and run.places != WHOLE:
                        kept &= run.places.of(coded)
                    context, data, counts = context[kept], data[kept], [c[kept] for c in counts]
                else:
                    pairs = spread(run.tokens, run.owner[trained], run.frequent[trained])
                    context, data = with_frequent(context_of(pairs.coded, ORDERS - 2)[pairs.byte], pairs.frequent), pairs.coded.data[pairs.byte]
                    counts = [c[trained][pairs.pair] for c in (run.a, run.b)]
                used = [np.nonzero(c)[0] for c in counts]
                for _, node, bit in _bits(data):
                    at = slots_of(context, node) * 2 + bit
                    for table, c, u in zip(tables, counts, used):
                        np.add.at(table, at[u], c[u])
            shaped = tables.reshape(2, SLOTS // BLOCK, BLOCK * 2)
            for block in np.nonzero(shaped.any(axis=(0, 2)))[0]:
                yield pa.RecordBatch.from_pydict({"order": pa.array([order], pa.int32()), "block": pa.array([block], pa.int32()),
                                                  "a": pa.array([_pack(shaped[0, block])], pa.binary()), "b": pa.array([_pack(shaped[1, block])], pa.binary())})

    return rows_of(vocabulary).mapInArrow(run, "order int, block int, a binary, b binary")


def states_of(counts: np.ndarray) -> np.ndarray:
    """16-bit states from counts (slot, bit); 0 is a slot never met."""
    pairs = counts.reshape(-1, 2)
    n = pairs.sum(axis=1)
    odds = np.log((pairs[:, 1] + 0.4) / (pairs[:, 0] + 0.4))
    level = np.clip(np.rint((odds + 10) * ((ODDS - 1) / 20)), 0, ODDS - 1).astype(np.int64)
    amount = np.minimum(np.log2(n + 1).astype(np.int64), AMOUNTS - 1)
    return np.where(n > 0, amount * ODDS + level, 0).astype(np.uint16)


class Tables:
    """The states of all contexts as compressed blocks, unpacked where they are used."""

    def __init__(self, blocks: list[tuple[int, int, bytes]]):
        self.blocks = blocks

    def __getstate__(self):
        return self.blocks

    def __setstate__(self, blocks) -> None:
        self.blocks = blocks

    @cached_property
    def array(self) -> np.ndarray:
        """ORDERS x SLOTS."""
        out = np.zeros((ORDERS, SLOTS), np.uint16)
        for order, block, packed in self.blocks:
            out[order, block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(zlib.decompress(packed), np.uint16)
        return out


def state_tables(blocks: DataFrame) -> tuple[Tables, Tables]:
    """States of the larger fold, and of both. Blocks are summed in tasks; the tables' size is fixed."""

    def summed(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BLOCK * 2), np.int64)
        for part in parts:
            for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
                both[0] += _unpack(a)
                both[1] += _unpack(b)
        yield pa.RecordBatch.from_pydict({"order": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()),
                                          "larger": pa.array([zlib.compress(states_of(both[0]).tobytes(), 1)], pa.binary()), "all": pa.array([zlib.compress(states_of(both.sum(axis=0)).tobytes(), 1)], pa.binary())})

    rows = blocks.groupBy("order", "block").applyInArrow(summed, "order int, block int, larger binary, all binary")
    found = rows.toArrow()  # at most ORDERS * SLOTS / BLOCK rows, compressed
    order, block = found.column("order").to_pylist(), found.column("block").to_pylist()
    return tuple(Tables(list(zip(order, block, found.column(c).to_pylist()))) for c in ("larger", "all"))


# --- 3. and 4. odds of states, weights, refinement ------------------------------------------


class Model(NamedTuple):
    odds: np.ndarray  # ORDERS x STATES
    weights: tuple[np.ndarray, np.ndarray]  # gate x (ORDERS + 1) each
    refined: np.ndarray  # byte before x BUCKETS: odds


def first_weights() -> tuple[np.ndarray, np.ndarray]:
    """Before learning, the longest contexts lead."""
    start = np.zeros((GATES[1], ORDERS + 1))
    start[:, :ORDERS] = [0.05, 0.05, 0.1, 0.1, 0.3, 0.4]
    return np.zeros((GATES[0], ORDERS + 1)), start


def bit_states(pairs: Pairs, tables: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per bit of the bytes: states (ORDERS x bytes of pairs), gates (2 x bytes), bits."""
    coded = pairs.coded
    data = coded.data[pairs.byte]
    used = np.zeros(len(coded.data), bool)
    used[pairs.byte] = True
    byte = (np.cumsum(used) - 1)[pairs.byte]
    contexts = [context_of(coded, order)[used] for order in range(ORDERS - 1)]
    last = with_frequent(contexts[-1][byte], pairs.frequent)
    place = np.minimum(coded.place[pairs.byte], 7) * 8
    for (at, node, bit), (_, own_node, _) in zip(_bits(data), _bits(coded.data[used])):
        states = np.empty((ORDERS, len(data)), np.uint16)
        for order in range(ORDERS - 1):
            states[order] = tables[order][slots_of(contexts[order], own_node)][byte]
        states[-1] = tables[-1][slots_of(last, node)]
        gates = np.stack([(states[-2] // ODDS).astype(np.int64) * AMOUNTS + states[-1] // ODDS, place + at])
        yield states, gates, bit


def inputs_of(states: np.ndarray, odds: np.ndarray) -> np.ndarray:
    x = np.ones((ORDERS + 1, states.shape[1]), np.float32)
    for order in range(ORDERS):
        x[order] = odds[order][states[order]]
    x[-1] = 0.3
    return x


def mixed(x: np.ndarray, gates: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    total = np.zeros(x.shape[1], np.float32)
    for k in range(ORDERS + 1):
        total += (weights[0][:, k][gates[0]] + weights[1][:, k][gates[1]]) * x[k]
    return np.clip(total, -14, 14)


def bucket_of(total: np.ndarray) -> np.ndarray:
    return np.clip(((total + 8) * (BUCKETS / 16)).astype(np.int64), 0, BUCKETS - 1)


def _before(pairs: Pairs) -> np.ndarray:
    """The byte before each byte, a space at the start of a token."""
    coded = pairs.coded
    shifted = np.concatenate([[32], coded.data[:-1]])
    return np.where(coded.place == 0, 32, shifted)[pairs.byte]


def _smaller_fold(batches: Iterator[pa.RecordBatch], size: int = BYTES) -> Iterator[tuple[Pairs, np.ndarray]]:
    for run in _vocabulary_batches(batches, size):
        seen = run.b > 0
        if seen.any():
            pairs = run.spread(seen)
            if len(pairs.byte):
                yield pairs, run.b[seen][pairs.pair].astype(np.float64)


def state_odds(vocabulary: DataFrame, tables) -> np.ndarray:
    """What the smaller fold did after each state; a state never met keeps the odds that it says itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ORDERS, STATES, 2))
        for pairs, mass in _smaller_fold(batches):
            for states, _, bit in bit_states(pairs, tables.value.array):
                for order in range(ORDERS):
                    counts[order] += np.bincount(states[order].astype(np.int64) * 2 + bit, weights=mass, minlength=STATES * 2).reshape(STATES, 2)
        order, state = np.nonzero(counts.any(axis=2))
        yield pa.RecordBatch.from_pydict({"order": pa.array(order, pa.int32()), "state": pa.array(state, pa.int32()),
                                          "zeros": pa.array(counts[order, state, 0]), "ones": pa.array(counts[order, state, 1])})

    said = (np.arange(STATES) % ODDS) * (20 / (ODDS - 1)) - 10
    said[0] = 0  # never met
    weak = np.where(np.arange(STATES) // ODDS < 2, 0.5, 1.0) * said
    counts = np.zeros((ORDERS, STATES, 2))
    rows = rows_of(vocabulary).mapInArrow(run, "order int, state int, zeros double, ones double")
    for r in rows.groupBy("order", "state").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect():  # ORDERS * STATES rows
        counts[r["order"], r["state"]] = r["zeros"], r["ones"]
    p = 1 / (1 + np.exp(-weak))
    ones, n = counts[..., 1] + 2 * p, counts.sum(axis=2) + 2
    p = np.clip(ones / n, 1e-5, 1 - 1e-5)
    return np.log(p / (1 - p)).astype(np.float32)


RATE = 0.02  # of a gradient step


def learn_weights(vocabulary: DataFrame, tables, odds: np.ndarray) -> Model:
    """Online gradient steps over each task's stream; weights averaged by mass; counts of the last table summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = first_weights()
        squares = [np.full(w.shape, 1e-8) for w in weights]
        met = [np.zeros(len(w)) for w in weights]
        last = np.zeros((256, BUCKETS, 2))
        for pairs, mass in _smaller_fold(batches, STEP_BYTES):
            before = _before(pairs)
            for states, gates, bit in bit_states(pairs, tables.value.array):
                x = inputs_of(states, odds)
                total = mixed(x, gates, weights)
                p = 1 / (1 + np.exp(-total))
                last += np.bincount((before * BUCKETS + bucket_of(total)) * 2 + bit, weights=mass, minlength=last.size).reshape(last.shape)
                error = (bit - p) * mass
                for side in range(2):
                    m = np.bincount(gates[side], weights=mass, minlength=GATES[side])
                    met[side] += m
                    for k in range(ORDERS + 1):
                        slope = np.bincount(gates[side], weights=error * x[k], minlength=GATES[side]) / (m + 1)
                        squares[side][:, k] += slope * slope
                        weights[side][:, k] += RATE * slope / np.sqrt(squares[side][:, k])
        out = [(side, g, met[side][g], (weights[side][g] * met[side][g]).tolist()) for side in range(2) for g in np.nonzero(met[side])[0]]
        used = np.argwhere(last.any(axis=2))
        out += [(2, int(c) * BUCKETS + int(u), 0.0, last[c, u].tolist()) for c, u in used]
        yield pa.RecordBatch.from_pydict({"side": pa.array([o[0] for o in out], pa.int32()), "gate": pa.array([o[1] for o in out], pa.int32()),
                                          "mass": pa.array([o[2] for o in out], pa.float64()), "sums": pa.array([o[3] for o in out], pa.list_(pa.float64()))})

    rows = rows_of(vocabulary).mapInArrow(run, "side int, gate int, mass double, sums array<double>")
    each = rows.select("side", "gate", "mass", F.posexplode("sums").alias("k", "value"))
    weights = first_weights()
    last = np.zeros((256 * BUCKETS, 2))
    for r in each.groupBy("side", "gate", "k").agg(F.sum("mass").alias("mass"), F.sum("value").alias("value")).collect():  # fixed number of rows
        if r["side"] == 2:
            last[r["gate"], r["k"]] = r["value"]
        else:
            weights[r["side"]][r["gate"], r["k"]] = r["value"] / r["mass"]
    middle = np.tile((np.arange(BUCKETS) + 0.5) * (16 / BUCKETS) - 8, 256)
    p = 1 / (1 + np.exp(-middle))
    p = (last[:, 1] + 20 * p) / (last.sum(axis=1) + 20)
    return Model(odds, tuple(w.astype(np.float32) for w in weights), (np.log(p / (1 - p)) - middle).reshape(256, BUCKETS).astype(np.float32))


def bits_of(pairs: Pairs, n_pairs: int, tables: np.ndarray, model: Model) -> np.ndarray:
    """Bits of each pair's token."""
    cost = np.zeros(len(pairs.byte))
    before = _before(pairs)
    for states, gates, bit in bit_states(pairs, tables):
        total = mixed(inputs_of(states, model.odds), gates, model.weights)
        total = total + model.refined[before, bucket_of(total)] / 2  # halfway between the mix and what was seen there
        cost += np.log1p(np.exp(np.where(bit == 1, -total, total)))  # total is between bounds
    return np.bincount(pairs.pair, weights=cost, minlength=n_pairs) / math.log(2)


# --- the corpus --------------------------------------------------------------------------------


class Learned(NamedTuple):
    vocabulary: DataFrame  # joint (whether the row is one: JOINT bytes before a token, then its first ones), word, c (training count), uses: array of (frequent, a, b, n)
    train_tokens: int
    train_words: int  # different tokens of training texts
    frequent: list[bytes]
    tables: Tables
    model: Model


class Tokens(NamedTuple):
    """The tokens of some texts: different tokens, and for each use its token, text, last frequent word and joint (a number of 50 bits)."""

    words: pa.Array  # binary
    word: np.ndarray
    text: np.ndarray
    frequent: np.ndarray
    joint: np.ndarray
    n_texts: int


def slices_of(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[slice, pa.Array]]:
    """Runs of texts of about ``size`` bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + size, "right")))
        yield slice(at, end), texts.slice(at, end - at)
        at = end


def _placed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of the type large_binary."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    buffer = words.buffers()[2]
    return offsets, np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(1, np.uint8)


def _begin(words: pa.Array, size: int) -> np.ndarray:
    """The first ``size`` bytes as a number, zeros where a word has fewer."""
    offsets, data = _placed(words)
    number = np.zeros(len(words), np.int64)
    for at in range(size):
        number = number << 8 | np.where(np.diff(offsets) > at, data[np.minimum(offsets[:-1] + at, len(data) - 1)], 0)
    return number


def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its last JOINT bytes, spaces where it has fewer, and its first JOINT bytes with their number, each as a number."""
    offsets, data = _placed(words)
    size = np.diff(offsets)
    last = np.zeros(len(words), np.int64)
    for back in range(JOINT, 0, -1):
        last = last << 8 | np.where(size >= back, data[np.maximum(offsets[1:] - back, 0)], 32)
    return last, _begin(words, JOINT) << 2 | np.minimum(size, JOINT)


def _joints(words: pa.Array, word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The joint of each use of a word: what stands before it in its text, words with one space between, and how it begins."""
    last, first = _ends(words)
    size = pc.binary_length(words).to_numpy()
    starts = np.concatenate([[True], text[1:] != text[:-1]])[:len(word)]
    before = np.where(starts, 0x202020, last[np.concatenate([word[:1], word[:-1]])])
    # behind a word of one byte the last byte of the word before it is in reach
    single = np.nonzero(~starts[2:] & ~starts[1:-1] & (size[word[1:-1]] == 1))[0] + 2
    before[single] = before[single] & 0xFFFF | (last[word[single - 2]] & 0xFF) << 16
    return before << 26 | first[word]


def joint_words(joints: np.ndarray) -> pa.Array:
    """Joints as the bytes before the token, then its first ones."""
    held = (joints >> 2).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - 2 * JOINT:]
    size = JOINT + (joints & 3)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = held[np.arange(2 * JOINT) < size[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(joints), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def joint_numbers(words: pa.Array) -> np.ndarray:
    """The reverse of ``joint_words``."""
    words = words.cast(pa.large_binary())
    return _begin(words, 2 * JOINT) << 2 | (pc.binary_length(words).to_numpy() - JOINT)


def read_tokens(texts: pa.Array, frequent: list[bytes]) -> Tokens:
    """Words in lower case (A-Z), split at the six ASCII white-space characters, and an end (the empty token) behind each text's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = np.diff(lists.offsets.to_numpy())
    encoded = pc.dictionary_encode(lists.flatten().cast(pa.large_binary()))
    known = encoded.dictionary
    indices = encoded.indices.to_numpy()
    filled = pc.binary_length(known).to_numpy() > 0  # white space at an end of a text gives an empty piece
    keep = filled[indices]
    owner = np.repeat(np.arange(len(texts)), counts)[keep]
    per_text = np.bincount(owner, minlength=len(texts))
    word, text = np.empty(len(owner) + len(texts), np.int64), np.empty(len(owner) + len(texts), np.int64)
    for at, w, t in ((np.arange(len(owner)) + owner, indices[keep], owner), (np.cumsum(per_text) + np.arange(len(texts)), len(known), np.arange(len(texts)))):
        word[at], text[at] = w, t
    known = pa.concat_arrays([known, pa.array([END], pa.large_binary())])
    number = np.zeros(len(known), np.int8)
    if frequent:
        number = (pc.fill_null(pc.index_in(known, pa.array(frequent, pa.large_binary())), -1).to_numpy() + 1).astype(np.int8)
    # the last frequent word before each token, inside its text
    at = np.where(number[word] > 0, np.arange(len(word)), -1)
    last = np.maximum.accumulate(np.concatenate([[-1], at[:-1]]))
    starts = np.cumsum(per_text + 1) - per_text - 1
    last = np.where(last >= starts[text], last, -1)
    return Tokens(known, word, text, np.where(last >= 0, number[word[last]], 0).astype(np.int64), _joints(known, word, text), len(texts))


def _texts(docs: DataFrame, text: str, fold: Column) -> DataFrame:
    return docs.select(column(text).cast("string").alias("text"), fold.cast("int").alias("fold"))


def count_short_words(docs: DataFrame, text: str) -> DataFrame:
    """word, n: words of at most FREQUENT_BYTES bytes, sums per slice of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices_of(batch.column("text")):
                tokens = read_tokens(texts, [])
                n = np.bincount(tokens.word, minlength=len(tokens.words))
                size = pc.binary_length(tokens.words).to_numpy()
                fit = np.nonzero((n > 0) & (size > 0) & (size <= FREQUENT_BYTES))[0]
                yield pa.RecordBatch.from_arrays([tokens.words.take(pa.array(fit)).cast(pa.binary()), pa.array(n[fit])], names=["word", "n"])

    return docs.select(column(text).cast("string").alias("text")).mapInArrow(run, "word binary, n bigint")


def count_tokens(docs: DataFrame, fold: Column, frequent: list[bytes], text: str) -> DataFrame:
    """word, frequent, a, b, n: tokens by fold (1: a, 2: b, 0: only n), sums per slice of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for at, texts in slices_of(batch.column("text")):
                tokens = read_tokens(texts, frequent)
                keys, back = np.unique(tokens.word * (FREQUENT + 1) + tokens.frequent, return_inverse=True)
                fold_of = folds[at][tokens.text]
                a, b = (np.bincount(back[fold_of == f], minlength=len(keys)) for f in (1, 2))
                n = np.bincount(back, minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [tokens.words.take(pa.array(keys // (FREQUENT + 1))).cast(pa.binary()), pa.array((keys % (FREQUENT + 1)).astype(np.int32)), pa.array(a), pa.array(b), pa.array(n)],
                    names=["word", "frequent", "a", "b", "n"])

    return _texts(docs, text, fold).mapInArrow(run, "word binary, frequent int, a bigint, b bigint, n bigint")


def count_joints(docs: DataFrame, fold: Column, frequent: list[bytes], text: str) -> DataFrame:
    """word (a joint's), uses, c of all joints. A task sends its counts packed, by hash of the joint, and they are added where a hash's joints meet."""

    def packed(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (mix64((found // (4 * (FREQUENT + 1))).astype(np.uint64)) % np.uint64(JOINT_PARTS)).astype(np.int32)
        order = np.argsort(part, kind="stable")  # keys stay in order inside a part
        parts, first = np.unique(part[order], return_index=True)
        blobs = []
        for rows in np.split(order, first[1:]):
            planes = found[rows].view(np.uint8).reshape(-1, 8).T  # bytes of one weight together, which are alike in keys in order
            blobs.append((zlib.compress(planes.tobytes(), 1), _pack(n[rows])))
        return pa.RecordBatch.from_arrays([pa.array(parts), *(pa.array([b[i] for b in blobs], pa.binary()) for i in range(2))], names=["part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for at, texts in slices_of(batch.column("text")):
                tokens = read_tokens(texts, frequent)
                held = added_counts(held, np.unique((tokens.joint * (FREQUENT + 1) + tokens.frequent) * 4 + folds[at][tokens.text], return_counts=True))
                if len(held[0]) > JOINTS_HELD:
                    yield packed(*held)
                    held = None
        if held is not None:
            yield packed(*held)

    def summed(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some, size = None, [], 0
        for part in parts:
            for keys, counts in zip(part.column("keys").to_pylist(), part.column("counts").to_pylist()):
                some.append((np.ascontiguousarray(np.frombuffer(zlib.decompress(keys), np.uint8).reshape(8, -1).T).view(np.int64).ravel(), _unpack(counts)))
                size += len(some[-1][0])
                if size > JOINTS_HELD:
                    held, some, size = added_counts(held, *some), [], 0
        held = added_counts(held, *some)
        for rows in joint_slices(held[0]):
            yield joint_uses(held[0][rows], held[1][rows])

    sent = _texts(docs, text, fold).mapInArrow(run, "part int, keys binary, counts binary")
    return sent.groupBy("part").applyInArrow(summed, "word binary, uses array<struct<frequent: int, a: bigint, b: bigint, n: bigint>>, c bigint")


def joint_slices(found: np.ndarray) -> Iterator[slice]:
    """Runs of about JOINT_ROWS keys, a joint in one run."""
    first = np.nonzero(np.diff(found // (4 * (FREQUENT + 1)), prepend=-1))[0]
    at = 0
    while at < len(found):
        later = np.searchsorted(first, at + JOINT_ROWS)
        end = int(first[later]) if later < len(first) else len(found)
        yield slice(at, end)
        at = end


def joint_uses(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of the vocabulary from counted keys: joint, frequent word and fold."""
    keys, back = np.unique(found >> 2, return_inverse=True)
    fold = found & 3
    a, b, every = (np.bincount(back, weights=n * own, minlength=len(keys)).astype(np.int64) for own in (fold == 1, fold == 2, fold >= 0))
    joints, first = np.unique(keys // (FREQUENT + 1), return_index=True)
    uses = pa.StructArray.from_arrays([pa.array((keys % (FREQUENT + 1)).astype(np.int32)), pa.array(a), pa.array(b), pa.array(every)], ["frequent", "a", "b", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)).astype(np.int32)), uses)
    return pa.RecordBatch.from_arrays([joint_words(joints), lists, pa.array(np.add.reduceat(a + b, first))], names=["word", "uses", "c"])


def added_counts(held: tuple[np.ndarray, np.ndarray] | None, *more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of different keys in order and their counts as one."""
    every = [*([held] if held is not None else []), *more]
    if len(every) == 1:
        return every[0]
    keys, n = (np.concatenate(c) for c in zip(*every))
    order = np.argsort(keys, kind="stable")  # runs in order, which are only merged
    keys, n = keys[order], n[order]
    at = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[at], np.add.reduceat(n, at)


def learn(docs: DataFrame, fold: Column, text: str = "text") -> Learned:
    """fold per document: 1 the larger training fold, 2 the smaller, 0 not for training. The vocabulary holds all documents' tokens and joints."""
    spark = docs.sparkSession
    top = count_short_words(docs.filter(fold > 0), text).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = [bytes(r["word"]) for r in top]
    pairs = count_tokens(docs, fold, frequent, text).repartition("word").groupBy("word", "frequent").agg(*[F.sum(c).alias(c) for c in ("a", "b", "n")])
    uses = F.array_sort(F.collect_list(F.struct("frequent", "a", "b", "n")))  # at most FREQUENT + 1 of a word
    words = pairs.groupBy("word").agg(uses.alias("uses"), F.sum(F.col("a") + F.col("b")).alias("c"))
    kinds = [rows.select(F.lit(joint).alias("joint"), "word", "uses", "c") for rows, joint in ((words, False), (count_joints(docs, fold, frequent, text), True))]
    vocabulary = materialise(kinds[0].unionByName(kinds[1]))
    of_word = F.when(~F.col("joint"), F.col("c"))
    sums = vocabulary.agg(F.count("*").alias("rows"), F.coalesce(F.sum(of_word), F.lit(0)).alias("n"), F.count_if(of_word > 0).alias("v")).first()
    gathered = rows_of(vocabulary.filter("c > 0")).repartition(max(1, -(-sums["rows"] // WORDS_PER_TABLE)))  # by no key: each task sends whole tables
    larger, both = state_tables(table_blocks(gathered))
    shared = spark.sparkContext.broadcast(larger)
    odds = state_odds(vocabulary, shared)
    model = learn_weights(vocabulary, shared, odds)
    shared.unpersist()
    return Learned(vocabulary, sums["n"], sums["v"], frequent, both, model)


def token_scores(learned: Learned) -> DataFrame:
    """joint, word, frequent, n, c, lp: log10 probability of every joint, and of what every token has behind its own, after every frequent word it was met after."""
    shared = learned.vocabulary.sparkSession.sparkContext.broadcast((learned.tables, learned.model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, model = shared.value
        for batch in batches:
            for part, _ in _kinds(batch):
                out = [bits_of(r.spread(), len(r.owner), tables.array, model) for r in _vocabulary_batches(iter([part]))]
                uses = part.column("uses")
                owner = np.repeat(np.arange(part.num_rows), np.diff(uses.offsets.to_numpy()))
                flat, of_row = uses.flatten(), part.select(["joint", "word", "c"]).take(pa.array(owner))
                lp = np.concatenate(out) * -math.log10(2) if out else np.zeros(0)
                yield pa.RecordBatch.from_arrays([of_row.column("joint"), of_row.column("word"), flat.field("frequent"), flat.field("n"), of_row.column("c"), pa.array(lp)],
                                                 names=["joint", "word", "frequent", "n", "c", "lp"])

    return learned.vocabulary.mapInArrow(run, "joint boolean, word binary, frequent int, n bigint, c bigint, lp double")


class Head(NamedTuple):
    """The most frequent pairs of a kind, ordered by a number: the hash of a word and its frequent word, or what a joint and its frequent word are as a number."""

    keys: np.ndarray
    lp: np.ndarray  # log10 probabilities
    c: np.ndarray | None = None  # training counts
    words: pa.Array | None = None  # None where the number says it all
    frequent: np.ndarray | None = None
    alike: int = 1  # most words of one hash

    def find(self, keys: np.ndarray, words: pa.Array | None = None, frequent: np.ndarray | None = None) -> np.ndarray:
        """Positions, -1 for what is not in the head."""
        place = np.full(len(keys), -1)
        if len(self.keys):
            first = np.searchsorted(self.keys, keys)
            for i in range(self.alike):
                at = np.minimum(first + i, len(self.keys) - 1)
                same = self.keys[at] == keys
                if self.words is not None:
                    same &= (self.frequent[at] == frequent) & pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
                place[same] = at[same]
        return place


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words of an array of the type large_binary."""
    offsets, data = _placed(words)
    size = np.diff(offsets)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0xD1342543DE82EF95, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[offsets[0]:offsets[-1]].astype(np.uint64) + np.uint64(1)) * powers[place])])
        at = offsets - offsets[0]
        return mix64((sums[at[1:]] - sums[at[:-1]]) + size.astype(np.uint64) * _P)


def in_head(scored: DataFrame, head: int, head_bytes: int = HEAD_BYTES) -> Column:
    """The pairs of a count or more, the smallest count that is sure to leave at most ``head`` of them."""
    short = F.octet_length("word") <= head_bytes
    level = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in scored.filter(short).groupBy(level.alias("level")).agg(F.count("*").alias("m"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():  # a few hundred rows
        total += r["m"]
        if total > head:
            break
        least = r["least"]
    return F.lit(False) if least is None else short & (F.col("n") >= least)


def head_of(scored: DataFrame, chosen: Column) -> Head:
    found = scored.filter(chosen).select("word", "frequent", "c", "lp").toArrow().combine_chunks()
    words = pa.concat_arrays([pa.array([], pa.large_binary()), *found.column("word").cast(pa.large_binary()).chunks])
    frequent, c, lp = (found.column(name).to_numpy() for name in ("frequent", "c", "lp"))
    keys = with_frequent(hashes_of(words), frequent)
    order = np.argsort(keys)
    alike = int(np.unique(keys, return_counts=True)[1].max(initial=1))
    return Head(keys[order], lp[order], c[order], words.take(pa.array(order)), frequent[order].astype(np.int8), alike)


def joint_head_of(scored: DataFrame, chosen: Column) -> Head:
    found = scored.filter(chosen).select("word", "frequent", "lp").toArrow()
    words = pa.concat_arrays([pa.array([], pa.large_binary()), *found.column("word").cast(pa.large_binary()).chunks])
    keys = joint_numbers(words) * (FREQUENT + 1) + found.column("frequent").to_numpy()
    order = np.argsort(keys)
    return Head(keys[order], found.column("lp").to_numpy()[order])


def base_log(c, train_tokens: int, train_words: int, alpha: float = 0.1):
    return (c + alpha) / (train_tokens + alpha * (train_words + 1))


def score(docs: DataFrame, learned: Learned, text: str = "text", doc_id: str = "doc_id", head: int = HEAD) -> DataFrame:
    """id, n_tokens, n_known, n_bytes, base_score, score, bits_per_byte: a row per row of ``docs``."""
    scored = materialise(token_scores(learned))  # from here on the tables are not needed
    n, v = learned.train_tokens, learned.train_words
    words_scored, joints_scored = scored.filter("not joint"), scored.filter("joint")
    chosen, chosen_joints = in_head(words_scored, head), in_head(joints_scored, 2 * head)
    shared = docs.sparkSession.sparkContext.broadcast((learned.frequent, head_of(words_scored, chosen), joint_head_of(joints_scored, chosen_joints)))
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_tokens bigint, n_bytes bigint, n_known bigint, base double, lp double, rest array<struct<joint: boolean, frequent: int, word: binary, m: bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, known, known_joints = shared.value
        base_of = np.log10(base_log(known.c, n, v)) if n else np.full(len(known.c), np.nan)
        for batch in batches:
            for at, texts in slices_of(batch.column("text"), SCORED_SLICE):
                tokens = read_tokens(texts, frequent)
                k = tokens.n_texts
                pairs, back = np.unique(tokens.word * (FREQUENT + 1) + tokens.frequent, return_inverse=True)
                words_of, frequent_of = tokens.words.take(pa.array(pairs // (FREQUENT + 1))), pairs % (FREQUENT + 1)
                hashes = with_frequent(hashes_of(tokens.words)[pairs // (FREQUENT + 1)], frequent_of)
                hit = known.find(hashes, words_of, frequent_of)[back]
                met = hit >= 0
                sums = [np.bincount(tokens.text[met], weights=w[hit[met]], minlength=k) for w in ((known.c > 0).astype(float), base_of, known.lp)]
                size = pc.binary_length(tokens.words).to_numpy().astype(np.int64)[tokens.word] + 1
                joints, joint_back = np.unique(tokens.joint * (FREQUENT + 1) + tokens.frequent, return_inverse=True)
                joint_hit = known_joints.find(joints)[joint_back]
                joint_met = joint_hit >= 0
                sums[2] = sums[2] + np.bincount(tokens.text[joint_met], weights=known_joints.lp[joint_hit[joint_met]], minlength=k)
                # what is not in the heads: pairs of words, then those of joints
                numbers = len(pairs) + len(joints)
                rest, m = np.unique(np.concatenate([tokens.text[~met] * numbers + back[~met], tokens.text[~joint_met] * numbers + len(pairs) + joint_back[~joint_met]]), return_counts=True)
                owner, pair = rest // max(numbers, 1), rest % max(numbers, 1)
                of_joint = pair >= len(pairs)
                own = np.unique(pair[of_joint]) - len(pairs)
                place = np.where(of_joint, len(words_of) + np.searchsorted(own, pair - len(pairs)), pair)
                named = pa.concat_arrays([words_of.cast(pa.binary()), joint_words(joints[own] // (FREQUENT + 1))])
                frequent_of = np.concatenate([frequent_of, joints[own] % (FREQUENT + 1)])
                fields = [pa.array(of_joint), pa.array(frequent_of[place].astype(np.int32)), named.take(pa.array(place)), pa.array(m)]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=k))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["joint", "frequent", "word", "m"]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(at.start, k), pa.array(np.bincount(tokens.text, minlength=k)), pa.array(np.bincount(tokens.text, weights=size, minlength=k).astype(np.int64)),
                    pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(float)), pa.array(sums[2].astype(float)), lists], names=["id", "n_tokens", "n_bytes", "n_known", "base", "lp", "rest"])

    read = materialise(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rest = read.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    behind = scored.filter(~F.when(F.col("joint"), chosen_joints).otherwise(chosen))
    met = rest.join(behind, ["joint", "frequent", "word"]).groupBy("row").agg(
        F.sum(F.when(~F.col("joint") & (F.col("c") > 0), F.col("m")).otherwise(0)).alias("_known"),
        F.sum(F.when(~F.col("joint"), F.col("m") * F.log10((F.col("c") + 0.1) / (F.lit(float(n)) + 0.1 * (v + 1))))).alias("_base"), F.sum(F.col("m") * F.col("lp")).alias("_lp"))
    added = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    summed = read.drop("rest").join(met, "row", "left")
    base = added("base", "_base") if n else F.lit(None).cast("double")
    return summed.select("id", "n_tokens", added("n_known", "_known").alias("n_known"), "n_bytes", base.alias("base_score"), added("lp", "_lp").alias("score"),
                         (added("lp", "_lp") * (-1 / math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"))
