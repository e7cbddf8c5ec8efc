"""Token ids of whole texts in a binary file format: patched frame-of-reference blocks.

Documents are put in id order by a range partitioning, each task encodes its range and packs ids into chunks of whole
documents. A chunk is one value of the written table (the table gives atomic commits, so lost tasks are simply
run again) and has this form, little-endian:

    "PFB1" | u32 documents | u32 ids | u32 blocks | u32 ids a block
    i64 id count per document | u32 start of every block in the body (the block index) | body

A block of the body: u32 minimum | u8 width | u8 0 | u16 exceptions | u16 positions | u32 values | packed bits. The
block's minimum is subtracted from its ids; the width is that of the ``PERCENTILE`` of the differences; low bits of every difference are
packed at this width, and those that need more are stored whole in the exception list.

Any block is read on its own through the index (``read_block``). Positions over all documents come from one running total
per part, not per document: ``read_tokens`` adds the totals of the parts before.

Defined results: null and empty texts hold the end id only; equal ids are ordered by text; null ids come first;
a text longer than a chunk is a chunk of its own; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from statwitness.llm.common import column, materialise, text_column

END_ID = 2
BLOCK = 1024  # a multiple of 64
PERCENTILE = 90
CHUNK_IDS = 1 << 17
MAGIC = b"PFB1"


# --- the format -------------------------------------------------------------------------------

def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` numbers below 2**width as rows of bytes: 64 numbers fill ``width`` 64-bit words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        j, s = divmod(i * width, 64)
        out[j] |= lanes[i] << np.uint64(s)
        if s + width > 64:
            out[j + 1] |= lanes[i] >> np.uint64(64 - s)
    return np.ascontiguousarray(out.T).astype("<u8", copy=False).view(np.uint8).reshape(len(values), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The numbers of rows of bytes."""
    rows = len(packed)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T)
    out = np.empty((64, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        j, s = divmod(i * width, 64)
        v = words[j] >> np.uint64(s)
        if s + width > 64:
            v = v | (words[j + 1] << np.uint64(64 - s))
        out[i] = v & mask
    return np.ascontiguousarray(out.T).reshape(rows, -1).astype(np.uint32)


def encode_chunk(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a chunk. ``ids``: unsigned 32-bit numbers; ``lengths``: how many each document has."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    v = padded.reshape(blocks, BLOCK)
    low = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = v - low[:, None]
    kth = BLOCK * PERCENTILE // 100
    ranked = np.partition(diff, kth, axis=1)[:, kth] if blocks else np.zeros(0, np.uint32)
    widths = np.ceil(np.log2(ranked.astype(np.float64) + 1)).astype(np.int64)
    over = diff > ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    bodies: list[bytes] = [b""] * blocks
    for width in np.unique(widths):
        rows = np.nonzero(widths == width)[0]
        low_bits = diff[rows] & np.uint32((1 << int(width)) - 1)
        bits = _pack(low_bits, int(width)) if width else np.zeros((len(rows), 0), np.uint8)
        for r, packed in zip(rows, bits):
            at = np.nonzero(over[r])[0]
            bodies[r] = b"".join((int(low[r]).to_bytes(4, "little"), bytes((int(width), 0)), len(at).to_bytes(2, "little"),
                                  at.astype("<u2").tobytes(), diff[r][at].astype("<u4").tobytes(), packed.tobytes()))
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]]) if blocks else np.zeros(0)
    head = MAGIC + np.array([len(lengths), n, blocks, BLOCK], "<u4").tobytes()
    return b"".join((head, np.asarray(lengths, "<i8").tobytes(), starts.astype("<u4").tobytes(), *bodies))


def _header(data: bytes) -> tuple[np.ndarray, int, np.ndarray, int, int]:
    """Lengths, number of ids, block starts, ids a block, where the body begins."""
    if data[:4] != MAGIC:
        raise ValueError("not a token chunk")
    docs, n, blocks, block = map(int, np.frombuffer(data, "<u4", 4, 4))
    lengths = np.frombuffer(data, "<i8", docs, 20)
    starts = np.frombuffer(data, "<u4", blocks, 20 + 8 * docs)
    return lengths, n, starts, block, 20 + 8 * docs + 4 * blocks


def _parts(data: bytes, at: int):
    low = int.from_bytes(data[at : at + 4], "little")
    width, many = data[at + 4], int.from_bytes(data[at + 6 : at + 8], "little")
    where = np.frombuffer(data, "<u2", many, at + 8)
    values = np.frombuffer(data, "<u4", many, at + 8 + 2 * many)
    return low, width, where, values, at + 8 + 6 * many


def read_block(data: bytes, k: int) -> np.ndarray:
    """The ids of block ``k`` alone."""
    _, n, starts, block, body = _header(data)
    low, width, where, values, at = _parts(data, body + int(starts[k]))
    out = np.zeros(block, np.uint32)
    if width:
        out = _unpack(np.frombuffer(data, np.uint8, block * width // 8, at)[None, :], width)[0]
    out[where] = values
    return (out + np.uint32(low))[: min(block, n - k * block)]


def decode_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the documents' lengths."""
    lengths, n, starts, block, body = _header(data)
    out = np.zeros((len(starts), block), np.uint32)
    parts = [_parts(data, body + int(s)) for s in starts]
    widths = np.array([p[1] for p in parts], np.int64)
    raw = np.frombuffer(data, np.uint8)
    for width in np.unique(widths):
        if width:
            rows = np.nonzero(widths == width)[0]
            size = block * int(width) // 8
            at = np.array([parts[r][4] for r in rows])
            out[rows] = _unpack(raw[at[:, None] + np.arange(size)], int(width))
    for r, (low, _, where, values, _) in enumerate(parts):
        out[r][where] = values
        out[r] += np.uint32(low)
    return out.reshape(-1)[:n], lengths


# --- encoding texts ---------------------------------------------------------------------------

class Encoder:
    """Ids of texts by the tokenizer file.

    The tokenizer cuts a text before every space, and around every line break, that has no other white space beside it;
    what is between two cuts is encoded apart from its neighbours. Such pieces are encoded once and remembered, up to ``BOUND`` pieces, then
    the memory is emptied. New pieces of a text are encoded in one call: only the first id of a piece starts with its
    space or is its line break, which tells the pieces apart. A text with other white space beside a space or a line
    break is encoded whole."""

    BOUND = 800_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.line = self.whole("\n")
        self.marks = {c: self.whole(c).tobytes() for c in ".,"}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[str], joined: str, starts) -> None:
        if not pieces:
            return
        ids = self.whole(joined)
        at = np.nonzero(starts(ids))[0]
        if len(at) != len(pieces) or at[0]:  # not told apart: one by one
            self.known.update((p, self.whole(p if p[0] == "\n" else " " + p).tobytes()) for p in pieces)
            return
        raw, cut = ids.tobytes(), [4 * int(x) for x in at] + [4 * len(ids)]
        self.known.update((p, raw[cut[i] : cut[i + 1]]) for i, p in enumerate(pieces))

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        new = set(pieces).difference(self.known)
        if new:
            if any(not p or p[-1].isspace() or p[p[0] == "\n"].isspace() for p in new):
                return self.whole(text)
            if len(self.known) + 2 * len(new) > self.BOUND:
                self.known.clear()
                new = set(pieces)
            # a word with a mark behind it is the word and the mark
            marked = {p: p[:-1] for p in new if p[-1] in self.marks and p[:-1].isalpha()}
            plain = sorted(new.difference(marked).union(w for w in marked.values() if w not in self.known))
            lines = [p for p in plain if p[0] == "\n"]
            words = [p for p in plain if p[0] != "\n"]
            self._learn(lines, "".join(lines), lambda ids: ids == self.line[0])
            self._learn(words, "".join([" " + p for p in words]), lambda ids: self.spaced[ids])
            self.known.update((p, self.known[w] + self.marks[p[-1]]) for p, w in marked.items())
        # the line break put before the text is left out again
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint32)[len(self.line):]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the chunks and returns the written table: part, chunk, start_in_part, ids (of its documents), data."""
    rows = docs.select(column(doc_id).alias("id"), text_column(text).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    schema = f"part int, chunk int, start_in_part bigint, n_ids bigint, ids array<{id_type}>, data binary"
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, total = TaskContext.get().partitionId(), 0, 0
        enc, ids, held, id_arrow = encoder(tokenizer_path), [], [], None
        size = 0
        end = np.array([end_id], np.uint32)

        def flush():
            nonlocal chunk, total, ids, held, size
            flat = np.concatenate(held)
            data = encode_chunk(flat, np.array([len(h) for h in held]))
            values = [[part], [chunk], [total], [len(flat)], [ids], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_arrow), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["part", "chunk", "start_in_part", "n_ids", "ids", "data"])
            chunk, total, ids, held, size = chunk + 1, total + len(flat), [], [], 0
            return out

        for b in batches:
            id_arrow = b.schema.field("id").type
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                one = np.concatenate([enc.encode(t), end])
                if held and size + len(one) > CHUNK_IDS:
                    yield flush()
                ids.append(i)
                held.append(one)
                size += len(one)
        if held:
            yield flush()

    return materialise(ordered.mapInArrow(run, schema))


def read_tokens(written: DataFrame, with_ids: bool = False) -> DataFrame:
    """From the written chunks: id, start (ids of all documents before), n_tokens, ids_crc32, and the ids if asked."""
    id_type = dict(written.dtypes)["ids"][len("array<") : -1]
    totals = written.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    chunks = written.join(base, "part").select((F.col("base") + F.col("start_in_part")).alias("at"), "ids", "data")
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids
    schema = f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_arrow = b.schema.field("ids").type.value_type
            for at, ids, data in zip(*[b.column(c).to_pylist() for c in ("at", "ids", "data")]):
                flat, lengths = decode_chunk(data)
                flat = flat.astype("<u4")
                ends = np.cumsum(lengths)
                docs = [flat[e - n : e] for e, n in zip(ends, lengths)]
                cols = [pa.array(ids, id_arrow), pa.array(at + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())]
                if with_ids:
                    cols.append(pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return chunks.mapInArrow(run, schema)
