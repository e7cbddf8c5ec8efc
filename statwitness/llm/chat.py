r"""Chat formatting by prefix-target expansion.

A conversation is written once, as turns in order. Each assistant turn becomes a training example of its own: its prompt
is everything written before its reply, spelled out, and only its reply is trainable. Prompts therefore grow with the square of a
conversation's turns, as the form requires; a prompt is written in parts, one for each block of ``BLOCK`` code points of the conversation that
it reaches into, so no row grows with the conversation and the parts of a long one are made by as many tasks as it has blocks.

Turns of a conversation are streamed in order through the task that holds them, never gathered: one conversation may
be of any length. Many conversations with equal texts are different keys and spread evenly.

Form of a turn: ``<turn>### role: text</turn>`` and a line break. Inside role and text ``\`` is written ``\\``, ``<`` is
written ``\l`` and ``###`` is written ``\h``, and in roles ``:`` is written ``\c``; so no control string can appear in them, and reading undoes it exactly.

Defined results: null text and null role are empty; rows go by turn, nulls first, equal turns by role and text;
repeated rows are turns of their own; null conv_id is one conversation; a conversation without assistant turns has
no examples; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from statwitness.llm.common import column, text_column

OPEN, HEAD, CLOSE = "<turn>### ", ": ", "</turn>\n"
BLOCK = 1 << 16
_BACK = {"\\\\": "\\", "\\l": "<", "\\h": "###", "\\c": ":"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("###", "\\h")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lhc]", lambda m: _BACK[m[0]], text) if "\\" in text else text


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where the text begins and ends in it."""
    head = OPEN + escape(role).replace(":", "\\c") + HEAD
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
        raise ValueError(f"not a turn: {piece[:40]!r}")
    role, _, body = piece[len(OPEN): -len(CLOSE)].partition(HEAD)
    return unescape(role), unescape(body)


def _ordered(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_turns(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, position, piece (the written turn), start (code points before it in the
    conversation), loss_start and loss_end (offsets in the conversation, null if the turn is not trainable)."""
    rows = conversations.select(column("conv_id").alias("conv_id"), column("turn").alias("turn"),
                                text_column("role").alias("role"), text_column("text").alias("text"))
    id_type = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {id_type}, position bigint, piece string, start bigint, loss_start bigint, loss_end bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, at = object(), 0, 0
        for b in batches:
            cols = [[], [], [], [], []]
            for conv, role, text in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
                if conv != now:
                    now, position, at = conv, 0, 0
                piece, s, e = write_turn(role, text)
                on = role == trainable
                for c, v in zip(cols, (position, piece, at, at + s if on else None, at + e if on else None)):
                    c.append(v)
                position, at = position + 1, at + len(piece)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             names=["conv_id", "position", "piece", "start", "loss_start", "loss_end"])

    return _ordered(rows, "turn", "role", "text").mapInArrow(run, schema)


def examples(turns: DataFrame) -> DataFrame:
    """The examples of the trainable turns: conv_id, position, part, prompt, loss_start, loss_end, target.

    A turn belongs to the block of the conversation in which it starts. An example has one row per block up to its own that holds turns: the
    whole text of the blocks before its own, and of its own (the last part) what is before ``loss_start``. ``target``, the
    reply as written in [loss_start, loss_end), is in the last part and the only trainable one; it is null in the others. The
    prompts in order of ``part`` are the first ``loss_start`` characters of the conversation.
    """
    block = F.expr(f"start div {BLOCK}")
    rows = turns.groupBy("conv_id", block.alias("part")).agg(F.min("start").alias("start"), F.array_sort(
        F.collect_list(F.struct("position", "piece", "loss_start", "loss_end"))).alias("turns"))
    blocks = rows.withColumn("text", F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    cut = lambda a, b: F.expr(f"substring(text, cast({a} - start + 1 as int), cast({b} - {a} as int))")
    last = blocks.select("conv_id", "part", "start", "text", F.explode(F.transform(
        F.filter("turns", lambda t: t["loss_start"].isNotNull()), lambda t: F.struct(t["position"], t["loss_start"], t["loss_end"]))).alias("e")).select(
        "conv_id", "part", "start", "text", "e.*")
    last = last.select("conv_id", "position", "part", cut("start", "loss_start").alias("prompt"), "loss_start", "loss_end", cut("loss_start", "loss_end").alias("target"))
    # only a block that is full has another one behind it; null-safe throughout, so that both readers of the blocks share one shuffle, and
    # never sent to all, as its texts are many times what Spark takes them for
    full = blocks.filter(F.expr(f"(start + length(text)) div {BLOCK} > start div {BLOCK}")).select(F.col("conv_id").alias("of"), F.col("part").alias("block"), "text")
    behind = turns.filter(F.col("loss_start").isNotNull() & (block > 0)).select(
        "conv_id", "position", "loss_start", "loss_end", F.explode(F.sequence(F.lit(0).cast("bigint"), block - 1)).alias("part"))
    whole = behind.join(full.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of")) & F.col("part").eqNullSafe(F.col("block"))).select(
        "conv_id", "position", "part", F.col("text").alias("prompt"), "loss_start", "loss_end", F.lit(None).cast("string").alias("target"))
    return last.unionByName(whole)


def example_texts(turns: DataFrame) -> DataFrame:
    """The examples in one row each: conv_id, position, prompt, reply, both as written; a prompt must fit a cell here."""
    in_order = F.array_sort(F.collect_list(F.struct("part", "prompt")))
    return examples(turns).groupBy("conv_id", "position").agg(
        F.array_join(F.transform(in_order, lambda x: x["prompt"]), "").alias("prompt"), F.max("target").alias("reply"))


def read_back(turns: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """One row per conversation from what is written: n_turns, digest of the turns and formatted length from the turns, digest and
    length of the text under the loss mask from the targets of ``expanded`` (``examples`` of the turns). An example whose span does
    not hold its target, or whose prompt is not what is written before it, is an error; prompts are compared by length and digest, part by
    part. Streams through each conversation in order; of its blocks only the digests are kept."""
    id_type = dict(turns.dtypes)["conv_id"]
    schema = (f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    names = [p.split()[0] for p in schema.split(", ")]
    asked = ["conv_id", "position", "example", "part", "piece", "loss_start", "loss_end", "prompt_chars", "prompt_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, written, met = None, (None, 0, ""), set()
        blocks, at_block, now, before = {}, None, None, None  # written blocks, number and text of the one written now, its text before the last turn
        id_arrow = None

        def result(done):
            conv, n, turns_hash, chars, loss_hash, formatted = done
            values = (conv, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted)
            types = (id_arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return values, types

        def batch(rows):
            values = list(zip(*[r[0] for r in rows]))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, rows[0][1])], names=names)

        def wrong(conv, position):
            return ValueError(f"the example of conversation {conv!r} at {position} is not what is written there")

        for b in batches:
            id_arrow, out = b.schema.field("conv_id").type, []
            for conv, position, example, part, piece, s, e, chars, digest in zip(*[b.column(c).to_pylist() for c in asked]):
                if state is None or conv != state[0]:
                    if met:
                        raise wrong(state[0], written[0])
                    if state is not None:
                        out.append(result(state))
                    state, written = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], (None, 0, "")
                    blocks, at_block, now, before = {}, None, None, None
                if example:
                    of, start, turn = written
                    if of != position or part in met:
                        raise wrong(conv, position)
                    if part != at_block:
                        if blocks.get(part) != (chars, digest):
                            raise wrong(conv, position)
                        met.add(part)
                        continue
                    head = before[1].copy()
                    head.update(turn[: max(s - start, 0)].encode("utf-8", "surrogatepass"))
                    if s < start or turn[s - start : e - start] != piece or len(met) != len(blocks) or (chars, digest) != (before[0] + s - start, head.hexdigest()):
                        raise wrong(conv, position)
                    met = set()
                    reply = unescape(piece)
                    state[3] += len(reply)
                    state[4].update(reply.encode("utf-8", "surrogatepass"))
                    continue
                if met:
                    raise wrong(conv, written[0])
                role, text = read_turn(piece)
                written = position, state[5], piece
                if state[5] // BLOCK != at_block:
                    if now is not None:
                        blocks[at_block] = now[0], now[1].hexdigest()
                    at_block, now = state[5] // BLOCK, [0, hashlib.sha256()]
                before = now[0], now[1].copy()
                now[0] += len(piece)
                now[1].update(piece.encode("utf-8", "surrogatepass"))
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            if out:
                yield batch(out)
        if met:
            raise wrong(state[0], written[0])
        if state is not None:
            yield batch([result(state)])

    none = F.lit(None).cast("bigint")
    made = examples(turns) if expanded is None else expanded
    both = turns.select(
        "conv_id", "position", F.lit(False).alias("example"), none.alias("part"), "piece", none.alias("loss_start"), none.alias("loss_end"), none.alias("prompt_chars"),
        F.lit(None).cast("string").alias("prompt_sha256")).union(made.select(
            "conv_id", "position", F.lit(True), "part", "target", "loss_start", "loss_end", F.length("prompt").cast("bigint"), F.sha2("prompt", 256)))
    return _ordered(both, "position", "example", "part").mapInArrow(run, schema)
