"""Every example of a conversation is written with its whole prompt."""

import hashlib

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from statwitness.llm import chat

LONG = [("user", "ä" * 30000), ("assistant", "b" * 40000), ("user", "c" * 200000), ("assistant", "one"), ("assistant", "d" * 70000), ("system", ""), ("assistant", "two")]
SHORT = [("system", "s"), ("user", "<q>"), ("assistant", "### r"), ("assistant", "")]


def written(spark):
    rows = [(c, i, r, t) for c, said in ((1, LONG), (None, SHORT), (2, SHORT), (3, [("user", "only")])) for i, (r, t) in enumerate(said)]
    return chat.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))


def test_prompts_are_all_that_is_written_before_the_reply(spark):
    got = {}
    for r in sorted(chat.examples(written(spark)).collect(), key=lambda r: r.part):
        got.setdefault((r.conv_id, r.position), []).append(r)
    assert len(got) == 4 + 2 + 2
    for c, said in ((1, LONG), (None, SHORT), (2, SHORT)):
        for i, (role, text) in enumerate(said):
            if role == "assistant":
                parts = got[c, i]
                before = "".join(chat.write_turn(*t)[0] for t in said[:i]) + chat.write_turn(role, "")[0][: -len(chat.CLOSE)]
                assert "".join(p.prompt for p in parts) == before and parts[-1].target == chat.escape(text)
                assert [p.target for p in parts[:-1]] == [None] * (len(parts) - 1) and {p.loss_start for p in parts} == {len(before)}
    # turns start in blocks 0, 0, 1, 4, 4, 5 and 5
    assert [len(got[1, i]) for i in (1, 3, 4, 6)] == [1, 3, 3, 4]


def test_a_wrong_or_missing_prompt_is_an_error(spark):
    turns = written(spark)
    made = chat.examples(turns)
    got = {r.conv_id: r for r in chat.read_back(turns, made).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(("b" * 40000 + "one" + "d" * 70000 + "two").encode()).hexdigest() and got[3].loss_chars == 0
    first = F.col("part") == 0
    for wrong in (made.withColumn("prompt", F.expr("substring(prompt, 2)")), made.filter("conv_id is null or position < 3 or part > 0"), made.filter("target is null or position < 6"),
                  made.withColumn("prompt", F.when(first, F.concat(F.lit("x"), F.expr("substring(prompt, 2)"))).otherwise(F.col("prompt"))), made.union(made.filter(first))):
        with pytest.raises(PythonException, match="is not what is written there"):
            chat.read_back(turns, wrong).collect()
