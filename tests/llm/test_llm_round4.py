"""The loss text of conversations comes from their examples."""

import hashlib

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from statwitness.llm import chat


def test_loss_comes_from_the_examples(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "é ### <b>"), (1, 2, "assistant", ""), (1, 3, "assistant", "last"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (2, 0, "user", "only")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    made = chat.examples(turns)
    assert made.count() == 5
    got = {r.conv_id: r for r in chat.read_back(turns, made).collect()}
    assert [(got[c].n_turns, got[c].loss_chars) for c in (1, 2, None)] == [(4, 13), (1, 0), (2, 2)]
    assert got[1].loss_sha256 == hashlib.sha256("é ### <b>last".encode()).hexdigest()
    # without the example of a turn its reply is not trained on
    fewer = {r.conv_id: r for r in chat.read_back(turns, made.filter("position <> 3")).collect()}
    assert fewer[1].loss_chars == 9 and fewer[1].n_turns == 4
    for wrong in (made.withColumn("target", F.concat("target", F.lit("!"))), made.withColumns({"loss_start": F.col("loss_start") + 1, "loss_end": F.col("loss_end") + 1})):
        with pytest.raises(PythonException, match="is not what is written there"):
            chat.read_back(turns, wrong).collect()
