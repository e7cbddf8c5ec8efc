"""Exact de-duplication with skew-safe combining.

Texts are equal when they are identical after every run of white space became one space. Copies are combined in three
steps, and each step groups by the digest and by the whole normalised text, so a digest alone never decides:

1. every task combines its own rows (the partial aggregate of step 2),
2. rows of one digest are combined within salts, so that a group of any size is spread over ``SALTS`` tasks,
3. the winners of the salts, at most ``SALTS`` rows a text, are combined for good.

Each row then finds its group by digest. Step 3 has shown how many texts stand behind a digest; where there are
several, and only there, rows meet their group by digest and text.

Defined results: null text is empty text; the smallest id of a group stays; a null id sorts after all others, and a group of null
ids only keeps all its rows; rows that repeat an id stay or go together; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from statwitness.llm.common import SPACE, column, materialise, text_column

SALTS = 32


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256)) -> DataFrame:
    """One row per row of ``docs``: its id, digest, keep_id, group_size, kept."""
    whole = docs.select(column(doc_id).alias("id"), normalise(text_column(text)).alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = (
        whole.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        .groupBy("digest", "salt", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")))
    combined = (
        salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")))
    groups = materialise(combined.select("digest", "keep_id", "group_size"))
    several = materialise(groups.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"))
    light = whole.select("id", "digest")
    if several.isEmpty():
        found = light.join(groups, "digest")
    else:
        # digests with several texts: those rows only carry their text into the join
        one = light.join(several, "digest", "left_anti").join(groups, "digest")
        hard = combined.join(several, "digest", "left_semi")
        found = one.select("id", "digest", "keep_id", "group_size").unionByName(
            whole.join(several, "digest", "left_semi").join(hard, ["digest", "norm"]).select("id", "digest", "keep_id", "group_size"))
    return found.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
