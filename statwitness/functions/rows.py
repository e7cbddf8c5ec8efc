"""Rows from arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_computed(df: DataFrame, keep: list, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of a costly array expression.

    A plain explode lets the optimizer add a "not empty" filter, which repeats the expression further
    down the plan, often several times. The outer form does not; its empty rows are dropped here.
    """
    if position is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return rows.filter(F.col(name).isNotNull())
