"""Named queries over the provided tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(load) -> DataFrame``; ``load(table)`` reads one of the provided tables."""

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return wide_types(fn(Loader(spark, sf_dir)))

        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(build, sql)
        return fn

    return register


class Loader:
    """Reads the provided parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")


def wide_types(df: DataFrame) -> DataFrame:
    """Integers as bigint and floats as double, so both engines report the same types."""
    narrow = {T.ByteType: "bigint", T.ShortType: "bigint", T.IntegerType: "bigint", T.FloatType: "double"}
    return df.select(*[
        F.col(f"`{f.name}`").cast(narrow[type(f.dataType)]).alias(f.name)
        if type(f.dataType) in narrow else F.col(f"`{f.name}`")
        for f in df.schema.fields])
