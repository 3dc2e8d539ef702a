"""Shared pieces of the training-data operators: registry, tables, spreading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its equivalent."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """A text column with nulls as empty texts."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until it is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def chunks(values: list, sizes: list[int], most: int):
    """Index ranges (from, to) of consecutive values with at most ``most`` in
    total size each (one larger value stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)
