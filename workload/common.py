"""Shared inputs of the registered queries: whole tables, lightly derived.

The tables hold no missing values, so the ``gappy`` forms turn some values into
NULL with the same rule on the Spark and on the SQL side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.models.base import Fitted, Training
from gridloom.session import shared_folder  # noqa: F401

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


def gappy_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        F.expr("nullif(l_discount, 0.0D)").alias("l_discount"),
        "l_tax",
        F.expr("nullif(l_returnflag, 'A')").alias("l_returnflag"),
        "l_linestatus",
    )


GAPPY_LINEITEM = """t AS (SELECT l_linenumber, l_quantity, l_extendedprice,
  nullif(l_discount, 0.0) AS l_discount, l_tax,
  nullif(l_returnflag, 'A') AS l_returnflag, l_linestatus FROM lineitem)"""
GAPPY_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPPY_COLUMNS = [*GAPPY_NUMBERS, "l_returnflag", "l_linestatus"]

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINEITEM_NUMBERS = LINEITEM[:8]


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def per_column(columns: list[str], body: str) -> str:
    """``body`` once per column, with {c} replaced, as one union."""
    return union([body.replace("{c}", c) for c in columns])


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


# Entries of an embedding.
WIDTH = 64


def embedding_columns(spark: SparkSession, sf: str, width: int = WIDTH) -> DataFrame:
    """The entries of each embedding as columns."""
    return table(spark, sf, "embeddings").select(
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i:02d}") for i in range(width)]
    )


def numbers(df: DataFrame, features: list[str], label: str | None = None, classes: int = 0):
    """Columns as a training table without split or preparation."""
    x = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    columns = [x] + ([F.col(label).cast("double").alias("label")] if label else [])
    arrays = df.select(*columns).persist()
    return Training(arrays, arrays.count(), len(features), classes)


def line_of(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Weights and intercept of a fitted line as one row per term."""
    if fitted.model is not None:
        weights, intercept = list(fitted.model.coefficients), fitted.model.intercept
    else:
        weights, intercept = list(fitted.params["weights"]), fitted.params["intercept"]
    rows = [("intercept", float(intercept))] + [
        (f"weight_{i}", float(w)) for i, w in enumerate(weights)
    ]
    return rounded(spark.createDataFrame(rows, "term string, value double"), "value", digits=5)


def metric_rows(spark: SparkSession, metrics: dict) -> DataFrame:
    rows = [(k, float(v)) for k, v in metrics.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "metric string, value double")
