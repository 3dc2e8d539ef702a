"""The long table of value counts that most of a profile derives from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions.columns import ref

_SCHEMA = "column string, value string, cnt bigint"


def _normal(field: T.StructField) -> tuple[str, Column]:
    """Key family and grouping key: integers and floats group natively, the
    rest as text. Negative zero equals zero and NaN is missing."""
    value = ref(field.name)
    if isinstance(field.dataType, T.IntegralType):
        return "bigint", value.cast("bigint")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return "double", F.when(value == 0, F.lit(0.0)).when(
            ~F.isnan(value), value.cast("double")
        )
    if isinstance(field.dataType, T.BooleanType):
        return "string", F.when(value, "True").when(~value, "False")
    return "string", value.cast("string")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (column, value, cnt), missing values included as NULL.

    One unpivot and one aggregation per key family; counts combine before the
    shuffle, so a value that fills a third of a column is one row per task.
    """
    wanted = set(columns if columns is not None else df.columns)
    families: dict[str, list[tuple[str, Column]]] = {}
    for field in df.schema:
        if field.name in wanted:
            family, key = _normal(field)
            families.setdefault(family, []).append((field.name, key))
    parts = []
    for members in families.values():
        narrow = df.select(*[key.alias(name) for name, key in members])
        names = [ref(name) for name, _ in members]
        long = narrow.unpivot([], names, "column", "value")
        parts.append(
            long.groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("cnt"))
            .select("column", F.col("value").cast("string").alias("value"), "cnt")
        )
    if not parts:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def level_counts(counts: DataFrame) -> DataFrame:
    """Per column: distinct values, non-missing values, rows and one value."""
    return counts.groupBy("column").agg(
        F.count("value").alias("n_unique"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))), F.lit(0)).alias(
            "non_null_count"
        ),
        F.sum("cnt").alias("n_rows"),
        F.min("value").alias("smallest_value"),
    )


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column with their rank.

    Spark keeps the best ``k`` per column in every task before it shuffles, so
    a column with very many values does not gather in one task.
    """
    order = Window.partitionBy("column").orderBy(
        F.col("cnt").desc(), F.col("value").asc_nulls_first()
    )
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
