"""Column roles and scalar expressions shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELLIPSIS = "…"
NULL_LABEL = "(null)"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric, non-boolean columns in table order."""
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is not numeric: text, booleans, dates."""
    return [f.name for f in df.schema if not is_numeric(f.dataType)]


def ref(name: str) -> Column:
    """A column by its literal name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_as_null(df: DataFrame) -> DataFrame:
    """Fold NaN into NULL, so that both count as one kind of missing value."""
    floats = (T.FloatType, T.DoubleType)
    return df.select(
        *[
            F.when(~F.isnan(ref(f.name)), ref(f.name)).alias(f.name)
            if isinstance(f.dataType, floats)
            else ref(f.name)
            for f in df.schema
        ]
    )


def as_number(name: str) -> Column:
    """The column as a double; unparseable text and NaN become NULL."""
    value = ref(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def as_text(name: str) -> Column:
    """The column as text, NULL kept."""
    return ref(name).cast("string")


def as_class(name: str) -> Column:
    """The column as a class label: text, with missing as the class ``nan``."""
    return F.coalesce(as_text(name), F.lit("nan"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_round(value: Column, digits: int = 6) -> Column:
    """Rounded, with NULL for anything that is not a finite number."""
    return F.when(is_finite(value), F.round(value, digits))


def clip_between(value: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; a missing value stays missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def shorten(text: Column, limit: int, kept: int) -> Column:
    """Texts longer than ``limit`` keep ``kept`` characters and an ellipsis."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, kept), F.lit(ELLIPSIS))
    ).otherwise(text)


def top_label(text: Column) -> Column:
    """Label of a frequent value; missing, or the text ``nan``, is ``(null)``."""
    return F.when(text.isNull() | (F.lower(text) == "nan"), F.lit(NULL_LABEL)).otherwise(
        shorten(text, 80, 77)
    )


def bar_label(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(NULL_LABEL)).otherwise(shorten(text, 40, 39))


def constant_label(text: Column) -> Column:
    return shorten(text, 64, 61)


def balanced_sum(terms: list[Column]) -> Column:
    """Sum of many terms as a shallow tree, so that wide sums still compile."""
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        terms = [
            reduce(lambda a, b: a + b, terms[i : i + 2]) for i in range(0, len(terms), 2)
        ]
    return terms[0]


def first_match(rules: list[tuple[Column, str]]) -> Column:
    """Text of the first rule whose condition holds, else NULL."""
    chosen = F.lit(None).cast("string")
    for condition, text in reversed(rules):
        chosen = F.when(condition, F.lit(text)).otherwise(chosen)
    return chosen
