"""Whole-table checks: duplicate rows and columns that give the target away."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import ref

# Name patterns of row keys and dates, first match wins.
NAME_PATTERNS = [
    (r"\b(uuid|guid)\b", "uuid_or_guid"),
    (r"\b(row_?id|record_?id)\b", "row_or_record_id"),
    (r"(?:_id|_uuid|_guid)$", "suffix_id"),
    (r"\bid\b", "id_token"),
    (r"^index$|^_index_$|\bidx\b|\brow_?index\b", "index_like"),
    (
        r"\b(timestamp|datetime)\b|created|updated|modified|_date_|_at$|_date$|^date$",
        "datetime_like",
    ),
]
LEAK_NOTE = (
    "Column name suggests id/date/index and values line up 1:1 with "
    "target classes on non-null rows - possible leakage or row key; "
    "verify before using as a feature."
)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one, and in percent.

    Only 8-byte row hashes are grouped at first; the rows themselves move just
    for hashes seen more than once, and they are compared in full, so a hash
    collision cannot count as a duplicate.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*[ref(c) for c in df.columns]))
    repeated = (
        hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_hash")
    )
    copies = (
        hashed.join(repeated, "_hash", "left_semi")
        .groupBy(*[ref(c) for c in hashed.columns])
        .agg((F.count(F.lit(1)) - 1).alias("_extra"))
        .agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicate_row_count"))
    )
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    # Two one-row tables side by side.
    return (
        copies.withColumn("_one", F.lit(1))
        .join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one")
        .select(
            "duplicate_row_count",
            F.when(F.col("_n") > 0, 100.0 * F.col("duplicate_row_count") / F.col("_n"))
            .otherwise(0.0)
            .alias("duplicate_row_pct"),
        )
    )


def name_pattern(column: str) -> str | None:
    """Label of the first pattern the column name matches."""
    for pattern, label in NAME_PATTERNS:
        if re.search(pattern, column, re.IGNORECASE):
            return label
    return None


def one_to_one(df: DataFrame, feature: str | list[str], target: str) -> DataFrame:
    """One row per feature: complete rows, levels of both sides, and whether they
    pair 1:1. All features share one pass and one grouping."""
    features = [feature] if isinstance(feature, str) else list(feature)
    entries = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("f")) for c in features])
    )
    pairs = (
        df.select(ref(target).alias("t"), entries.alias("e"))
        .select("e.column", "e.f", "t")
        .dropna()
        .groupBy("column", "f", "t")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # Each side's number of partners, from the distinct pairs alone.
    left = (
        pairs.groupBy("column", "f")
        .agg(F.count("t").alias("p"), F.sum("cnt").alias("cnt"))
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("feature_levels"),
            F.max("p").alias("_max_f"),
            F.sum("cnt").alias("complete_rows"),
        )
    )
    right = (
        pairs.groupBy("column", "t")
        .agg(F.count("f").alias("p"))
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("target_levels"), F.max("p").alias("_max_t"))
    )
    paired = (
        (F.col("complete_rows") >= 30)
        & (F.col("_max_f") == 1)
        & (F.col("_max_t") == 1)
        & (F.col("feature_levels") == F.col("target_levels"))
        & (F.col("feature_levels") >= 3)
    )
    # One row per feature, also for one without a complete row.
    names = df.sparkSession.createDataFrame([(c,) for c in features], "column string")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("complete_rows", "feature_levels", "target_levels")]
    return (
        F.broadcast(names).join(left, "column", "left").join(right, "column", "left")
        .select("column", *counts, F.coalesce(paired, F.lit(False)).alias("one_to_one"))
    )


def leakage_hints(df: DataFrame, target: str, task: str) -> DataFrame:
    """Key-like feature names whose values determine the class and back."""
    found = df.sparkSession.createDataFrame(
        [], "column string, name_pattern string, note string"
    )
    if task != "classification":
        return found
    named = {c: name_pattern(c) for c in df.columns if c != target and name_pattern(c)}
    if not named:
        return found
    labels = F.create_map(*[F.lit(v) for pair in named.items() for v in pair])
    return one_to_one(df, list(named), target).filter("one_to_one").select(
        "column", F.element_at(labels, F.col("column")).alias("name_pattern"), F.lit(LEAK_NOTE).alias("note")
    )
