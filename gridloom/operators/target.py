"""Task inference and target summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import as_class, is_numeric, ref

CLASSIFICATION, REGRESSION = "classification", "regression"
MAX_DISCRETE = 20
MAX_CLASSES = 400

# Fixed texts shown with an inferred task.
EXPLANATIONS = {
    CLASSIFICATION: (
        "The target column looks categorical or has few distinct numeric values "
        "(20 or fewer unique). Training will use classification metrics."
    ),
    REGRESSION: (
        "The target column looks numeric with many distinct values. "
        "Training will use regression metrics."
    ),
}


def task_of(numeric: bool, distinct: int) -> str:
    return REGRESSION if numeric and distinct > MAX_DISCRETE else CLASSIFICATION


def infer_task(df: DataFrame, target: str) -> str:
    """Classification for non-numeric targets or up to 20 distinct values."""
    if not is_numeric(df.schema[target].dataType):
        return CLASSIFICATION
    # 21 distinct values settle the question; the limit stops the scan early.
    few = df.select(ref(target)).dropna().distinct().limit(MAX_DISCRETE + 1).count()
    return task_of(True, few)


def inferred_tasks(df: DataFrame, levels: DataFrame) -> DataFrame:
    """The task each column would get as a target, from its level counts."""
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    return levels.select(
        "column",
        F.when(F.col("column").isin(numeric) & (F.col("n_unique") > MAX_DISCRETE), REGRESSION)
        .otherwise(CLASSIFICATION)
        .alias("inferred_task"),
    )


def require_target(df: DataFrame, target: str) -> None:
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not in dataset.")


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Distinct and missing counts of the target with its inferred task."""
    require_target(df, target)
    numeric = is_numeric(df.schema[target].dataType)
    value = ref(target)
    task = F.when(
        F.lit(numeric) & (F.col("target_n_unique") > MAX_DISCRETE), REGRESSION
    ).otherwise(CLASSIFICATION)
    explanation = F.when(task == REGRESSION, EXPLANATIONS[REGRESSION]).otherwise(
        EXPLANATIONS[CLASSIFICATION]
    )
    return (
        df.groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .agg(
            F.count("value").alias("target_n_unique"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias(
                "target_missing_count"
            ),
            F.sum("cnt").alias("_n"),
        )
        .select(
            F.lit(target).alias("target_column"),
            task.alias("inferred_task"),
            explanation.alias("target_task_explanation"),
            "target_n_unique",
            "target_missing_count",
            F.try_divide(100.0 * F.col("target_missing_count"), F.col("_n")).alias(
                "target_missing_pct"
            ),
        )
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows per class; a missing target is the class ``nan``."""
    return df.groupBy(as_class(target).alias("class")).agg(F.count(F.lit(1)).alias("cnt"))


def class_balance(distribution: DataFrame) -> DataFrame:
    """Largest-to-smallest ratio, minority percent and the imbalance flag."""
    ratio = F.try_divide(F.max("cnt").cast("double"), F.min("cnt"))
    minority = F.try_divide(100.0 * F.min("cnt"), F.sum("cnt"))
    return distribution.agg(
        ratio.alias("imbalance_ratio_max_to_min"),
        minority.alias("minority_class_pct"),
        ((minority < 5.0) | (ratio > 10)).alias("imbalance_warning"),
    )
