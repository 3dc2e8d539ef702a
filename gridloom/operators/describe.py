"""Per-column profile: missing, distinct, summaries, outliers, warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import (
    as_number,
    categorical_columns,
    constant_label,
    finite_round,
    numeric_columns,
    ref,
    top_label,
)
from gridloom.operators.ordering import exact_quantiles
from gridloom.operators.value_counts import level_counts, top_values

# Aggregates per pass, so that generated code stays compilable.
AGGREGATES_PER_PASS = 90

NUMERIC_SUMMARY_SCHEMA = (
    "column string, min double, max double, mean double, median double, std double, "
    "zero_pct double, non_null_count bigint, note string"
)
OUTLIER_SCHEMA = "column string, iqr_outlier_pct double, note string"


def aggregate_by_column(df: DataFrame, columns: list[str], make) -> dict[str, list]:
    """``make(column)`` aggregates for many columns, a bounded number per pass."""
    out: dict[str, list] = {}
    per_column = max(1, len(make(columns[0]))) if columns else 1
    step = max(1, AGGREGATES_PER_PASS // per_column)
    for start in range(0, len(columns), step):
        group = columns[start : start + step]
        expressions = [e for c in group for e in make(c)]
        row = df.agg(*[e.alias(f"a{i}") for i, e in enumerate(expressions)]).first()
        for j, c in enumerate(group):
            out[c] = list(row[j * per_column : (j + 1) * per_column])
    return out


def missing_counts(df: DataFrame) -> DataFrame:
    """One row per column: missing count and percent."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(ref(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counted.select("_n", F.explode(entries).alias("e")).select(
        "e.column",
        "e.missing_count",
        F.when(F.col("_n") > 0, 100.0 * F.col("e.missing_count") / F.col("_n"))
        .otherwise(0.0)
        .alias("missing_pct"),
    )


def column_report(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Name, type, missing count and percent, distinct count, in table order."""
    kinds = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "ordinal int, column string, dtype string",
    )
    levels = level_counts(counts).select(
        "column",
        "n_unique",
        (F.col("n_rows") - F.col("non_null_count")).alias("missing_count"),
        (100.0 * (F.col("n_rows") - F.col("non_null_count")) / F.col("n_rows")).alias(
            "missing_pct"
        ),
    )
    return kinds.join(levels, "column", "left").select(
        "ordinal", "column", "dtype", "missing_count", "missing_pct", "n_unique"
    )


def distinct_counts(counts: DataFrame) -> DataFrame:
    return level_counts(counts).select("column", "n_unique")


def approximate_distinct_counts(df: DataFrame) -> DataFrame:
    """Sketch-based distinct counts: one scan, no shuffle of values."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("n_unique"))
        for i, c in enumerate(df.columns)
    ]
    return (
        df.agg(
            *[F.approx_count_distinct(ref(c)).alias(f"u{i}") for i, c in enumerate(df.columns)]
        )
        .select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> list[dict]:
    """Min, max, mean, median, population deviation and zero share."""
    columns = numeric_columns(df) if columns is None else columns

    def wanted(c):
        v = as_number(c)
        return [
            F.count(v),
            F.min(v),
            F.max(v),
            F.avg(v),
            F.stddev_pop(v),
            F.count(F.when(v == 0, 1)),
            F.count(F.lit(1)),
        ]

    basics = aggregate_by_column(df, columns, wanted)
    rows = basics[columns[0]][6] if columns else 0
    medians = exact_quantiles(df, columns, [0.5], rows=rows)
    out = []
    for c in columns:
        count, low, high, mean, std, zeros, _ = basics[c]
        entry = dict.fromkeys(["min", "max", "mean", "median", "std", "zero_pct"])
        entry |= {"column": c, "non_null_count": count, "note": None}
        if count:
            entry |= {
                "min": low,
                "max": high,
                "mean": mean,
                "median": medians[c][0],
                "std": std,
                "zero_pct": 100.0 * zeros / count,
            }
        else:
            entry["note"] = "no_numeric_values"
        out.append(entry)
    return out


def numeric_summary_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = [part.split()[0] for part in NUMERIC_SUMMARY_SCHEMA.split(", ")]
    rows = [tuple(e[n] for n in names) for e in numeric_summary(df, columns)]
    table = df.sparkSession.createDataFrame(rows, NUMERIC_SUMMARY_SCHEMA)
    for name in ("min", "max", "mean", "median", "std", "zero_pct"):
        table = table.withColumn(name, finite_round(F.col(name), 6))
    return table


def categorical_summary(counts: DataFrame, columns: list[str]) -> DataFrame:
    """The five most frequent values per categorical column."""
    return top_values(counts.filter(F.col("column").isin(columns)), 5).select(
        "column", "rank", top_label(F.col("value")).alias("value"), "cnt"
    )


def outlier_shares(
    df: DataFrame, columns: list[str] | None = None, exclude: str | None = None
) -> list[dict]:
    """Percent of values outside the 1.5-IQR fences per numeric column."""
    columns = [
        c for c in (numeric_columns(df) if columns is None else columns) if c != exclude
    ]
    counts = aggregate_by_column(
        df, columns, lambda c: [F.count(as_number(c)), F.count(F.lit(1))]
    )
    rows = counts[columns[0]][1] if columns else 0
    enough = [c for c in columns if counts[c][0] >= 10]
    quartiles = exact_quantiles(df, enough, [0.25, 0.75], rows=rows)
    fences = {}
    for c, (q1, q3) in quartiles.items():
        if q3 - q1 > 0:
            fences[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))

    def outside(c):
        low, high = fences[c]
        return [F.count(F.when((as_number(c) < low) | (as_number(c) > high), 1))]

    found = aggregate_by_column(df, list(fences), outside)
    out = []
    for c in columns:
        if c in fences:
            out.append((c, 100.0 * found[c][0] / counts[c][0], None))
        elif c in quartiles:
            out.append((c, 0.0, "zero_iqr"))
        else:
            out.append((c, None, "too_few_values"))
    return [dict(zip(("column", "iqr_outlier_pct", "note"), row)) for row in out]


def outlier_table(df: DataFrame, **options) -> DataFrame:
    rows = [tuple(e.values()) for e in outlier_shares(df, **options)]
    return df.sparkSession.createDataFrame(rows, OUTLIER_SCHEMA)


def sample_rows(df: DataFrame, order: list[str], rows: int = 15) -> DataFrame:
    """The first rows by an explicit key as JSON records (5 to 20 of them)."""
    limit = max(5, min(20, int(rows)))
    return (
        df.orderBy(*[ref(c) for c in order])
        .limit(limit)
        .select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    )


def constant_columns(counts: DataFrame) -> DataFrame:
    """Columns with at least one value and a single distinct one."""
    return (
        level_counts(counts)
        .filter((F.col("non_null_count") > 0) & (F.col("n_unique") <= 1))
        .select("column", constant_label(F.col("smallest_value")).alias("value_sample"))
    )


def high_cardinality_columns(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Text-like columns (no booleans) with very many levels."""
    text = [
        c for c in categorical_columns(df) if df.schema[c].dataType.typeName() != "boolean"
    ]
    levels, rows = F.col("n_unique"), F.col("n_rows")
    many = (
        (levels >= 80)
        | ((levels >= 50) & (rows >= 80))
        | ((rows >= 40) & (levels / rows >= 0.12) & (levels >= 25))
    )
    return (
        level_counts(counts.filter(F.col("column").isin(text)))
        .filter((levels >= 2) & many)
        .select(
            "column",
            "n_unique",
            (levels / rows).alias("unique_to_rows_ratio"),
            F.lit("many_levels").alias("note"),
        )
    )


def id_like_columns(df: DataFrame, counts: DataFrame, target: str | None = None) -> DataFrame:
    """Columns whose values are nearly all distinct."""
    usable = [
        f.name for f in df.schema if f.dataType.typeName() != "boolean" and f.name != target
    ]
    ratio = F.try_divide(F.col("n_unique").cast("double"), F.col("non_null_count"))
    return (
        level_counts(counts.filter(F.col("column").isin(usable)))
        .filter((F.col("non_null_count") >= 10) & (ratio >= 0.97))
        .select("column", "n_unique", "non_null_count", ratio.alias("unique_ratio"))
    )


def column_alerts(missing: DataFrame, outliers: DataFrame) -> DataFrame:
    """Columns with a quarter or more missing, or over 5 % IQR outliers."""
    lacking = missing.filter(F.col("missing_pct") >= 25).select(
        "column", F.lit("many_missing").alias("alert"), F.col("missing_pct").alias("percent")
    )
    wild = outliers.filter(F.col("iqr_outlier_pct") > 5).select(
        "column", F.lit("many_outliers").alias("alert"), F.col("iqr_outlier_pct").alias("percent")
    )
    return lacking.unionByName(wild)
