"""Reading tables: CSV with missing-value tokens and type inference, JSON rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.columns import missing_as_null, ref

# Texts read as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """A CSV with header. Without a schema every column gets the narrowest type
    that all its non-missing values fit: integer, decimal number, boolean, text.

    Types are found by one aggregate over the file; dates stay text. Line breaks
    inside quotes belong to the value, for which a file is read as one piece;
    ``multi_line=False`` splits large files that are known to have none.
    """
    try:
        # Quoted values may hold line breaks and doubled quotes.
        reader = spark.read.option("header", True).option("multiLine", multi_line)
        text = reader.option("escape", '"').csv(path)
        columns = text.columns
    except Exception as error:
        raise ValueError(f"Could not read CSV: {error}") from error
    clean = text.select(
        *[F.when(~ref(c).isin(MISSING_TOKENS), ref(c)).alias(c) for c in columns]
    )
    if clean.isEmpty():
        raise ValueError("CSV has no data rows.")
    if schema is not None:
        return missing_as_null(
            clean.select(*[ref(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
        )
    kinds = column_kinds(clean)
    return missing_as_null(
        clean.select(
            *[
                ref(c).try_cast(kinds[c]).alias(c) if kinds[c] != "string" else ref(c)
                for c in columns
            ]
        )
    )


def column_kinds(text: DataFrame) -> dict[str, str]:
    """Type per text column: bigint, double, boolean or string."""
    wanted = []
    for c in text.columns:
        value = F.trim(ref(c))
        wanted += [
            F.count(value),
            F.count(F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("bigint"))),
            F.count(value.try_cast("double")),
            F.count(F.when(value.isin("True", "False", "TRUE", "FALSE", "true", "false"), 1)),
        ]
    row = text.agg(*[e.alias(f"a{i}") for i, e in enumerate(wanted)]).first()
    kinds = {}
    for i, c in enumerate(text.columns):
        present, whole, number, boolean = row[4 * i : 4 * i + 4]
        if present == 0 or (number == present and whole < present):
            kinds[c] = "double"
        elif whole == present:
            kinds[c] = "bigint"
        else:
            kinds[c] = "boolean" if boolean == present else "string"
    return kinds


def check_csv(spark: SparkSession, path: str) -> list[str]:
    """Column names of an incoming file, after reading its first five rows."""
    if not path.lower().endswith(".csv"):
        raise ValueError("Upload a .csv file.")
    try:
        head = spark.read.option("header", True).csv(path)
        head.limit(5).collect()
        return head.columns
    except Exception as error:
        raise ValueError("Could not parse CSV.") from error


def approximate_rows(spark: SparkSession, path: str) -> int:
    """Lines of the file less its header."""
    return max(spark.read.text(path).count() - 1, 0)


def load_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of objects, one object, or an object on every line.

    Files whose first line is a whole object are read line by line, and split; an
    array, or an object over several lines, is read as one piece.
    """
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    try:
        by_line = first is not None and isinstance(json.loads(first.value), dict)
    except ValueError:
        by_line = False
    return spark.read.schema(schema).option("multiLine", not by_line).json(path)


def rows_to_table(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """Inline rows with the saved feature schema; extra keys are dropped."""
    present = set().union(*[r.keys() for r in rows]) if rows else set()
    missing = sorted(set(schema.names) - present)
    if missing:
        raise ValueError(f"Missing columns: {missing}")

    def fit(value, dtype):
        if value is None:
            return None
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(dtype, T.StringType):
            return str(value)
        return value

    data = [tuple(fit(r.get(f.name), f.dataType) for f in schema) for r in rows]
    return spark.createDataFrame(data, schema)


def require_columns(df: DataFrame, features: list[str]) -> DataFrame:
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df.select(*[ref(c) for c in features])


def register_dataset(df: DataFrame, name: str, database: str | None = None) -> str:
    """Store a table in the session catalogue."""
    full = f"{database}.{name}" if database else name
    df.write.mode("overwrite").format("parquet").saveAsTable(full)
    return full


def list_datasets(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Stored tables with their columns."""
    rows = [
        (t.name, [c.name for c in spark.catalog.listColumns(_full(t))])
        for t in spark.catalog.listTables(database)
        if not t.isTemporary
    ]
    return spark.createDataFrame(rows, "dataset_id string, columns array<string>")


def _full(table) -> str:
    return f"{table.namespace[0]}.{table.name}" if table.namespace else table.name


def get_dataset(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise ValueError("Unknown dataset.")
    return spark.table(name)
