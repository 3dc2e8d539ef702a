"""Saved models and the run log."""

from __future__ import annotations

import json
import math
from typing import Any

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.hints import error_hint, metric_line
from gridloom.operators.models import trees
from gridloom.operators.models.base import Fitted
from gridloom.operators.prepare import Preparation
from gridloom.plans.training import TrainedModel, score

RUN_SCHEMA = (
    "run_id string, dataset_id string, status string, message string, task string, "
    "algorithm_id string, learning_mode string, metrics map<string,double>, logged_at timestamp"
)
METADATA_SCHEMA = "metadata string, state string"


def save_model(model: TrainedModel, path: str, dataset_id: str | None = None) -> None:
    """Write metadata and parameters as one JSON row, Spark models and tables
    beside it."""
    spark = SparkSession.getActiveSession()
    fitted = model.fitted
    if isinstance(fitted.model, list):
        # Boosted trees become plain arrays.
        fitted.params |= trees.joined_trees(fitted.model)
        fitted.model = None
    state = {
        "scorer": fitted.scorer,
        "params": fitted.params,
        "spark_model": fitted.model is not None,
        "table": fitted.table is not None,
        "vocabulary": model.preparation.vocabulary is not None,
        "preparation": model.preparation.to_dict(),
        "classes": model.classes,
        "schema": model.schema.json(),
    }
    metadata = model.metadata | {"dataset_id": dataset_id}
    row = (json.dumps(metadata, default=_plain), json.dumps(state, default=_plain))
    spark.createDataFrame([row], METADATA_SCHEMA).coalesce(1).write.mode("overwrite").json(
        f"{path}/metadata"
    )
    if fitted.model is not None:
        PipelineModel([fitted.model]).write().overwrite().save(f"{path}/model")
    if fitted.table is not None:
        fitted.table.write.mode("overwrite").parquet(f"{path}/table")
    if model.preparation.vocabulary is not None:
        model.preparation.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def _plain(value: Any):
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    raise TypeError(f"Cannot store {type(value)}")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    try:
        row = spark.read.schema(METADATA_SCHEMA).json(f"{path}/metadata").first()
    except Exception as error:
        raise ValueError("Model artifacts missing.") from error
    if row is None:
        raise ValueError("Model artifacts missing.")
    state = json.loads(row.state)
    fitted = Fitted(
        state["scorer"],
        state["params"],
        PipelineModel.load(f"{path}/model").stages[0] if state["spark_model"] else None,
        spark.read.parquet(f"{path}/table") if state["table"] else None,
    )
    vocabulary = spark.read.parquet(f"{path}/vocabulary") if state["vocabulary"] else None
    return TrainedModel(
        Preparation.from_dict(state["preparation"], vocabulary),
        fitted,
        state["classes"],
        T.StructType.fromJson(json.loads(state["schema"])),
        json.loads(row.metadata),
    )


def run_rows(spark: SparkSession, runs: list[dict], dataset_id: str | None = None) -> DataFrame:
    """Finished runs as a table with readable metrics and advice for failures."""
    rows = []
    for i, run in enumerate(runs):
        measured = {
            k: float(v)
            for k, v in (run.get("metrics") or {}).items()
            if isinstance(v, (int, float)) and math.isfinite(v)
        }
        mode = "unsupervised" if run.get("task") == "unsupervised" else "supervised"
        rows.append(
            (
                run.get("run_id") or f"{run['algorithm_id']}-{i}",
                dataset_id,
                run["status"],
                run.get("message"),
                run.get("task"),
                run["algorithm_id"],
                mode,
                measured,
            )
        )
    table = spark.createDataFrame(rows, RUN_SCHEMA.rsplit(", ", 1)[0])
    return table.withColumn("logged_at", F.current_timestamp())


def log_runs(table: DataFrame, path: str) -> None:
    table.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The log with a metric line and a hint per run."""
    runs = spark.read.schema(RUN_SCHEMA).parquet(path)
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
        if runs.isEmpty():
            raise ValueError("Unknown job.")
    return described(runs)


def described(runs: DataFrame) -> DataFrame:
    return runs.withColumn("metric_line", metric_line(F.col("task"), F.col("metrics"))).withColumn(
        "hint", error_hint(F.col("message"))
    )


def write_scores(model: TrainedModel, rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Score ``rows`` and write them with their prediction or embedding."""
    writer = score(model, rows).write.mode("overwrite").format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)
