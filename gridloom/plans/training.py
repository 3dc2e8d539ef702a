"""Training runs: prepare, split, fit, evaluate, compare and score."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.columns import as_class, as_number, missing_as_null, ref
from gridloom.operators import metrics as m
from gridloom.operators.models import registry
from gridloom.operators.models.base import Fitted, Training, apply_model
from gridloom.operators.oversample import oversample
from gridloom.operators.prepare import (
    Preparation,
    PrepareConfig,
    fit_preparation,
    resolve_config,
    select_features,
)
from gridloom.operators.split import train_test_split
from gridloom.operators.target import (
    CLASSIFICATION,
    MAX_CLASSES,
    class_distribution,
    infer_task,
    require_target,
)
from gridloom.session import cache_small, spread_small
from gridloom.sources.tables import require_columns

MAX_ALGORITHMS = 12
SEED = 42


@dataclass
class TrainedModel:
    preparation: Preparation
    fitted: Fitted
    # Classes the model's codes stand for, in order (classification only).
    classes: list[str] | None
    schema: T.StructType
    metadata: dict[str, Any] = field(default_factory=dict)


@dataclass
class Prepared:
    """One split and its features, shared by all algorithms of a comparison."""

    table: DataFrame
    train: DataFrame
    test: DataFrame
    features: list[str]
    target: str
    task: str
    config: PrepareConfig
    classes: list[str] | None
    all_classes: list[str] | None
    rows: int
    example: dict
    cache: dict[bool, tuple[Preparation, Training, DataFrame]] = field(default_factory=dict)

    def arrays(self, wants_scale: bool) -> tuple[Preparation, Training, DataFrame]:
        """Fitted preparation and cached training and test arrays."""
        if wants_scale not in self.cache:
            preparation = fit_preparation(self.train, self.features, self.config, wants_scale)
            both = [
                preparation.transform(
                    part.withColumn("_label", self.label()), keep=["_label"]
                ).withColumnRenamed("_label", "label")
                for part in (self.train, self.test)
            ]
            train = spread_small(both[0], self.rows).persist()
            training = Training(
                train, train.count(), len(self.features), len(self.classes or [])
            )
            self.cache[wants_scale] = (preparation, training, both[1])
        return self.cache[wants_scale]

    def label(self):
        if self.classes is None:
            return ref(self.target)
        # A class that only the test rows have is never predicted, but counts as a
        # label of its own: it takes a code behind those of the training rows.
        unseen = [c for c in self.all_classes or [] if c not in set(self.classes)]
        codes = F.create_map(
            *[F.lit(v) for i, c in enumerate([*self.classes, *unseen]) for v in (c, float(i))]
        )
        return F.coalesce(F.element_at(codes, ref(self.target)), F.lit(-1.0))

    def release(self) -> None:
        for _, training, _ in self.cache.values():
            training.df.unpersist()
        self.table.unpersist()


def prepare_supervised(
    df: DataFrame,
    target: str,
    options: dict | None = None,
    test_size: float = 0.2,
    seed: int = SEED,
) -> Prepared:
    """Check the request, clean the target and split the rows."""
    if not target or not str(target).strip():
        raise ValueError("target_column is required for supervised mode.")
    if not 0.05 <= test_size <= 0.4:
        raise ValueError("test_size must be between 0.05 and 0.4.")
    require_target(df, target)
    config = resolve_config(options)
    df = missing_as_null(df)
    features = select_features(df, target, config.feature_columns)
    task = infer_task(df, target)
    label = as_class(target) if task == CLASSIFICATION else as_number(target)
    table = df.select(*[ref(c) for c in features], label.alias(target))
    all_classes = None
    if task == CLASSIFICATION:
        distinct = df.select(ref(target)).dropna().distinct().count()
        if distinct > MAX_CLASSES:
            raise ValueError(
                f"Target has {distinct} unique values—too many distinct classes for classification."
            )
        counts = {r["class"]: r.cnt for r in class_distribution(table, target).collect()}
        all_classes, rows = sorted(counts), sum(counts.values())
    else:
        table = table.filter(ref(target).isNotNull())
        rows = table.count()
        if config.imbalance == "smote":
            raise ValueError(
                "SMOTE applies only to classification. Set imbalance to none for regression."
            )
    if rows < 10:
        raise ValueError("Need at least 10 rows after cleaning.")
    table = cache_small(table, rows)
    train, test = train_test_split(
        table, target, test_size, seed, stratify=task == CLASSIFICATION
    )
    if config.imbalance == "smote":
        train = oversample(train, target, features)
    classes = None
    if task == CLASSIFICATION:
        found = train.select(ref(target)).distinct().collect()
        classes = sorted(r[0] for r in found)
    return Prepared(
        table, train, test, features, target, task, config, classes, all_classes, rows,
        example_row(table, features),
    )


def example_row(df: DataFrame, features: list[str]) -> dict:
    """One feature row with JSON-safe values."""
    row = df.select(
        F.to_json(F.struct(*[ref(c) for c in features]), {"ignoreNullFields": "false"})
    ).first()
    return json.loads(row[0]) if row else {}


def fallback_example(schema: T.StructType, sample: dict | None = None) -> dict:
    """An example by type, used where no sample row has a value."""
    out = {}
    for f in schema:
        if sample and f.name in sample:
            out[f.name] = sample[f.name]
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = False
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = 0
        else:
            out[f.name] = "example"
    return out


def fit_supervised(prepared: Prepared, algorithm: str) -> TrainedModel:
    """Fit one algorithm on the prepared rows and evaluate it on the test rows."""
    spec, fit = registry.supervised(algorithm, prepared.task)
    preparation, training, test = prepared.arrays(spec.scale)
    fitted = fit(training)
    scored = apply_model(fitted, test)
    if prepared.classes is not None:
        measured = m.classification_metrics(m.confusion(scored)).first().asDict()
    else:
        measured = m.regression_metrics(scored).first().asDict()
    measured["train_rows"] = training.rows
    schema = T.StructType([prepared.train.schema[c] for c in prepared.features])
    metadata = {
        "task": prepared.task,
        "metrics": measured,
        "feature_columns": prepared.features,
        "prediction_example_row": prepared.example,
        "label_classes": prepared.all_classes,
        "target_column": prepared.target,
        "dataset_id": None,
        "algorithm_id": spec.id,
        "algorithm_label": spec.label,
        "learning_mode": "supervised",
        "unsupervised_family": None,
        "inference_method": "predict",
        "preprocess_applied": prepared.config.to_dict(),
    }
    return TrainedModel(preparation, fitted, prepared.classes, schema, metadata)


def train(
    df: DataFrame,
    target: str,
    algorithm: str = registry.DEFAULT_ALGORITHM,
    options: dict | None = None,
    test_size: float = 0.2,
    seed: int = SEED,
) -> TrainedModel:
    """One supervised training run."""
    prepared = prepare_supervised(df, target, options, test_size, seed)
    try:
        return fit_supervised(prepared, algorithm)
    finally:
        prepared.release()


@dataclass
class PreparedTable:
    """A table cleaned for unsupervised runs; arrays by the wish for scaling."""

    table: DataFrame
    features: list[str]
    config: PrepareConfig
    rows: int
    example: dict
    cache: dict[bool, tuple[Preparation, Training]] = field(default_factory=dict)

    def arrays(self, wants_scale: bool) -> tuple[Preparation, Training]:
        if wants_scale not in self.cache:
            preparation = fit_preparation(self.table, self.features, self.config, wants_scale)
            arrays = spread_small(preparation.transform(self.table), self.rows).persist()
            self.cache[wants_scale] = (preparation, Training(arrays, self.rows, len(self.features)))
        return self.cache[wants_scale]

    def release(self) -> None:
        for _, training in self.cache.values():
            training.df.unpersist()
        self.table.unpersist()


def prepare_unsupervised(
    df: DataFrame, options: dict | None = None, exclude: list[str] | None = None
) -> PreparedTable:
    """Check the request and clean the table, once for all algorithms."""
    config = resolve_config(options)
    if config.imbalance != "none":
        raise ValueError("Imbalance handling (SMOTE) is only for supervised classification.")
    df = missing_as_null(df)
    features = select_features(df, None, config.feature_columns, exclude)
    table = df.select(*[ref(c) for c in features])
    rows = table.count()
    if rows < 5:
        raise ValueError("Need at least 5 rows for unsupervised training.")
    table = cache_small(table, rows)
    return PreparedTable(table, features, config, rows, example_row(table, features))


def fit_unsupervised(
    df: DataFrame,
    family: str,
    algorithm: str,
    options: dict | None = None,
    exclude: list[str] | None = None,
) -> TrainedModel:
    """Fit on all rows and evaluate on the same rows."""
    if family not in registry.FAMILIES:
        raise ValueError("unsupervised_family is required when mode is unsupervised.")
    registry.unsupervised(algorithm, family)
    prepared = prepare_unsupervised(df, options, exclude)
    try:
        return fit_prepared(prepared, family, algorithm)
    finally:
        prepared.release()


def fit_prepared(prepared: PreparedTable, family: str, algorithm: str) -> TrainedModel:
    """One unsupervised run on a table that is already cleaned."""
    spec = registry.unsupervised(algorithm, family)
    preparation, training = prepared.arrays(spec.scale)
    fitted = spec.fit(training)
    metadata = {
        "task": "unsupervised",
        "metrics": unsupervised_metrics(fitted, training, family),
        "feature_columns": prepared.features,
        "prediction_example_row": prepared.example,
        "label_classes": None,
        "target_column": None,
        "dataset_id": None,
        "algorithm_id": spec.id,
        "algorithm_label": spec.label,
        "learning_mode": "unsupervised",
        "unsupervised_family": family,
        "inference_method": spec.inference,
        "preprocess_applied": prepared.config.to_dict(),
    }
    return TrainedModel(preparation, fitted, None, prepared.table.schema, metadata)


def unsupervised_metrics(fitted: Fitted, training: Training, family: str) -> dict:
    out = {"n_samples": training.rows, "n_features_transformed": training.d}
    if family == "decomposition":
        return out | fitted.facts
    if fitted.facts.get("feature_labels"):
        return out | {
            "n_label_values": len(set(fitted.facts["feature_labels"])),
            "cluster_metric_note": "Labels belong to features, not to rows: no row metrics.",
        }
    # A failure ends the run (a comparison marks it): metrics that are missing would
    # look like a result.
    scored = apply_model(fitted, training.df)
    if family == "clustering":
        return out | m.clustering_metrics(scored, training.d)
    return out | m.anomaly_metrics(scored)


def score(model: TrainedModel, df: DataFrame, refit_on_batch: bool = False) -> DataFrame:
    """``df`` with a ``prediction`` column, or ``embedding`` as JSON text.

    Outliers are clipped at the fences of the training rows, or with
    ``refit_on_batch`` at those of the rows of ``df``: one row is then never clipped,
    and a row's prediction depends on the others.
    """
    if model.metadata["inference_method"] == "none":
        raise ValueError(
            "This unsupervised model was fit without a way to score new rows "
            "(e.g. DBSCAN, agglomerative, spectral). Use an algorithm with "
            "predict or transform (KMeans, GMM, PCA, isolation forest, …)."
        )
    if refit_on_batch:
        model = replace(model, preparation=model.preparation.refitted_clips(missing_as_null(df)))
    return _scored(model, df)


def fitted_labels(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Labels of the rows a model was fitted on, also without scoring method."""
    return _scored(model, df)


def _scored(model: TrainedModel, df: DataFrame) -> DataFrame:
    require_columns(df, model.metadata["feature_columns"])
    clean = missing_as_null(df).withColumn("_row", F.struct(*[ref(c) for c in df.columns]))
    out = apply_model(model.fitted, model.preparation.transform(clean, keep=["_row"]))
    if model.metadata["inference_method"] == "transform":
        return out.select("_row.*", F.to_json("embedding").alias("embedding"))
    prediction = F.col("prediction")
    if model.classes is not None:
        prediction = F.element_at(
            F.array(*[F.lit(c) for c in model.classes]), prediction.cast("int") + 1
        )
    elif model.metadata["learning_mode"] == "unsupervised":
        prediction = prediction.cast("int")
    return out.select("_row.*", prediction.alias("prediction"))


def chosen_algorithms(ids: list[str]) -> list[str]:
    """Requested ids without blanks and repeats, in order, at most twelve."""
    if len(ids) > MAX_ALGORITHMS:
        raise ValueError("At most 12 algorithms per train request.")
    kept = list(dict.fromkeys(str(i).strip() for i in ids if str(i).strip()))
    if not kept:
        raise ValueError("Select at least one algorithm.")
    return kept


def compare(
    df: DataFrame,
    target: str,
    algorithms: list[str],
    options: dict | None = None,
    test_size: float = 0.2,
    seed: int = SEED,
) -> list[dict]:
    """One run per algorithm on the same split; a failure marks its own run."""
    ids = chosen_algorithms(algorithms)
    known = {a.id for a in registry.SUPERVISED}
    for name in ids:
        if name not in known:
            raise ValueError(f"Unknown algorithm_id: {name!r}")
    if df.columns and target in df.columns and infer_task(df, target) != CLASSIFICATION:
        # Resampling has no meaning for numbers and is switched off.
        options = {**(options or {}), "imbalance": "none"}
    prepared = prepare_supervised(df, target, options, test_size, seed)

    def one(name):
        return fit_supervised(prepared, name)

    try:
        return [_attempt(name, one) for name in ids]
    finally:
        prepared.release()


def compare_unsupervised(
    df: DataFrame,
    family: str,
    algorithms: list[str],
    options: dict | None = None,
    exclude: list[str] | None = None,
) -> list[dict]:
    ids = chosen_algorithms(algorithms)
    for name in ids:
        registry.unsupervised(name, family)
    prepared = prepare_unsupervised(df, options, exclude)
    try:
        return [_attempt(name, lambda n: fit_prepared(prepared, family, n)) for name in ids]
    finally:
        prepared.release()


def _attempt(name, fit) -> dict:
    run = {"algorithm_id": name, "status": "completed", "message": None, "metrics": None}
    run |= {"model": None, "task": None}
    try:
        model = fit(name)
        run |= {"model": model, "metrics": model.metadata["metrics"], "task": model.metadata["task"]}
    except Exception as error:
        run |= {"status": "failed", "message": str(error).split("\n")[0]}
    return run
