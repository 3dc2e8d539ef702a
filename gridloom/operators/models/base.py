"""Shared shape of fitted models and how they score a table.

A model is either a Spark ML model or a small dictionary of numbers with the
name of the scorer that applies it. Both score row by row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import balanced_sum
from gridloom.operators.sums import Moments, moments

SEED = 42
# Weights a linear score may spell out as a Spark expression.
EXPRESSION_TERMS = 200


@dataclass
class Training:
    """Prepared rows to fit on: ``x`` (array) and, if supervised, ``label``."""

    df: DataFrame
    rows: int
    d: int
    classes: int = 0

    def __getstate__(self):
        # Only the sizes travel to the tasks, never the table.
        return {"df": None, "rows": self.rows, "d": self.d, "classes": self.classes}

    @cached_property
    def vectors(self) -> DataFrame:
        return self.df.withColumn("features", array_to_vector("x"))

    @cached_property
    def moments(self) -> Moments:
        if self.classes:
            return moments(self.df, targets=["label"], d=self.d, classes=self.classes)
        return moments(self.df, targets=["label"], d=self.d)

    @cached_property
    def x_moments(self) -> Moments:
        return moments(self.df, d=self.d)

    @cached_property
    def label_stats(self):
        return self.df.agg(
            F.avg("label").alias("mean"),
            F.stddev_pop("label").alias("std"),
            F.stddev_samp("label").alias("sample_std"),
        ).first()


@dataclass
class Fitted:
    scorer: str
    params: dict[str, Any] = field(default_factory=dict)
    # A Spark ML model, when the algorithm is one of Spark's.
    model: Any = None
    # Rows the scorer needs (neighbour models) or labels of the fitted rows.
    table: DataFrame | None = None
    facts: dict[str, Any] = field(default_factory=dict)


SCORERS: dict[str, Callable[[Fitted, DataFrame], DataFrame]] = {}


def scorer(name: str):
    def register(function):
        SCORERS[name] = function
        return function

    return register


def apply_model(fitted: Fitted, df: DataFrame) -> DataFrame:
    """``df`` (with ``x``) and the model's output columns."""
    return SCORERS[fitted.scorer](fitted, df)


def stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()) if len(x) else np.zeros((0, 0))


def numeric_output(function: Callable[[np.ndarray], np.ndarray]):
    """A vectorised column function from the feature array to one number."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(function(stack(x)) if len(x) else [], dtype=float)

    return score


def array_output(function: Callable[[np.ndarray], np.ndarray]):
    """A vectorised column function from the feature array to an array."""

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(list(function(stack(x))) if len(x) else [], dtype=object)

    return score


def fourier_features(d: int, width: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases whose cosines approximate the RBF kernel
    (Rahimi & Recht 2007)."""
    draw = np.random.default_rng(SEED)
    return (
        draw.normal(scale=np.sqrt(2 * gamma), size=(d, width)),
        draw.uniform(0, 2 * np.pi, width),
    )


def fourier_map(x: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    return np.sqrt(2 / len(phases)) * np.cos(x @ frequencies + phases)


def arrays(params: dict) -> dict:
    """Parameters with lists turned back into numpy arrays."""
    return {k: np.array(v) if isinstance(v, list) else v for k, v in params.items()}


def basis(params: dict) -> Callable[[np.ndarray], np.ndarray]:
    """The feature map a linear model was fitted on (identity or Fourier)."""
    if "frequencies" not in params:
        return lambda x: x
    frequencies, phases = params["frequencies"], params["phases"]
    return lambda x: fourier_map(x, frequencies, phases)


@scorer("linear")
def _linear(fitted, df):
    """Intercept plus weighted sum; ``exponential`` applies a log link."""
    p = arrays(fitted.params)
    weights, intercept = np.ravel(p["weights"]), float(p["intercept"])
    if "frequencies" in p or len(weights) > EXPRESSION_TERMS:
        lift = basis(p)
        value = numeric_output(lambda x: lift(x) @ weights + intercept)("x")
    else:
        terms = [F.get("x", F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights)]
        value = balanced_sum(terms) + F.lit(intercept)
    if p.get("exponential"):
        value = F.exp(value)
    return df.withColumn("prediction", value)


@scorer("linear_argmax")
def _linear_argmax(fitted, df):
    """The class with the largest linear score."""
    p = arrays(fitted.params)
    weights, intercepts, lift = p["weights"], p["intercepts"], basis(p)
    score = numeric_output(lambda x: (lift(x) @ weights + intercepts).argmax(1))
    return df.withColumn("prediction", score("x"))


@scorer("gaussian_argmax")
def _gaussian_argmax(fitted, df):
    """The class (or component) with the largest Gaussian log density."""
    p = arrays(fitted.params)
    centres, precisions, offsets = p["centres"], p["precisions"], p["offsets"]

    def best(x):
        scores = []
        for centre, precision, offset in zip(centres, precisions, offsets):
            gap = x - centre
            scores.append(offset - 0.5 * ((gap @ precision) * gap).sum(1))
        return np.column_stack(scores).argmax(1)

    return df.withColumn("prediction", numeric_output(best)("x"))


@scorer("spark")
def _spark(fitted, df):
    """Any Spark ML classifier, regressor or clustering model."""
    lifted = df.withColumn("features", array_to_vector("x"))
    kept = [c for c in df.columns if c != "prediction"]
    return fitted.model.transform(lifted).select(
        *kept, F.col("prediction").cast("double").alias("prediction")
    )


@scorer("projection")
def _projection(fitted, df):
    """An embedding: centred (lifted) features times a matrix."""
    p = arrays(fitted.params)
    centre, matrix, lift = p["centre"], p["matrix"], basis(p)
    return df.withColumn("embedding", array_output(lambda x: (lift(x) - centre) @ matrix)("x"))
