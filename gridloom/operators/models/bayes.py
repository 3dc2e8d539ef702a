"""Discriminant analysis and naive Bayes from class-wise sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators.models.base import Fitted, Training, arrays, numeric_output, scorer
from gridloom.operators.sums import first_values, sum_over_rows


def class_sums(t: Training, squares: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class: count, mean of x, and centred squares or cross products of x.

    Sums are of values less a shift, so that large values with a small spread keep
    their digits.
    """
    k, d = t.classes, t.d
    second = d * d if squares == "cross" else d
    shift = first_values(t.df, ["x"])
    shift = shift if len(shift) == d else np.zeros(d)

    def statistic(x, y):
        x = x - shift
        one = (np.asarray(y)[:, None] == np.arange(k)).astype(float)
        if squares == "cross":
            products = np.concatenate([(x.T @ (x * one[:, c : c + 1])).ravel() for c in range(k)])
        else:
            products = (one.T @ (x * x)).ravel()
        return np.concatenate([one.sum(0), (one.T @ x).ravel(), products])

    packed = sum_over_rows(t.df, ["x", "label"], statistic, k + k * d + k * second)
    counts, sums = packed[:k], packed[k : k + k * d].reshape(k, d)
    means = sums / np.maximum(counts, 1)[:, None]
    if squares == "cross":
        centred = packed[k + k * d :].reshape(k, d, d) - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    else:
        centred = (packed[k + k * d :].reshape(k, d) - counts[:, None] * means**2).clip(min=0)
    return counts, means + shift, centred


def linear_discriminant(t: Training) -> Fitted:
    """Shared covariance: linear scores per class."""
    m = t.moments
    counts = m.y_mean * m.n
    means = (m.sxy.T + np.outer(counts, m.x_mean)) / counts[:, None]
    gaps = means - m.x_mean
    within = (m.sxx - (gaps.T * counts) @ gaps) / max(m.n - t.classes, 1)
    inverse = np.linalg.pinv(within, rcond=1e-8, hermitian=True)
    weights = inverse @ means.T
    offsets = np.log(counts / m.n) - 0.5 * np.einsum("kd,dk->k", means, weights)
    return Fitted("linear_argmax", {"weights": weights, "intercepts": offsets})


def quadratic_discriminant(t: Training) -> Fitted:
    counts, means, cross = class_sums(t, "cross")
    if counts.min() < 2:
        raise ValueError("y has only 1 sample in the least populated class.")
    centres, precisions, offsets = [], [], []
    for n, centre, products in zip(counts, means, cross):
        covariance = products / (n - 1)
        values, vectors = np.linalg.eigh(covariance)
        values = values.clip(min=1e-10 * max(values.max(), 1e-300))
        centres.append(centre)
        precisions.append((vectors / values) @ vectors.T)
        offsets.append(np.log(n / counts.sum()) - 0.5 * np.log(values).sum())
    return Fitted(
        "gaussian_argmax",
        {"centres": np.array(centres), "precisions": np.array(precisions), "offsets": np.array(offsets)},
    )


def gaussian_bayes(t: Training) -> Fitted:
    """Independent Gaussians per class, variances raised by 1e-9 of the largest."""
    counts, centres, squares = class_sums(t, "diagonal")
    variances = squares / counts[:, None]
    middle = counts @ centres / counts.sum()
    overall = (squares.sum(0) + counts @ (centres - middle) ** 2) / counts.sum()
    variances = variances + max(1e-9 * overall.max(), 1e-300)
    return Fitted(
        "diagonal_argmax",
        {
            "centres": centres,
            "variances": variances,
            "offsets": np.log(counts / counts.sum()) - 0.5 * np.log(2 * np.pi * variances).sum(1),
        },
    )


@scorer("diagonal_argmax")
def _diagonal_argmax(fitted, df):
    p = arrays(fitted.params)
    centres, variances, offsets = p["centres"], p["variances"], p["offsets"]

    def best(x):
        scores = [
            offset - 0.5 * ((x - centre) ** 2 / variance).sum(1)
            for centre, variance, offset in zip(centres, variances, offsets)
        ]
        return np.column_stack(scores).argmax(1)

    return df.withColumn("prediction", numeric_output(best)("x"))


def categorical_bayes(t: Training) -> Fitted:
    """Smoothed category frequencies per class, for features that are codes."""
    sizes = [
        int(v) + 1
        for v in t.df.agg(*[F.max(F.get("x", F.lit(i))) for i in range(t.d)]).first()
    ]
    lows = t.df.agg(*[F.min(F.get("x", F.lit(i))) for i in range(t.d)]).first()
    if min(lows) < 0:
        raise ValueError("Negative values in data passed to CategoricalNB.")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    k = t.classes

    def statistic(x, y):
        y = np.asarray(y).astype(int)
        counts = np.zeros((k, starts[-1]))
        for j in range(len(sizes)):
            np.add.at(counts, (y, starts[j] + x[:, j].astype(int)), 1)
        return np.concatenate([np.bincount(y, minlength=k), counts.ravel()])

    packed = sum_over_rows(t.df, ["x", "label"], statistic, k + k * int(starts[-1]))
    counts, table = packed[:k], packed[k:].reshape(k, -1)
    logs = np.concatenate(
        [
            np.log((table[:, a:b] + 1) / (counts[:, None] + b - a))
            for a, b in zip(starts[:-1], starts[1:])
        ],
        axis=1,
    )
    return Fitted(
        "category_argmax",
        {"starts": starts, "logs": logs, "priors": np.log(counts / counts.sum())},
    )


@scorer("category_argmax")
def _category_argmax(fitted, df):
    p = arrays(fitted.params)
    starts, logs, priors = p["starts"].astype(int), p["logs"], p["priors"]

    def best(x):
        scores = np.tile(priors, (len(x), 1))
        for j in range(len(starts) - 1):
            code, size = x[:, j].astype(int), starts[j + 1] - starts[j]
            # A category not seen in training adds nothing to any class.
            known = (code >= 0) & (code < size)
            scores += np.where(known[:, None], logs[:, starts[j] + code.clip(0, size - 1)].T, 0.0)
        return scores.argmax(1)

    return df.withColumn("prediction", numeric_output(best)("x"))
