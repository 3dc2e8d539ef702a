"""Models trained by mini-batches inside each partition and averaged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.operators.models.base import (
    SEED,
    Fitted,
    Training,
    arrays,
    numeric_output,
    scorer,
)
from gridloom.operators.sums import batch_array, sum_over_rows

ROUNDS = 15
# Rows whose updates are computed together.
BLOCK = 32


def _mixed(t: Training, start: np.ndarray, step) -> np.ndarray:
    """Iterative parameter mixing (McDonald 2010): every round each partition
    runs its rows once from the shared weights, then the weights are averaged
    by row count. ``step(weights, x, y)`` returns the summed row updates."""
    weights, size = start, start.size
    for _ in range(ROUNDS):
        def learn(batches, weights=weights):
            own, seen = weights.copy(), 0
            for batch in batches:
                x, y = batch_array(batch.column(0)), batch_array(batch.column(1))
                x = np.column_stack([x, np.ones(len(x))]) if len(x) else x
                for i in range(0, len(x), BLOCK):
                    block = slice(i, i + BLOCK)
                    own = own + step(own, x[block], y[block]) / len(x[block])
                seen += len(x)
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(size + 1), pa.int64()),
                        pa.array(np.append(own.ravel() * seen, seen), pa.float64()),
                    ],
                    names=["position", "value"],
                )

        rows = (
            t.df.select("x", "label")
            .mapInArrow(learn, "position long, value double")
            .groupBy("position")
            .agg(F.sum("value").alias("value"))
            .collect()
        )
        total = np.zeros(size + 1)
        for row in rows:
            total[row.position] = row.value
        after = (total[:-1] / total[-1]).reshape(start.shape)
        moved = np.abs(after - weights).max()
        weights = after
        if moved < 1e-4 * max(1.0, np.abs(weights).max()):
            break
    return weights


def _signs(y, k):
    return np.where(np.asarray(y)[:, None] == np.arange(k), 1.0, -1.0)


def perceptron(t: Training) -> Fitted:
    def step(weights, x, y):
        signs = _signs(y, t.classes)
        wrong = signs * (x @ weights) <= 0
        return x.T @ (signs * wrong)

    weights = _mixed(t, np.zeros((t.d + 1, t.classes)), step)
    return Fitted("linear_argmax", {"weights": weights[:-1], "intercepts": weights[-1]})


def passive_aggressive_classifier(t: Training) -> Fitted:
    def step(weights, x, y):
        signs = _signs(y, t.classes)
        loss = np.maximum(0.0, 1 - signs * (x @ weights))
        size = np.minimum(1.0, loss / (x * x).sum(1)[:, None])
        return x.T @ (signs * size)

    weights = _mixed(t, np.zeros((t.d + 1, t.classes)), step)
    return Fitted("linear_argmax", {"weights": weights[:-1], "intercepts": weights[-1]})


def passive_aggressive_regressor(t: Training) -> Fitted:
    def step(weights, x, y):
        gap = np.asarray(y, float) - x @ weights
        size = np.minimum(1.0, np.maximum(0.0, np.abs(gap) - 0.1) / (x * x).sum(1))
        return x.T @ (np.sign(gap) * size)

    # The intercept starts at the mean, which unit steps would reach slowly.
    start = np.append(np.zeros(t.d), t.label_stats["mean"])
    weights = _mixed(t, start, step)
    return Fitted("linear", {"weights": weights[:-1], "intercept": float(weights[-1])})


HIDDEN = (128, 64)


def _unpack(flat, d):
    sizes = [d, *HIDDEN, 1]
    layers, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def _forward(layers, x):
    values = [x]
    for i, (weights, bias) in enumerate(layers):
        x = x @ weights + bias
        if i < len(layers) - 1:
            x = np.maximum(x, 0)
        values.append(x)
    return values


def network_regressor(t: Training, passes: int = 120) -> Fitted:
    """A 128-64 network; every step sums the gradient over all rows in Spark."""
    centre, scale = t.label_stats["mean"], t.label_stats["std"] or 1.0
    draw = np.random.default_rng(SEED)
    parts = []
    for a, b in zip([t.d, *HIDDEN], [*HIDDEN, 1]):
        parts += [draw.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]
    flat = np.concatenate(parts)
    first, second, best, stalled = np.zeros_like(flat), np.zeros_like(flat), np.inf, 0
    for step in range(1, passes + 1):
        def gradient(x, y, flat=flat):
            layers = _unpack(flat, t.d)
            values = _forward(layers, x)
            signal = values[-1] - ((np.asarray(y, float) - centre) / scale)[:, None]
            loss, out = 0.5 * (signal**2).sum(), []
            for i in range(len(layers) - 1, -1, -1):
                out = [(values[i].T @ signal).ravel(), signal.sum(0), *out]
                if i:
                    signal = (signal @ layers[i][0].T) * (values[i] > 0)
            return np.concatenate([*out, [loss]])

        total = sum_over_rows(t.df, ["x", "label"], gradient, flat.size + 1) / t.rows
        slope, loss = total[:-1], total[-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        flat = flat - rate * first / (np.sqrt(second) + 1e-8)
        stalled = 0 if loss < best - 1e-4 else stalled + 1
        best = min(best, loss)
        if stalled >= 10:
            break
    return Fitted("network", {"flat": flat, "d": t.d, "centre": centre, "scale": scale})


@scorer("network")
def _network(fitted, df):
    p = arrays(fitted.params)
    layers = _unpack(p["flat"], int(p["d"]))
    value = numeric_output(lambda x: _forward(layers, x)[-1][:, 0] * p["scale"] + p["centre"])
    return df.withColumn("prediction", value("x"))
