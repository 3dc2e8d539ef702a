"""Linear models solved from one pass of cross products or by reweighting.

Rows enter only through sums; every solve is on a features-by-features matrix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.models.base import (
    SEED,
    Fitted,
    Training,
    fourier_features,
    fourier_map,
)
from gridloom.operators.ordering import exact_quantiles
from gridloom.operators.sums import PackedRows, sum_over_rows
from gridloom.session import checkpoint

FOURIER_WIDTH = 256


def _line(weights, m) -> Fitted:
    """A fitted line through the means of ``m``."""
    weights = np.ravel(weights)
    return Fitted(
        "linear", {"weights": weights, "intercept": float(m.y_mean[0] - m.x_mean @ weights)}
    )


def least_squares(t: Training) -> Fitted:
    m = t.moments
    return _line(np.linalg.lstsq(m.sxx, m.sxy, rcond=1e-12)[0], m)


def ridge_sums(t: Training, penalty: float) -> Fitted:
    m = t.moments
    return _line(np.linalg.solve(m.sxx + penalty * np.eye(t.d), m.sxy), m)


def sgd_regressor(t: Training) -> Fitted:
    """The minimiser of the same penalised squared loss, alpha 1e-4 per row."""
    return ridge_sums(t, 1e-4 * t.rows)


def lasso_path_end(t: Training, alpha: float = 1.0) -> Fitted:
    """Lasso at one penalty by coordinate descent on the covariances."""
    m = t.moments
    c, target = m.covariance, m.sxy[:, 0] / m.n
    weights = np.zeros(t.d)
    for _ in range(5000):
        before = weights.copy()
        for j in range(t.d):
            if c[j, j] > 0:
                partial = target[j] - c[j] @ weights + c[j, j] * weights[j]
                weights[j] = np.sign(partial) * max(abs(partial) - alpha, 0.0) / c[j, j]
        if np.abs(weights - before).max(initial=0.0) < 1e-10 * max(1.0, np.abs(weights).max()):
            break
    return _line(weights, m)


def matching_pursuit(t: Training) -> Fitted:
    """Greedy selection of a tenth of the features, at least one."""
    m = t.moments
    weights, chosen = np.zeros(t.d), []
    for _ in range(max(1, int(0.1 * t.d))):
        residual = np.abs(m.sxy[:, 0] - m.sxx @ weights)
        residual[chosen] = -1
        chosen.append(int(residual.argmax()))
        weights = np.zeros(t.d)
        weights[chosen] = np.linalg.lstsq(
            m.sxx[np.ix_(chosen, chosen)], m.sxy[chosen, 0], rcond=1e-12
        )[0]
    return _line(weights, m)


def bayesian_ridge(t: Training) -> Fitted:
    """Evidence maximisation on the eigenvectors of the cross products."""
    m, tiny = t.moments, 1e-6
    values, vectors = np.linalg.eigh(m.sxx)
    values = values.clip(min=0)
    rotated, total = vectors.T @ m.sxy[:, 0], m.syy[0, 0]
    noise, precision = t.rows / max(total, 1e-300), 1.0
    weights = np.zeros(t.d)
    for _ in range(300):
        before = weights
        weights = vectors @ (rotated / (values + precision / noise))
        error = max(total - 2 * weights @ m.sxy[:, 0] + weights @ m.sxx @ weights, 0.0)
        used = (noise * values / (precision + noise * values)).sum()
        precision = (used + 2 * tiny) / (weights @ weights + 2 * tiny)
        noise = (t.rows - used + 2 * tiny) / (error + 2 * tiny)
        if np.abs(weights - before).sum() < 1e-3:
            break
    return _line(weights, m)


def relevance_regression(t: Training) -> Fitted:
    """One precision per weight; weights with a huge precision are dropped."""
    m, tiny = t.moments, 1e-6
    total, noise = m.syy[0, 0], t.rows / max(m.syy[0, 0], 1e-300)
    precision, kept = np.ones(t.d), np.ones(t.d, bool)
    weights = np.zeros(t.d)
    for _ in range(300):
        before, weights = weights, np.zeros(t.d)
        inner = np.ix_(kept, kept)
        spread = np.linalg.pinv(np.diag(precision[kept]) + noise * m.sxx[inner])
        weights[kept] = noise * spread @ m.sxy[kept, 0]
        error = max(total - 2 * weights @ m.sxy[:, 0] + weights @ m.sxx @ weights, 0.0)
        used = 1 - precision[kept] * np.diag(spread)
        precision[kept] = (used + 2 * tiny) / (weights[kept] ** 2 + 2 * tiny)
        noise = (t.rows - used.sum() + 2 * tiny) / (error + 2 * tiny)
        kept = kept & (precision < 1e4)
        weights[~kept] = 0.0
        if np.abs(weights - before).sum() < 1e-3 or not kept.any():
            break
    return _line(weights, m)


def ridge_classifier(t: Training) -> Fitted:
    """Least squares on +1/-1 targets per class with a unit ridge."""
    m = t.moments
    weights = np.linalg.solve(m.sxx + np.eye(t.d), 2 * m.sxy)
    return Fitted(
        "linear_argmax",
        {"weights": weights, "intercepts": 2 * m.y_mean - 1 - m.x_mean @ weights},
    )


# --- reweighted least squares ---------------------------------------------


def _reweighted(t: Training, work, ridge, start, passes, lift=None, width=None) -> np.ndarray:
    """Repeat weighted least squares; ``work(score, y, step)`` gives weight and
    target of each row. The last coefficient is the intercept. One pass per step."""
    lift = lift or (lambda x: x)
    size = (width or t.d) + 1
    beta = start
    with PackedRows(t.df, ["x", "label"], t.d) as rows:
        for step in range(passes):
            def statistic(x, y, beta=beta, step=step):
                x = np.column_stack([lift(x), np.ones(len(x))])
                weight, target = work(x @ beta, y, step)
                # A matrix with itself is half of the products.
                x *= np.sqrt(weight)[:, None]
                return np.concatenate([(x.T @ x).ravel(), x.T @ (np.sqrt(weight) * target)])

            packed = rows.sum(statistic, size * size + size)
            gram, right = packed[: size * size].reshape(size, size), packed[size * size :]
            after = np.linalg.lstsq(gram + np.diag(ridge), right, rcond=1e-13)[0]
            moved = np.abs(after - beta).max()
            beta = after
            if moved < 1e-6 * max(1.0, np.abs(beta).max()):
                break
    return beta


def _coefficients(beta, **more) -> Fitted:
    return Fitted("linear", {"weights": beta[:-1], "intercept": float(beta[-1]), **more})


def tweedie(t: Training, power: float = 1.5, alpha: float = 1.0) -> Fitted:
    """Log-link Tweedie regression by Fisher scoring."""
    if t.df.filter(F.col("label") < 0).limit(1).count():
        raise ValueError("Some value(s) of y are out of the valid range of the loss.")
    mean = max(t.label_stats["mean"], 1e-12)

    def work(score, y, step):
        mu = np.exp(score.clip(-30, 30))
        return mu ** (2 - power), score + (y - mu) / mu

    start = np.append(np.zeros(t.d), np.log(mean))
    ridge = np.append(np.full(t.d, alpha * t.rows), 0.0)
    return _coefficients(_reweighted(t, work, ridge, start, 100), exponential=True)


def _absolute(scale: float):
    """Row weights that turn least squares into absolute loss (Hunter & Lange);
    the rounding of its tip shrinks step by step."""

    def work(score, y, step):
        floor = scale * max(1e-5, 0.1 * 0.6**step)
        return 1.0 / np.maximum(np.abs(y - score), floor), y

    return work


def median_regression(t: Training) -> Fitted:
    scale = t.label_stats["std"] or 1.0
    start = least_squares(t).params
    beta = np.append(start["weights"], start["intercept"])
    ridge = np.append(np.full(t.d, 1e-9), 0.0)
    return _coefficients(_reweighted(t, _absolute(scale), ridge, beta, 40))


def linear_support_regression(t: Training) -> Fitted:
    """Absolute loss with C = 1 and a unit ridge, intercept included."""
    scale = t.label_stats["std"] or 1.0
    beta = np.append(np.zeros(t.d), t.label_stats["mean"])
    return _coefficients(_reweighted(t, _absolute(scale), np.ones(t.d + 1), beta, 40))


def _squared_hinge(t: Training, lift, width: int, passes: int = 40) -> Fitted:
    """All one-against-rest margins at once by Newton steps on squared hinge
    loss, C = 1, intercept penalised like a weight."""
    size, k = width + 1, t.classes
    beta = np.zeros((size, k))
    with PackedRows(t.df, ["x", "label"], t.d) as rows:
        for _ in range(passes):
            def statistic(x, y, beta=beta):
                x = np.column_stack([lift(x), np.ones(len(x))])
                signs = np.where(np.asarray(y)[:, None] == np.arange(k), 1.0, -1.0)
                active = (signs * (x @ beta) < 1).astype(float)
                met = [x[active[:, c] > 0] for c in range(k)]
                grams = np.concatenate([(part.T @ part).ravel() for part in met])
                return np.concatenate([grams, (x.T @ (signs * active)).ravel()])

            packed = rows.sum(statistic, k * size * size + size * k)
            grams = packed[: k * size * size].reshape(k, size, size)
            right = packed[k * size * size :].reshape(size, k)
            after = np.column_stack(
                [np.linalg.solve(grams[c] + 0.5 * np.eye(size), right[:, c]) for c in range(k)]
            )
            moved = np.abs(after - beta).max()
            beta = after
            if moved < 1e-6 * max(1.0, np.abs(beta).max()):
                break
    return Fitted("linear_argmax", {"weights": beta[:-1], "intercepts": beta[-1]})


def linear_support_classifier(t: Training) -> Fitted:
    return _squared_hinge(t, lambda x: x, t.d)


# --- kernel methods on random Fourier features ------------------------------


def _kernel_basis(t: Training, gamma: float, width: int = FOURIER_WIDTH):
    frequencies, phases = fourier_features(t.d, width, gamma)
    return (lambda x: fourier_map(x, frequencies, phases)), {
        "frequencies": frequencies,
        "phases": phases,
    }


def scale_gamma(t: Training) -> float:
    """One over features times the variance of all feature values."""
    m = t.x_moments
    variance = np.trace(m.raw) / (m.n * t.d) - m.x_mean.mean() ** 2
    return 1.0 / (t.d * variance) if variance > 0 else 1.0


def kernel_ridge(t: Training) -> Fitted:
    lift, more = _kernel_basis(t, 1.0 / t.d)

    def statistic(x, y):
        z = lift(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    size = FOURIER_WIDTH
    packed = sum_over_rows(t.df, ["x", "label"], statistic, size * size + size)
    gram = packed[: size * size].reshape(size, size)
    weights = np.linalg.solve(gram + np.eye(size), packed[size * size :])
    return Fitted("linear", {"weights": weights, "intercept": 0.0, **more})


def kernel_support_classifier(t: Training) -> Fitted:
    lift, more = _kernel_basis(t, scale_gamma(t))
    fitted = _squared_hinge(t, lift, FOURIER_WIDTH)
    fitted.params |= more
    return fitted


def kernel_support_regression(t: Training, tube: float = 0.1) -> Fitted:
    lift, more = _kernel_basis(t, scale_gamma(t))
    scale = t.label_stats["std"] or 1.0

    def work(score, y, step):
        floor = scale * max(1e-4, 0.1 * 0.6**step)
        # Rows inside the tube are already met; outside, aim at its edge.
        gap = y - score
        outside = np.abs(gap) > tube
        weight = np.where(outside, 1.0 / np.maximum(np.abs(gap), floor), 1e-8)
        return weight, np.where(outside, y - np.sign(gap) * tube, score)

    start = np.append(np.zeros(FOURIER_WIDTH), t.label_stats["mean"])
    ridge = np.append(np.ones(FOURIER_WIDTH), 1e-9)
    beta = _reweighted(t, work, ridge, start, 25, lift, FOURIER_WIDTH)
    return _coefficients(beta, **more)


# --- robust regression from small subsets -----------------------------------


def drawn_subsets(t: Training, subsets: int) -> DataFrame:
    """(rows): about ``subsets`` groups of d + 1 rows (h, x, label), drawn by hash.

    Every row has a number; in each round the hash of number and round deals it to a
    group of twice the size wanted on average, of which the smallest hashes stay. A
    small table has many rounds; of a large one, each row takes part in one round at
    most, and only rows that take part are moved. Copies are rows of their own.
    """
    size = t.d + 1
    wanted = 2 * subsets * size
    rounds = max(1, math.ceil(wanted / max(t.rows, 1)))
    key = F.xxhash64(F.lit(SEED), F.monotonically_increasing_id())
    rows = t.df.select("x", "label").withColumn("key", key)
    if wanted < t.rows:
        rows = rows.filter(F.col("key") < int(-(1 << 63) + wanted / t.rows * (1 << 64)))
    # Numbers hold once they are written.
    rows = checkpoint(rows)
    groups = max(1, subsets // rounds)
    turns = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    turns = turns.withColumn("h", F.xxhash64("key", "round")).withColumn("g", F.pmod("h", F.lit(groups)))
    # A group holds about twice d + 1 rows at any size of the table.
    gathered = turns.groupBy("round", "g").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("h").alias("h"), "x", "label"))).alias("rows"))
    return gathered.filter(F.size("rows") >= size).select(F.slice("rows", 1, size).alias("rows"))


def subset_lines(t: Training, subsets: int) -> DataFrame:
    """(x, y): the line through each subset, weights and intercept as ``x``."""
    d = t.d

    def fit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).flatten()
            x = rows.field(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d + 1, d)
            y = rows.field(2).to_numpy(zero_copy_only=False).reshape(-1, d + 1, 1)
            lines = np.linalg.pinv(np.concatenate([x, np.ones((*x.shape[:2], 1))], axis=2)) @ y
            yield pa.RecordBatch.from_arrays([pa.array(list(lines[:, :, 0]), pa.list_(pa.float64()))], names=["x"])

    rows = drawn_subsets(t, subsets).select(F.transform("rows", lambda r: F.struct(r["h"], r["x"].alias("x"), r["label"].cast("double").alias("label"))).alias("rows"))
    return checkpoint(rows.mapInArrow(fit, "x array<double>"))


def consensus_regression(t: Training, trials: int = 200) -> Fitted:
    """Least squares on the largest consensus set among 200 drawn lines."""
    median = exact_quantiles(t.df, ["label"], [0.5], rows=t.rows)["label"][0]
    spread = t.df.select(F.abs(F.col("label") - median).alias("gap"))
    limit = exact_quantiles(spread, ["gap"], [0.5], rows=t.rows)["gap"][0]
    # A bounded number of lines, tried on all rows at once.
    lines = np.array([r.x for r in subset_lines(t, trials).collect()], float)
    if not len(lines):
        raise ValueError("RANSAC could not find a valid consensus set: too few rows.")

    def inliers(x, y):
        x = np.column_stack([x, np.ones(len(x))])
        return (np.abs(x @ lines.T - np.asarray(y)[:, None]) <= limit).sum(0).astype(float)

    best = lines[sum_over_rows(t.df, ["x", "label"], inliers, len(lines)).argmax()]

    def work(x, y):
        x = np.column_stack([x, np.ones(len(x))])
        inside = np.abs(x @ best - y) <= limit
        x, y = x[inside], np.asarray(y)[inside]
        return np.concatenate([(x.T @ x).ravel(), x.T @ y])

    size = t.d + 1
    packed = sum_over_rows(t.df, ["x", "label"], work, size * size + size)
    gram = packed[: size * size].reshape(size, size)
    return _coefficients(np.linalg.lstsq(gram, packed[size * size :], rcond=1e-12)[0])


def spatial_median(points: DataFrame, d: int, passes: int = 300, tolerance: float = 1e-3) -> np.ndarray:
    """The point with the least sum of distances to the points ``x``: means weighted
    by the inverse distance to the last one, a pass over the rows each. A point that
    the last one coincides with pulls by its own weight only (Vardi & Zhang 2000)."""
    middles = [F.percentile_approx(F.get("x", F.lit(i)), 0.5, F.lit(1000)) for i in range(d)]
    at = np.array([float(v) for v in points.agg(*middles).first()])
    for _ in range(passes):
        def pull(x, at=at):
            gap = np.sqrt(((x - at) ** 2).sum(1))
            away = gap > 1e-12
            weight = 1 / gap[away]
            return np.concatenate([[(~away).sum(), weight.sum()], weight @ x[away]])

        packed = sum_over_rows(points, ["x"], pull, d + 2)
        if packed[1] == 0:
            return at
        target = packed[2:] / packed[1]
        force = np.sqrt((((target - at) * packed[1]) ** 2).sum())
        stay = min(1.0, packed[0] / force) if force > 0 else 1.0
        after = (1 - stay) * target + stay * at
        moved = np.sqrt(((after - at) ** 2).sum())
        at = after
        if moved < tolerance * max(1e-12, np.sqrt((at**2).sum())):
            return at
    return at


def spatial_median_regression(t: Training, subsets: int = 10_000) -> Fitted:
    """Theil–Sen: the spatial median of the lines through many small subsets. The
    driver holds one line at a time."""
    lines = subset_lines(t, subsets)
    if lines.isEmpty():
        raise ValueError("Theil-Sen needs more rows than features.")
    return _coefficients(spatial_median(lines, t.d + 1))
