"""Embeddings: projections from second moments and iterative factorisations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators.models.base import (
    SEED,
    SCORERS,
    Fitted,
    Training,
    array_output,
    arrays,
    fourier_features,
    fourier_map,
    scorer,
)
from gridloom.operators.sums import PackedRows, digamma, sum_over_rows, trigamma

COMPONENTS = 10
ATOMS = 15
FOURIER_WIDTH = 256
# Rounds over the rows, the move at which the weights of a row's topics have settled,
# and the rows that a task settles together.
TOPIC_ROUNDS, TOPIC_CHANGE, TOPIC_PART = 50, 1e-3, 1024


def _width(t: Training, wanted: int = COMPONENTS, narrow: bool = False) -> int:
    """Component count capped below the row count; some methods also need it to
    stay within the feature count."""
    width = max(1, min(wanted, t.rows - 1))
    if narrow and width > t.d:
        raise ValueError(f"n_components={width} must be at most the number of features {t.d}.")
    return width


def _project(centre, matrix, **facts) -> Fitted:
    return Fitted("projection", {"centre": centre, "matrix": matrix}, facts=facts)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Fix the sign of each direction: its largest entry is positive."""
    top = np.abs(vectors).argmax(0)
    return vectors * np.sign(vectors[top, np.arange(vectors.shape[1])] + 1e-300)


def _principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)
    return values[order].clip(min=0), _signed(vectors[:, order])


def _variance_facts(values, total, k):
    share = values[:k].sum() / total if total > 0 else 0.0
    return {"explained_variance_ratio_sum": float(share), "n_components": int(k)}


def pca(t: Training, share: float = 0.95) -> Fitted:
    """The fewest components that explain 95 % of the variance."""
    m = t.x_moments
    values, vectors = _principal(m.covariance)
    shares = np.cumsum(values) / max(values.sum(), 1e-300)
    k = min(int(np.searchsorted(shares, share, side="right")) + 1, t.d)
    return _project(m.x_mean, vectors[:, :k], **_variance_facts(values, values.sum(), k))


def incremental_pca(t: Training) -> Fitted:
    k, m = _width(t, narrow=True), t.x_moments
    values, vectors = _principal(m.covariance)
    return _project(m.x_mean, vectors[:, :k], **_variance_facts(values, values.sum(), k))


def truncated_svd(t: Training) -> Fitted:
    """Uncentred directions; explained variance is that of the projected rows."""
    k, m = _width(t, narrow=True), t.x_moments
    _, vectors = _principal(m.raw)
    vectors = vectors[:, :k]
    values = np.einsum("dk,de,ek->k", vectors, m.covariance, vectors)
    return _project(
        np.zeros(t.d), vectors, **_variance_facts(values, np.trace(m.covariance), k)
    )


def kernel_pca(t: Training) -> Fitted:
    """PCA of random Fourier features of the RBF kernel."""
    k = _width(t)
    frequencies, phases = fourier_features(t.d, FOURIER_WIDTH, 1.0 / t.d)

    def statistic(x):
        z = fourier_map(x, frequencies, phases)
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    size = FOURIER_WIDTH
    packed = sum_over_rows(t.df, ["x"], statistic, size + size * size)
    centre = packed[:size] / t.rows
    covariance = packed[size:].reshape(size, size) / t.rows - np.outer(centre, centre)
    _, vectors = _principal(covariance)
    fitted = _project(centre, vectors[:, :k], n_components=k)
    fitted.params |= {"frequencies": frequencies, "phases": phases}
    del fitted.facts["n_components"]
    return fitted


def factor_analysis(t: Training, passes: int = 500) -> Fitted:
    """Maximum likelihood factors; rows enter only through their covariance."""
    k, m = min(_width(t), t.d), t.x_moments
    covariance = m.covariance
    variance = np.diag(covariance)
    noise, tiny, before = np.ones(t.d), 1e-12, -np.inf
    for _ in range(passes):
        root = np.sqrt(noise) + tiny
        values, vectors = _principal(covariance / np.outer(root, root))
        kept, rest = values[:k], values[k:]
        loadings = np.sqrt(np.maximum(kept - 1, 0)) * vectors[:, :k] * root[:, None]
        likelihood = -0.5 * (
            np.log(np.maximum(kept, 1e-300)).sum() + rest.sum() + 2 * np.log(root).sum()
        )
        if likelihood - before < 1e-2 / max(t.rows, 1):
            break
        before = likelihood
        noise = np.maximum(variance - (loadings**2).sum(1), tiny)
    scaled = loadings / noise[:, None]
    inner = np.linalg.inv(np.eye(k) + loadings.T @ scaled)
    return _project(m.x_mean, scaled @ inner)


def fast_ica(t: Training, passes: int = 400) -> Fitted:
    """Whitened directions with the least Gaussian projections (log cosh)."""
    k, m = min(_width(t), t.d), t.x_moments
    values, vectors = _principal(m.covariance)
    k = min(k, int((values > 1e-10 * max(values.max(), 1e-300)).sum()))
    whiten = vectors[:, :k] / np.sqrt(values[:k])
    rotation = _orthogonal(np.random.default_rng(SEED).normal(size=(k, k)))
    centre = m.x_mean
    for _ in range(passes):
        def statistic(x, rotation=rotation):
            z = (x - centre) @ whiten
            g = np.tanh(z @ rotation.T)
            return np.concatenate([(g.T @ z).ravel(), (1 - g * g).sum(0)])

        packed = sum_over_rows(t.df, ["x"], statistic, k * k + k) / t.rows
        slope = packed[: k * k].reshape(k, k) - packed[k * k :][:, None] * rotation
        after = _orthogonal(slope)
        moved = np.abs(np.abs((after * rotation).sum(1)) - 1).max()
        rotation = after
        if moved < 1e-4:
            break
    return _project(centre, whiten @ rotation.T)


def _orthogonal(matrix: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(matrix @ matrix.T)
    return (vectors / np.sqrt(values.clip(min=1e-300))) @ vectors.T @ matrix


def feature_agglomeration(t: Training, groups: int = 8) -> Fitted:
    """Ward clusters of the features from their cross products; each output is
    the mean of one group."""
    raw = t.x_moments.raw
    if t.d < groups:
        raise ValueError(f"Cannot extract more clusters than features: {groups} > {t.d}.")
    squares = np.diag(raw)
    gap = np.maximum(squares[:, None] + squares[None] - 2 * raw, 0)
    np.fill_diagonal(gap, np.inf)
    members, size = [[j] for j in range(t.d)], np.ones(t.d)
    alive = np.ones(t.d, bool)
    for _ in range(t.d - groups):
        masked = np.where(alive[:, None] & alive[None], gap, np.inf)
        a, b = np.unravel_index(masked.argmin(), masked.shape)
        # Ward's update of squared distances after a merge.
        total = size[a] + size[b] + size
        merged = ((size[a] + size) * gap[a] + (size[b] + size) * gap[b] - size * gap[a, b]) / total
        gap[a], gap[:, a] = merged, merged
        gap[a, a], alive[b] = np.inf, False
        members[a], size[a] = members[a] + members[b], size[a] + size[b]
    kept = sorted((members[j] for j in range(t.d) if alive[j]), key=min)
    matrix = np.zeros((t.d, len(kept)))
    labels = [0] * t.d
    for g, group in enumerate(kept):
        matrix[group, g] = 1 / len(group)
        for j in group:
            labels[j] = g
    return _project(np.zeros(t.d), matrix, feature_labels=labels)


def gaussian_projection(t: Training) -> Fitted:
    k = _width(t, narrow=True)
    draw = np.random.default_rng(SEED).normal(size=(t.d, k)) / np.sqrt(k)
    return _project(np.zeros(t.d), draw)


def sparse_projection(t: Training) -> Fitted:
    """Signs with density one over the root of the feature count."""
    k, draw = _width(t, narrow=True), np.random.default_rng(SEED)
    density = 1 / np.sqrt(t.d)
    signs = np.where(draw.uniform(size=(t.d, k)) < 0.5, 1.0, -1.0)
    kept = draw.uniform(size=(t.d, k)) < density
    return _project(np.zeros(t.d), signs * kept / np.sqrt(density * k))


# --- factorisations whose row codes are solved inside the tasks --------------


def _nonnegative_codes(x, parts, steps: int = 100):
    """Non-negative row factors by cyclic coordinate descent."""
    gram, right = parts @ parts.T, x @ parts.T
    codes = np.maximum(right, 0) / max(np.trace(gram), 1e-300)
    for _ in range(steps):
        before = codes.copy()
        for j in range(len(parts)):
            if gram[j, j] > 1e-300:
                slope = right[:, j] - codes @ gram[:, j]
                codes[:, j] = np.maximum(codes[:, j] + slope / gram[j, j], 0)
        if np.abs(codes - before).max(initial=0) < 1e-6 * max(np.abs(codes).max(initial=0), 1e-12):
            break
    return codes


def nmf(t: Training, passes: int = 60) -> Fitted:
    """Non-negative factors: tasks solve their rows, the driver the parts."""
    if t.df.filter(F.exists("x", lambda v: v < 0)).limit(1).count():
        raise ValueError("Negative values in data passed to NMF.")
    k, m = _width(t), t.x_moments
    values, vectors = _principal(m.raw)
    # Non-negative start from the leading directions, zeros filled by the mean.
    parts = np.abs(vectors[:, : min(k, t.d)].T) * np.sqrt(values[: min(k, t.d)] / t.rows)[:, None]
    if k > len(parts):
        draw = np.random.default_rng(SEED).uniform(size=(k - len(parts), t.d))
        parts = np.vstack([parts, draw * m.x_mean])
    parts, size, before = np.maximum(parts, 1e-6), k * k + k * t.d + 1, np.inf
    for _ in range(passes):
        def statistic(x, parts=parts):
            codes = _nonnegative_codes(x, parts)
            error = ((x - codes @ parts) ** 2).sum()
            return np.concatenate([(codes.T @ codes).ravel(), (codes.T @ x).ravel(), [error]])

        packed = sum_over_rows(t.df, ["x"], statistic, size)
        error = packed[-1]
        if before - error <= 1e-4 * max(before, 1e-300) and np.isfinite(before):
            break
        before, fitted_parts = error, parts
        gram, right = packed[: k * k].reshape(k, k), packed[k * k : -1].reshape(k, t.d)
        parts = parts.copy()
        for _ in range(20):
            for j in range(k):
                if gram[j, j] > 1e-300:
                    step = (right[j] - gram[j] @ parts) / gram[j, j]
                    parts[j] = np.maximum(parts[j] + step, 0)
    return Fitted(
        "nonnegative",
        {"parts": fitted_parts},
        facts={"reconstruction_error": float(np.sqrt(before))},
    )


@scorer("nonnegative")
def _nonnegative(fitted, df):
    parts = arrays(fitted.params)["parts"]
    return df.withColumn("embedding", array_output(lambda x: _nonnegative_codes(x, parts))("x"))


def _sparse_codes(x, atoms, alpha: float = 1.0, steps: int = 200):
    """Lasso codes of every row by coordinate descent."""
    gram, right = atoms @ atoms.T, x @ atoms.T
    codes = np.zeros_like(right)
    for _ in range(steps):
        before = codes.copy()
        for j in range(len(atoms)):
            if gram[j, j] > 1e-12:
                partial = right[:, j] - codes @ gram[:, j] + codes[:, j] * gram[j, j]
                shrunk = np.maximum(np.abs(partial) - alpha, 0)
                codes[:, j] = np.sign(partial) * shrunk / gram[j, j]
        if np.abs(codes - before).max(initial=0) < 1e-6:
            break
    return codes


def dictionary_learning(t: Training, passes: int = 60) -> Fitted:
    """Unit atoms with sparse codes (Mairal 2009): codes in the tasks, atoms on
    the driver from the summed code products."""
    k = _width(t, ATOMS)
    m, draw = t.x_moments, np.random.default_rng(SEED)
    _, vectors = _principal(m.covariance)
    atoms = vectors.T[: min(k, t.d)]
    if k > len(atoms):
        atoms = np.vstack([atoms, draw.normal(size=(k - len(atoms), t.d))])
    atoms = atoms / np.linalg.norm(atoms, axis=1, keepdims=True)
    size, before = k * k + k * t.d + 1, np.inf
    for _ in range(passes):
        def statistic(x, atoms=atoms):
            codes = _sparse_codes(x, atoms)
            cost = 0.5 * ((x - codes @ atoms) ** 2).sum() + np.abs(codes).sum()
            return np.concatenate([(codes.T @ codes).ravel(), (codes.T @ x).ravel(), [cost]])

        packed = sum_over_rows(t.df, ["x"], statistic, size)
        gram, right = packed[: k * k].reshape(k, k), packed[k * k : -1].reshape(k, t.d)
        cost, best = packed[-1], atoms
        if np.isfinite(before) and before - cost <= 1e-4 * abs(before):
            break
        before, atoms = cost, atoms.copy()
        for j in range(k):
            if gram[j, j] > 1e-8:
                moved = atoms[j] + (right[j] - gram[j] @ atoms) / gram[j, j]
                atoms[j] = moved / max(np.linalg.norm(moved), 1e-12)
    return Fitted("sparse_codes", {"atoms": best})


@scorer("sparse_codes")
def _sparse(fitted, df):
    atoms = arrays(fitted.params)["atoms"]
    return df.withColumn("embedding", array_output(lambda x: _sparse_codes(x, atoms))("x"))


def _expected_log(gamma: np.ndarray) -> np.ndarray:
    """Expected logarithms of Dirichlet shares, by row."""
    return digamma(gamma) - digamma(gamma.sum(1))[:, None]


def _topic_weights(x: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Variational weights of the topics of every row of ``x``, each row until they
    move by 0.001 on average; ``beta`` is the exponential of the expected log of the
    topics, by topic and feature."""
    gamma, left = np.ones((len(x), len(alpha))), np.arange(len(x))
    while len(left):
        before, rows = gamma[left], x[left]
        theta = np.exp(_expected_log(before))
        after = alpha + theta * ((rows / (theta @ beta + 1e-100)) @ beta.T)
        gamma[left] = after
        left = left[np.abs(after - before).mean(1) > TOPIC_CHANGE]
    return gamma


def topics(t: Training) -> Fitted:
    """Online variational Bayes as Spark's LDA, with its rates and priors. A round sums
    over all rows in packed form, without drawing a sample of them first."""
    if t.df.filter(F.exists("x", lambda v: v < 0)).limit(1).count():
        raise ValueError("Negative values in data passed to LatentDirichletAllocation.")
    k, d = max(2, _width(t)), t.d
    alpha, eta = np.full(k, 1 / k), 1 / k
    weights = np.random.default_rng(SEED).gamma(100.0, 0.01, (k, d))
    with PackedRows(t.df, ["x"], d) as packed:
        for turn in range(1, TOPIC_ROUNDS + 1):
            beta = np.exp(_expected_log(weights))

            def statistic(x, beta=beta, alpha=alpha):
                total = np.zeros(k * d + k + 1)
                x = x[(x != 0).any(1)]
                # Small parts stay in the processor's cache.
                for part in np.array_split(x, range(TOPIC_PART, len(x), TOPIC_PART)):
                    logs = _expected_log(_topic_weights(part, beta, alpha))
                    theta = np.exp(logs)
                    total[: k * d] += (theta.T @ (part / (theta @ beta + 1e-100))).ravel()
                    total[k * d : -1] += logs.sum(0)
                    total[-1] += len(part)
                return total

            found = packed.sum(statistic, k * d + k + 1)
            n = found[-1]
            if not n:
                break
            rate = (1024 + turn) ** -0.51
            weights = (1 - rate) * weights + rate * (found[: k * d].reshape(k, d) * beta * (t.rows / n) + eta)
            # A Newton step of the prior of the shares.
            slope = n * (found[k * d : -1] / n - _expected_log(alpha[None])[0])
            bend, rest = -n * trigamma(alpha), n * trigamma(alpha.sum())
            step = -(slope - (slope / bend).sum() / (1 / rest + (1 / bend).sum())) / bend
            if (alpha + rate * step > 0).all():
                alpha = alpha + rate * step
    return Fitted("topics", {"weights": weights, "alpha": alpha})


@scorer("topics")
def _topics(fitted, df):
    p = arrays(fitted.params)
    beta, alpha = np.exp(_expected_log(p["weights"])), p["alpha"]

    def shares(x):
        gamma = _topic_weights(x, beta, alpha)
        # Rows without any count have no topics.
        return gamma / gamma.sum(1)[:, None] * (x != 0).any(1)[:, None]

    return df.withColumn("embedding", array_output(shares)("x"))
