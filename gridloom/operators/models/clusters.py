"""Clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.operators.models.base import (
    SEED,
    Fitted,
    Training,
    arrays,
    numeric_output,
    scorer,
)
from gridloom.operators.eigen import leading_vectors, normalised
from gridloom.operators.merging import cut, merge_points
from gridloom.operators.models.nearest import lookup
from gridloom.operators.neighbours import (
    build_index,
    distances,
    distinct_points,
    near_leaves,
    nearest,
    within,
)
from gridloom.operators.ordering import with_positions
from gridloom.operators.sums import batch_array, digamma, sum_over_rows
from gridloom.session import checkpoint

CLUSTERS = 8
# Micro-cluster centres that travel with the tasks; more are a table to look up in.
CENTRES = 4_096


def _count(t: Training, wanted: int) -> int:
    return max(1, min(wanted, t.rows - 1))


def kmeans(t: Training) -> Fitted:
    model = KMeans(k=_count(t, CLUSTERS), seed=SEED, maxIter=300, initSteps=5)
    return Fitted("spark", model=model.fit(t.vectors))


def gaussian_mixture(t: Training, passes: int = 100, tolerance: float = 1e-3) -> Fitted:
    """Full-covariance mixture by expectation and maximisation, started from k-means
    clusters, so that groups far apart begin apart. A pass is one sum over the rows."""
    d = t.d
    start = np.array(KMeans(k=_count(t, CLUSTERS), seed=SEED).fit(t.vectors).clusterCenters())
    k, shift = len(start), t.x_moments.x_mean
    params, previous = None, -np.inf
    for _ in range(passes + 1):
        def expect(x, params=params):
            if params is None:
                nearest = ((start**2).sum(1) - 2 * x @ start.T).argmin(1)
                shares, fit = np.eye(k)[nearest], 0.0
            else:
                scores = np.column_stack([o - 0.5 * (((x - c) @ p) * (x - c)).sum(1) for c, p, o in zip(*params)])
                top = scores.max(1, keepdims=True)
                shares = np.exp(scores - top)
                norm = shares.sum(1, keepdims=True)
                shares, fit = shares / norm, (top + np.log(norm)).sum()
            away = x - shift
            cross = [(away.T @ (away * shares[:, j : j + 1])).ravel() for j in range(k)]
            return np.concatenate([[fit], shares.sum(0), (shares.T @ away).ravel(), *cross])

        packed = sum_over_rows(t.df, ["x"], expect, 1 + k + k * d + k * d * d)
        fit = packed[0] / t.rows
        if params is not None and abs(fit - previous) < tolerance:
            break
        previous = fit if params is not None else -np.inf
        counts = packed[1 : 1 + k] + 1e-10
        means = packed[1 + k : 1 + k + k * d].reshape(k, d) / counts[:, None]
        cross = packed[1 + k + k * d :].reshape(k, d, d) / counts[:, None, None]
        covariances = cross - means[:, :, None] * means[:, None, :] + 1e-6 * np.eye(d)
        offsets = np.log(counts / t.rows) - 0.5 * (np.linalg.slogdet(covariances)[1] + d * math.log(2 * math.pi))
        params = (means + shift, np.linalg.inv(covariances), offsets)
    centres, precisions, offsets = params
    return Fitted("gaussian_argmax", {"centres": centres, "precisions": precisions, "offsets": offsets})


def agglomerative(t: Training) -> Fitted:
    """Ward's clusters: mergers of mutual nearest partners, cut at the wanted number.

    Copies of a position are one cluster from the start, as their union costs
    nothing, so there are at most as many clusters as positions."""
    points = distinct_points(t.df.select("x")).persist()
    merges = merge_points(points)
    names = _dense(cut(points, merges, _count(t, CLUSTERS)))
    labels = points.join(names, F.col("pid") == F.col("id")).select("x", F.col("cluster").cast("double").alias("prediction"))
    return Fitted("labels", table=labels)


@scorer("centres")
def _centres(fitted, df):
    p = arrays(fitted.params)
    centres, labels = p["centres"], p.get("labels")
    norms = (centres**2).sum(1)

    def near(x):
        found = (norms - 2 * x @ centres.T).argmin(1)
        return found if labels is None else labels[found]

    return df.withColumn("prediction", numeric_output(near)("x"))


def mini_batch_kmeans(t: Training, slices: int = 20, rounds: int = 2) -> Fitted:
    """Centres moved slice by slice with a decaying rate; the slices are
    disjoint by row hash, so one round reads every row once."""
    k = _count(t, CLUSTERS)
    rows = t.df.withColumn("slice", F.pmod(F.xxhash64(F.lit(SEED), "x"), F.lit(slices))).persist()
    start = rows.select("x").distinct().orderBy(F.xxhash64(F.lit(SEED), "x")).limit(50 * k)
    # Spread the first centres over a bounded sample.
    sample = np.array([r.x for r in start.collect()], float)
    centres = sample[:1]
    while len(centres) < min(k, len(sample)):
        gap = ((sample[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, sample[gap.argmax()]])
    weight, k = np.zeros(len(centres)), len(centres)
    for step in range(slices * rounds):
        def assign(x, centres=centres):
            near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            one = np.eye(k)[near]
            return np.concatenate([one.sum(0), (one.T @ x).ravel()])

        part = rows.filter(F.col("slice") == step % slices)
        packed = sum_over_rows(part, ["x"], assign, k + k * t.d)
        counts, sums = packed[:k], packed[k:].reshape(k, t.d)
        weight += counts
        moved = counts > 0
        centres = centres.copy()
        centres[moved] += (sums[moved] - counts[moved, None] * centres[moved]) / weight[moved, None]
    rows.unpersist()
    return Fitted("centres", {"centres": centres})


def birch(t: Training, threshold: float = 0.5) -> Fitted:
    """Micro-clusters of a radius within the threshold, then Ward's clusters of
    their centres; a row belongs to its nearest centre's cluster.

    Micro-clusters are the rows' sums in the cells of a grid. They do not depend on
    how rows are dealt out or ordered, and there is no limit on their number; groups
    that a cell border cuts are put together again by Ward's first mergers.
    """
    micro = checkpoint(micro_clusters(t, threshold))
    merges = merge_points(micro.select("pid", "x", F.lit(1.0).alias("w")))
    names = _dense(cut(micro, merges, min(_count(t, CLUSTERS), micro.count())))
    labelled = micro.join(names, F.col("pid") == F.col("id")).select("pid", "x", "w", F.array(F.col("cluster").cast("double")).alias("payload"))
    if micro.count() <= CENTRES:
        rows = sorted(labelled.collect(), key=lambda r: r.pid)
        return Fitted("centres", {"centres": np.array([r.x for r in rows]), "labels": np.array([r.payload[0] for r in rows])})
    return Fitted("nearest_centre", table=labelled)


def micro_clusters(t: Training, threshold: float) -> DataFrame:
    """(pid, x, w): centre and size of every grid cell that holds rows."""
    # No two rows of a cell are further apart than twice the threshold, so their
    # mean squared distance to the centre is within its square.
    side = 2 * threshold / math.sqrt(t.d)
    key = F.transform("x", lambda v: F.floor(v / side))
    # Sums are of the distances from the cell's corner, which keeps their digits.
    inside = F.zip_with("x", "key", lambda v, k: v - k * side)
    rows = t.df.select("x", key.alias("key")).select("key", inside.alias("r"))
    sums = [F.sum(F.get("r", F.lit(i))).alias(f"s{i}") for i in range(t.d)]
    cells = rows.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("w"), *sums)
    mean = F.array(*[F.col(f"s{i}") / F.col("w") for i in range(t.d)])
    centre = F.zip_with("key", mean, lambda k, m: k * side + m)
    return with_positions(cells.select("key", "w", centre.alias("x")), ["key"]).select(F.col("position").alias("pid"), "x", "w")


@scorer("nearest_centre")
def _nearest_centre(fitted, df):
    """The label of the nearest of any number of centres."""
    found = lookup(fitted, df, 1).withColumn("prediction", F.get(F.get("near", F.lit(0))["payload"], F.lit(0)))
    return found.drop("near")


def bayesian_mixture(t: Training, components: int = 10, passes: int = 300) -> Fitted:
    """Variational mixture with a Dirichlet process prior on the weights; every
    step is one pass of responsibility-weighted sums."""
    k, d = _count(t, components), t.d
    start = KMeans(k=k, seed=SEED).fit(t.vectors).clusterCenters()
    k, m = len(start), t.x_moments
    prior_mean, prior_cov = m.x_mean, m.sxx / max(m.n - 1, 1) + 1e-6 * np.eye(d)
    centres, covariances = np.array(start), np.array([prior_cov] * k)
    counts = np.full(k, t.rows / k)
    degrees, scales = d + counts, np.ones(k) + counts
    previous = None
    for _ in range(passes):
        after = np.append(np.cumsum(counts[::-1])[::-1][1:], 0)
        a, b = 1 + counts, 1.0 / k + after
        total = digamma(a + b)
        rest = np.concatenate([[0], np.cumsum(digamma(b) - total)[:-1]])
        log_weights = digamma(a) - total + rest
        precisions = np.linalg.inv(covariances)
        determinants = -np.linalg.slogdet(covariances)[1]
        spread = digamma(0.5 * (degrees - np.arange(d)[:, None])).sum(0) + d * math.log(2)
        offsets = (
            log_weights + 0.5 * (determinants - d * np.log(degrees) + spread) - 0.5 * d / scales
        )

        def expect(x, centres=centres, precisions=precisions, offsets=offsets):
            scores = np.column_stack(
                [o - 0.5 * (((x - c) @ p) * (x - c)).sum(1) for c, p, o in zip(centres, precisions, offsets)]
            )
            top = scores.max(1, keepdims=True)
            shares = np.exp(scores - top)
            norm = shares.sum(1, keepdims=True)
            shares /= norm
            bound = (top + np.log(norm)).sum()
            cross = np.concatenate([(x.T @ (x * shares[:, j : j + 1])).ravel() for j in range(k)])
            return np.concatenate([[bound], shares.sum(0), (shares.T @ x).ravel(), cross])

        packed = sum_over_rows(t.df, ["x"], expect, 1 + k + k * d + k * d * d)
        counts = packed[1 : 1 + k] + 1e-10
        means = packed[1 + k : 1 + k + k * d].reshape(k, d) / counts[:, None]
        cross = packed[1 + k + k * d :].reshape(k, d, d) / counts[:, None, None]
        degrees, scales = d + counts, 1 + counts
        centres = (prior_mean + counts[:, None] * means) / scales[:, None]
        covariances = np.array(
            [
                (
                    prior_cov
                    + n * (c - np.outer(mu, mu) + 1e-6 * np.eye(d))
                    + n / (1 + n) * np.outer(mu - prior_mean, mu - prior_mean)
                )
                / v
                for n, c, mu, v in zip(counts, cross, means, degrees)
            ]
        )
        bound = packed[0] / t.rows
        if previous is not None and abs(bound - previous) < 1e-3:
            break
        previous = bound
    return Fitted(
        "gaussian_argmax", {"centres": centres, "precisions": precisions, "offsets": offsets}
    )


# --- density and graph clustering on the neighbour join ----------------------


def dbscan(t: Training, eps: float = 0.5, least: int = 5) -> Fitted:
    """Core positions by counting rows within eps, clusters as components of
    cores within eps, border rows to their nearest core.

    No task emits pairs: counts are summed, and every block of core positions
    returns only a spanning forest of its links.
    """
    points = distinct_points(t.df.select("x"))
    index = build_index(points)
    queries = index.points.select(F.col("pid").alias("qid"), "x")

    def count(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"qid": [], "rows": []})
        a, b, w = np.stack(q.qx.to_numpy()), np.stack(p.x.to_numpy()), p.w.to_numpy()
        rows = np.zeros(len(a), np.int64)
        for group, near, _ in near_leaves(a, b, index.metric):
            there = near(eps)
            if len(there):
                rows[group] = np.concatenate([(gaps <= eps) @ w[there] for _, gaps in distances(a[group], b[there])])
        return pd.DataFrame({"qid": q.qid.to_numpy(), "rows": rows})

    weights = within(index, queries, eps, count, "qid bigint, rows bigint")
    core_ids = (
        weights.groupBy("qid").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= least)
    ).select(F.col("qid").alias("pid"))
    cores = points.join(core_ids, "pid").persist()
    if cores.isEmpty():
        return Fitted("labels", table=points.select("x", F.lit(-1.0).alias("prediction")))
    core_index = build_index(cores)
    core_queries = core_index.points.select(F.col("pid").alias("qid"), "x")
    edges = within(core_index, core_queries, eps, _forest(eps), "src bigint, dst bigint")
    parts = connected_components(cores.select(F.col("pid").alias("id")), edges)
    names = _dense(parts)
    border = nearest(core_index, queries, 1).select(
        "qid", F.get("near", F.lit(0)).alias("core")
    )
    labelled = (
        border.join(names, F.col("core.pid") == F.col("id"))
        .select(
            "qid",
            F.when(F.col("core.distance") <= eps, F.col("cluster")).otherwise(-1).alias("cluster"),
        )
        .join(points, F.col("qid") == F.col("pid"))
        .select("x", F.col("cluster").cast("double").alias("prediction"))
    )
    return Fitted("labels", table=labelled)


def _forest(eps: float):
    """Links of one block, reduced to a spanning forest by repeated merging."""

    def work(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"src": [], "dst": []})
        a, b = np.stack(q.qx.to_numpy()), np.stack(p.x.to_numpy())
        # The label of a point is the smallest id it was linked to so far.
        ids = np.concatenate([q.qid.to_numpy(), p.pid.to_numpy()])
        names, place = np.unique(ids, return_inverse=True)
        left, right = place[: len(a)], place[len(a) :]
        pairs = []
        for group, near, _ in near_leaves(a, b, "euclidean"):
            there = near(eps)
            if len(there):
                close = np.vstack([gaps <= eps for _, gaps in distances(a[group], b[there])])
                pairs.append((left[group], right[there], close))
        label = np.arange(len(names))
        while True:
            before = label.copy()
            for one, two, close in pairs:
                from_right = np.where(close, label[two][None, :], len(names)).min(1)
                np.minimum.at(label, one, np.minimum(label[one], from_right))
                from_left = np.where(close, label[one][:, None], len(names)).min(0)
                np.minimum.at(label, two, np.minimum(label[two], from_left))
            label = label[label]
            if (label == before).all():
                break
        linked = label != np.arange(len(names))
        return pd.DataFrame({"src": names[linked], "dst": names[label[linked]]})

    return work


def _dense(parts):
    """Components numbered 0, 1, … by their smallest id."""
    order = with_positions(parts.select("component").distinct(), ["component"])
    return parts.join(order, "component").select("id", F.col("position").alias("cluster"))


def affinities(points: DataFrame, neighbours: int) -> DataFrame:
    """(src, dst, weight): RBF affinities of each position and its nearest ones, once
    for each pair; the kernel width of one suits standardised features."""
    index = build_index(points)
    near = nearest(index, index.points.select(F.col("pid").alias("qid"), "x"), neighbours + 1)
    pairs = near.select("qid", F.explode("near").alias("n")).filter(F.col("qid") != F.col("n.pid"))
    pairs = pairs.select(
        F.least("qid", "n.pid").alias("src"),
        F.greatest("qid", "n.pid").alias("dst"),
        F.exp(-F.col("n.distance") * F.col("n.distance")).alias("weight"),
    )
    return pairs.groupBy("src", "dst").agg(F.max("weight").alias("weight")).filter(F.col("weight") > 0)


def spectral(t: Training, neighbours: int = 10, groups: int = CLUSTERS) -> Fitted:
    """K-means in the leading eigenvectors of the normalised affinities of each
    position's neighbours.

    A position without any affinity belongs to no cluster and is labelled -1."""
    points = distinct_points(t.df.select("x")).persist()
    edges = checkpoint(affinities(points, neighbours))
    k = _count(t, groups)
    entries, degrees = normalised(edges)
    if edges.isEmpty():
        return Fitted("labels", table=points.select("x", F.lit(-1.0).alias("prediction")))
    vectors, _ = leading_vectors(entries, k)
    placed = vectors.join(degrees, "id").select("id", F.transform("v", lambda v: v / F.sqrt("degree")).alias("x"))
    placed = placed.withColumn("features", array_to_vector("x")).persist()
    found = KMeans(k=k, seed=SEED, initSteps=10, maxIter=100).fit(placed).transform(placed).select("id", "prediction")
    labelled = points.join(found, F.col("pid") == F.col("id"), "left").select(
        "x", F.coalesce(F.col("prediction"), F.lit(-1)).cast("double").alias("prediction")
    )
    return Fitted("labels", table=labelled)


@scorer("labels")
def _labels(fitted, df):
    """Labels of the fitted rows, joined on their position."""
    return df.join(fitted.table, "x")
