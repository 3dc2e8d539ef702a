"""Evaluation of predictions, clusterings, embeddings and anomaly flags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.sums import sum_over_rows, vector_size


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def classification_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, macro F1 over all labels seen on either side, and row count."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("cnt")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("name"), F.col("cnt").alias("actual"), F.lit(0).alias("told")),
        F.struct(
            F.col("prediction").alias("name"), F.lit(0).alias("actual"), F.col("cnt").alias("told")
        ),
    )
    per_label = (
        cells.select(hit.alias("hit"), F.explode(sides).alias("s"))
        .groupBy("s.name")
        .agg(
            # Every cell enters twice, once per side.
            (F.sum("hit") / 2).alias("hits"),
            F.sum("s.actual").alias("actual"),
            F.sum("s.told").alias("told"),
        )
    )
    f1 = 2 * F.col("hits") / (F.col("actual") + F.col("told"))
    return per_label.agg(
        (F.sum("hits") / F.sum("actual")).alias("accuracy"),
        F.avg(f1).alias("f1_macro"),
        F.sum("actual").alias("test_rows"),
    )


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """R², mean absolute error, root mean squared error and row count."""
    error = F.col(label) - F.col(prediction)
    squared = F.sum(error * error)
    spread = F.var_pop(label) * F.count(F.lit(1))
    return df.agg(
        F.when(spread > 0, 1 - squared / spread)
        .otherwise(F.when(squared > 0, 0.0).otherwise(1.0))
        .alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(F.lit(1)).alias("test_rows"),
    )


def clustering_metrics(df: DataFrame, d: int | None = None) -> dict:
    """Label count, silhouette (of squared distances), Calinski–Harabasz and
    Davies–Bouldin over rows with a non-negative ``prediction``.

    All come from per-cluster counts, sums and squared norms, and one more pass
    for the mean distance to the centroid; no pair of rows is compared.
    """
    valid = df.filter(F.col("prediction") >= 0).select(
        "x", F.col("prediction").cast("int").alias("cluster")
    )
    sizes = {r.cluster: r["count"] for r in valid.groupBy("cluster").count().collect()}
    out = {"n_label_values": len(sizes)}
    k, n = len(sizes), sum(sizes.values())
    if k < 2 or n < k + 1:
        return out
    names = sorted(sizes)
    code = {name: i for i, name in enumerate(names)}
    d = d or vector_size(df)

    def places(clusters):
        return np.array([code[int(c)] for c in np.asarray(clusters)])

    def spread(x, clusters):
        one = np.eye(k)[places(clusters)]
        return np.concatenate([(one.T @ x).ravel(), one.T @ (x * x).sum(1)])

    packed = sum_over_rows(valid, ["x", "cluster"], spread, k * d + k)
    count = np.array([sizes[c] for c in names], float)
    sums, norms = packed[: k * d].reshape(k, d), packed[k * d :]
    centres = sums / count[:, None]
    overall = sums.sum(0) / n
    between = (count * ((centres - overall) ** 2).sum(1)).sum()
    within = (norms - count * (centres**2).sum(1)).sum()

    def distances(x, clusters):
        own = places(clusters)
        to_centre = np.sqrt(((x - centres[own]) ** 2).sum(1))
        # Mean squared distance of each row to every cluster, in closed form.
        mean_sq = (
            (x * x).sum(1)[:, None] - 2 * x @ centres.T + (norms / count)[None, :]
        ).clip(min=0)
        rows = np.arange(len(x))
        own_size = count[own]
        a = mean_sq[rows, own] * own_size / np.maximum(own_size - 1, 1)
        other = mean_sq.copy()
        other[rows, own] = np.inf
        b = other.min(1)
        top = np.maximum(a, b)
        s = np.where((own_size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
        return np.concatenate([np.bincount(own, to_centre, k), [s.sum()]])

    measured = sum_over_rows(valid, ["x", "cluster"], distances, k + 1)
    scatter = measured[:k] / count
    gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    np.fill_diagonal(gaps, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = (scatter[:, None] + scatter[None]) / gaps
    out["silhouette"] = float(measured[k] / n)
    out["calinski_harabasz"] = (
        float(between * (n - k) / (within * (k - 1))) if within > 0 else 1.0
    )
    out["davies_bouldin"] = float(np.nanmax(ratios, axis=1).mean())
    return out


def anomaly_metrics(df: DataFrame) -> dict:
    """Mean and deviation of ``score`` and the share of rows flagged -1."""
    flagged = F.count(F.when(F.col("prediction") == -1, 1))
    row = df.agg(
        F.avg("score").alias("anomaly_score_mean"),
        F.stddev_pop("score").alias("anomaly_score_std"),
        flagged.alias("rows_flagged_outlier"),
        (flagged / F.count(F.lit(1))).alias("outlier_fraction_fit_data"),
    ).first()
    return row.asDict()
