"""Anomaly detection: every model gives a ``score`` (low is odd) and -1 or 1."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.models.base import (
    SEED,
    Fitted,
    Training,
    arrays,
    fourier_features,
    fourier_map,
    numeric_output,
    scorer,
)
from gridloom.operators.models.linear import FOURIER_WIDTH, scale_gamma
from gridloom.operators.models.nearest import lookup
from gridloom.operators.models.trees import descend
from gridloom.operators.neighbours import build_index, distinct_points, nearest
from gridloom.operators.ordering import exact_quantiles
from gridloom.operators.sums import PackedRows, sum_over_rows
from gridloom.session import checkpoint

TREES, TREE_ROWS = 200, 256
EULER_GAMMA = 0.5772156649015329


def _flagged(df, score, offset: float):
    scored = df.withColumn("score", score)
    return scored.withColumn("prediction", F.when(F.col("score") < offset, -1.0).otherwise(1.0))


# --- isolation forest --------------------------------------------------------


def _expected_depth(n):
    """Mean depth of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, float)
    deep = 2 * (np.log(np.maximum(n - 1, 1)) + EULER_GAMMA) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def isolation_forest(t: Training) -> Fitted:
    """200 trees, each grown in its own task on 256 rows drawn without
    replacement (all rows of a smaller table).

    A tree takes the rows whose hash with its number is smallest. Copies of a row
    are numbered by count, so each is drawn by itself, and the forest does not
    depend on partitioning.
    """
    per_tree = min(TREE_ROWS, t.rows)
    counted = t.df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select("x", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))

    def hashed(*more):
        return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "x", "copy", *more), 1)

    # A pool of about twice the rows of all trees, bounded for any table.
    share = min(1.0, 2 * TREES * per_tree / t.rows)
    pool = rows if share == 1.0 else rows.filter(hashed() <= F.lit(int(share * 2**53) << 10))
    drawn = (
        pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
        .withColumn("order", hashed("tree"))
        .withColumn("place", F.row_number().over(W.partitionBy("tree").orderBy("order", "copy")))
        .filter(F.col("place") <= per_tree)
        .select("tree", "order", "x")
    )

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("order")
        draw = np.random.default_rng([SEED, int(part.tree.iloc[0])])
        columns = _isolation_tree(np.stack(part.x.to_numpy()), draw)
        return pd.DataFrame(
            {"tree": [int(part.tree.iloc[0])]} | {n: [list(c)] for n, c in columns.items()}
        )

    schema = (
        "tree long, feature array<long>, cut array<double>, left array<long>, "
        "right array<long>, length array<double>"
    )
    grown = drawn.groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()
    forest: dict[str, list] = {n: [] for n in ("feature", "cut", "left", "right", "length")}
    roots = []
    for row in grown:
        at = len(forest["feature"])
        roots.append(at)
        for name in forest:
            shift = at if name in ("left", "right") else 0
            forest[name] += [v + shift if shift and v >= 0 else v for v in row[name]]
    params = {n: np.array(v) for n, v in forest.items()} | {"roots": np.array(roots)}
    return Fitted("isolation", params | {"norm": float(_expected_depth(per_tree))})


def _isolation_tree(x: np.ndarray, draw) -> dict[str, list]:
    limit = math.ceil(math.log2(max(len(x), 2)))
    feature, cut, left, right, length = [], [], [], [], []

    def add(rows, depth):
        at = len(feature)
        for column, entry in ((feature, -1), (cut, 0.0), (left, -1), (right, -1)):
            column.append(entry)
        length.append(depth + float(_expected_depth(len(rows))))
        spread = rows.max(0) - rows.min(0)
        usable = np.nonzero(spread > 0)[0]
        if depth < limit and len(usable):
            j = int(draw.choice(usable))
            value = float(draw.uniform(rows[:, j].min(), rows[:, j].max()))
            inside = rows[:, j] <= value
            feature[at], cut[at] = j, value
            left[at], right[at] = add(rows[inside], depth + 1), add(rows[~inside], depth + 1)
        return at

    add(x, 0)
    return {"feature": feature, "cut": cut, "left": left, "right": right, "length": length}


@scorer("isolation")
def _isolation(fitted, df):
    p = arrays(fitted.params)
    tree = [p[n] for n in ("roots", "feature", "cut", "left", "right")]
    length, norm = p["length"], float(p["norm"])
    score = numeric_output(lambda x: -(2.0 ** (-length[descend(x, *tree)].mean(1) / norm)))
    return _flagged(df, score("x"), -0.5)


# --- local outlier factor -----------------------------------------------------


def local_outlier_factor(t: Training, k: int = 20) -> Fitted:
    """Neighbour distances and densities of the fitted rows, kept as a table."""
    k = max(1, min(k, t.rows - 1))
    points = distinct_points(t.df.select("x"))
    index = build_index(points)
    near = nearest(index, index.points.select(F.col("pid").alias("qid"), "x"), k + 1)
    lists = checkpoint(
        near.join(points, F.col("qid") == F.col("pid")).select(
            "pid", "x", "w", _taken(F.col("pid"), k).alias("near")
        )
    )
    reach = lists.select("pid", F.element_at("near", -1)["distance"].alias("reach"))
    density = _density(lists.select("pid", "near"), reach).select("pid", "density")
    table = lists.join(reach, "pid").join(density, "pid").select(
        "pid", "x", "w", F.array("reach", "density").alias("payload")
    )
    return Fitted("outlier_factor", {"k": k}, table=checkpoint(table))


def _taken(own, k):
    """Neighbours of a fitted row: one copy less of itself, copies up to ``k``.

    Each entry carries how many rows of that position count.
    """
    others = F.filter(
        F.transform(
            "near",
            lambda e: F.struct(
                e["distance"].alias("distance"),
                e["pid"].alias("pid"),
                (e["w"] - F.when(e["pid"] == own, 1).otherwise(0)).alias("w"),
            ),
        ),
        lambda e: e["w"] > 0,
    )
    return _first_rows(others, k)


def _first_rows(entries, k):
    """Entries in order until ``k`` rows are counted."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("rows"),
        F.array().cast("array<struct<distance:double,pid:bigint,w:bigint>>").alias("kept"),
    )

    def step(state, e):
        room = F.greatest(F.lit(k) - state["rows"], F.lit(0)).cast("bigint")
        take = F.least(room, e["w"])
        entry = F.struct(
            e["distance"].alias("distance"), e["pid"].alias("pid"), take.alias("w")
        )
        return F.struct(
            (state["rows"] + take).alias("rows"),
            F.when(take > 0, F.concat(state["kept"], F.array(entry)))
            .otherwise(state["kept"])
            .alias("kept"),
        )

    return F.aggregate(entries, start, step, lambda s: s["kept"])


def _density(lists, reach):
    """One over the mean reachability distance to the neighbours."""
    flat = lists.select("pid", F.explode("near").alias("e")).select(
        "pid", F.col("e.pid").alias("other"), F.col("e.distance").alias("distance"),
        F.col("e.w").alias("rows"),
    )
    reached = flat.join(reach.withColumnRenamed("pid", "other"), "other").withColumn(
        "gap", F.greatest("distance", "reach")
    )
    mean = F.sum(F.col("gap") * F.col("rows")) / F.sum("rows")
    return reached.groupBy("pid").agg((1.0 / (mean + F.lit(1e-10))).alias("density"))


@scorer("outlier_factor")
def _outlier_factor(fitted, df):
    """Density of a new row against the densities of its neighbours."""
    k = int(fitted.params["k"])
    start = F.struct(F.lit(k).cast("bigint").alias("left"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("density"))

    def step(state, e):
        take = F.least(state["left"], e["w"])
        reach = F.greatest(e["distance"], F.get(e["payload"], F.lit(0)))
        return F.struct(
            (state["left"] - take).alias("left"),
            (state["gap"] + take * reach).alias("gap"),
            (state["density"] + take * F.get(e["payload"], F.lit(1))).alias("density"),
        )

    def factor(state):
        rows = k - state["left"]
        return -(state["density"] / rows) * (state["gap"] / rows + F.lit(1e-10))

    found = lookup(fitted, df, k)
    return _flagged(found, F.aggregate("near", start, step, factor), -1.5).drop("near")


# --- one-class margin ----------------------------------------------------------


def one_class(t: Training, share: float = 0.05, passes: int = 80) -> Fitted:
    """A linear one-class margin on Fourier features of the RBF kernel.

    The margin offset is part of the subgradient; about ``share`` of the rows
    end up below it.
    """
    frequencies, phases = fourier_features(t.d, FOURIER_WIDTH, scale_gamma(t))
    size, n = FOURIER_WIDTH, t.rows

    def mean_map(x):
        return fourier_map(x, frequencies, phases).sum(0)

    weights = sum_over_rows(t.df, ["x"], mean_map, size) / n
    rho = _score_quantile(t, weights, frequencies, phases, share)
    best, best_cost = (weights, rho), np.inf
    for step in range(passes):
        def statistic(x, weights=weights, rho=rho):
            z = fourier_map(x, frequencies, phases)
            gap = rho - z @ weights
            active = gap > 0
            return np.concatenate([z[active].sum(0), [active.sum(), gap[active].sum()]])

        packed = sum_over_rows(t.df, ["x"], statistic, size + 2)
        cost = 0.5 * weights @ weights - rho + packed[-1] / (share * n)
        if cost < best_cost:
            best, best_cost = (weights, rho), cost
        rate = 0.5 / (1 + step) ** 0.75
        weights = weights - rate * (weights - packed[:size] / (share * n))
        rho = rho - rate * (packed[size] / (share * n) - 1) * 0.2
    weights = best[0]
    rho = _score_quantile(t, weights, frequencies, phases, share)
    return Fitted(
        "one_class",
        {"weights": weights, "rho": rho, "frequencies": frequencies, "phases": phases},
    )


def _score_quantile(t, weights, frequencies, phases, share):
    score = numeric_output(lambda x: fourier_map(x, frequencies, phases) @ weights)
    return exact_quantiles(
        t.df.select(score("x").alias("score")), ["score"], [share], rows=t.rows
    )["score"][0]


@scorer("one_class")
def _one_class(fitted, df):
    p = arrays(fitted.params)
    weights, frequencies, phases = p["weights"], p["frequencies"], p["phases"]
    score = numeric_output(lambda x: fourier_map(x, frequencies, phases) @ weights)
    return _flagged(df, score("x"), float(p["rho"]))


# --- elliptic envelope ----------------------------------------------------------


# Rows that the first starts are tried on, their number, and how many of them are
# carried on with all rows.
START_ROWS, STARTS, CARRIED = 1_500, 500, 10


def elliptic_envelope(t: Training, contamination: float = 0.05, passes: int = 30) -> Fitted:
    """Minimum covariance determinant (Rousseeuw & Van Driessen 1999): many starts
    from d + 1 rows each are concentrated on a bounded sample, the best of them on
    all rows, and the best of these until the determinant stays."""
    d = t.d
    share = min(1.0, 0.5 * (t.rows + d + 1) / t.rows)
    found = _sample_starts(t, share)
    with PackedRows(t.df, ["x"], d) as rows:
        for _ in range(2):
            found = _concentrated(rows, found, share)
        centre, covariance = min(found, key=lambda f: _log_size(f[1]))
        before = _log_size(covariance)
        for _ in range(passes):
            after = _concentrated(rows, [(centre, covariance)], share)[0]
            size = _log_size(after[1])
            if before - size < 1e-6:
                break
            (centre, covariance), before = after, size
        # Rescale to the median distance, then keep all rows within the 97.5 % ring.
        precision = np.linalg.pinv(covariance, hermitian=True)
        median = _distance_quantile(rows, centre, precision, 0.5)
        covariance = covariance * median / _chi_square(0.5, d)
        precision = np.linalg.pinv(covariance, hermitian=True)
        centre, covariance = _kept_moments(rows, centre, precision, _chi_square(0.975, d))
        precision = np.linalg.pinv(covariance, hermitian=True)
        offset = -_distance_quantile(rows, centre, precision, 1 - contamination)
    return Fitted(
        "envelope", {"centre": centre, "precision": precision, "offset": float(offset)}
    )


def _log_size(covariance) -> float:
    return float(np.linalg.slogdet(covariance + 1e-12 * np.eye(len(covariance)))[1])


def _sample_starts(t, share):
    """The best (centre, covariance) of starts from few rows, after two
    concentration steps on a sample of bounded size each, and then until they stay."""
    rows = t.df.select("x").orderBy(F.xxhash64(F.lit(SEED), F.monotonically_increasing_id())).limit(START_ROWS)
    x = np.array([r.x for r in rows.collect()], float)
    draw, half = np.random.default_rng(SEED), max(int(math.ceil(share * len(x))), 1)
    ridge = 1e-9 * np.diag(x.var(0) + 1e-12)

    def step(centre, covariance):
        gap = x - centre
        kept = x[np.argsort(((gap @ np.linalg.pinv(covariance + ridge, hermitian=True)) * gap).sum(1), kind="stable")[:half]]
        return kept.mean(0), np.cov(kept.T, bias=True).reshape(t.d, t.d)

    found = []
    for _ in range(STARTS if len(x) > t.d + 1 else 1):
        few = x[draw.choice(len(x), min(t.d + 1, len(x)), replace=False)]
        start = step(*step(few.mean(0), np.cov(few.T, bias=True).reshape(t.d, t.d)))
        found.append((_log_size(start[1]), start))
    best = [start for _, start in sorted(found, key=lambda f: f[0])[:CARRIED]]
    for i, start in enumerate(best):
        for _ in range(20):
            after = step(*start)
            if _log_size(start[1]) - _log_size(after[1]) < 1e-6:
                break
            start = after
        best[i] = start
    return best


def _concentrated(rows, starts, share):
    """One concentration step of every start over all rows."""
    precisions = [np.linalg.pinv(c, hermitian=True) for _, c in starts]
    gaps = [_gaps(m, p) for (m, _), p in zip(starts, precisions)]
    limits = rows.quantile(lambda x: np.column_stack([gap(x) for gap in gaps]), len(starts), share)
    d = rows.d
    size = 1 + d + d * d

    def statistic(x):
        out = []
        for (m, _), distance, limit in zip(starts, gaps, limits):
            gap = x[distance(x) <= limit] - m
            out.append(np.concatenate([[len(gap)], gap.sum(0), (gap.T @ gap).ravel()]))
        return np.concatenate(out)

    packed = rows.sum(statistic, size * len(starts)).reshape(len(starts), size)
    after = []
    for (m, _), row in zip(starts, packed):
        n = max(row[0], 1.0)
        shift = row[1 : 1 + d] / n
        after.append((m + shift, row[1 + d :].reshape(d, d) / n - np.outer(shift, shift)))
    return after


def _gaps(centre, precision):
    return lambda x: (((x - centre) @ precision) * (x - centre)).sum(1)


def _distance(centre, precision):
    return numeric_output(_gaps(centre, precision))


def _distance_quantile(rows, centre, precision, share):
    gaps = _gaps(centre, precision)
    return rows.quantile(lambda x: gaps(x)[:, None], 1, share)[0]


def _kept_moments(rows, centre, precision, limit):
    """Mean and covariance of the rows within a squared distance."""
    d, gaps = rows.d, _gaps(centre, precision)

    def statistic(x):
        x = x[gaps(x) <= limit] - centre
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    packed = rows.sum(statistic, 1 + d + d * d)
    n = max(packed[0], 1.0)
    shift = packed[1 : 1 + d] / n
    return centre + shift, packed[1 + d :].reshape(d, d) / n - np.outer(shift, shift)


def _chi_square(p: float, d: int) -> float:
    """Quantile of the chi-square distribution (Wilson–Hilferty)."""
    normal = {0.5: 0.0, 0.975: 1.959963984540054}[p]
    return d * (1 - 2 / (9 * d) + normal * math.sqrt(2 / (9 * d))) ** 3


@scorer("envelope")
def _envelope(fitted, df):
    p = arrays(fitted.params)
    score = -_distance(p["centre"], p["precision"])("x")
    return _flagged(df, score, float(p["offset"]))
