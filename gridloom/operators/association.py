"""Correlation and mutual information between columns."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import (
    as_class,
    as_number,
    categorical_columns,
    numeric_columns,
    ref,
)
from gridloom.operators.describe import aggregate_by_column
from gridloom.operators.neighbours import build_index, distinct_points, nearest
from gridloom.operators.ordering import exact_quantiles, with_positions
from gridloom.operators.sums import sum_over_rows
from gridloom.session import bounded_lookup, checkpoint

MATRIX_COLUMNS = 18
TOP_PAIRS = 60
# Up to this many pairs built-in aggregates are used, beyond it one Arrow pass.
NATIVE_PAIRS = 6
NEIGHBOURS = 3
EULER_GAMMA = 0.5772156649015329

CORRELATION_SCHEMA = "column_a string, column_b string, r double, n bigint"
ASSOCIATION_SCHEMA = "column string, pearson_r double, mutual_info double, note string"


def correlations(df: DataFrame, columns: list[str] | None = None) -> list[tuple]:
    """(a, b, r, shared rows) for every pair a before b; r is None below three
    shared rows or without variation."""
    columns = numeric_columns(df) if columns is None else columns
    pairs = list(combinations(columns, 2))
    if not pairs:
        return []
    measured = (
        _native_pairs(df, pairs) if len(pairs) <= NATIVE_PAIRS else _wide_pairs(df, columns)
    )
    out = []
    for a, b in pairs:
        n, r = measured[a, b]
        usable = n >= 3 and r is not None and math.isfinite(r)
        out.append((a, b, float(r) if usable else None, int(n)))
    return out


def _native_pairs(df, pairs):
    expressions = [e for a, b in pairs for e in _pair_moments(a, b)]
    row = df.agg(*[e.alias(f"a{i}") for i, e in enumerate(expressions)]).first()
    return {pair: _pair_r(row[4 * i : 4 * i + 4]) for i, pair in enumerate(pairs)}


def _pair_moments(a, b) -> list[Column]:
    """Count, deviations and covariance over the rows where both are present."""
    x, y = as_number(a), as_number(b)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return [F.count(x), F.stddev_pop(x), F.stddev_pop(y), F.covar_pop(x, y)]


def _pair_r(facts) -> tuple[int, float | None]:
    """Shared rows and r; a flat column has no correlation (Spark's own ``corr``
    stops with a division error there)."""
    n, sx, sy, covariance = facts
    if n == 0 or sx < 1e-12 or sy < 1e-12:
        return n, None
    r = covariance / (sx * sy)
    return n, r if math.isfinite(r) else None


def _wide_pairs(df, columns):
    """Pairwise-complete correlations of many columns from one pass of matrix
    products; values are shifted by the column mean first."""
    d = len(columns)
    table = df.select(*[as_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    centre = aggregate_by_column(table, table.columns, lambda c: [F.avg(c)])
    shift = np.array([centre[f"c{i}"][0] or 0.0 for i in range(d)])

    def statistic(*values):
        x = np.column_stack([np.asarray(v, float) for v in values]) - shift
        seen = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x)
        products = (seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x)
        return np.concatenate([p.ravel() for p in products])

    packed = sum_over_rows(table, table.columns, statistic, 4 * d * d)
    n, s, q, p = packed.reshape(4, d, d)
    with np.errstate(all="ignore"):
        covariance = p / n - (s / n) * (s.T / n)
        variance = q / n - (s / n) ** 2
        # Rounding leaves a constant column with a tiny variance of either sign.
        variance = np.where(variance <= 1e-14 * np.maximum(q / n, 1e-300), 0.0, variance)
        r = covariance / np.sqrt(variance * variance.T)
    return {
        (columns[i], columns[j]): (n[i, j], float(r[i, j]) if np.isfinite(r[i, j]) else None)
        for i in range(d)
        for j in range(i + 1, d)
    }


def correlation_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame(correlations(df, columns), CORRELATION_SCHEMA)


def strongest_pairs(table: DataFrame, limit: int = TOP_PAIRS) -> DataFrame:
    return (
        table.filter(F.col("r").isNotNull())
        .orderBy(F.abs("r").desc(), "column_a", "column_b")
        .limit(limit)
    )


def target_correlations(df: DataFrame, target: str, features: list[str]) -> dict[str, tuple]:
    """Per numeric feature: (shared rows, Pearson r or None) with the target."""
    found = aggregate_by_column(df, features, lambda c: _pair_moments(c, target))
    return {c: _pair_r(facts) for c, facts in found.items()}


def _n_log_n(count: Column) -> Column:
    return count * F.ln(count)


def _information_from_joint(joint: DataFrame) -> DataFrame:
    """Plug-in mutual information in nats from counts (column, x, y, cnt).

    Uses n·MI = Σ f(n_xy) − Σ f(n_x) − Σ f(n_y) + f(n) with f(m) = m·ln m, so
    the marginals are aggregated separately and never joined back.
    """
    count = F.col("cnt").cast("double")
    cells = joint.groupBy("column", "x").agg(
        F.sum(_n_log_n(count)).alias("fxy"), F.sum(count).alias("nx")
    )
    by_x = cells.groupBy("column").agg(
        F.sum("fxy").alias("fxy"), F.sum(_n_log_n(F.col("nx"))).alias("fx"), F.sum("nx").alias("n")
    )
    by_y = (
        joint.groupBy("column", "y")
        .agg(F.sum(count).alias("ny"))
        .groupBy("column")
        .agg(F.sum(_n_log_n(F.col("ny"))).alias("fy"))
    )
    total = (F.col("fxy") - F.col("fx") - F.col("fy") + _n_log_n(F.col("n"))) / F.col("n")
    return by_x.join(by_y, "column").select(
        "column", F.greatest(total, F.lit(0.0)).alias("mutual_info")
    )


def information_discrete(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Mutual information of categorical features with the class."""
    narrow = df.select(
        as_class(target).alias("y"), *[as_class(c).alias(f"f{i}") for i, c in enumerate(features)]
    )
    joint = (
        narrow.unpivot(["y"], [f"f{i}" for i in range(len(features))], "slot", "x")
        .groupBy("slot", "x", "y")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return _information_from_joint(_named(joint, features))


def _named(long: DataFrame, features: list[str]) -> DataFrame:
    """Replace slot names f0, f1, … by the feature names."""
    names = F.create_map(*[F.lit(v) for i, c in enumerate(features) for v in (f"f{i}", c)])
    return long.withColumn("column", F.element_at(names, F.col("slot"))).drop("slot")


def digamma(count: Column) -> Column:
    """Digamma of a positive integer: harmonic numbers below ten, else the
    asymptotic series."""
    m = count.cast("double")
    exact = F.element_at(
        F.array(*[F.lit(sum(1.0 / j for j in range(1, k)) - EULER_GAMMA) for k in range(1, 10)]),
        F.least(count, F.lit(9)).cast("int"),
    )
    inverse = 1.0 / (m * m)
    series = (
        F.ln(m)
        - 0.5 / m
        - inverse * (F.lit(1 / 12) - inverse * (F.lit(1 / 120) - inverse * F.lit(1 / 252)))
    )
    return F.when(count < 10, exact).otherwise(series)


def information_nearest(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Mutual information of numeric features with the class (Ross 2014, k=3).

    Equal values are one weighted row. Each row finds its neighbours through
    global positions (a fan-out of seven, no window over a whole class), and the
    number of rows within its radius is a difference of two running totals over
    the sorted values. No jitter is added, so results repeat exactly.
    """
    narrow = df.select(
        as_class(target).alias("y"), *[as_number(c).alias(f"f{i}") for i, c in enumerate(features)]
    )
    weighted = _named(
        narrow.unpivot(["y"], [f"f{i}" for i in range(len(features))], "slot", "x")
        .filter(F.col("x").isNotNull())
        .groupBy("slot", "y", "x")
        .agg(F.count(F.lit(1)).alias("w")),
        features,
    )
    # One row per feature and class; a text target may have any number of them.
    sizes = (
        weighted.groupBy("column", "y")
        .agg(F.sum("w").alias("class_rows"))
        .filter("class_rows > 1")
    )
    points = weighted.join(sizes, ["column", "y"])
    placed = with_positions(points, ["column", "y", "x"])
    # Sorting reads its input twice, and the radii are joined again: they are kept.
    radii = checkpoint(_neighbour_radius(placed).drop("y"))
    inner = _rows_within(radii)
    n, weight = F.sum("w"), F.col("w")
    mean_psi_k = F.sum(weight * digamma(F.col("k"))) / n
    mean_psi_m = F.sum(weight * digamma(F.col("m"))) / n
    mean_psi_class = F.sum(weight * digamma(F.col("class_rows"))) / n
    return inner.groupBy("column").agg(
        F.greatest(
            digamma(n) + mean_psi_k - mean_psi_class - mean_psi_m, F.lit(0.0)
        ).alias("mutual_info")
    )


def _neighbour_radius(placed: DataFrame) -> DataFrame:
    """Distance to the k-th nearest row of the same class, own copies first."""
    around = placed.withColumn(
        "offset", F.explode(F.array(*[F.lit(j) for j in range(-NEIGHBOURS, NEIGHBOURS + 1)]))
    )
    grouped = around.groupBy((F.col("position") + F.col("offset")).alias("at")).agg(
        F.max(
            F.when(F.col("offset") == 0, F.struct("column", "y", "x", "w", "class_rows"))
        ).alias("own"),
        # At most seven entries per position.
        F.collect_list(F.struct("column", "y", "x", "w", "offset")).alias("near"),
    )
    same = F.filter(
        "near",
        lambda e: (e["column"] == F.col("own.column"))
        & (e["y"] == F.col("own.y"))
        & (e["offset"] != 0),
    )
    k = F.least(F.lit(NEIGHBOURS), F.col("own.class_rows") - 1).cast("int")
    repeats = lambda w: F.least(w, F.lit(NEIGHBOURS)).cast("int")
    distances = F.array_sort(
        F.concat(
            F.array_repeat(F.lit(0.0), repeats(F.col("own.w") - 1)),
            F.flatten(
                F.transform(
                    same, lambda e: F.array_repeat(F.abs(e["x"] - F.col("own.x")), repeats(e["w"]))
                )
            ),
        )
    )
    return (
        grouped.filter(F.col("own").isNotNull())
        .withColumn("k", k)
        .withColumn("radius", F.element_at(distances, F.col("k")))
        .select("own.*", "k", "radius", F.col("at").alias("point"))
    )


def _rows_within(radii: DataFrame) -> DataFrame:
    """Rows of any class strictly inside the radius (equal values always)."""
    shared = radii.select("column", "point", "x", "w", "radius")
    moving = F.col("radius") > 0
    # Data sit between the upper probe (before equals) and the lower (after),
    # or, for radius zero, the other way round so that equal values count.
    probes = F.array(
        F.struct(
            F.col("x").alias("at"), F.lit(1).alias("rank"), F.col("w").alias("weight"),
            F.lit(0).alias("sign"),
        ),
        F.struct(
            (F.col("x") + F.col("radius")).alias("at"),
            F.when(moving, 0).otherwise(2).alias("rank"),
            F.lit(0).cast("bigint").alias("weight"),
            F.lit(1).alias("sign"),
        ),
        F.struct(
            (F.col("x") - F.col("radius")).alias("at"),
            F.when(moving, 2).otherwise(0).alias("rank"),
            F.lit(0).cast("bigint").alias("weight"),
            F.lit(-1).alias("sign"),
        ),
    )
    events = shared.select("column", "point", F.explode(probes).alias("e")).select(
        "column", "point", "e.*"
    )
    totals = with_positions(events, ["column", "at", "rank", "point"], weight="weight")
    counted = (
        totals.filter("sign != 0").groupBy("point").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    )
    return radii.join(counted, "point")


def information_continuous(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Mutual information with a numeric target (Kraskov 2004, first estimator, k=3).

    Numbers are taken as they are, text as the place of its level among the sorted
    levels; both sides are scaled by their deviation. The third nearest row in the
    larger of the two differences gives every row its radius; ``neighbours`` finds it
    without comparing all rows, with the features far apart on an axis of their own,
    so that one index serves them all. Rows within the radius of one side alone are
    differences of two running totals. Copies count as rows; no jitter is added, so
    results repeat exactly. A row on the radius itself does not count, also where
    rounding would move it inside.
    """
    long = _against_number(df, target, features)
    facts = long.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{name}_{c}") for c in "xy" for name, f in (("std", F.stddev_pop), ("low", F.min), ("high", F.max))],
    )
    # One row for each feature.
    facts = {r.slot: r.asDict() for r in facts.collect()}
    scale = {s: [r[f"std_{c}"] or 1.0 for c in "xy"] for s, r in facts.items()}
    reach = max([(r[f"high_{c}"] - r[f"low_{c}"]) / scale[s][i] for s, r in facts.items() for i, c in enumerate("xy")], default=0.0)
    gap = 4.0 * reach + 1.0

    def per_slot(value) -> Column:
        pairs = [F.lit(v) for s in facts for v in (s, float(value(s)))]
        return F.element_at(F.create_map(*pairs), F.col("slot"))

    if not facts:
        return df.sparkSession.createDataFrame([], "column string, mutual_info double")
    place = F.array(
        F.col("slot") * F.lit(gap), F.col("x") / per_slot(lambda s: scale[s][0]), F.col("y") / per_slot(lambda s: scale[s][1])
    )
    index = build_index(distinct_points(long.select(place.alias("x"))), metric="maximum")
    near = nearest(index, index.points.select(F.col("pid").alias("qid"), "x"), NEIGHBOURS + 1)
    # Rows as near as the k-th other one: the row itself and its copies come first.
    radius = F.aggregate(
        "near",
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0.0).alias("r")),
        lambda a, e: F.when(a["seen"] > NEIGHBOURS, a).otherwise(F.struct((a["seen"] + e["w"]).alias("seen"), e["distance"].alias("r"))),
    )["r"]
    points = index.points.join(near.withColumnRenamed("qid", "pid"), "pid").select(
        F.round(F.get("x", F.lit(0)) / gap).cast("int").alias("column"),
        F.col("pid").alias("point"),
        "w",
        (radius * (1 - 1e-9)).alias("radius"),
        F.get("x", F.lit(1)).alias("x"),
        F.get("x", F.lit(2)).alias("y"),
    )
    points = checkpoint(points)
    by_x = _rows_within(points.drop("y")).select("point", F.col("column").alias("slot"), "w", F.col("m").alias("m_x"))
    by_y = _rows_within(points.select("column", "point", "w", "radius", F.col("y").alias("x"))).select("point", F.col("m").alias("m_y"))
    weight, n = F.col("w"), F.sum("w")
    k = F.least(F.lit(NEIGHBOURS), n - 1).cast("bigint")
    total = digamma(n) + digamma(k) - F.sum(weight * (digamma(F.col("m_x")) + digamma(F.col("m_y")))) / n
    out = by_x.join(by_y, "point").groupBy("slot").agg(F.greatest(total, F.lit(0.0)).alias("mutual_info"))
    names = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(features) for v in (i, c)]), F.col("slot"))
    return out.select(names.alias("column"), "mutual_info")


def _against_number(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(slot, x, y) of every row with a target, ``slot`` being the feature's place."""
    numeric = [c for c in features if c in numeric_columns(df)]
    text = [c for c in features if c not in numeric]
    y = as_number(target)
    usable = df.filter(y.isNotNull())
    slot = F.substring("name", 2, 10).cast("int").alias("slot")
    parts = []
    if numeric:
        names = [f"f{features.index(c)}" for c in numeric]
        narrow = usable.select(y.alias("y"), *[as_number(c).alias(f) for c, f in zip(numeric, names)])
        parts.append(narrow.unpivot(["y"], names, "name", "x").filter(F.col("x").isNotNull()).select(slot, "x", "y"))
    if text:
        names = [f"f{features.index(c)}" for c in text]
        narrow = usable.select(y.alias("y"), *[as_class(c).alias(f) for c, f in zip(text, names)])
        long = narrow.unpivot(["y"], names, "name", "level")
        # Levels of all rows, as those without a target have a place, too.
        every = df.select(*[as_class(c).alias(f) for c, f in zip(text, names)]).unpivot([], names, "name", "level")
        placed = with_positions(every.distinct(), ["name", "level"])
        first = placed.groupBy("name").agg(F.min("position").alias("first"))
        codes = placed.join(F.broadcast(first), "name").select("name", "level", (F.col("position") - F.col("first")).cast("double").alias("x"))
        codes = checkpoint(codes)
        coded = long.join(bounded_lookup(codes, codes.count()), ["name", "level"])
        parts.append(coded.select(slot, "x", "y"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def information_binned(df: DataFrame, target: str, features: list[str], rows: int) -> DataFrame:
    """Mutual information with a numeric target on a grid of quantile bins.

    Numeric columns are cut at their quantiles; text is ordered by value and cut
    by cumulative count, as its codes are ordered numbers. About n^(1/3) bins,
    at most 64.
    """
    bins = int(min(64, max(2, math.ceil(rows ** (1 / 3)))))
    inner = [j / bins for j in range(1, bins)]
    numeric = [c for c in features if c in numeric_columns(df)]
    text = [c for c in features if c not in numeric]
    cuts = _cut_points(df, [target, *numeric], inner, rows)
    y = as_number(target)
    usable = df.filter(y.isNotNull())
    parts = []
    if numeric:
        narrow = usable.select(
            _bin_of(y, cuts[target]).alias("y"),
            *[_bin_of(as_number(c), cuts[c]).alias(f"f{i}") for i, c in enumerate(numeric)],
        )
        joint = (
            narrow.unpivot(["y"], [f"f{i}" for i in range(len(numeric))], "slot", "x")
            .filter(F.col("x").isNotNull())
            .groupBy("slot", "x", "y")
            .agg(F.count(F.lit(1)).alias("cnt"))
        )
        parts.append(_named(joint, numeric).select("column", "x", "y", "cnt"))
    if text:
        narrow = usable.select(
            _bin_of(y, cuts[target]).alias("y"),
            *[as_class(c).alias(f"f{i}") for i, c in enumerate(text)],
        )
        levels = _named(
            narrow.unpivot(["y"], [f"f{i}" for i in range(len(text))], "slot", "level")
            .groupBy("slot", "level", "y")
            .agg(F.count(F.lit(1)).alias("cnt")),
            text,
        )
        marginal = levels.groupBy("column", "level").agg(F.sum("cnt").alias("level_rows"))
        placed = with_positions(marginal, ["column", "level"], weight="level_rows")
        starts = placed.groupBy("column").agg(
            F.min(F.col("upto") - F.col("level_rows")).alias("start"),
            F.sum("level_rows").alias("total"),
        )
        middle = F.col("upto") - F.col("start") - F.col("level_rows") / 2
        coded = placed.join(F.broadcast(starts), "column").select(
            "column",
            "level",
            F.floor(middle * bins / F.col("total")).cast("int").alias("x"),
        )
        parts.append(
            levels.join(coded, ["column", "level"])
            .groupBy("column", "x", "y")
            .agg(F.sum("cnt").alias("cnt"))
            .select("column", "x", "y", "cnt")
        )
    joint = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _information_from_joint(joint)


def _cut_points(df, columns, shares, rows) -> dict[str, list[float]]:
    """Bin edges: exact quantiles, for a table of any size."""
    return exact_quantiles(df, columns, shares, rows=rows)


def _bin_of(value: Column, cuts: list[float]) -> Column:
    """Number of distinct cut points below the value, by halving: a row is compared
    with as many of them as the halvings, not with all."""
    edges = sorted(set(cuts))

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(edges[middle]), below(middle + 1, high)).otherwise(below(low, middle))

    return F.when(value.isNotNull(), below(0, len(edges)))


def feature_target_association(df: DataFrame, target: str, task: str) -> DataFrame:
    """Pearson r and mutual information of every feature with the target,
    strongest first."""
    numeric = [c for c in numeric_columns(df) if c != target]
    text = [c for c in categorical_columns(df) if c != target]
    rows = df.count()
    spark = df.sparkSession
    parts = []
    if task == "classification":
        counts = aggregate_by_column(df, numeric, lambda c: [F.count(as_number(c))])
        pearson = {c: (counts[c][0], None) for c in numeric}
        enough = [c for c in numeric if pearson[c][0] >= 5]
        if enough:
            parts.append(information_nearest(df, target, enough))
        if text:
            parts.append(information_discrete(df, target, text))
        short = {c for c in numeric if c not in enough}
    else:
        pearson = target_correlations(df, target, numeric)
        y_rows = df.agg(F.count(as_number(target))).first()[0]
        enough = [c for c in numeric if pearson[c][0] >= 5]
        usable = enough + (text if y_rows >= 5 else [])
        if usable:
            parts.append(information_continuous(df, target, usable))
        short = {c for c in numeric + text if c not in usable}
    facts = spark.createDataFrame(
        [
            (
                c,
                pearson.get(c, (0, None))[1] if c not in short else None,
                "too_few_values" if c in short else None,
            )
            for c in numeric + text
        ],
        "column string, pearson_r double, note string",
    )
    information = spark.createDataFrame([], "column string, mutual_info double")
    for part in parts:
        information = information.unionByName(part)
    table = facts.join(information, "column", "left").select(
        "column", "pearson_r", "mutual_info", "note"
    )
    return ranked(table)


def ranked(table: DataFrame) -> DataFrame:
    """Association rows by mutual information, then by |r|; missing counts as 0."""
    return table.orderBy(
        F.coalesce("mutual_info", F.lit(0.0)).desc(),
        F.coalesce(F.abs("pearson_r"), F.lit(0.0)).desc(),
        "column",
    )
