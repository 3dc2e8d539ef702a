"""Registered queries that hold fitted models against their own conditions.

A model that minimises something is where the slope of that is zero; a tree's leaf
is the mean of its rows; a cluster's centre is the mean of its members; a principal
direction is only scaled by the covariance. Each query fits on all rows of a table
whose target does not follow the features exactly, scores the rows, and returns
these differences, which are zero for a right model and for no other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridloom.operators.models import clusters, decomposition, linear, native, trees
from gridloom.operators.models.base import apply_model, arrays, basis
from gridloom.operators.sums import sum_over_rows
from workload.common import WIDTH, embedding_columns, numbers, query, table

FEATURES = ["quantity", "discount", "tax", "line"]
TERMS = [*FEATURES, "intercept"]


def _rows(spark, sf):
    """Features of about unit size, a price, and three classes that overlap."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_quantity") / 50).alias("quantity"),
        (F.col("l_discount") * 10).alias("discount"),
        (F.col("l_tax") * 10).alias("tax"),
        (F.col("l_linenumber") / 7).alias("line"),
        (F.col("l_extendedprice") / 20000).alias("price"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END").alias("flag"),
    )


def _zeros(names, column: str, source: str = "lineitem") -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f"SELECT {column}, 0.0::DOUBLE AS difference FROM (VALUES {values}) v({column}), (SELECT count(*) AS n FROM {source}) WHERE n > 0"


def _differences(spark, names, values, column: str, digits: int):
    # Adding zero takes the sign from a rounded minus zero.
    rows = [(n, round(float(v), digits) + 0.0) for n, v in zip(names, values, strict=True)]
    return spark.createDataFrame(rows, f"{column} string, difference double")


def _slopes(scored, pull):
    """Means of a row's pull times each feature, and of the pull."""
    x = [F.get("x", F.lit(i)) for i in range(len(FEATURES))]
    return np.array([float(v) for v in scored.agg(*[F.avg(pull * v) for v in x], F.avg(pull)).first()])


def _weights(fitted):
    if fitted.model is not None:
        return np.append(np.array(fitted.model.coefficients), 0.0)
    return np.append(np.ravel(fitted.params["weights"]), 0.0)


_GAP = "label - prediction"
# Fit, pull of a row, penalty as a multiple of the weights, digits that are zero.
_LINES = {
    "multiple_linear_regression": (native.ordinary, _GAP, lambda n: 0.0, 6),
    "lars": (linear.least_squares, _GAP, lambda n: 0.0, 6),
    "sgd_regressor": (linear.sgd_regressor, _GAP, lambda n: 1e-4, 6),
    "poisson": (native.poisson, _GAP, lambda n: 1.0, 4),
    "gamma": (native.gamma, f"({_GAP}) / prediction", lambda n: 1.0, 4),
    "tweedie": (linear.tweedie, f"({_GAP}) / sqrt(prediction)", lambda n: 1.0, 4),
    "quantile": (linear.median_regression, f"signum({_GAP})", lambda n: 0.0, 2),
    "svc_linear_regression": (linear.linear_support_regression, f"signum({_GAP})", lambda n: 1.0 / n, 2),
}


def _line_query(name, fit, pull, penalty, digits):
    @query(f"stationary_{name}", _zeros(TERMS, "term"))
    def run(spark, sf):
        t = numbers(_rows(spark, sf), FEATURES, "price")
        fitted = fit(t)
        slopes = _slopes(apply_model(fitted, t.df), F.expr(pull)) - penalty(t.rows) * _weights(fitted)
        t.df.unpersist()
        return _differences(spark, TERMS, slopes, "term", digits)


for _name, _case in _LINES.items():
    _line_query(_name, *_case)


@query("stationary_huber", _zeros(TERMS, "term"))
def stationary_huber(spark, sf):
    """Residuals beyond 1.35 scales pull no stronger than those at it."""
    t = numbers(_rows(spark, sf), FEATURES, "price")
    fitted = native.huber(t)
    scaled = F.expr(_GAP) / F.lit(float(fitted.model.scale))
    slopes = _slopes(apply_model(fitted, t.df), F.greatest(F.least(scaled, F.lit(1.35)), F.lit(-1.35)))
    t.df.unpersist()
    return _differences(spark, TERMS, slopes, "term", 3)


_CLASS_TERMS = [f"{term} {c}" for c in range(3) for term in TERMS]


@query("stationary_logistic_regression", _zeros(_CLASS_TERMS, "term"))
def stationary_logistic_regression(spark, sf):
    """Probabilities match the classes along every feature, up to the penalty."""
    t = numbers(_rows(spark, sf), FEATURES, "flag", 3)
    model = native.logistic(t).model
    scored = model.transform(t.vectors).withColumn("p", vector_to_array("probability"))
    slopes = []
    for c in range(3):
        pull = (F.col("label") == c).cast("double") - F.get("p", F.lit(c))
        penalty = np.append(model.coefficientMatrix.toArray()[c], 0.0) / t.rows
        slopes.extend(_slopes(scored, pull) - penalty)
    t.df.unpersist()
    return _differences(spark, _CLASS_TERMS, slopes, "term", 3)


@query("stationary_svc_linear", _zeros(_CLASS_TERMS, "term"))
def stationary_svc_linear(spark, sf):
    """One machine for each class: margins short of one pull by what they lack."""
    t = numbers(_rows(spark, sf), FEATURES, "flag", 3)
    p = linear.linear_support_classifier(t).params
    weights = np.vstack([p["weights"], p["intercepts"]])
    slopes = []
    for c in range(3):
        terms = [F.get("x", F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights[:-1, c])]
        margin = reduce(lambda a, b: a + b, terms) + F.lit(float(weights[-1, c]))
        sign = F.when(F.col("label") == c, 1.0).otherwise(-1.0)
        slopes.extend(_slopes(t.df, sign * F.greatest(1 - sign * margin, F.lit(0.0))) - weights[:, c] / (2 * t.rows))
    t.df.unpersist()
    return _differences(spark, _CLASS_TERMS, slopes, "term", 5)


@query("stationary_kernel_ridge", _zeros(["largest slope"], "term"))
def stationary_kernel_ridge(spark, sf):
    """Residuals along every random feature equal the weight."""
    t = numbers(_rows(spark, sf), FEATURES, "price")
    p = arrays(linear.kernel_ridge(t).params)
    lift, weights = basis(p), np.ravel(p["weights"])

    def pull(x, y):
        z = lift(x)
        return z.T @ (np.asarray(y) - z @ weights)

    slopes = sum_over_rows(t.df, ["x", "label"], pull, len(weights)) - weights
    t.df.unpersist()
    return _differences(spark, ["largest slope"], [np.abs(slopes).max() / t.rows], "term", 6)


def _tree_query(name, fit):
    @query(f"leaves_{name}", "SELECT true AS many_leaves, 0.0::DOUBLE AS difference FROM part HAVING count(*) > 0")
    def run(spark, sf):
        """Every leaf predicts the mean of its rows."""
        df = table(spark, sf, "part").select("p_size", "p_partkey", (F.col("p_retailprice") % 97).alias("y"))
        t = numbers(df, ["p_size", "p_partkey"], "y")
        leaves = apply_model(fit(t), t.df).groupBy("prediction").agg(F.avg("label").alias("mean"))
        gap = F.round(F.max(F.abs(F.col("mean") - F.col("prediction"))), 6) + 0.0
        return leaves.agg((F.count(F.lit(1)) > 50).alias("many_leaves"), gap.alias("difference"))


_tree_query("decision_tree", native.decision_tree)
_tree_query("extra_tree", trees.extra_tree)


@query(
    "centres_kmeans",
    "SELECT 8::BIGINT AS clusters, 0.0::DOUBLE AS difference FROM embeddings HAVING count(*) > 0",
)
def centres_kmeans(spark, sf):
    """Every centre is the mean of the rows that are nearest to it."""
    t = numbers(embedding_columns(spark, sf, 6), [f"e{i:02d}" for i in range(6)])
    fitted = clusters.kmeans(t)
    centres = np.array(fitted.model.clusterCenters())
    means = apply_model(fitted, t.df).groupBy("prediction").agg(*[F.avg(F.get("x", F.lit(i))) for i in range(6)]).collect()
    gap = max(np.abs(np.array(r[1:]) - centres[int(r.prediction)]).max() for r in means)
    t.df.unpersist()
    return spark.createDataFrame([(len(means), round(float(gap), 3) + 0.0)], "clusters bigint, difference double")


def _direction_query(name, fit, centred):
    @query(f"directions_{name}", "SELECT i AS component, true AS ordered, 0.0::DOUBLE AS difference FROM range(10) r(i), embeddings GROUP BY 1")
    def run(spark, sf):
        """All entries of the embeddings: the (co)moments scale each direction by
        its own variance, the directions come by falling variance."""
        names = [f"e{i:02d}" for i in range(WIDTH)]
        t = numbers(embedding_columns(spark, sf), names)
        fitted = fit(t)
        matrix = np.array(fitted.params["matrix"])[:, :10]
        scored = apply_model(fitted, t.df)
        x = [F.get("x", F.lit(j)) for j in range(WIDTH)]
        found = []
        for i in range(10):
            s = F.get("embedding", F.lit(i))
            both = [F.covar_pop(s, v) if centred else F.avg(s * v) for v in x]
            own = F.var_pop(s) if centred else F.avg(s * s)
            row = [float(v) for v in scored.agg(*both, own).first()]
            found.append((row[-1], np.abs(np.array(row[:-1]) - row[-1] * matrix[:, i]).max()))
        t.df.unpersist()
        rows = [(i, i == 0 or v <= found[i - 1][0] + 1e-12, round(float(gap), 6) + 0.0) for i, (v, gap) in enumerate(found)]
        return spark.createDataFrame(rows, "component bigint, ordered boolean, difference double")


_direction_query("pca", decomposition.pca, True)
_direction_query("incremental_pca", decomposition.incremental_pca, True)
_direction_query("truncated_svd", decomposition.truncated_svd, False)
