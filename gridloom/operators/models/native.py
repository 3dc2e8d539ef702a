"""Algorithms that Spark ML provides, with penalties mapped to the same optimum."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import functions as F

from gridloom.operators.models.base import SCORERS, SEED, Fitted, Training, scorer

# Spark's limit; trees are otherwise grown to pure leaves.
MAX_DEPTH = 30
MAX_BINS = 128
# As many candidate cuts as the single tree.
FOREST_BINS = MAX_BINS
# Leaves that the trees of a forest may have together, as Spark keeps all trees on
# the driver: a leaf holds at least the rows of all trees divided by this.
FOREST_LEAVES = 100_000


def _fit(estimator, t: Training) -> Fitted:
    return Fitted("spark", model=estimator.fit(t.vectors))


def logistic(t: Training, penalty: float | None = None) -> Fitted:
    """L2 logistic regression; ``penalty`` is per row (C = 1 by default)."""
    return _fit(
        LogisticRegression(
            regParam=1.0 / t.rows if penalty is None else penalty,
            standardization=False,
            maxIter=2000,
        ),
        t,
    )


def sgd_classifier(t: Training) -> Fitted:
    """The same penalised log loss solved to its optimum."""
    return logistic(t, penalty=1e-4)


def ordinary(t: Training) -> Fitted:
    return _fit(LinearRegression(solver="normal"), t)


def ridge(t: Training) -> Fitted:
    # Spark scales the label by its deviation before it applies the penalty.
    return _fit(
        LinearRegression(
            solver="normal",
            regParam=t.label_stats["std"] / t.rows,
            elasticNetParam=0.0,
            standardization=False,
        ),
        t,
    )


def lasso(t: Training) -> Fitted:
    return _fit(
        LinearRegression(
            regParam=1.0, elasticNetParam=1.0, standardization=False, maxIter=5000, tol=1e-9
        ),
        t,
    )


def elastic_net(t: Training, alpha: float = 1.0, share: float = 0.5) -> Fitted:
    total = alpha * (share + (1 - share) * t.label_stats["sample_std"])
    return _fit(
        LinearRegression(
            solver="l-bfgs",
            regParam=total,
            elasticNetParam=alpha * share / total,
            standardization=False,
            maxIter=5000,
            tol=1e-9,
        ),
        t,
    )


def huber(t: Training) -> Fitted:
    return _fit(
        LinearRegression(
            loss="huber",
            epsilon=1.35,
            regParam=1e-4 / t.rows,
            standardization=False,
            maxIter=200,
        ),
        t,
    )


def poisson(t: Training) -> Fitted:
    return _fit(
        GeneralizedLinearRegression(
            family="poisson", link="log", regParam=1.0 / t.label_stats["mean"], maxIter=500
        ),
        t,
    )


def gamma(t: Training) -> Fitted:
    return _fit(
        GeneralizedLinearRegression(family="gamma", link="log", regParam=1.0, maxIter=500), t
    )


def decision_tree(t: Training) -> Fitted:
    kind = DecisionTreeClassifier if t.classes else DecisionTreeRegressor
    return _fit(kind(maxDepth=MAX_DEPTH, maxBins=MAX_BINS, seed=SEED), t)


def _forest(t: Training, trees: int, features: str) -> Fitted:
    kind = RandomForestClassifier if t.classes else RandomForestRegressor
    return _fit(
        kind(
            numTrees=trees,
            maxDepth=MAX_DEPTH,
            maxBins=FOREST_BINS,
            minInstancesPerNode=max(1, round(trees * t.rows / FOREST_LEAVES)),
            featureSubsetStrategy=features,
            seed=SEED,
            maxMemoryInMB=512,
        ),
        t,
    )


def random_forest(t: Training) -> Fitted:
    return _forest(t, 200, "sqrt" if t.classes else "all")


def bagging(t: Training) -> Fitted:
    return _forest(t, 30, "all")


def _boosting(t: Training, depth: int, bins: int) -> Fitted:
    options = {
        "maxIter": 100,
        "maxDepth": depth,
        "stepSize": 0.1,
        "maxBins": bins,
        "seed": SEED,
        "checkpointInterval": 10,
    }
    if not t.classes:
        return _fit(GBTRegressor(**options), t)
    one = GBTClassifier(**options)
    return _fit(one if t.classes <= 2 else OneVsRest(classifier=one), t)


def gradient_boosting(t: Training) -> Fitted:
    return _boosting(t, 3, MAX_BINS)


def binned_boosting(t: Training) -> Fitted:
    return _boosting(t, 5, 255)


def perceptron_network(t: Training) -> Fitted:
    return _fit(
        MultilayerPerceptronClassifier(
            layers=[t.d, 128, 64, max(t.classes, 2)], maxIter=200, tol=1e-4, seed=SEED
        ),
        t,
    )


def naive_bayes(kind: str):
    def fit(t: Training) -> Fitted:
        model = NaiveBayes(modelType=kind, smoothing=1.0)
        if kind == "bernoulli":
            ones = t.df.withColumn("x", F.transform("x", _above_zero))
            return Fitted(
                "bernoulli", model=model.fit(Training(ones, t.rows, t.d, t.classes).vectors)
            )
        if t.df.filter(F.exists("x", lambda v: v < 0)).limit(1).count():
            raise ValueError(f"Negative values in data passed to {kind} naive Bayes.")
        return _fit(model, t)

    return fit


def _above_zero(value):
    return F.when(value > 0, 1.0).otherwise(0.0)


@scorer("bernoulli")
def _bernoulli(fitted, df):
    ones = df.withColumn("_kept", F.col("x")).withColumn("x", F.transform("x", _above_zero))
    out = SCORERS["spark"](fitted, ones)
    return out.withColumn("x", F.col("_kept")).drop("_kept")
