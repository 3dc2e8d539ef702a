"""The algorithms by id: label, task kind, wish for scaling and how to fit them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from gridloom.operators.models import (
    anomalies,
    bayes,
    clusters,
    decomposition,
    linear,
    native,
    nearest,
    online,
    trees,
)
from gridloom.operators.models.base import Fitted, Training

Fit = Callable[[Training], Fitted]
DEFAULT_ALGORITHM = "random_forest"
FAMILIES = ("clustering", "decomposition", "anomaly")


@dataclass(frozen=True)
class Algorithm:
    id: str
    label: str
    scale: bool
    classify: Fit | None = None
    regress: Fit | None = None

    @property
    def kind(self) -> str:
        if self.classify and self.regress:
            return "both"
        return "classification" if self.classify else "regression"


@dataclass(frozen=True)
class Unsupervised:
    id: str
    label: str
    family: str
    scale: bool
    # predict, transform, or none when only the fitted rows get labels.
    inference: str
    fit: Fit


SUPERVISED = [
    Algorithm("logistic_regression", "Logistic regression", True, native.logistic),
    Algorithm("ridge_classifier", "Ridge classifier", True, linear.ridge_classifier),
    Algorithm("sgd_classifier", "SGD classifier (log loss)", True, native.sgd_classifier),
    Algorithm(
        "passive_aggressive_classifier", "Passive aggressive classifier", True,
        online.passive_aggressive_classifier,
    ),
    Algorithm("perceptron", "Perceptron", True, online.perceptron),
    Algorithm(
        "linear_regression", "Linear / multiple regression (OLS)", True, None, native.ordinary
    ),
    Algorithm(
        "multiple_linear_regression", "Multiple linear regression (alias: OLS on all features)",
        True, None, native.ordinary,
    ),
    Algorithm("ridge", "Ridge regression", True, None, native.ridge),
    Algorithm("lasso", "Lasso", True, None, native.lasso),
    Algorithm("elastic_net", "Elastic net", True, None, native.elastic_net),
    Algorithm("lars", "LARS", True, None, linear.least_squares),
    Algorithm("lasso_lars", "Lasso LARS", True, None, linear.lasso_path_end),
    Algorithm("bayesian_ridge", "Bayesian ridge", True, None, linear.bayesian_ridge),
    Algorithm("ard_regression", "ARD regression", True, None, linear.relevance_regression),
    Algorithm("sgd_regressor", "SGD regressor", True, None, linear.sgd_regressor),
    Algorithm(
        "passive_aggressive_regressor", "Passive aggressive regressor", True, None,
        online.passive_aggressive_regressor,
    ),
    Algorithm("omp", "Orthogonal matching pursuit", True, None, linear.matching_pursuit),
    Algorithm("huber", "Huber regressor", True, None, native.huber),
    Algorithm("ransac", "RANSAC regression", True, None, linear.consensus_regression),
    Algorithm("theil_sen", "Theil–Sen regressor", True, None, linear.spatial_median_regression),
    Algorithm("poisson", "Poisson regressor", False, None, native.poisson),
    Algorithm("gamma", "Gamma regressor", False, None, native.gamma),
    Algorithm("tweedie", "Tweedie regressor", False, None, linear.tweedie),
    Algorithm("quantile", "Quantile regressor (median)", True, None, linear.median_regression),
    Algorithm("kernel_ridge", "Kernel ridge", True, None, linear.kernel_ridge),
    Algorithm("knn", "k-nearest neighbors", True, nearest.knn, nearest.knn),
    Algorithm(
        "svc_rbf", "SVM (RBF)", True,
        linear.kernel_support_classifier, linear.kernel_support_regression,
    ),
    Algorithm(
        "svc_linear", "Linear SVM", True,
        linear.linear_support_classifier, linear.linear_support_regression,
    ),
    Algorithm("lda", "Linear discriminant analysis", True, bayes.linear_discriminant),
    Algorithm("qda", "Quadratic discriminant analysis", True, bayes.quadratic_discriminant),
    Algorithm(
        "decision_tree", "Decision tree", False, native.decision_tree, native.decision_tree
    ),
    Algorithm("extra_tree", "Extra-tree (single)", False, trees.extra_tree, trees.extra_tree),
    Algorithm(
        "random_forest", "Random forest", False, native.random_forest, native.random_forest
    ),
    Algorithm("extra_trees", "Extra trees", False, trees.extra_trees, trees.extra_trees),
    Algorithm(
        "gradient_boosting", "Gradient boosting", False,
        native.gradient_boosting, native.gradient_boosting,
    ),
    Algorithm(
        "hist_gradient_boosting", "Hist gradient boosting", False,
        native.binned_boosting, native.binned_boosting,
    ),
    Algorithm("adaboost", "AdaBoost", False, trees.boosted_classifier, trees.boosted_regressor),
    Algorithm("bagging", "Bagging", False, native.bagging, native.bagging),
    Algorithm(
        "mlp", "Multi-layer perceptron", True, native.perceptron_network, online.network_regressor
    ),
    Algorithm("gaussian_nb", "Gaussian naive Bayes", False, bayes.gaussian_bayes),
    Algorithm(
        "multinomial_nb", "Multinomial naive Bayes", False, native.naive_bayes("multinomial")
    ),
    Algorithm("bernoulli_nb", "Bernoulli naive Bayes", False, native.naive_bayes("bernoulli")),
    Algorithm("complement_nb", "Complement naive Bayes", False, native.naive_bayes("complement")),
    Algorithm("categorical_nb", "Categorical naive Bayes", False, bayes.categorical_bayes),
]

UNSUPERVISED = [
    Unsupervised("kmeans", "K-means", "clustering", True, "predict", clusters.kmeans),
    Unsupervised(
        "mini_batch_kmeans", "Mini-batch K-means", "clustering", True, "predict",
        clusters.mini_batch_kmeans,
    ),
    Unsupervised("birch", "BIRCH", "clustering", True, "predict", clusters.birch),
    Unsupervised(
        "gaussian_mixture", "Gaussian mixture", "clustering", True, "predict",
        clusters.gaussian_mixture,
    ),
    Unsupervised(
        "bayesian_gaussian_mixture", "Bayesian Gaussian mixture", "clustering", True, "predict",
        clusters.bayesian_mixture,
    ),
    Unsupervised("dbscan", "DBSCAN", "clustering", True, "none", clusters.dbscan),
    Unsupervised(
        "agglomerative", "Agglomerative clustering", "clustering", True, "none",
        clusters.agglomerative,
    ),
    Unsupervised("spectral", "Spectral clustering", "clustering", True, "none", clusters.spectral),
    Unsupervised(
        "feature_agglomeration", "Feature agglomeration (embedding)", "clustering", True,
        "transform", decomposition.feature_agglomeration,
    ),
    Unsupervised("pca", "PCA", "decomposition", True, "transform", decomposition.pca),
    Unsupervised(
        "incremental_pca", "Incremental PCA", "decomposition", True, "transform",
        decomposition.incremental_pca,
    ),
    Unsupervised(
        "kernel_pca", "Kernel PCA", "decomposition", True, "transform", decomposition.kernel_pca
    ),
    Unsupervised(
        "truncated_svd", "Truncated SVD (LSA)", "decomposition", False, "transform",
        decomposition.truncated_svd,
    ),
    Unsupervised("nmf", "NMF", "decomposition", False, "transform", decomposition.nmf),
    Unsupervised(
        "fast_ica", "FastICA", "decomposition", True, "transform", decomposition.fast_ica
    ),
    Unsupervised(
        "factor_analysis", "Factor analysis", "decomposition", True, "transform",
        decomposition.factor_analysis,
    ),
    Unsupervised(
        "dictionary_learning", "Dictionary learning", "decomposition", True, "transform",
        decomposition.dictionary_learning,
    ),
    Unsupervised(
        "lda_topic", "Latent Dirichlet allocation (topics)", "decomposition", False, "transform",
        decomposition.topics,
    ),
    Unsupervised(
        "gaussian_random_projection", "Gaussian random projection", "decomposition", True,
        "transform", decomposition.gaussian_projection,
    ),
    Unsupervised(
        "sparse_random_projection", "Sparse random projection", "decomposition", False,
        "transform", decomposition.sparse_projection,
    ),
    Unsupervised(
        "isolation_forest", "Isolation forest", "anomaly", False, "predict",
        anomalies.isolation_forest,
    ),
    Unsupervised(
        "local_outlier_factor", "Local outlier factor (novelty)", "anomaly", True, "predict",
        anomalies.local_outlier_factor,
    ),
    Unsupervised(
        "one_class_svm", "One-class SVM", "anomaly", True, "predict", anomalies.one_class
    ),
    Unsupervised(
        "elliptic_envelope", "Elliptic envelope", "anomaly", True, "predict",
        anomalies.elliptic_envelope,
    ),
]

_BY_ID = {a.id: a for a in SUPERVISED}
_UNSUPERVISED_BY_ID = {a.id: a for a in UNSUPERVISED}


def supervised(algorithm: str, task: str) -> tuple[Algorithm, Fit]:
    found = _BY_ID.get(algorithm)
    if found is None:
        raise ValueError(f"Unknown algorithm_id: {algorithm!r}")
    fit = found.classify if task == "classification" else found.regress
    if fit is None:
        raise ValueError(
            f"Algorithm {algorithm!r} is for {found.kind} only; "
            f"this dataset was inferred as {task}."
        )
    return found, fit


def unsupervised(algorithm: str, family: str) -> Unsupervised:
    found = _UNSUPERVISED_BY_ID.get(algorithm)
    if found is None:
        raise ValueError(f"Unknown unsupervised algorithm_id: {algorithm!r}")
    if found.family != family:
        raise ValueError(f"Algorithm {algorithm!r} is for {found.family!r}, not {family!r}.")
    return found


def options_for(task: str) -> list[str]:
    """Ids usable for a task: its own kind and those that serve both."""
    return [a.id for a in SUPERVISED if a.kind in (task, "both")]


def catalogue(spark):
    """All algorithms as a table."""
    rows = [(a.id, a.label, "supervised", a.kind, a.scale, "predict") for a in SUPERVISED]
    rows += [
        (a.id, a.label, "unsupervised", a.family, a.scale, a.inference) for a in UNSUPERVISED
    ]
    return spark.createDataFrame(
        rows,
        "id string, label string, mode string, kind string, scale_numeric boolean, "
        "inference string",
    )
