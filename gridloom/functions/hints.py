"""Advice for error messages and readable metric lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.columns import first_match

# Fixed values: (pattern, advice); matched without regard to case, in order.
HINTS = [
    (
        r"Missing columns:",
        "Use the exact feature names from training (copy the list or example JSON). "
        "Include every listed column; spelling and case must match.",
    ),
    (
        r"This unsupervised model was fit without|sklearn API for new rows|DBSCAN|agglomerative|spectral",
        "This algorithm does not score new rows in the API. Train again with one that supports "
        "predict or transform (e.g. K-Means, Gaussian Mixture, PCA, Isolation Forest).",
    ),
    (
        r"Target column '[^']+' not in dataset",
        "Pick a target that appears exactly in your CSV header (watch spaces and spelling).",
    ),
    (r"Target column not in dataset", "Choose a column that exists in this dataset."),
    (
        r"Target column .+ is not in the CSV",
        "That column name is not in the file—match the header row exactly.",
    ),
    (
        r"exclude_columns not in dataset",
        "Only exclude names that exist in the CSV. Remove typos or columns from another file.",
    ),
    (
        r"No feature columns left after exclusions",
        "Shorten the exclude list so at least one column remains for features.",
    ),
    (
        r"No usable columns after preprocessing split",
        "Features may be all-empty or the wrong type—check the CSV has real values in those columns.",
    ),
    (
        r"Need at least 5 rows for unsupervised",
        "Add more data rows (unsupervised needs at least 5).",
    ),
    (
        r"Need at least 10 rows after cleaning",
        "Too many rows were dropped for missing targets—fix gaps in the target column or add more rows.",
    ),
    (
        r"for regression only.*inferred as classification",
        "The app treated your target as classification. Pick a classification algorithm, or use fewer "
        "categories / bucket labels; if the target is really numeric, check column types in the CSV.",
    ),
    (
        r"for classification only.*inferred as regression",
        "The app treated your target as regression. Pick a regression algorithm, or turn the target "
        "into clear categories.",
    ),
    (
        r"too many distinct classes for classification",
        "Use regression if the target is numeric, or bucket labels into fewer groups "
        "(e.g. top categories plus an 'Other' bucket).",
    ),
    (
        r"too many unique.*class|class.*too many unique",
        "Too many categories makes training hard. Merge rare labels, bucket into groups, or use "
        "regression if the target is numeric.",
    ),
    (
        r"least populated class",
        "Each class needs enough examples (often 2+ per class for a test split). Merge rare labels "
        "or collect more data.",
    ),
    (
        r"test_size|stratify|Cannot stratify|minimum number of groups",
        "Train/test split failed—try a larger dataset, fewer classes, or more rows per class.",
    ),
    (
        r"(?-i:Unknown algorithm_id)|Unknown unsupervised algorithm_id",
        "Refresh algorithms and pick an option from the list (unknown id).",
    ),
    (
        r"Algorithm .+ is for '.+', not",
        "Pick an algorithm that matches the analysis family (clustering vs decomposition vs anomaly).",
    ),
    (
        r"Could not read CSV",
        "Save as UTF-8 CSV with a standard delimiter; check for corrupt or binary content.",
    ),
    (r"CSV has no data rows", "Add at least one row of data under the header."),
    (
        r"Could not profile dataset",
        "Check for odd quoting, wrong delimiter, or merged cells—open the file in a spreadsheet app.",
    ),
    (
        r"Could not parse CSV",
        "The upload is not a valid CSV—try exporting again with comma separation and UTF-8.",
    ),
    (r"Upload a \.csv file", "Choose a file whose name ends in .csv."),
    (
        r"(?-i:Unknown dataset|CSV file missing on disk)",
        "Re-upload the file or pick a dataset from the library after refreshing.",
    ),
    (
        r"Unknown job",
        "That job id is not on this server—start training again or pick a job from the list.",
    ),
    (
        r"Job must be completed",
        "Wait until training finishes (or fix a failed run) before download or prediction.",
    ),
    (
        r"(?-i:Artifacts missing|Model artifacts missing)",
        "The saved model files are missing—train again on this server.",
    ),
    (
        r"target_column is required",
        "Supervised training needs a target column—select which column to predict.",
    ),
    (
        r"unsupervised_family is required",
        "Pick clustering, decomposition, or anomaly before training.",
    ),
    (
        r"SMOTE|SMOTENC|imblearn|k_neighbors",
        "Resampling failed—ensure each class has at least 2 rows in the training split, or turn off SMOTE.",
    ),
    (
        r"KBinsDiscretizer|bin edges|unique values",
        "Binning failed—use fewer bins or drop rows with too few distinct values in that column.",
    ),
    (
        r"imbalanced-learn",
        "Install imbalanced-learn on the server: pip install imbalanced-learn",
    ),
]


def error_hint(message: Column) -> Column:
    """Advice for the first pattern the message contains, else NULL."""
    return first_match([(message.rlike("(?is)" + pattern), text) for pattern, text in HINTS])


def _part(metrics: Column, name: str, text) -> Column:
    """One piece of the line, NULL (and so left out) without that metric."""
    value = F.element_at(metrics, name)
    return F.when(value.isNotNull(), text(value))


def metric_line(task: Column, metrics: Column) -> Column:
    """A one-line reading of a run's metrics (a map of doubles) by its task."""
    separator = " · "
    percent = lambda v: F.concat(F.lit("acc "), F.format_string("%.1f%%", v * 100))
    fixed = lambda label, digits: (
        lambda v: F.format_string(f"{label} %.{digits}f", v)
    )
    lines = [
        (
            "classification",
            F.concat_ws(
                separator,
                _part(metrics, "accuracy", percent),
                _part(metrics, "f1_macro", fixed("F1", 3)),
            ),
        ),
        (
            "regression",
            F.concat_ws(
                separator, _part(metrics, "r2", fixed("R²", 4)), _part(metrics, "rmse", fixed("RMSE", 4))
            ),
        ),
        (
            "unsupervised",
            F.concat_ws(
                separator,
                _part(metrics, "silhouette", fixed("silhouette", 3)),
                _part(
                    metrics,
                    "reconstruction_error",
                    lambda v: F.concat(F.lit("recon "), F.format_string("%.2e", v)),
                ),
                _part(metrics, "explained_variance_ratio_sum", fixed("EV Σ", 3)),
                _part(
                    metrics,
                    "rows_flagged_outlier",
                    lambda v: F.concat(F.lit("outliers "), v.cast("bigint").cast("string")),
                ),
            ),
        ),
    ]
    text = F.lit("")
    for name, line in lines:
        text = F.when(task == name, line).otherwise(text)
    return F.when(text == "", "—").otherwise(text)
