"""Registered model queries: closed forms against SQL, others by their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators.models import bayes, clusters, decomposition, linear, native, nearest
from gridloom.operators.models.base import apply_model
from gridloom.operators.models.registry import SUPERVISED, UNSUPERVISED
from gridloom.plans import training
from gridloom.sources import store
from workload.common import (
    embedding_columns,
    line_of,
    metric_rows,
    numbers,
    query,
    rounded,
    shared_folder,
    table,
)

# --- lines with a closed form -------------------------------------------------

_Y = "l_quantity * 0.5 + l_extendedprice / 10000.0"
_STATS = f"""WITH s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c,
  var_pop(x) AS v FROM (SELECT l_quantity AS x, {_Y} AS y FROM lineitem)),
  w AS (SELECT {{weight}} AS w, mx, my FROM s)
  SELECT 'weight_0' AS term, round(w, 5) AS value FROM w
  UNION ALL SELECT 'intercept', round(my - w * mx, 5) FROM w"""
_OLS = "c / v"
_LINES = {
    "linear_regression": (native.ordinary, _OLS),
    "multiple_linear_regression": (native.ordinary, _OLS),
    "ridge": (native.ridge, "c * n / (v * n + 1)"),
    "lasso": (native.lasso, "sign(c) * greatest(abs(c) - 1, 0) / v"),
    "elastic_net": (native.elastic_net, "sign(c) * greatest(abs(c) - 0.5, 0) / (v + 0.5)"),
    "lars": (linear.least_squares, _OLS),
    "lasso_lars": (linear.lasso_path_end, "sign(c) * greatest(abs(c) - 1, 0) / v"),
    "sgd_regressor": (linear.sgd_regressor, "c / (v + 0.0001)"),
    "omp": (linear.matching_pursuit, _OLS),
}


def _register_line(name, fit, weight):
    @query(f"fit_{name}", _STATS.format(weight=weight))
    def run(spark, sf):
        df = table(spark, sf, "lineitem").select("l_quantity", F.expr(_Y).alias("y"))
        return line_of(spark, fit(numbers(df, ["l_quantity"], "y")))


for _name, (_fit, _weight) in _LINES.items():
    _register_line(_name, _fit, _weight)


# --- classifiers whose scores SQL can repeat -----------------------------------


def _argmax(scores: str) -> str:
    """Counts of (label, prediction) from (id, y, k, score) rows."""
    return f"""b AS (SELECT id, y, k, row_number() OVER (PARTITION BY id ORDER BY score DESC, k)
  AS rn FROM ({scores})) SELECT y::DOUBLE AS label, k::DOUBLE AS prediction, count(*) AS cnt
  FROM b WHERE rn = 1 GROUP BY 1, 2"""


def _predictions(fitted, t):
    return (
        apply_model(fitted, t.df)
        .groupBy("label", "prediction")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


_FLAGS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_LINES_T = f"""t AS (SELECT row_number() OVER () AS id, l_quantity AS a,
  l_extendedprice / 1000.0 AS b, {_FLAGS} AS y FROM lineitem)"""


def _priced(spark, sf, features=("a", "b")):
    df = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"),
        (F.col("l_extendedprice") / 1000.0).alias("b"),
        F.expr(_FLAGS).alias("y"),
    )
    return numbers(df, list(features), "y", 3)


@query(
    "fit_gaussian_nb",
    f"""WITH {_LINES_T}, e AS (SELECT 1e-9 * greatest(var_pop(a), var_pop(b)) AS e FROM t),
  s AS (SELECT y AS k, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) + max(e) AS va,
    var_pop(b) + max(e) AS vb FROM t, e GROUP BY y), """
    + _argmax(
        """SELECT id, y, k, ln(n) - 0.5 * (ln(va) + ln(vb)) - 0.5 * (pow(a - ma, 2) / va
  + pow(b - mb, 2) / vb) AS score FROM t, s"""
    ),
)
def fit_gaussian_nb(spark, sf):
    t = _priced(spark, sf)
    return _predictions(bayes.gaussian_bayes(t), t)


_CLASS_STATS = """s AS (SELECT y AS k, count(*) AS n, avg(a) AS m, var_samp(a) AS v,
  sum(a * a) - count(*) * avg(a) * avg(a) AS ss FROM t GROUP BY y),
  p AS (SELECT sum(ss) / (sum(n) - count(*)) AS pooled FROM s)"""


@query(
    "fit_lda",
    f"WITH {_LINES_T}, {_CLASS_STATS}, "
    + _argmax(
        """SELECT id, y, k, a * m / pooled - 0.5 * m * m / pooled + ln(n) AS score
  FROM t, s, p"""
    ),
)
def fit_lda(spark, sf):
    t = _priced(spark, sf, ["a"])
    return _predictions(bayes.linear_discriminant(t), t)


@query(
    "fit_qda",
    f"WITH {_LINES_T}, {_CLASS_STATS}, "
    + _argmax(
        """SELECT id, y, k, ln(n) - 0.5 * ln(v) - 0.5 * pow(a - m, 2) / v AS score
  FROM t, s"""
    ),
)
def fit_qda(spark, sf):
    t = _priced(spark, sf, ["a"])
    return _predictions(bayes.quadratic_discriminant(t), t)


@query(
    "fit_ridge_classifier",
    f"""WITH {_LINES_T}, c AS (SELECT range AS k FROM range(3)),
  g AS (SELECT k, 2 * avg((y = k)::INT) - 1 AS mean_y, avg(a) AS mx,
    2 * (sum(a * (y = k)::INT) - count(*) * avg(a) * avg((y = k)::INT)) /
    (count(*) * var_pop(a) + 1) AS w FROM t, c GROUP BY k), """
    + _argmax("SELECT id, y, k, mean_y + w * (a - mx) AS score FROM t, g"),
)
def fit_ridge_classifier(spark, sf):
    t = _priced(spark, sf, ["a"])
    return _predictions(linear.ridge_classifier(t), t)


_CODES_T = f"""t AS (SELECT row_number() OVER () AS id, l_linenumber::DOUBLE AS a,
  round(l_discount * 100) AS b, round(l_tax * 100) AS c, {_FLAGS} AS y FROM lineitem)"""


def _codes(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("double").alias("a"),
        F.round(F.col("l_discount") * 100).alias("b"),
        F.round(F.col("l_tax") * 100).alias("c"),
        F.expr(_FLAGS).alias("y"),
    )
    return numbers(df, ["a", "b", "c"], "y", 3)


@query(
    "fit_multinomial_nb",
    f"""WITH {_CODES_T}, s AS (SELECT y AS k, ln(count(*)) AS p, sum(a) + 1 AS sa, sum(b) + 1 AS sb,
  sum(c) + 1 AS sc FROM t GROUP BY y), """
    + _argmax(
        """SELECT id, y, k, p + a * ln(sa / (sa + sb + sc)) + b * ln(sb / (sa + sb + sc))
  + c * ln(sc / (sa + sb + sc)) AS score FROM t, s"""
    ),
)
def fit_multinomial_nb(spark, sf):
    t = _codes(spark, sf)
    return _predictions(native.naive_bayes("multinomial")(t), t)


@query(
    "fit_complement_nb",
    f"""WITH {_CODES_T}, s AS (SELECT y AS k, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc FROM t
  GROUP BY y), r AS (SELECT k, sum(sa) OVER () - sa + 1 AS ra, sum(sb) OVER () - sb + 1 AS rb,
  sum(sc) OVER () - sc + 1 AS rc FROM s), """
    + _argmax(
        """SELECT id, y, k, -(a * ln(ra / (ra + rb + rc)) + b * ln(rb / (ra + rb + rc))
  + c * ln(rc / (ra + rb + rc))) AS score FROM t, r"""
    ),
)
def fit_complement_nb(spark, sf):
    t = _codes(spark, sf)
    return _predictions(native.naive_bayes("complement")(t), t)


def _flag_score(name):
    return f"CASE WHEN {name} > 0 THEN ln(p{name}) ELSE ln(1 - p{name}) END"


@query(
    "fit_bernoulli_nb",
    f"""WITH {_CODES_T}, s AS (SELECT y AS k, ln(count(*)) AS p,
  (sum((a > 0)::INT) + 1.0) / (count(*) + 2) AS pa, (sum((b > 0)::INT) + 1.0) / (count(*) + 2) AS pb,
  (sum((c > 0)::INT) + 1.0) / (count(*) + 2) AS pc FROM t GROUP BY y), """
    + _argmax(
        f"SELECT id, y, k, p + {_flag_score('a')} + {_flag_score('b')} + {_flag_score('c')} AS score "
        "FROM t, s"
    ),
)
def fit_bernoulli_nb(spark, sf):
    t = _codes(spark, sf)
    return _predictions(native.naive_bayes("bernoulli")(t), t)


def _category(name):
    return f"""{name}n AS (SELECT y AS k, {name} AS v, count(*) AS c FROM t GROUP BY 1, 2)"""


def _category_log(name):
    return (
        f"ln((coalesce((SELECT c FROM {name}n WHERE {name}n.k = s.k AND {name}n.v = u.{name}), 0)"
        f" + 1.0) / (n + max_{name} + 1))"
    )


@query(
    "fit_categorical_nb",
    f"""WITH {_CODES_T}, {_category('a')}, {_category('b')}, {_category('c')},
  s AS (SELECT y AS k, count(*) AS n FROM t GROUP BY y),
  m AS (SELECT max(a) AS max_a, max(b) AS max_b, max(c) AS max_c FROM t),
  u AS (SELECT DISTINCT a, b, c FROM t),
  z AS (SELECT u.a, u.b, u.c, s.k, ln(n) + {_category_log('a')} + {_category_log('b')}
    + {_category_log('c')} AS score FROM u, s, m), """
    + _argmax("SELECT id, y, z.k, z.score FROM t JOIN z USING (a, b, c)"),
)
def fit_categorical_nb(spark, sf):
    t = _codes(spark, sf)
    return _predictions(bayes.categorical_bayes(t), t)


# --- neighbours -----------------------------------------------------------------

_PLACES = """t AS (SELECT c_custkey AS id, c_acctbal / 1000.0 AS a, c_nationkey::DOUBLE AS b,
  (c_custkey % 100)::DOUBLE AS y FROM customer)"""


def _places(spark, sf, keep=()):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double")).alias("x"),
        (F.col("c_custkey") % 100).cast("double").alias("label"),
    )


@query(
    "fit_knn",
    f"""WITH {_PLACES}, d AS (SELECT q.id, p.y, sqrt(pow(q.a - p.a, 2) + pow(q.b - p.b, 2)) AS gap,
    row_number() OVER (PARTITION BY q.id ORDER BY pow(q.a - p.a, 2) + pow(q.b - p.b, 2)) AS rn
    FROM t q, t p WHERE q.id % 2 = 1 AND p.id % 2 = 0)
  SELECT id AS c_custkey, round(CASE WHEN min(gap) = 0 THEN avg(y) FILTER (gap = 0)
    ELSE sum(y / gap) / sum(1 / gap) END, 5) AS prediction FROM d WHERE rn <= 5 GROUP BY id""",
)
def fit_knn(spark, sf):
    """Odd customers predicted from the even ones."""
    df = _places(spark, sf)
    even = df.filter("c_custkey % 2 = 0")
    model = nearest.knn(training.Training(even, even.count(), 2))
    odd = df.filter("c_custkey % 2 = 1").select("c_custkey", "x")
    return rounded(
        apply_model(model, odd).select("c_custkey", "prediction"), "prediction", digits=5
    )


@query(
    "fit_dbscan",
    f"""WITH {_PLACES}, n AS (SELECT q.id, count(*) AS c FROM t q, t p
    WHERE sqrt(pow(q.a - p.a, 2) + pow(q.b - p.b, 2)) <= 0.5 GROUP BY q.id),
  core AS (SELECT t.* FROM t JOIN n USING (id) WHERE c >= 5),
  o AS (SELECT b, a, a - lag(a) OVER (PARTITION BY b ORDER BY a) AS step FROM core),
  r AS (SELECT DISTINCT q.id FROM t q, core p
    WHERE sqrt(pow(q.a - p.a, 2) + pow(q.b - p.b, 2)) <= 0.5)
  SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM r) AS noise_rows,
  (SELECT count(*) FROM o WHERE step IS NULL OR step > 0.5) AS n_clusters""",
)
def fit_dbscan(spark, sf):
    """Nations are a unit apart, so clusters are runs of balances per nation."""
    df = _places(spark, sf).select("x").persist()
    model = clusters.dbscan(training.Training(df, df.count(), 2))
    found = apply_model(model, df)
    return found.agg(
        F.count(F.when(F.col("prediction") < 0, 1)).alias("noise_rows"),
        F.count_distinct(F.when(F.col("prediction") >= 0, F.col("prediction"))).alias("n_clusters"),
    )


# --- principal components ---------------------------------------------------------


@query(
    "fit_pca",
    """WITH s AS (SELECT var_pop(l_extendedprice / 1000.0) AS a, var_pop(l_quantity) AS c,
    covar_pop(l_extendedprice / 1000.0, l_quantity) AS b FROM lineitem),
  e AS (SELECT ((a + c) + sqrt(pow(a - c, 2) + 4 * b * b)) / 2 / (a + c) AS share FROM s)
  SELECT CASE WHEN share > 0.95 THEN 1 ELSE 2 END::BIGINT AS n_components,
  round(CASE WHEN share > 0.95 THEN share ELSE 1 END, 6) AS explained_variance_ratio_sum FROM e""",
)
def fit_pca(spark, sf):
    df = table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 1000.0).alias("a"), F.col("l_quantity").alias("b")
    )
    facts = decomposition.pca(numbers(df, ["a", "b"])).facts
    return rounded(
        spark.createDataFrame(
            [(facts["n_components"], facts["explained_variance_ratio_sum"])],
            "n_components bigint, explained_variance_ratio_sum double",
        ),
        "explained_variance_ratio_sum",
    )


# --- training runs without a closed form: their metrics ----------------------------

_SQL_TWINS = set(_LINES) | {
    "gaussian_nb", "lda", "qda", "ridge_classifier", "multinomial_nb", "complement_nb",
    "bernoulli_nb", "categorical_nb",
}

# Whole tables with an answer that SQL can state: classes with a gap between them,
# a target that follows one feature, groups far apart, planted outliers, columns
# that all follow one.
_CLASSES = """SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS level, count(*) AS n,
  count(*) AS n_right FROM part GROUP BY 1"""
_TARGET = "SELECT p_size, count(*) AS n, count(*) AS n_near FROM part GROUP BY 1"


def _classification(spec):
    # A single tree of random cuts does not place every row that it has not seen.
    @query(
        f"train_{spec.id}" + ("_classification" if spec.kind == "both" else ""),
        None if spec.id == "extra_tree" else _CLASSES,
    )
    def run(spark, sf):
        """Predictions of all rows, with two further features that say nothing."""
        level = F.expr("CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END").alias("level")
        size = F.expr("CASE WHEN p_size > 25 THEN p_size + 50 ELSE p_size END").alias("size")
        df = table(spark, sf, "part").select(size, "p_retailprice", "p_brand", level)
        model = training.train(df, "level", spec.id)
        right = F.count(F.when(F.col("prediction") == F.col("level"), 1))
        return training.score(model, df).groupBy("level").agg(F.count(F.lit(1)).alias("n"), right.alias("n_right"))


# Share of the target's range that a prediction may miss it by; wider for models
# with a logarithmic link and a penalty, and for averaged single steps.
_NEAR = {"poisson": 0.25, "gamma": 0.35, "tweedie": 0.35, "adaboost": 0.15, "mlp": 0.15, "svc_rbf": 0.15}


def _regression(spec):
    @query(f"train_{spec.id}" + ("_regression" if spec.kind == "both" else ""), _TARGET)
    def run(spark, sf):
        """Rows whose prediction is near the target, by feature value."""
        logarithmic = spec.id in ("poisson", "gamma", "tweedie")
        y = "exp(0.03 * p_size)" if logarithmic else "3 * p_size + 5"
        df = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("p_size"), F.expr(f"double({y})").alias("y"))
        model = training.train(df, "y", spec.id)
        low, high = (1.03, 4.49) if logarithmic else (8.0, 155.0)
        near = F.abs(F.col("prediction") - F.col("y")) <= _NEAR.get(spec.id, 0.05) * (high - low)
        scored = training.score(model, df).groupBy(F.col("p_size").cast("int").alias("p_size"))
        return scored.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(near, 1)).alias("n_near"))


for _spec in SUPERVISED:
    if _spec.id not in _SQL_TWINS:
        if _spec.kind in ("classification", "both"):
            _classification(_spec)
        if _spec.kind in ("regression", "both"):
            _regression(_spec)


_GROUPS = """SELECT n, count(*) AS clusters FROM (SELECT p_size % {k} AS g, count(*) AS n FROM part GROUP BY 1)
  GROUP BY 1"""


def _clustering(spec):
    @query(f"train_{spec.id}", _GROUPS.format(k=clusters.CLUSTERS))
    def run(spark, sf):
        """Sizes of the clusters of groups that lie far apart."""
        k = clusters.CLUSTERS
        group = F.col("p_size") % k
        df = table(spark, sf, "part").select(
            *[
                (F.when(group % 2 == 0, 1).otherwise(-1) * (group + i) * 50 % (50 * k) + F.col("p_retailprice") / 2000).alias(f"x{i}")
                for i in (0, 3)
            ]
        )
        model = training.fit_unsupervised(df, spec.family, spec.id)
        sizes = training.fitted_labels(model, df).groupBy("prediction").count()
        return sizes.groupBy(F.col("count").alias("n")).agg(F.count(F.lit(1)).alias("clusters"))


def _anomaly(spec):
    @query(f"train_{spec.id}", "SELECT count(*) AS planted, count(*) AS flagged FROM part WHERE p_partkey % 200 = 0")
    def run(spark, sf):
        """Planted outliers, each far from all other rows, and how many are flagged."""
        far = F.col("p_partkey") % 200 == 0
        df = table(spark, sf, "part").select(
            F.when(far, F.col("p_partkey") * 7 + 4000).otherwise(F.col("p_size")).cast("double").alias("a"),
            F.when(far, -F.col("p_partkey") * 5 - 9000).otherwise(F.col("p_retailprice")).cast("double").alias("b"),
        )
        model = training.fit_unsupervised(df, "anomaly", spec.id)
        scored = training.fitted_labels(model, df).filter("b < 0")
        return scored.agg(F.count(F.lit(1)).alias("planted"), F.count(F.when(F.col("prediction") == -1, 1)).alias("flagged"))


def _decomposition(spec):
    @query(f"train_{spec.id}", "SELECT count(*) AS n, true AS follows FROM part")
    def run(spark, sf):
        """Columns that all follow one: the first component does so, too."""
        df = table(spark, sf, "part").select(
            *[(F.col("p_size") * (i + 1.0)).alias(f"x{i:02d}") for i in range(20)]
        )
        model = training.fit_unsupervised(df, "decomposition", spec.id)
        first = F.get(F.from_json("embedding", "array<double>"), F.lit(0))
        return training.score(model, df).agg(
            F.count(F.lit(1)).alias("n"), (F.abs(F.corr(first, F.col("x00"))) > 0.99).alias("follows")
        )


def _metrics_only(spec):
    @query(f"train_{spec.id}")
    def run(spark, sf):
        df = embedding_columns(spark, sf)
        if spec.id == "lda_topic":
            df = df.select(*[F.abs(F.col(c)).alias(c) for c in df.columns])
        if spec.id == "fast_ica":
            df = table(spark, sf, "part").select("p_size", "p_retailprice")
        model = training.fit_unsupervised(df, spec.family, spec.id)
        return metric_rows(spark, model.metadata["metrics"])


# Topics, independent sources and dictionary atoms are found up to order, sign or
# mixture, variational mixtures up to a local optimum: their metrics are reported.
_METRICS_ONLY = {
    "lda_topic", "fast_ica", "kernel_pca", "dictionary_learning", "bayesian_gaussian_mixture", "spectral",
}


@query("train_feature_agglomeration", "SELECT 'x' || lpad(i::VARCHAR, 2, '0') AS feature, i % 8 AS cluster FROM range(24) r(i), part GROUP BY 1, 2")
def train_feature_agglomeration(spark, sf):
    """Columns that follow one of eight others up to a small remainder."""
    key = F.col("p_partkey")
    base = [F.xxhash64(key, F.lit(i % 8)) / F.lit(float(1 << 63)) for i in range(24)]
    rest = [F.xxhash64(key, F.lit(i + 100)) / F.lit(float(1 << 63)) for i in range(24)]
    df = table(spark, sf, "part").select(*[(a + 0.05 * b).alias(f"x{i:02d}") for i, (a, b) in enumerate(zip(base, rest))])
    model = training.fit_unsupervised(df, "clustering", "feature_agglomeration")
    rows = list(zip(df.columns, model.fitted.facts["feature_labels"]))
    return spark.createDataFrame(rows, "feature string, cluster bigint")


@query(
    "micro_clusters",
    """SELECT round(avg(l_quantity * 10 + l_discount), 6) AS x, round(avg(l_suppkey * 10 + l_tax), 6) AS y,
  count(*)::DOUBLE AS w FROM lineitem
  GROUP BY floor((l_quantity * 10 + l_discount) / (1 / sqrt(2.0))), floor((l_suppkey * 10 + l_tax) / (1 / sqrt(2.0)))""",
)
def micro_clusters(spark, sf):
    """Micro-clusters of thousands of groups."""
    x = [F.col("l_quantity") * 10 + F.col("l_discount"), F.col("l_suppkey") * 10 + F.col("l_tax")]
    df = table(spark, sf, "lineitem").select(*[c.cast("double").alias(n) for c, n in zip(x, "xy")])
    t = numbers(df, df.columns)
    found = clusters.micro_clusters(t, 0.5)
    t.df.unpersist()
    return rounded(found.select(F.get("x", F.lit(0)).alias("x"), F.get("x", F.lit(1)).alias("y"), "w"), "x", "y")


for _spec in UNSUPERVISED:
    if _spec.id in _METRICS_ONLY:
        _metrics_only(_spec)
    elif _spec.id not in ("pca", "dbscan", "feature_agglomeration"):
        {"clustering": _clustering, "anomaly": _anomaly, "decomposition": _decomposition}[_spec.family](_spec)


# --- comparison, saving and scoring ------------------------------------------------


_ONLY = "Algorithm ''{0}'' is for {1} only; this dataset was inferred as {2}."


def _runs(table_name, rows):
    """SQL of the expected runs over a table that is large enough for them."""
    values = ", ".join(f"('{a}', '{status}', {measured}, {message})" for a, status, measured, message in rows)
    return (
        f"SELECT v.* FROM (VALUES {values}) v(algorithm_id, status, measured, message), "
        f"(SELECT count(*) AS n FROM {table_name}) WHERE n >= 10"
    )


def _described(frame):
    return store.described(frame) if "metric_line" not in frame.columns else frame


def _run_columns(frame):
    return _described(frame).select(
        "algorithm_id", "status", (F.col("metric_line") != "—").alias("measured"), "message"
    )


@query(
    "leaderboard",
    _runs(
        "part",
        [
            ("lda", "completed", "true", "NULL"),
            ("gaussian_nb", "completed", "true", "NULL"),
            ("ridge", "failed", "false", f"'{_ONLY.format('ridge', 'regression', 'classification')}'"),
            ("categorical_nb", "completed", "true", "NULL"),
        ],
    ),
)
def leaderboard(spark, sf):
    df = table(spark, sf, "part").drop("p_partkey", "p_name")
    ids = ["lda", "gaussian_nb", "ridge", "lda", "categorical_nb"]
    runs = training.compare(df, "p_type", ids)
    return _run_columns(store.run_rows(spark, runs, "part"))


@query(
    "score_saved_model",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS prediction FROM part""",
)
def score_saved_model(spark, sf):
    """Saved, loaded, scored into a written table; every row against its class."""
    size = F.expr("CASE WHEN p_size > 25 THEN p_size + 50 ELSE p_size END").alias("size")
    level = F.expr("CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END").alias("level")
    df = table(spark, sf, "part").select("p_partkey", size, "p_retailprice", level)
    model = training.train(df.drop("p_partkey"), "level", "lda")
    folder = shared_folder(spark, "model")
    store.save_model(model, folder, "part")
    store.write_scores(store.load_model(spark, folder), df.drop("level"), f"{folder}/scores")
    return spark.read.parquet(f"{folder}/scores").select("p_partkey", "prediction")


@query("score_embedding")
def score_embedding(spark, sf):
    df = embedding_columns(spark, sf)
    model = training.fit_unsupervised(df, "decomposition", "incremental_pca")
    return training.score(model, df).select("embedding")


@query(
    "run_log",
    _runs(
        "customer",
        [
            ("linear_regression", "completed", "true", "NULL"),
            ("lda", "failed", "false", f"'{_ONLY.format('lda', 'classification', 'regression')}'"),
        ],
    ),
)
def run_log(spark, sf):
    """One failing and one finished run, written, read back and described."""
    df = table(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    runs = training.compare(df, "c_acctbal", ["linear_regression", "lda"])
    folder = shared_folder(spark, "runs")
    store.log_runs(store.run_rows(spark, runs, "customer"), folder)
    return _run_columns(store.read_runs(spark, folder))
