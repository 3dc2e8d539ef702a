"""Registered preparation, split and metric queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.columns import as_number
from gridloom.functions.hints import error_hint, metric_line
from gridloom.operators import metrics
from gridloom.operators.oversample import oversample
from gridloom.operators.prepare import fit_preparation, resolve_config
from gridloom.operators.split import train_test_split
from gridloom.sources.tables import require_columns
from workload.common import query, rounded, table


def _gappy_customer(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END").alias("c_acctbal"),
        "c_nationkey",
        F.expr("nullif(c_mktsegment, 'HOUSEHOLD')").alias("c_mktsegment"),
    )


GAPPY_CUSTOMER = """t AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL
  ELSE c_acctbal END AS c_acctbal, c_nationkey, nullif(c_mktsegment, 'HOUSEHOLD') AS c_mktsegment
  FROM customer)"""
# Filled numbers: the clipped value, or the median.
_FILLED = """q AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2,
  quantile_cont(c_acctbal, 0.75) AS q3 FROM t),
  f AS (SELECT c_custkey, c_nationkey, c_mktsegment, coalesce(c_acctbal, q2) AS a FROM t, q)"""


def _prepared(spark, sf, features, names, **options):
    """The prepared array of the gappy customers as named columns."""
    df = _gappy_customer(spark, sf)
    config = resolve_config(options)
    preparation = fit_preparation(df, features, config)
    out = preparation.transform(df, keep=["c_custkey"])
    return out.select(
        "c_custkey", *[F.round(F.get("x", F.lit(i)), 6).alias(n) for i, n in enumerate(names)]
    )


@query(
    "coerce_to_number",
    """SELECT count(*) AS n_rows, count(try_cast(p_brand AS DOUBLE)) AS brand_numbers,
  count(try_cast(substr(p_brand, 7) AS DOUBLE)) AS suffix_numbers,
  sum(try_cast(substr(p_brand, 7) AS DOUBLE)) AS suffix_sum FROM part""",
)
def coerce_to_number(spark, sf):
    df = table(spark, sf, "part").withColumn("suffix", F.expr("substring(p_brand, 7)"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(as_number("p_brand")).alias("brand_numbers"),
        F.count(as_number("suffix")).alias("suffix_numbers"),
        F.sum(as_number("suffix")).alias("suffix_sum"),
    )


@query(
    "impute_median",
    f"WITH {GAPPY_CUSTOMER}, {_FILLED} SELECT c_custkey, round(a, 6) AS c_acctbal FROM f",
)
def impute_median(spark, sf):
    return _prepared(spark, sf, ["c_acctbal"], ["c_acctbal"], scaling="none")


@query(
    "clip_and_impute",
    f"""WITH {GAPPY_CUSTOMER}, {_FILLED} SELECT c_custkey, round(CASE WHEN c_acctbal IS NULL THEN q2 ELSE
  greatest(least(c_acctbal, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) END, 6) AS c_acctbal FROM
  (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal
   FROM customer), q""",
)
def clip_and_impute(spark, sf):
    return _prepared(
        spark, sf, ["c_acctbal"], ["c_acctbal"], scaling="none", numeric_outliers="clip_iqr"
    )


@query(
    "clip_events",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events) SELECT event_id, round(greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1),
  value)), 6) AS value FROM events, q""",
)
def clip_events(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    config = resolve_config({"scaling": "none", "numeric_outliers": "clip_iqr"})
    out = fit_preparation(df, ["value"], config).transform(df, keep=["event_id"])
    return out.select("event_id", F.round(F.get("x", F.lit(0)), 6).alias("value"))


_SCALED = {
    "standard": "(a - (SELECT avg(a) FROM f)) / (SELECT stddev_pop(a) FROM f)",
    "minmax": "(a - (SELECT min(a) FROM f)) / (SELECT max(a) - min(a) FROM f)",
    "robust": "(a - (SELECT quantile_cont(a, 0.5) FROM f)) / "
    "(SELECT quantile_cont(a, 0.75) - quantile_cont(a, 0.25) FROM f)",
}


def _scale_query(mode):
    sql = f"WITH {GAPPY_CUSTOMER}, {_FILLED} SELECT c_custkey, round({_SCALED[mode]}, 6) AS scaled FROM f"

    @query(f"scale_{mode}", sql)
    def run(spark, sf):
        return _prepared(spark, sf, ["c_acctbal"], ["scaled"], scaling=mode)


for _mode in _SCALED:
    _scale_query(_mode)


@query(
    "encode_ordinal",
    f"""WITH {GAPPY_CUSTOMER}, m AS (SELECT c_mktsegment AS v, count(*) AS c FROM t
  WHERE c_mktsegment IS NOT NULL GROUP BY 1), top AS (SELECT v FROM m ORDER BY c DESC, v LIMIT 1),
  codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM m)
  SELECT c_custkey, code::DOUBLE AS code FROM t, top JOIN codes
  ON codes.v = coalesce(t.c_mktsegment, top.v)""",
)
def encode_ordinal(spark, sf):
    return _prepared(spark, sf, ["c_mktsegment"], ["code"])


@query(
    "encode_large_vocabulary",
    """SELECT c_custkey, (row_number() OVER (ORDER BY c_name) - 1)::DOUBLE AS code FROM customer""",
)
def encode_large_vocabulary(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    out = fit_preparation(df, ["c_name"], resolve_config({})).transform(df, keep=["c_custkey"])
    return out.select("c_custkey", F.get("x", F.lit(0)).alias("code"))


@query(
    "encode_unseen_levels",
    """WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM
  (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderstatus = 'F'
   AND o_orderpriority <> '1-URGENT'))
  SELECT o_orderkey, coalesce(code, -1)::DOUBLE AS code FROM orders
  LEFT JOIN c ON v = o_orderpriority""",
)
def encode_unseen_levels(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    seen = df.filter("o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'")
    out = fit_preparation(seen, ["o_orderpriority"], resolve_config({})).transform(
        df, keep=["o_orderkey"]
    )
    return out.select("o_orderkey", F.get("x", F.lit(0)).alias("code"))


def _cut_points(strategy, bins):
    if strategy == "quantile":
        return [f"(SELECT quantile_cont(a, {j / bins!r}) FROM f)" for j in range(1, bins)]
    return [
        f"(SELECT min(a) + (max(a) - min(a)) * {j / bins!r} FROM f)" for j in range(1, bins)
    ]


def _bin_query(strategy, bins):
    code = " + ".join(f"(a >= {cut})::INT" for cut in _cut_points(strategy, bins))
    sql = f"WITH {GAPPY_CUSTOMER}, {_FILLED} SELECT c_custkey, ({code})::DOUBLE AS bin FROM f"

    @query(f"bin_{strategy}", sql)
    def run(spark, sf):
        specs = [{"column": "c_acctbal", "n_bins": bins, "strategy": strategy}]
        return _prepared(spark, sf, ["c_acctbal"], ["bin"], numeric_bins=specs)


_bin_query("quantile", 5)
_bin_query("uniform", 8)


@query(
    "prepared_columns",
    f"""WITH {GAPPY_CUSTOMER}, {_FILLED}, m AS (SELECT c_mktsegment AS v, count(*) AS c FROM t
  WHERE c_mktsegment IS NOT NULL GROUP BY 1), top AS (SELECT v FROM m ORDER BY c DESC, v LIMIT 1),
  codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM m)
  SELECT c_custkey, ({" + ".join(f"(a >= {c})::INT" for c in _cut_points("quantile", 4))})::DOUBLE
  AS binned, round((c_nationkey - (SELECT avg(c_nationkey) FROM f)) /
  (SELECT stddev_pop(c_nationkey) FROM f), 6) AS plain, code::DOUBLE AS text
  FROM f, top JOIN codes ON codes.v = coalesce(f.c_mktsegment, top.v)""",
)
def prepared_columns(spark, sf):
    return _prepared(
        spark,
        sf,
        ["c_mktsegment", "c_nationkey", "c_acctbal"],
        ["binned", "plain", "text"],
        scaling="standard",
        numeric_bins=[{"column": "c_acctbal", "n_bins": 4}],
    )


_QUOTA = """WITH c AS (SELECT {label} AS class, count(*) AS n FROM {source} GROUP BY 1),
  w AS (SELECT ceil(sum(n) * 0.2 - 1e-9) AS wanted, sum(n) AS total FROM c),
  e AS (SELECT class, n, wanted, wanted * n / total AS share,
    floor(wanted * n / total) AS base FROM c, w),
  r AS (SELECT *, row_number() OVER (ORDER BY base - share, class) AS rn,
    wanted - sum(base) OVER () AS spare FROM e)
  SELECT class, (base + CASE WHEN rn <= spare THEN 1 ELSE 0 END)::BIGINT AS test_rows,
  (n - base - CASE WHEN rn <= spare THEN 1 ELSE 0 END)::BIGINT AS train_rows FROM r"""


def _sides(train, test, label):
    count = lambda df, name: df.groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias(name)
    )
    return count(test, "test_rows").join(count(train, "train_rows"), "class", "full")


@query("split_stratified", _QUOTA.format(label="o_orderpriority", source="orders"))
def split_stratified(spark, sf):
    df = table(spark, sf, "orders")
    train, test = train_test_split(df, "o_orderpriority")
    return _sides(train, test, "o_orderpriority")


@query(
    "split_with_copies",
    _QUOTA.format(label="l_returnflag", source="lineitem"),
)
def split_with_copies(spark, sf):
    """Few distinct rows, so that copies must be divided at the threshold."""
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    train, test = train_test_split(df, "l_returnflag")
    return _sides(train, test, "l_returnflag")


@query(
    "split_spreads_copies",
    """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, true AS spread
  FROM lineitem GROUP BY 1, 2, 3""",
)
def split_spreads_copies(spark, sf):
    """The test share of every repeated row lies within five deviations of 0.2."""
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    train, test = train_test_split(df, "l_returnflag")
    both = train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))
    n = F.count(F.lit(1))
    return both.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        n.alias("n"), (F.abs(F.avg("test") - 0.2) <= 5 * F.sqrt(0.16 / n)).alias("spread")
    )


@query(
    "oversample_classes",
    """WITH c AS (SELECT CASE WHEN s_nationkey < 5 THEN 'few' ELSE 'many' END AS class,
  count(*) AS n FROM supplier GROUP BY 1) SELECT class, max(n) OVER () AS cnt FROM c""",
)
def oversample_classes(spark, sf):
    df = table(spark, sf, "supplier").select(
        "s_acctbal",
        F.col("s_suppkey").alias("key"),
        F.expr("CASE WHEN s_nationkey < 5 THEN 'few' ELSE 'many' END").alias("class"),
    )
    made = oversample(df, "class", ["s_acctbal", "key"])
    return made.groupBy("class").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "oversample_with_text",
    """WITH c AS (SELECT CASE WHEN c_nationkey < 3 THEN 'few' ELSE 'many' END AS class,
  count(*) AS n FROM customer GROUP BY 1) SELECT class, max(n) OVER () AS cnt,
  0::BIGINT AS unknown_segments FROM c""",
)
def oversample_with_text(spark, sf):
    segments = "'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'"
    df = table(spark, sf, "customer").select(
        "c_acctbal",
        "c_mktsegment",
        F.expr("CASE WHEN c_nationkey < 3 THEN 'few' ELSE 'many' END").alias("class"),
    )
    made = oversample(df, "class", ["c_acctbal", "c_mktsegment"])
    return made.groupBy("class").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count(F.expr(f"CASE WHEN c_mktsegment NOT IN ({segments}) THEN 1 END")).alias(
            "unknown_segments"
        ),
    )


_RULE = (
    "CASE WHEN o_totalprice > 200000 THEN 'O' WHEN o_totalprice > 100000 THEN 'F' ELSE 'P' END"
)


@query(
    "confusion",
    f"""SELECT o_orderstatus AS label, {_RULE} AS prediction, count(*) AS cnt FROM orders
  GROUP BY 1, 2""",
)
def confusion(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("label"), F.expr(_RULE).alias("prediction")
    )
    return metrics.confusion(df)


@query(
    "classification_metrics",
    f"""WITH p AS (SELECT o_orderstatus AS y, {_RULE} AS z FROM orders),
  l AS (SELECT y AS name FROM p UNION SELECT z FROM p),
  f AS (SELECT name, 2.0 * (SELECT count(*) FROM p WHERE y = name AND z = name) /
    ((SELECT count(*) FROM p WHERE y = name) + (SELECT count(*) FROM p WHERE z = name)) AS f1 FROM l)
  SELECT round((SELECT avg((y = z)::INT) FROM p), 6) AS accuracy, round(avg(f1), 6) AS f1_macro,
  (SELECT count(*) FROM p) AS test_rows FROM f""",
)
def classification_metrics(spark, sf):
    found = metrics.classification_metrics(confusion(spark, sf))
    return rounded(found, "accuracy", "f1_macro")


@query(
    "regression_metrics",
    """WITH p AS (SELECT l_extendedprice AS y, 2100.0 * l_quantity AS z FROM lineitem)
  SELECT round(1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*)), 6) AS r2,
  round(avg(abs(y - z)), 4) AS mae, round(sqrt(avg((y - z) * (y - z))), 4) AS rmse,
  count(*) AS test_rows FROM p""",
)
def regression_metrics(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 2100.0).alias("prediction"),
    )
    return rounded(rounded(metrics.regression_metrics(df), "r2"), "mae", "rmse", digits=4)


@query(
    "clustering_metrics",
    """WITH t AS (SELECT c_acctbal / 1000.0 AS a, c_nationkey::DOUBLE AS b,
    (c_nationkey // 7)::INT AS k FROM customer),
  c AS (SELECT k, count(*) AS n, avg(a) AS ca, avg(b) AS cb, sum(a * a + b * b) AS ss FROM t
    GROUP BY k),
  o AS (SELECT avg(a) AS oa, avg(b) AS ob, count(*) AS n FROM t),
  x AS (SELECT sum(c.n * (pow(ca - oa, 2) + pow(cb - ob, 2))) AS between_, max(o.n) AS n,
    count(*) AS k FROM c, o),
  y AS (SELECT sum(pow(a - ca, 2) + pow(b - cb, 2)) AS within_ FROM t JOIN c USING (k)),
  s AS (SELECT k, avg(sqrt(pow(a - ca, 2) + pow(b - cb, 2))) AS s FROM t JOIN c USING (k)
    GROUP BY k),
  r AS (SELECT p.k, max((s1.s + s2.s) / sqrt(pow(p.ca - q.ca, 2) + pow(p.cb - q.cb, 2))) AS m
    FROM c p JOIN c q ON p.k <> q.k JOIN s s1 ON s1.k = p.k JOIN s s2 ON s2.k = q.k GROUP BY p.k),
  d AS (SELECT t.a, t.b, t.k AS own, c.k, c.n, (t.a * t.a + t.b * t.b) - 2 * (t.a * ca + t.b * cb)
    + ss / c.n AS m FROM t, c),
  e AS (SELECT a, b, own, max(CASE WHEN own = k THEN m * n / (n - 1) END) AS i,
    min(CASE WHEN own <> k THEN m END) AS o, count(*) / (SELECT count(*) FROM c) AS w
    FROM d GROUP BY a, b, own)
  SELECT 'n_label_values' AS metric, round(count(*)::DOUBLE, 5) AS value FROM c
  UNION ALL SELECT 'calinski_harabasz', round(between_ * (n - k) / (within_ * (k - 1)), 5) FROM x, y
  UNION ALL SELECT 'davies_bouldin', round(avg(m), 5) FROM r
  UNION ALL SELECT 'silhouette', round(sum(w * (o - i) / greatest(o, i)) / sum(w), 5) FROM e""",
)
def clustering_metrics(spark, sf):
    df = table(spark, sf, "customer").select(
        F.array(F.col("c_acctbal") / 1000.0, F.col("c_nationkey").cast("double")).alias("x"),
        F.expr("c_nationkey div 7").alias("prediction"),
    )
    found = metrics.clustering_metrics(df)
    rows = [(k, float(v)) for k, v in found.items()]
    table_ = spark.createDataFrame(rows, "metric string, value double")
    return rounded(table_, "value", digits=5)


_MESSAGES = [
    ("F", "CSV has no data rows."),
    ("O", "Missing columns: ['a']"),
    ("P", "Target column 'y' not in dataset."),
]


@query(
    "error_hints",
    """SELECT o_orderstatus, CASE o_orderstatus
  WHEN 'F' THEN 'Add at least one row of data under the header.'
  WHEN 'O' THEN 'Use the exact feature names from training (copy the list or example JSON). Include every listed column; spelling and case must match.'
  WHEN 'P' THEN 'Pick a target that appears exactly in your CSV header (watch spaces and spelling).'
  END AS hint, count(*) AS cnt FROM orders GROUP BY 1""",
)
def error_hints(spark, sf):
    message = F.lit(None).cast("string")
    for status, text in _MESSAGES:
        message = F.when(F.col("o_orderstatus") == status, text).otherwise(message)
    return (
        table(spark, sf, "orders")
        .select("o_orderstatus", error_hint(message).alias("hint"))
        .groupBy("o_orderstatus", "hint")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


@query(
    "metric_lines",
    """SELECT o_orderpriority, 'acc ' || printf('%.1f', 100.0 * avg((o_orderstatus = 'O')::INT))
  || '% · F1 0.500' AS metric_line FROM orders GROUP BY 1""",
)
def metric_lines(spark, sf):
    hits = F.avg((F.col("o_orderstatus") == "O").cast("int"))
    measured = F.create_map(F.lit("accuracy"), hits, F.lit("f1_macro"), F.lit(0.5))
    return (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority")
        .agg(measured.alias("metrics"))
        .select(
            "o_orderpriority",
            metric_line(F.lit("classification"), F.col("metrics")).alias("metric_line"),
        )
    )


@query(
    "feature_selection",
    "SELECT l_tax, l_quantity, count(*) AS cnt FROM lineitem GROUP BY 1, 2",
)
def feature_selection(spark, sf):
    chosen = require_columns(table(spark, sf, "lineitem"), ["l_tax", "l_quantity"])
    return chosen.groupBy("l_tax", "l_quantity").agg(F.count(F.lit(1)).alias("cnt"))
