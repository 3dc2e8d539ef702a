"""Registered profile queries with their SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gridloom.operators import association, charts, describe, quality, target
from gridloom.operators.value_counts import level_counts, value_counts
from gridloom.plans.profile import profile
from workload.common import (
    GAPPY_COLUMNS,
    GAPPY_LINEITEM,
    GAPPY_NUMBERS,
    LINEITEM,
    LINEITEM_NUMBERS,
    embedding_columns,
    gappy_lineitem,
    per_column,
    query,
    rounded,
    table,
    union,
)


@query("table_size", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def table_size(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


@query(
    "sample_records",
    """SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
  'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment})::VARCHAR AS record
  FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 15)""",
)
def sample_records(spark, sf):
    return describe.sample_rows(table(spark, sf, "customer"), ["c_custkey"])


@query(
    "missing_values",
    f"WITH {GAPPY_LINEITEM} "
    + per_column(
        GAPPY_COLUMNS,
        "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
        "round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM t",
    ),
)
def missing_values(spark, sf):
    return rounded(describe.missing_counts(gappy_lineitem(spark, sf)), "missing_pct")


@query(
    "distinct_counts",
    per_column(
        LINEITEM, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM lineitem"
    ),
)
def distinct_counts(spark, sf):
    return describe.distinct_counts(value_counts(table(spark, sf, "lineitem")))


@query(
    "distinct_counts_approximate",
    per_column(LINEITEM, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_exact, true AS close FROM lineitem"),
)
def distinct_counts_approximate(spark, sf):
    """Sketched counts lie within three deviations (15 %) of the exact ones."""
    df = table(spark, sf, "lineitem")
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in LINEITEM]).unpivot([], LINEITEM, "column", "n_exact")
    sketched = describe.approximate_distinct_counts(df)
    close = F.abs(F.col("n_unique") - F.col("n_exact")) <= 0.15 * F.col("n_exact")
    return exact.join(sketched, "column").select("column", "n_exact", close.alias("close"))


@query(
    "value_counts",
    f"WITH {GAPPY_LINEITEM} "
    + per_column(
        ["l_linenumber", "l_returnflag", "l_linestatus"],
        "SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS cnt "
        "FROM t GROUP BY {c}",
    ),
)
def value_count_table(spark, sf):
    return value_counts(
        gappy_lineitem(spark, sf), ["l_linenumber", "l_returnflag", "l_linestatus"]
    )


_ORDERS_TYPES = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]


@query(
    "column_report",
    union(
        [
            f"SELECT {i} AS ordinal, '{c}' AS \"column\", '{kind}' AS dtype, "
            f"count(*) - count({c}) AS missing_count, "
            f"100.0 * (count(*) - count({c})) / count(*) AS missing_pct, "
            f"count(DISTINCT {c}) AS n_unique FROM orders"
            for i, (c, kind) in enumerate(_ORDERS_TYPES)
        ]
    ),
)
def column_report(spark, sf):
    df = table(spark, sf, "orders")
    return describe.column_report(df, value_counts(df))


@query(
    "numeric_summary",
    f"WITH {GAPPY_LINEITEM} "
    + per_column(
        GAPPY_NUMBERS,
        "SELECT '{c}' AS \"column\", round(min({c})::DOUBLE, 6) AS min, "
        "round(max({c})::DOUBLE, 6) AS max, round(avg({c}), 6) AS mean, "
        "round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(stddev_pop({c}), 6) AS std, "
        "round(100.0 * count(*) FILTER ({c} = 0) / count({c}), 6) AS zero_pct, "
        "count({c}) AS non_null_count, CAST(NULL AS VARCHAR) AS note FROM t",
    ),
)
def numeric_summary(spark, sf):
    return describe.numeric_summary_table(gappy_lineitem(spark, sf), GAPPY_NUMBERS)


_LABEL = (
    "CASE WHEN v IS NULL OR lower(v) = 'nan' THEN '(null)' "
    "WHEN length(v) > 80 THEN substr(v, 1, 77) || '…' ELSE v END"
)


@query(
    "top_values",
    f"""WITH {GAPPY_LINEITEM}, c AS ({per_column(
        ["l_returnflag", "l_linestatus"],
        "SELECT '{c}' AS col, {c} AS v, count(*) AS cnt FROM t GROUP BY {c}",
    )}), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, v NULLS FIRST) AS rn
    FROM c)
    SELECT col AS "column", rn::INT AS rank, {_LABEL} AS value, cnt FROM r WHERE rn <= 5""",
)
def top_values(spark, sf):
    df = gappy_lineitem(spark, sf)
    columns = ["l_returnflag", "l_linestatus"]
    return describe.categorical_summary(value_counts(df, columns), columns)


@query(
    "top_texts",
    f"""WITH c AS (SELECT text AS v, count(*) AS cnt FROM documents GROUP BY text),
    r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, v) AS rn FROM c)
    SELECT 'text' AS "column", rn::INT AS rank, {_LABEL} AS value, cnt FROM r WHERE rn <= 5""",
)
def top_texts(spark, sf):
    df = table(spark, sf, "documents").select("text")
    return describe.categorical_summary(value_counts(df), ["text"])


@query(
    "correlation_matrix",
    union(
        [
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r, "
            f"count(*) AS n FROM lineitem"
            for i, a in enumerate(LINEITEM_NUMBERS)
            for b in LINEITEM_NUMBERS[i + 1 :]
        ]
    ),
)
def correlation_matrix(spark, sf):
    return rounded(association.correlation_table(table(spark, sf, "lineitem")), "r")


@query(
    "correlation_with_gaps",
    f"WITH {GAPPY_LINEITEM} "
    + union(
        [
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r, "
            f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM t"
            for a, b in (
                ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"),
            )
        ]
    ),
)
def correlation_with_gaps(spark, sf):
    df = gappy_lineitem(spark, sf)
    return rounded(
        association.correlation_table(df, ["l_quantity", "l_discount", "l_tax"]), "r"
    )


@query(
    "strongest_pairs",
    """WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
  p AS (SELECT printf('e%02d', a.i) AS column_a, printf('e%02d', b.i) AS column_b,
    corr(a.v, b.v) AS r, count(*) AS n FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i)
  SELECT column_a, column_b, round(r, 6) AS r, n FROM p ORDER BY abs(r) DESC, column_a, column_b LIMIT 60""",
)
def strongest_pairs(spark, sf):
    pairs = association.correlation_table(embedding_columns(spark, sf))
    return rounded(association.strongest_pairs(pairs), "r")


_OUTLIERS = """SELECT '{c}' AS "column", round(100.0 * count(*) FILTER (
  {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}), 6) AS iqr_outlier_pct,
  CAST(NULL AS VARCHAR) AS note FROM events, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1,
  quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM events)"""


@query("outlier_shares", per_column(["event_id", "user_id", "value"], _OUTLIERS))
def outlier_shares(spark, sf):
    return rounded(describe.outlier_table(table(spark, sf, "events")), "iqr_outlier_pct")


@query(
    "column_alerts",
    """WITH t AS (SELECT value, CASE WHEN event_type = 'click' THEN event_type END AS clicked
  FROM events), m AS (SELECT 'clicked' AS col, 100.0 * (count(*) - count(clicked)) / count(*) AS p
  FROM t UNION ALL SELECT 'value', 0.0), o AS (SELECT 100.0 * count(*) FILTER (
  value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(value) AS p
  FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM events))
  SELECT col AS "column", 'many_missing' AS alert, round(p, 6) AS percent FROM m WHERE p >= 25
  UNION ALL SELECT 'value', 'many_outliers', round(p, 6) FROM o WHERE p > 5""",
)
def column_alerts(spark, sf):
    df = table(spark, sf, "events").select(
        "value", F.expr("CASE WHEN event_type = 'click' THEN event_type END").alias("clicked")
    )
    alerts = describe.column_alerts(describe.missing_counts(df), describe.outlier_table(df))
    return rounded(alerts, "percent")


@query(
    "target_summary",
    f"""WITH {GAPPY_LINEITEM} SELECT 'l_discount' AS target_column,
  'classification' AS inferred_task, '{target.EXPLANATIONS["classification"]}' AS
  target_task_explanation, count(DISTINCT l_discount) AS target_n_unique,
  count(*) - count(l_discount) AS target_missing_count,
  round(100.0 * (count(*) - count(l_discount)) / count(*), 6) AS target_missing_pct FROM t""",
)
def target_summary(spark, sf):
    summary = target.target_summary(gappy_lineitem(spark, sf), "l_discount")
    return rounded(summary, "target_missing_pct")


@query(
    "class_distribution",
    f"""WITH {GAPPY_LINEITEM} SELECT coalesce(l_returnflag, 'nan') AS class, count(*) AS cnt
  FROM t GROUP BY 1""",
)
def class_distribution(spark, sf):
    return target.class_distribution(gappy_lineitem(spark, sf), "l_returnflag")


@query(
    "class_balance",
    """WITH c AS (SELECT lang, count(*) AS cnt FROM documents GROUP BY lang)
  SELECT round(max(cnt) / min(cnt), 6) AS imbalance_ratio_max_to_min,
  round(100.0 * min(cnt) / sum(cnt), 6) AS minority_class_pct,
  (100.0 * min(cnt) / sum(cnt) < 5 OR max(cnt) / min(cnt) > 10) AS imbalance_warning FROM c""",
)
def class_balance(spark, sf):
    balance = target.class_balance(
        target.class_distribution(table(spark, sf, "documents"), "lang")
    )
    return rounded(balance, "imbalance_ratio_max_to_min", "minority_class_pct")


@query(
    "inferred_tasks",
    per_column(
        LINEITEM_NUMBERS,
        "SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) > 20 THEN 'regression' "
        "ELSE 'classification' END AS inferred_task FROM lineitem",
    )
    + "\nUNION ALL "
    + per_column(
        LINEITEM[8:], "SELECT '{c}', 'classification'"
    ),
)
def inferred_tasks(spark, sf):
    df = table(spark, sf, "lineitem")
    return target.inferred_tasks(df, level_counts(value_counts(df)))


_NARROW = "l_linenumber, l_discount, l_returnflag, l_linestatus"


@query(
    "duplicate_rows",
    f"""WITH {GAPPY_LINEITEM}, g AS (SELECT count(*) AS c FROM t GROUP BY {_NARROW})
  SELECT (sum(c) - count(*))::BIGINT AS duplicate_row_count,
  round(100.0 * (sum(c) - count(*)) / sum(c), 6) AS duplicate_row_pct FROM g""",
)
def duplicate_rows(spark, sf):
    narrow = gappy_lineitem(spark, sf).select(*_NARROW.split(", "))
    return rounded(quality.duplicate_rows(narrow), "duplicate_row_pct")


@query(
    "constant_columns",
    """SELECT 'channel' AS "column", 'web' AS value_sample FROM events HAVING count(*) > 0
  UNION ALL SELECT 'status', max(o) FROM (SELECT 'ok' AS o FROM events)""",
)
def constant_columns(spark, sf):
    df = table(spark, sf, "events").select(
        "user_id",
        F.lit("web").alias("channel"),
        F.expr("CASE WHEN value >= 0 OR value < 0 THEN 'ok' END").alias("status"),
        F.lit(None).cast("string").alias("empty"),
    )
    return describe.constant_columns(value_counts(df))


_PART_TEXT = ["p_name", "p_brand", "p_type"]


@query(
    "high_cardinality",
    "SELECT * FROM ("
    + per_column(
        _PART_TEXT,
        "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, "
        "round(count(DISTINCT {c}) / count(*), 6) AS unique_to_rows_ratio, "
        "'many_levels' AS note FROM part HAVING count(DISTINCT {c}) >= 80 "
        "OR (count(DISTINCT {c}) >= 50 AND count(*) >= 80) OR (count(*) >= 40 AND "
        "count(DISTINCT {c}) / count(*) >= 0.12 AND count(DISTINCT {c}) >= 25)",
    )
    + ")",
)
def high_cardinality(spark, sf):
    df = table(spark, sf, "part")
    return rounded(
        describe.high_cardinality_columns(df, value_counts(df)), "unique_to_rows_ratio"
    )


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]


@query(
    "id_like",
    "SELECT * FROM ("
    + per_column(
        _CUSTOMER,
        "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count({c}) AS "
        "non_null_count, round(count(DISTINCT {c}) / count({c}), 6) AS unique_ratio FROM customer "
        "HAVING count({c}) >= 10 AND count(DISTINCT {c}) / count({c}) >= 0.97",
    )
    + ")",
)
def id_like(spark, sf):
    df = table(spark, sf, "customer")
    found = describe.id_like_columns(df, value_counts(df), target="c_mktsegment")
    return rounded(found, "unique_ratio")


@query(
    "leakage_hints",
    f"""WITH t AS (SELECT c_nationkey AS nation_id, c_custkey AS row_id, n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
  f AS (SELECT nation_id, count(DISTINCT n_name) AS p FROM t GROUP BY 1),
  g AS (SELECT n_name, count(DISTINCT nation_id) AS p FROM t GROUP BY 1)
  SELECT 'nation_id' AS "column", 'suffix_id' AS name_pattern, '{quality.LEAK_NOTE}' AS note
  WHERE (SELECT max(p) FROM f) = 1 AND (SELECT max(p) FROM g) = 1
  AND (SELECT count(*) FROM f) >= 3 AND (SELECT count(*) FROM t) >= 30""",
)
def leakage_hints(spark, sf):
    nation = table(spark, sf, "nation")
    df = (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_nationkey").alias("nation_id"), F.col("c_custkey").alias("row_id"), "n_name"
        )
    )
    return quality.leakage_hints(df, "n_name", "classification")


_AGAINST_PRICE = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query(
    "target_correlation",
    f"WITH {GAPPY_LINEITEM} "
    + per_column(
        _AGAINST_PRICE,
        "SELECT '{c}' AS \"column\", count({c}) AS n, round(corr({c}, l_extendedprice), 6) AS "
        "pearson_r FROM t",
    ),
)
def target_correlation(spark, sf):
    found = association.target_correlations(
        gappy_lineitem(spark, sf), "l_extendedprice", _AGAINST_PRICE
    )
    rows = [(c, n, r) for c, (n, r) in found.items()]
    return rounded(
        spark.createDataFrame(rows, "column string, n bigint, pearson_r double"), "pearson_r"
    )


def _plug_in(column: str, x: str, y: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", round(greatest(sum(p * ln(p / (px * py))), 0), 6)
  AS mutual_info FROM (SELECT c / sum(c) OVER () AS p, sum(c) OVER (PARTITION BY x) /
  sum(c) OVER () AS px, sum(c) OVER (PARTITION BY y) / sum(c) OVER () AS py
  FROM (SELECT {x} AS x, {y} AS y, count(*) AS c FROM {source} GROUP BY 1, 2))"""


@query(
    "information_discrete",
    f"WITH {GAPPY_LINEITEM} "
    + union(
        [
            _plug_in("l_returnflag", "coalesce(l_returnflag, 'nan')", "l_discount::VARCHAR",
                     "(SELECT l_returnflag, coalesce(l_discount::VARCHAR, 'nan') AS l_discount FROM t)"),
            _plug_in("l_linestatus", "l_linestatus", "l_discount::VARCHAR",
                     "(SELECT l_linestatus, coalesce(l_discount::VARCHAR, 'nan') AS l_discount FROM t)"),
        ]
    ),
)
def information_discrete(spark, sf):
    found = association.information_discrete(
        gappy_lineitem(spark, sf), "l_discount", ["l_returnflag", "l_linestatus"]
    )
    return rounded(found, "mutual_info")


def _psi(m: str) -> str:
    """Digamma of a positive integer, shifted up to where the series is exact."""
    shifted = f"({m} + 12.0)"
    steps = " - ".join(f"1.0 / ({m} + {i})" for i in range(12))
    inverse = f"(1.0 / ({shifted} * {shifted}))"
    return (
        f"(ln({shifted}) - 0.5 / {shifted} - {inverse} * (1.0 / 12 - {inverse} * (1.0 / 120 - "
        f"{inverse} / 252)) - {steps})"
    )


_NEAREST = f"""WITH t AS (SELECT row_number() OVER () AS id, {{c}}::DOUBLE AS x,
  c_mktsegment AS y FROM customer),
  n AS (SELECT y, count(*) AS c FROM t GROUP BY y),
  s AS (SELECT t.* FROM t JOIN n USING (y) WHERE c > 1),
  d AS (SELECT a.id, abs(a.x - b.x) AS gap, row_number() OVER (PARTITION BY a.id
    ORDER BY abs(a.x - b.x)) AS rn FROM s a JOIN s b ON a.y = b.y AND a.id <> b.id),
  k AS (SELECT s.id, s.x, s.y, least(3, n.c - 1) AS k, n.c AS class_rows FROM s JOIN n USING (y)),
  r AS (SELECT k.*, d.gap AS radius FROM k JOIN d ON d.id = k.id AND d.rn = k.k),
  m AS (SELECT r.id, count(*) AS m FROM r JOIN s ON (r.radius > 0 AND abs(r.x - s.x) < r.radius)
    OR r.x = s.x GROUP BY r.id)
  SELECT '{{c}}' AS "column", round(greatest({_psi('count(*)')} + avg({_psi('k')})
  - avg({_psi('class_rows')}) - avg({_psi('m')}), 0), 6) AS mutual_info
  FROM r JOIN m USING (id)"""


@query(
    "information_nearest",
    union([f"SELECT * FROM ({_NEAREST.replace('{c}', c)})" for c in ("c_nationkey", "c_acctbal")]),
)
def information_nearest(spark, sf):
    found = association.information_nearest(
        table(spark, sf, "customer"), "c_mktsegment", ["c_nationkey", "c_acctbal"]
    )
    return rounded(found, "mutual_info")


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
# All pairs of rows: each row's third nearest in the larger difference, then the
# rows within that radius on either side.
_KRASKOV = f"""(WITH c AS (SELECT {{x}}::DOUBLE AS x, o_totalprice AS y FROM orders),
  v AS (SELECT row_number() OVER () AS id, x / (SELECT stddev_pop(x) FROM c) AS x,
    y / (SELECT stddev_pop(y) FROM c) AS y FROM c),
  r AS (SELECT a.id, any_value(a.x) AS x, any_value(a.y) AS y,
    min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] * (1 - 1e-9) AS r
    FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id),
  m AS (SELECT r.id, count(*) FILTER (abs(r.x - v.x) <= r) AS m_x,
    count(*) FILTER (abs(r.y - v.y) <= r) AS m_y FROM r, v GROUP BY r.id)
  SELECT '{{c}}' AS "column", round(greatest({_psi('count(*)')} + {_psi('3')}
  - avg({_psi('m_x')}) - avg({_psi('m_y')}), 0), 6) AS mutual_info FROM m)"""
_CODED = "(dense_rank() OVER (ORDER BY {c}::VARCHAR) - 1)"
_CONTINUOUS = union(
    [
        "SELECT * FROM " + _KRASKOV.replace("{x}", c if c.endswith("key") else _CODED.replace("{c}", c)).replace("{c}", c)
        for c in _ORDERS
    ]
)


@query("information_continuous", _CONTINUOUS)
def information_continuous(spark, sf):
    return rounded(association.information_continuous(table(spark, sf, "orders"), "o_totalprice", _ORDERS), "mutual_info")


@query("information_binned")
def information_binned(spark, sf):
    df = table(spark, sf, "orders").drop("o_orderdate")
    features = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return association.information_binned(df, "o_totalprice", features, df.count())


@query(
    "association_ranking",
    "SELECT \"column\", mutual_info, row_number() OVER (ORDER BY mutual_info DESC, \"column\")"
    "::INT AS place FROM ("
    + union(
        [
            _plug_in(c, f"{c}::VARCHAR", "o_orderstatus", "orders")
            for c in ("o_orderpriority", "o_orderdate")
        ]
    )
    + ")",
)
def association_ranking(spark, sf):
    df = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_orderdate")
    ordered = association.feature_target_association(df, "o_orderstatus", "classification")
    rows = [(r.column, r.mutual_info, i + 1) for i, r in enumerate(ordered.collect())]
    return rounded(
        spark.createDataFrame(rows, "column string, mutual_info double, place int"), "mutual_info"
    )


@query(
    "feature_target_association",
    f"""SELECT i."column", CASE i."column" WHEN 'o_orderkey' THEN round(corr(o_orderkey, o_totalprice), 6)
    WHEN 'o_custkey' THEN round(corr(o_custkey, o_totalprice), 6) END AS pearson_r, mutual_info, NULL AS note
  FROM ({_CONTINUOUS}) i, orders GROUP BY i."column", mutual_info""",
)
def feature_target_association(spark, sf):
    found = association.feature_target_association(table(spark, sf, "orders"), "o_totalprice", "regression")
    return rounded(found, "pearson_r", "mutual_info")


def _bins(column: str, source: str) -> str:
    """Bin counts as the histogram rule gives them, empty bins included."""
    return f"""(WITH v AS (SELECT {column}::DOUBLE AS v FROM {source}),
  s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1,
    quantile_cont(v, 0.75) AS q3 FROM v),
  w AS (SELECT *, least(greatest(2 * (q3 - q1) * pow(n, -1.0 / 3), (hi - lo) / sqrt(n) / 2),
    (hi - lo) / (log2(n) + 1)) AS width FROM s),
  b AS (SELECT *, CASE WHEN ceil((hi - lo) / width) + 1 > 42 THEN 40
    ELSE ceil((hi - lo) / width) END::INT AS bins FROM w),
  e AS (SELECT i::INT AS bin, lo + i * ((hi - lo) / bins) AS x_lo,
    CASE WHEN i + 1 = bins THEN hi ELSE lo + (i + 1) * ((hi - lo) / bins) END AS x_hi,
    i + 1 = bins AS last FROM b, range(bins) AS r(i))
  SELECT '{column}' AS "column", bin, round(x_lo, 6) AS x_lo, round(x_hi, 6) AS x_hi,
  (SELECT count(*) FROM v WHERE v >= x_lo AND (v < x_hi OR (last AND v <= x_hi))) AS cnt FROM e)"""


@query(
    "histogram",
    f"SELECT * FROM {_bins('l_extendedprice', 'lineitem')} UNION ALL "
    f"SELECT * FROM {_bins('l_quantity', 'lineitem')}",
)
def histogram(spark, sf):
    found = charts.histogram(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(found, "x_lo", "x_hi")


@query(
    "density_curve",
    """WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS sd,
    quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
  h AS (SELECT *, CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END * pow(n, -0.2) AS bw,
    least(96, greatest(48, n))::INT AS points FROM s),
  g AS (SELECT i::INT AS point, lo + i * ((hi - lo) / (points - 1)) AS x, bw, n
    FROM h, range(points) AS r(i))
  SELECT 'value' AS "column", point, round(x, 6) AS x,
  round(sum(exp(-0.5 * pow((x - value) / bw, 2))) / max(n * bw * sqrt(2 * pi())), 6) AS density
  FROM g, events GROUP BY point, x""",
)
def density_curve(spark, sf):
    found = charts.density_table(table(spark, sf, "events"), ["value"])
    return rounded(found, "x", "density")


@query(
    "category_bars",
    """WITH c AS (SELECT p_name AS v, count(*) AS cnt FROM part GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, v) AS rn FROM c)
  SELECT 'p_name' AS "column", rn::INT AS rank, CASE WHEN length(v) > 40 THEN
  substr(v, 1, 39) || '…' ELSE v END AS label, cnt FROM r WHERE rn <= 16
  UNION ALL SELECT 'p_name', 17, 'Other', sum(cnt)::BIGINT FROM r WHERE rn > 16
  HAVING sum(cnt) > 0""",
)
def category_bars(spark, sf):
    df = table(spark, sf, "part")
    return charts.bars(value_counts(df, ["p_name"]))


@query("chart_set")
def chart_set(spark, sf):
    df = embedding_columns(spark, sf)
    chosen = charts.choose_charts(df)
    rows = [
        (c, json.dumps(doc))
        for c, doc in charts.chart_documents(df, chosen.numeric, chosen.categorical).items()
    ]
    return spark.createDataFrame(rows, "column string, chart string").withColumn(
        "truncated", F.lit(chosen.truncated)
    )


@query("profile_document")
def profile_document(spark, sf):
    document = profile(
        table(spark, sf, "orders"),
        target="o_orderstatus",
        order=["o_orderkey"],
    )
    rows = [(k, json.dumps(v)) for k, v in document.items()]
    return spark.createDataFrame(rows, "section string, content string")
