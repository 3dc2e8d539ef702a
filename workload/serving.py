"""Registered queries of sources, checks, options and run facts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import metrics
from gridloom.operators.models import decomposition, registry
from gridloom.operators.prepare import fit_preparation, resolve_config, select_features
from gridloom.operators.target import infer_task
from gridloom.plans import training
from gridloom.sources import tables
from workload.common import metric_rows, numbers, query, rounded, shared_folder, table


def _csv(spark, sf, name: str) -> str:
    """A table written as CSV with header to the shared folder."""
    path = shared_folder(spark, name) + ".csv"
    table(spark, sf, name).write.option("header", True).option("escape", '"').csv(path)
    return path


@query(
    "csv_scan",
    """SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS price,
  count(DISTINCT o_orderpriority) AS priorities, 'bigint,bigint,string,double,string,string' AS kinds
  FROM orders GROUP BY 1""",
)
def csv_scan(spark, sf):
    """A whole table through CSV: the types are found again."""
    df = tables.load_csv(spark, _csv(spark, sf, "orders"), multi_line=False)
    kinds = ",".join(dict(df.dtypes)[c] for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
    found = df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_orderkey").alias("keys"),
        F.sum("o_totalprice").alias("price"),
        F.count_distinct("o_orderpriority").alias("priorities"),
    )
    return rounded(found, "price", digits=2).withColumn("kinds", F.lit(kinds))


@query("csv_header_check", "SELECT row_number() OVER () - 1 AS place, column_name AS name FROM (DESCRIBE customer)")
def csv_header_check(spark, sf):
    names = tables.check_csv(spark, _csv(spark, sf, "customer"))
    return spark.createDataFrame(list(enumerate(names)), "place bigint, name string")


@query("approximate_rows", "SELECT 'supplier' AS dataset, count(*) - 1 AS n FROM supplier")
def approximate_rows(spark, sf):
    """Lines of a file, less one for a header."""
    path = shared_folder(spark, "lines") + ".csv"
    table(spark, sf, "supplier").select(F.to_csv(F.struct("*"))).write.text(path)
    return spark.createDataFrame([("supplier", tables.approximate_rows(spark, path))], "dataset string, n bigint")


@query(
    "catalogue",
    """SELECT 'nation' AS dataset, string_agg(column_name, ',') AS columns, (SELECT count(*) FROM nation) AS n
  FROM (DESCRIBE nation)""",
)
def catalogue(spark, sf):
    """A table stored in the catalogue, found by its listing and read again."""
    name = f"dataset_{uuid.uuid4().hex}"
    tables.register_dataset(table(spark, sf, "nation"), name)
    listed = {r.dataset_id: r.columns for r in tables.list_datasets(spark).collect()}
    row = ("nation", ",".join(listed[name]), tables.get_dataset(spark, name).count())
    return spark.createDataFrame([row], "dataset string, columns string, n bigint")


@query("inline_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def inline_rows(spark, sf):
    """Rows as a caller would send them, with a key too many."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sent = [{**r.asDict(), "extra": 1} for r in rows.collect()]
    return tables.rows_to_table(spark, sent, rows.schema)


@query("score_json_rows", "SELECT p_size, count(*) AS n, round(avg(3.0 * p_size + 5), 4) AS predicted FROM part GROUP BY 1")
def score_json_rows(spark, sf):
    """A line scored on rows that come as JSON."""
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), (3.0 * F.col("p_size") + 5).alias("y"))
    model = training.train(df, "y", "linear_regression", {"feature_columns": ["p_size"]})
    path = shared_folder(spark, "rows")
    df.drop("y").write.json(path)
    scored = training.score(model, tables.load_json_rows(spark, path, model.schema))
    found = scored.groupBy(F.col("p_size").cast("int").alias("p_size"))
    return rounded(found.agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("predicted")), "predicted", digits=4)


def _names(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "place bigint, name string")


@query(
    "drop_target",
    "SELECT row_number() OVER () - 1 AS place, column_name AS name FROM (DESCRIBE lineitem) WHERE column_name <> 'l_tax'",
)
def drop_target(spark, sf):
    return _names(spark, select_features(table(spark, sf, "lineitem"), "l_tax"))


@query(
    "exclude_columns",
    """SELECT row_number() OVER () - 1 AS place, column_name AS name FROM (DESCRIBE orders)
  WHERE column_name NOT IN ('o_orderkey', 'o_orderdate', 'o_totalprice')""",
)
def exclude_columns(spark, sf):
    return _names(spark, select_features(table(spark, sf, "orders"), "o_totalprice", exclude=["o_orderkey", "o_orderdate"]))


@query(
    "drop_missing_target",
    """SELECT count(*) AS n, count(*) - ceil(count(*) * 0.2)::BIGINT AS train_rows, ceil(count(*) * 0.2)::BIGINT AS test_rows
  FROM lineitem WHERE l_discount <> 0""",
)
def drop_missing_target(spark, sf):
    """Rows without a numeric target take no part in a run."""
    price = F.expr("CASE WHEN l_discount <> 0 THEN l_extendedprice END").alias("price")
    prepared = training.prepare_supervised(table(spark, sf, "lineitem").select("l_quantity", "l_tax", price), "price")
    row = (prepared.rows, prepared.train.count(), prepared.test.count())
    prepared.release()
    return spark.createDataFrame([row], "n bigint, train_rows bigint, test_rows bigint")


@query(
    "scoring_column_check",
    """SELECT column_name AS missing, 'Missing columns: [''' || column_name || ''']' AS message FROM (DESCRIBE lineitem)""",
)
def scoring_column_check(spark, sf):
    df = table(spark, sf, "lineitem")
    rows = []
    for c in df.columns:
        try:
            tables.require_columns(df.drop(c), df.columns)
        except ValueError as error:
            rows.append((c, str(error)))
    return spark.createDataFrame(rows, "missing string, message string")


@query(
    "size_guards",
    """SELECT 'customer' AS dataset, 'Target has ' || count(DISTINCT c_name) || ' unique values—too many distinct classes for classification.'
    AS message FROM customer HAVING count(DISTINCT c_name) > 400
  UNION ALL SELECT 'region', 'Need at least 10 rows after cleaning.' FROM region HAVING count(*) < 10
  UNION ALL SELECT 'orders', 'test_size must be between 0.05 and 0.4.' FROM orders HAVING count(*) > 0""",
)
def size_guards(spark, sf):
    """Requests that are turned down, and why."""
    rows = []
    for name, target, share in (("customer", "c_name", 0.2), ("region", "r_name", 0.2), ("orders", "o_orderstatus", 0.5)):
        try:
            training.prepare_supervised(table(spark, sf, name), target, test_size=share).release()
        except ValueError as error:
            rows.append((name, str(error)))
    return spark.createDataFrame(rows, "dataset string, message string")


@query(
    "example_row",
    """SELECT 'r_regionkey' AS name, r_regionkey::VARCHAR AS value FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 1)
  UNION ALL SELECT 'r_name', r_name FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 1)""",
)
def example_row(spark, sf):
    ordered = table(spark, sf, "region").orderBy("r_regionkey")
    found = training.example_row(ordered, ["r_regionkey", "r_name"])
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "name string, value string")


@query(
    "fallback_example",
    """SELECT column_name AS name, CASE column_name WHEN 'p_partkey' THEN (SELECT max(p_partkey)::VARCHAR FROM part) ELSE
  CASE column_type WHEN 'VARCHAR' THEN 'example' WHEN 'BOOLEAN' THEN 'False' ELSE '0' END END AS value FROM (DESCRIBE part)""",
)
def fallback_example(spark, sf):
    """An example by type where a sample row names only one column."""
    df = table(spark, sf, "part")
    sample = {"p_partkey": df.agg(F.max("p_partkey")).first()[0]}
    found = training.fallback_example(df.schema, sample)
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "name string, value string")


@query(
    "resolved_options",
    """SELECT 'scaling' AS option, 'auto' AS value UNION ALL SELECT 'numeric_outliers', 'clip_iqr'
  UNION ALL SELECT 'imbalance', 'none' UNION ALL SELECT 'feature_columns', string_agg(column_name, ',') FROM (DESCRIBE supplier)
  UNION ALL SELECT 'bin ' || column_name, '5 quantile' FROM (DESCRIBE supplier) WHERE column_type <> 'VARCHAR'""",
)
def resolved_options(spark, sf):
    """Options for a table: wrong values become the defaults."""
    df = table(spark, sf, "supplier")
    whole = [f.name for f in df.schema if f.dataType.typeName() != "string"]
    bins = [{"column": c, "strategy": "golden"} for c in whole] + [{"n_bins": 3}, "text"]
    config = resolve_config(
        {"scaling": "loud", "numeric_outliers": "clip_iqr", "imbalance": 7, "feature_columns": df.columns, "numeric_bins": bins}
    ).to_dict()
    rows = [(k, config[k]) for k in ("scaling", "numeric_outliers", "imbalance")]
    rows.append(("feature_columns", ",".join(config["feature_columns"])))
    rows += [(f"bin {b['column']}", f"{b['n_bins']} {b['strategy']}") for b in config["numeric_bins"]]
    return spark.createDataFrame(rows, "option string, value string")


@query(
    "component_cap",
    """SELECT 'region' AS dataset, least(10, count(*) - 1) AS components FROM region
  UNION ALL SELECT 'nation', least(10, count(*) - 1) FROM nation""",
)
def component_cap(spark, sf):
    """Components of a projection: ten, or one less than the rows."""
    rows = []
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        wide = table(spark, sf, name).select(*[F.sin(F.col(key) * (i + 1)).alias(f"x{i}") for i in range(12)])
        t = numbers(wide, wide.columns)
        rows.append((name, decomposition.gaussian_projection(t).params["matrix"].shape[1]))
    return spark.createDataFrame(rows, "dataset string, components bigint")


@query(
    "anomaly_metrics",
    """SELECT metric, round(value, 6) AS value FROM (SELECT avg(p_retailprice) AS anomaly_score_mean,
    stddev_pop(p_retailprice) AS anomaly_score_std, count(*) FILTER (p_size > 45)::DOUBLE AS rows_flagged_outlier,
    count(*) FILTER (p_size > 45) / count(*) AS outlier_fraction_fit_data FROM part)
  UNPIVOT (value FOR metric IN (anomaly_score_mean, anomaly_score_std, rows_flagged_outlier, outlier_fraction_fit_data))""",
)
def anomaly_metrics(spark, sf):
    flag = F.when(F.col("p_size") > 45, -1).otherwise(1)
    scored = table(spark, sf, "part").select(F.col("p_retailprice").alias("score"), flag.alias("prediction"))
    return rounded(metric_rows(spark, metrics.anomaly_metrics(scored)), "value")


@query(
    "run_facts",
    """SELECT 'ridge' AS run, 'train_rows' AS fact, (count(*) - ceil(count(*) * 0.2))::BIGINT AS value FROM part
  UNION ALL SELECT 'kmeans', 'n_samples', count(*) FROM part
  UNION ALL SELECT 'kmeans', 'n_features_transformed', 2 FROM part HAVING count(*) > 0""",
)
def run_facts(spark, sf):
    """Facts that every run reports."""
    df = table(spark, sf, "part").select("p_size", "p_retailprice")
    ridge = training.train(df, "p_retailprice", "ridge").metadata["metrics"]
    kmeans = training.fit_unsupervised(df, "clustering", "kmeans").metadata["metrics"]
    rows = [("ridge", "train_rows", ridge["train_rows"])]
    rows += [("kmeans", k, kmeans[k]) for k in ("n_samples", "n_features_transformed")]
    return spark.createDataFrame(rows, "run string, fact string, value bigint")


_TASKS = "\nUNION ALL ".join(
    f"SELECT '{c}' AS target, CASE WHEN {number} AND count(DISTINCT {c}) > 20 THEN 'regression' ELSE 'classification' END AS task FROM lineitem"
    for c, number in (("l_quantity", True), ("l_discount", True), ("l_extendedprice", True), ("l_linenumber", True), ("l_returnflag", False))
)


@query(
    "algorithms_for_targets",
    f"""SELECT target, task, CASE task WHEN 'regression' THEN {len(registry.options_for("regression"))}
  ELSE {len(registry.options_for("classification"))} END::BIGINT AS algorithms FROM ({_TASKS})""",
)
def algorithms_for_targets(spark, sf):
    """The task of each target and how many listed algorithms serve it."""
    df = table(spark, sf, "lineitem")
    listed = registry.catalogue(spark).filter("mode = 'supervised'")
    counts = {r.kind: r["count"] for r in listed.groupBy("kind").count().collect()}
    rows = []
    for c in ("l_quantity", "l_discount", "l_extendedprice", "l_linenumber", "l_returnflag"):
        task = infer_task(df, c)
        rows.append((c, task, counts[task] + counts["both"]))
    return spark.createDataFrame(rows, "target string, task string, algorithms bigint")


@query(
    "refit_on_batch",
    """WITH b AS (SELECT o_totalprice * 3 AS v FROM orders WHERE o_orderstatus = 'F'),
  q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM b)
  SELECT count(*) AS n, round(min(greatest(least(v, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1))), 4) AS low,
  round(max(greatest(least(v, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1))), 4) AS high FROM b, q""",
)
def refit_on_batch(spark, sf):
    """Clipped at the fences of the rows that are transformed."""
    df = table(spark, sf, "orders").select("o_totalprice")
    fitted = fit_preparation(df, ["o_totalprice"], resolve_config({"numeric_outliers": "clip_iqr", "scaling": "none"}))
    batch = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select((F.col("o_totalprice") * 3).alias("o_totalprice"))
    x = F.get("x", F.lit(0))
    found = fitted.refitted_clips(batch).transform(batch)
    return rounded(found.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("low"), F.max(x).alias("high")), "low", "high", digits=4)
