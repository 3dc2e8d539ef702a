"""Session-level helpers: reliable checkpoints and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, and bytes of text, that a lookup table may hold before a join on it is
# left to shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
# Tables up to this size are spread over the cores before heavy work.
SPREAD_ROWS = 5_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``, as in tests) may leave it
    unset; a temporary folder is then named once. A cluster without it is an
    error, since a folder of the driver does not exist on its executors.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster")
        named = context.getCheckpointDir()
        if named is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
            named = context.getCheckpointDir()
    return named


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    Spark would keep the planner's guess of its size. A join's guess is the product
    of both sides', so in a loop each round squares it: its digits, on the driver, double
    with every round. After an explode, or over packed files, the guess is too low, and
    a large table would be broadcast. The written table has no guess; adaptive execution
    measures it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    jvm, kept = context._jvm, df.checkpoint(eager=True)._jdf
    plan, none = kept.queryExecution().analyzed(), jvm.scala.Option.empty()
    session = kept.sparkSession()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), spark)


def bounded_lookup(table: DataFrame, rows: int) -> DataFrame:
    """``table`` marked for broadcast when its row count and the measured size of
    its text columns are small.

    A larger table is returned unmarked: the join then shuffles, and adaptive
    execution splits skewed keys.
    """
    if rows > BROADCAST_ROWS:
        return table
    texts = [F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0)) for c, kind in table.dtypes if kind == "string"]
    size = sum(table.agg(*texts).first()) if texts else 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def spread_small(df: DataFrame, rows: int) -> DataFrame:
    """Spread a small table over all cores before CPU-heavy work.

    A small table often arrives as one file split and would occupy one core. A
    table beyond the row bound has splits enough and is left as it is.
    """
    if rows > SPREAD_ROWS:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def cache_small(df: DataFrame, rows: int) -> DataFrame:
    """Spread and cache a small table that several passes will read.

    A large table is left as it is: reading the needed columns again costs less
    than holding a copy.
    """
    return spread_small(df, rows).persist() if rows <= SPREAD_ROWS else df


def local_session(cores: int | str = "*", name: str = "gridloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    parallel = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.debug.maxToStringFields", "200")
        .getOrCreate()
    )
