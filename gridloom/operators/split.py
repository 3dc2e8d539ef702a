"""Repeatable train/test split of single rows with exact sizes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.columns import as_class, ref
from gridloom.operators.target import MAX_CLASSES, class_distribution
from gridloom.session import BROADCAST_ROWS, cache_small, checkpoint

# Hash values the last selection step may compare one by one.
SELECT_ROWS = 500_000
_HASH_BITS, _STEP_BITS = 63, 10
# Copies of one row that one task writes at most.
_CHUNK = 100_000


def quotas(counts: dict[str, int], test_size: float) -> dict[str, int]:
    """Test rows per class: the ceiling of the whole, by largest remainder."""
    total = sum(counts.values())
    wanted = math.ceil(total * test_size - 1e-9)
    exact = {k: wanted * c / total for k, c in counts.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    by_remainder = sorted(counts, key=lambda k: (out[k] - exact[k], k))
    for k in by_remainder[: wanted - sum(out.values())]:
        out[k] += 1
    return out


def train_test_split(
    df: DataFrame, label: str, test_size: float = 0.2, seed: int = 42, stratify: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows with the smallest hashes per class are the test set.

    Copies of a row are numbered; the hash covers the row's content, the copy's
    number and the seed. So every row is drawn by itself,
    copies spread over both sides, and the split does not depend on partitioning
    or row order. Per class only the hash at the quota is looked for; the split
    itself is then a filter.
    """
    if stratify:
        counts = {r["class"]: r.cnt for r in class_distribution(df, label).collect()}
        if len(counts) > MAX_CLASSES:
            raise ValueError(f"Cannot stratify by {len(counts)} classes.")
        stratify = min(counts.values(), default=0) >= 2
    if not stratify:
        counts = {"": df.count()}
    # Read by the search for the quota and by both sides.
    keyed = cache_small(
        numbered_copies(df, seed).withColumn("_k", as_class(label) if stratify else F.lit("")),
        sum(counts.values()),
    )
    limits = _thresholds(keyed, quotas(counts, test_size), sum(counts.values()))
    table = df.sparkSession.createDataFrame(list(limits.items()), "_k string, _limit bigint")
    # One row per class.
    marked = keyed.join(F.broadcast(table), "_k")
    sides = (F.col("_h") > F.col("_limit"), F.col("_h") <= F.col("_limit"))
    return tuple(marked.filter(side).select(*[ref(c) for c in df.columns]) for side in sides)


def numbered_copies(df: DataFrame, seed: int) -> DataFrame:
    """The rows of ``df`` with ``_h``, a hash of content and copy number.

    Hashes of the rows are counted first. A row whose hash is single has copy number
    zero and stays where it is; only rows of repeated hashes move, to be counted in
    full. If these are too many for a lookup, all rows are counted.
    """
    columns = [ref(c) for c in df.columns]
    key = F.xxhash64(F.lit("row"), *columns)
    repeated = df.select(key.alias("_r")).groupBy("_r").count().filter("count > 1").select("_r")
    repeated = checkpoint(repeated)
    rows = repeated.count()
    if rows > BROADCAST_ROWS:
        return _counted_copies(df, seed)
    content = F.xxhash64(F.lit(seed), *columns, F.lit(0).cast("long"))
    marked = F.shiftrightunsigned(content, 1).alias("_h")
    if not rows:
        return df.select(*columns, marked)
    lookup = F.broadcast(repeated)
    single = df.join(lookup, key == F.col("_r"), "left_anti").select(*columns, marked)
    return single.unionByName(_counted_copies(df.join(lookup, key == F.col("_r"), "left_semi"), seed))


def _counted_copies(df: DataFrame, seed: int) -> DataFrame:
    """Equal rows are counted before the shuffle; a row with very many copies is
    written out again in chunks of bounded size by several tasks."""
    columns = [ref(c) for c in df.columns]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _CHUNK)))
    chunks = counted.select(*columns, "_n", chunk.alias("_c"))
    if counted.filter(F.col("_n") > _CHUNK).limit(1).count():
        chunks = chunks.repartition(df.sparkSession.sparkContext.defaultParallelism)
    last = F.least(F.col("_n"), (F.col("_c") + 1) * _CHUNK) - 1
    copies = chunks.select(*columns, F.explode(F.sequence(F.col("_c") * _CHUNK, last)).alias("_copy"))
    content = F.xxhash64(F.lit(seed), *columns, "_copy")
    return copies.select(*columns, F.shiftrightunsigned(content, 1).alias("_h"))


def _thresholds(keyed: DataFrame, wanted: dict[str, int], total: int) -> dict[str, int]:
    """Per class the hash of the last test row.

    Each step counts rows per 10 bits of hash and keeps the slice holding the
    quota, until few enough rows are left to be ranked directly.
    """
    state = {k: (q, 0, _HASH_BITS) for k, q in wanted.items() if q > 0}
    rows = keyed.select("_k", "_h")
    while total > SELECT_ROWS and min(bits for _, _, bits in state.values()) > _STEP_BITS:
        slices = _in_slice(rows, state)
        shift = next(iter(state.values()))[2] - _STEP_BITS
        found = (
            slices.groupBy("_k", F.shiftright(F.col("_h") - F.col("_start"), shift).alias("s"))
            .agg(F.count(F.lit(1)).alias("c"))
            .withColumn("upto", F.sum("c").over(Window.partitionBy("_k").orderBy("s")))
            .collect()
        )
        total, state = _descend(found, state, shift)
    ranked = (
        _in_slice(rows, state)
        .groupBy("_k", "_h", "_quota")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("upto", F.sum("c").over(Window.partitionBy("_k").orderBy("_h")))
        .filter((F.col("upto") >= F.col("_quota")) & (F.col("upto") - F.col("c") < F.col("_quota")))
        .collect()
    )
    return {k: -1 for k in wanted} | {r["_k"]: r["_h"] for r in ranked}


def _in_slice(rows: DataFrame, state: dict) -> DataFrame:
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [
            (k, quota, start, start + 2**bits - 1)
            for k, (quota, start, bits) in state.items()
        ],
        "_k string, _quota bigint, _start bigint, _end bigint",
    )
    return rows.join(F.broadcast(table), "_k").filter(
        (F.col("_h") >= F.col("_start")) & (F.col("_h") <= F.col("_end"))
    )


def _descend(found, state, shift):
    total, after = 0, {}
    for r in found:
        quota, start, _ = state[r["_k"]]
        if r.upto - r.c < quota <= r.upto:
            after[r["_k"]] = (quota - (r.upto - r.c), start + (r.s << shift), shift)
            total += r.c
    return total, after
