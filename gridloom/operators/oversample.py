"""Oversampling of minority classes by interpolation between neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import as_class, categorical_columns, numeric_columns, ref
from gridloom.operators.neighbours import build_index, distinct_points, nearest
from gridloom.operators.ordering import with_positions
from gridloom.session import bounded_lookup, checkpoint

SEED = 42
# New rows of one position that one task writes at most.
CHUNK = 100_000


def oversample(train: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Raise every class to the size of the largest with synthetic rows.

    Numbers are drawn on the line to one of the k nearest rows of the class;
    text takes the most frequent value among these neighbours, and a mismatch
    in text adds the median deviation of the minority class to the distance.
    """
    table = train.select(as_class(label).alias("_y"), *[ref(c) for c in features])
    if table.filter(" or ".join(f"`{c}` is null" for c in features)).limit(1).count():
        raise ValueError("SMOTE: Input X contains NaN.")
    sizes = {r._y: r["count"] for r in table.groupBy("_y").count().collect()}
    smallest, largest = min(sizes.values()), max(sizes.values())
    if smallest < 2:
        raise ValueError(
            "SMOTE needs at least 2 training samples per class. "
            "Use imbalance none or collect more data."
        )
    k = min(5, max(1, smallest - 1))
    numbers = [c for c in features if c in numeric_columns(table)]
    text = [c for c in features if c in categorical_columns(table)]
    width = _mismatch_width(table, numbers, sizes) if text else 0.0
    out = train.select(ref(label), *[ref(c) for c in features])
    kind = train.schema[label].dataType
    for name, size in sorted(sizes.items()):
        if size < largest:
            rows = table.filter(F.col("_y") == name)
            made = _synthetic(rows, numbers, text, width, k, largest - size, size)
            out = out.unionByName(
                made.select(
                    F.lit(name).cast(kind).alias(label),
                    *[ref(c).cast(train.schema[c].dataType).alias(c) for c in features],
                )
            )
    return out


def _mismatch_width(table, numbers, sizes):
    """Median of the minority class's deviations; zero without numbers."""
    if not numbers:
        return 1.0
    minority = min(sizes, key=sizes.get)
    row = table.filter(F.col("_y") == minority).agg(
        *[F.stddev_pop(ref(c)) for c in numbers]
    ).first()
    return max(float(np.median([v or 0.0 for v in row])), 1e-9)


def _synthetic(rows, numbers, text, width, k, wanted, size):
    """``wanted`` new rows of one class.

    Positions are the numbers, then a code for each text column; a differing code
    adds the same whatever the codes are, so there may be any number of levels.
    """
    coded, tables = rows, []
    place = [ref(c).cast("double") for c in numbers]
    for i, c in enumerate(text):
        levels, step = _codes(rows, c, i, width)
        coded = coded.join(bounded_lookup(levels, levels.count()), ref(c).cast("string") == F.col(f"_level{i}"))
        place.append(F.col(f"_code{i}") * step)
        tables.append((levels, step))
    points = distinct_points(coded.select(F.array(*place).alias("x")))
    index = build_index(points, (len(numbers), width) if text else "euclidean")
    queries = index.points.select(F.col("pid").alias("qid"), "x")
    # One more than k: the list holds the row's own position as well.
    near = nearest(index, queries, k + 1)
    around = _neighbour_places(index, near, k)
    # New rows in proportion to the copies: the difference of a rounded running
    # total, which adds up to exactly ``wanted``.
    upto = lambda total: F.floor(total / F.lit(float(size)) * wanted)
    seeded = index.points.join(around, "pid").select(
        "pid", "x", "around", (upto(F.col("upto")) - upto(F.col("upto") - F.col("w"))).alias("made")
    )
    jobs = _spread(seeded.filter("made > 0"))
    pick = F.pmod(F.xxhash64(F.lit(SEED), "pid", "copy"), F.size("around")).cast("int")
    share = F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), "pid", "copy"), 11) / F.lit(float(1 << 53))
    drawn = jobs.select("x", "around", share.alias("share"), F.get("around", pick).alias("other"))
    columns = []
    for i, c in enumerate(numbers):
        own, far = F.get("x", F.lit(i)), F.get("other", F.lit(i))
        columns.append((own + F.col("share") * (far - own)).alias(c))
    for i, c in enumerate(text):
        columns.append(_most_frequent(len(numbers) + i).alias(f"_place{i}"))
    out = drawn.select(*columns)
    for i, (c, (levels, step)) in enumerate(zip(text, tables)):
        named = levels.select(F.col(f"_level{i}").alias(c), (F.col(f"_code{i}") * step).alias(f"_place{i}"))
        out = out.join(bounded_lookup(named, named.count()), f"_place{i}").drop(f"_place{i}")
    return out


def _codes(rows, column, i, width):
    """(level, code) of a text column, and the step between codes: their spread is
    that of a mismatch, so that cells are cut along the numbers first."""
    found = rows.select(ref(column).cast("string").alias(f"_level{i}")).distinct()
    levels = checkpoint(with_positions(found, [f"_level{i}"]).withColumnRenamed("position", f"_code{i}"))
    return levels, width / max(levels.count(), 1)


def _neighbour_places(index, near, k):
    """(pid, around): the places of up to ``k`` neighbours of every position, without
    its own unless it has copies or no neighbour."""
    flat = near.select(F.col("qid").alias("pid"), F.posexplode("near").alias("rank", "e"))
    others = index.points.select(F.col("pid").alias("npid"), F.col("x").alias("nx"), F.col("w").alias("nw"))
    # At most k + 1 entries each.
    entry = F.struct("rank", ((F.col("npid") != F.col("pid")) | (F.col("nw") > 1)).alias("usable"), F.col("nx").alias("x"))
    listed = flat.join(others, F.col("e.pid") == F.col("npid")).groupBy("pid").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    usable = F.slice(F.filter("all", lambda e: e["usable"]), 1, k)
    return listed.select("pid", F.transform(F.when(F.size(usable) > 0, usable).otherwise(F.col("all")), lambda e: e["x"]).alias("around"))


def _spread(seeded):
    """Every position once for each new row; a position with very many of them is
    first cut into chunks that go to several tasks."""
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("made") - 1) / CHUNK)))
    chunks = seeded.withColumn("chunk", chunk)
    if seeded.filter(F.col("made") > CHUNK).limit(1).count():
        chunks = chunks.repartition(seeded.sparkSession.sparkContext.defaultParallelism)
    last = F.least(F.col("made"), (F.col("chunk") + 1) * CHUNK) - 1
    return chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk", "made")


def _most_frequent(axis):
    """The code that most neighbours share; of equal numbers the smallest."""
    codes = F.transform("around", lambda x: F.get(x, F.lit(axis)))
    counted = F.transform(codes, lambda c: F.struct(F.size(F.filter(codes, lambda d: d == c)).alias("n"), (-c).alias("minus")))
    return -F.array_max(counted)["minus"]
