"""Exact order statistics and global positions without a single-task sort."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.columns import as_number
from gridloom.operators.sums import MAX_STATISTIC, batch_array, sum_over_rows
from gridloom.session import checkpoint

# Up to this many rows the one-pass exact percentile aggregate is used. It keeps
# every distinct value in one task, so larger inputs take the bracket search.
ONE_PASS_ROWS = 200_000
# Values of one bracket that may be gathered to read an order statistic from.
BRACKET_VALUES = 50_000
# Equal-width bins of the first look at a column.
COARSE_BINS = 512


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    rows: int | None = None,
    one_pass_rows: int = ONE_PASS_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the non-missing values, per column.

    ``rows`` is the table's row count when the caller has it already.
    """
    if not columns:
        return {}
    table = df.select(*[as_number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    if (df.count() if rows is None else rows) <= one_pass_rows:
        row = table.agg(
            *[
                F.percentile(f"c{i}", F.array(*[F.lit(p) for p in probabilities])).alias(f"q{i}")
                for i in range(len(columns))
            ]
        ).first()
        return {
            c: list(row[i]) if row[i] is not None else [None] * len(probabilities)
            for i, c in enumerate(columns)
        }
    return _bracketed_quantiles(table, columns, probabilities)


@dataclass
class _Search:
    """One wanted order statistic: the ``rank``-th value of open (low, high)."""

    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    size: int = 0
    answer: float | None = None

    def inside(self) -> Column:
        value = F.col(self.column)
        condition = value.isNotNull()
        if self.low is not None:
            condition &= value > self.low
        if self.high is not None:
            condition &= value < self.high
        return condition


def _bracketed_quantiles(table, columns, probabilities):
    """Order statistics by narrowing a bracket around each wanted rank.

    Every round is one scan with a small aggregate and no shuffle of rows. The
    first round counts all columns in equal-width bins; usually the few values
    of the right bin are then read directly. A bin that is still large goes on
    with sketches: two cut points inside it, and exact counts at the cut points
    tell on which side the rank lies. A value shared by many rows becomes a cut
    point and is then settled by its count alone.
    """
    facts = table.agg(
        *[f(f"c{i}") for f in (F.count, F.min, F.max) for i in range(len(columns))]
    ).first()
    k = len(columns)
    counts, ranges = facts[:k], list(zip(facts[k : 2 * k], facts[2 * k :]))
    searches: dict[tuple[int, int], _Search] = {}
    for i in range(len(columns)):
        for p in probabilities if counts[i] else []:
            position = p * (counts[i] - 1)
            for rank in {math.floor(position), math.ceil(position)}:
                searches[(i, rank)] = _Search(f"c{i}", rank, size=counts[i])
    _coarse(table, searches, ranges)
    _settle_single(table, [s for s in searches.values() if s.answer is None])
    open_ones = [s for s in searches.values() if s.answer is None]
    while open_ones:
        small = [s for s in open_ones if s.size <= BRACKET_VALUES]
        large = [s for s in open_ones if s.size > BRACKET_VALUES]
        for start in range(0, len(small), 30):
            group = small[start : start + 30]
            for s, value in zip(group, _gathered(table, group)):
                s.answer = value
        for start in range(0, len(large), 20):
            _narrow(table, large[start : start + 20])
        open_ones = [s for s in large if s.answer is None]
    out = {}
    for i, column in enumerate(columns):
        values = []
        for p in probabilities:
            if not counts[i]:
                values.append(None)
                continue
            position = p * (counts[i] - 1)
            low = searches[(i, math.floor(position))].answer
            high = searches[(i, math.ceil(position))].answer
            values.append(low + (high - low) * (position - math.floor(position)))
        out[column] = values
    return out


def _coarse(table, searches, ranges):
    """Move every search into its equal-width bin, all columns in one pass."""
    edges = {}
    for i, (low, high) in enumerate(ranges):
        if low is not None and math.isfinite(low) and math.isfinite(high - low) and low < high:
            edges[i] = np.linspace(low, high, COARSE_BINS + 1)
    for (i, _), s in searches.items():
        if ranges[i][0] == ranges[i][1]:
            s.answer = ranges[i][0]
    step = max(1, MAX_STATISTIC // COARSE_BINS)
    for start in range(0, len(edges), step):
        group = dict(list(edges.items())[start : start + step])

        def statistic(*columns, group=group):
            counts = []
            for values, bounds in zip(columns, group.values()):
                values = np.asarray(values, float)
                place = np.searchsorted(bounds, values[~np.isnan(values)], side="right") - 1
                counts.append(np.bincount(place.clip(0, COARSE_BINS - 1), minlength=COARSE_BINS))
            return np.concatenate(counts).astype(float)

        names = [f"c{i}" for i in group]
        found = sum_over_rows(table, names, statistic, COARSE_BINS * len(group))
        for (i, bounds), counts in zip(group.items(), found.reshape(len(group), -1)):
            upto = np.cumsum(counts).astype(int)
            for (column, _), s in searches.items():
                if column == i:
                    b = int(np.searchsorted(upto, s.rank, side="right"))
                    last = b == COARSE_BINS - 1
                    # The open interval that holds exactly the bin's values.
                    s.low = float(np.nextafter(bounds[b], -np.inf))
                    s.high = float(np.nextafter(bounds[b + 1], np.inf) if last else bounds[b + 1])
                    s.size, s.rank = int(counts[b]), s.rank - int(upto[b] - counts[b])


def _settle_single(table, searches):
    """Settle brackets that hold one repeated value, whatever its count."""
    for start in range(0, len(searches), 30):
        group = searches[start : start + 30]
        ends = [f(F.when(s.inside(), F.col(s.column))) for s in group for f in (F.min, F.max)]
        row = table.agg(*ends).first()
        for i, s in enumerate(group):
            if row[2 * i] is not None and row[2 * i] == row[2 * i + 1]:
                s.answer = row[2 * i]


def _gathered(table, group) -> list[float | None]:
    """The wanted value of every search, from the values of its bracket alone. Tasks
    compare whole columns with the brackets: as one condition of many brackets they
    are beyond what the JVM compiles."""
    names = sorted({s.column for s in group})
    brackets = [(names.index(s.column), s.low, s.high) for s in group]

    def inside(batches):
        for batch in batches:
            columns = [np.asarray(batch_array(c), float) for c in batch.columns]
            for search, (i, low, high) in enumerate(brackets):
                values = columns[i][~np.isnan(columns[i])]
                if low is not None:
                    values = values[values > low]
                if high is not None:
                    values = values[values < high]
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), search)), pa.array(values)], names=["search", "value"])

    values = table.select(*names).mapInArrow(inside, "search long, value double")
    ordered = values.groupBy("search").agg(F.sort_array(F.collect_list("value")).alias("v"))
    ranks = F.array(*[F.lit(s.rank) for s in group])
    rows = ordered.select("search", F.get("v", F.get(ranks, F.col("search").cast("int"))).alias("value")).collect()
    found = {r.search: r.value for r in rows}
    return [found.get(i) for i in range(len(group))]


def _narrow(table, group):
    slack = 0.002
    cuts = table.agg(
        *[
            F.percentile_approx(
                F.when(s.inside(), F.col(s.column)),
                F.array(
                    F.lit(max(0.0, s.rank / s.size - slack)),
                    F.lit(min(1.0, s.rank / s.size + slack)),
                ),
                F.lit(2000),
            )
            for s in group
        ]
    ).first()
    wanted = []
    for s, (a, b) in zip(group, cuts):
        value = F.col(s.column)
        for condition in (value < a, value == a, (value > a) & (value < b), value == b):
            wanted.append(F.count(F.when(s.inside() & condition, 1)))
    found = table.agg(*wanted).first()
    for i, (s, (a, b)) in enumerate(zip(group, cuts)):
        below, at_a, between, at_b = found[4 * i : 4 * i + 4]
        if s.rank < below:
            s.high, s.size = a, below
        elif s.rank < below + at_a:
            s.answer = a
        elif s.rank < below + at_a + between:
            s.low, s.high, s.size = a, b, between
            s.rank -= below + at_a
        elif a != b and s.rank < below + at_a + between + at_b:
            s.answer = b
        else:
            gone = below + at_a + between + (at_b if a != b else 0)
            s.low, s.rank, s.size = b, s.rank - gone, s.size - gone


def with_positions(
    df: DataFrame, order: list[str], weight: str | None = None
) -> DataFrame:
    """``df`` sorted by ``order`` with its global ``position`` (from 0) and, for
    a weight, the running total ``upto`` (inclusive).

    The sort is a range partitioning, so no task holds more than its range;
    only one total per partition is combined globally. Rows should be
    pre-aggregated, so that a frequent value is one row.
    """
    placed = checkpoint(
        df.orderBy(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
    )
    amount = F.col(weight) if weight else F.lit(1)
    totals = placed.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_sum")
    )
    # One row per partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
    )
    within = Window.partitionBy("_part").orderBy("_id")
    out = placed.join(F.broadcast(offsets), "_part").withColumn(
        "position",
        F.col("_rows_before") + F.col("_id") - F.shiftleft(F.col("_part"), 33),
    )
    if weight:
        out = out.withColumn("upto", F.col("_sum_before") + F.sum(weight).over(within))
    return out.drop("_id", "_part", "_rows_before", "_sum_before")
