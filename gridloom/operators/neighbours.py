"""Exact nearest neighbours and radius joins without comparing all pairs.

Points are first reduced to distinct positions with a count, so that copies cost
nothing. Space is cut in two levels: at most 4,096 cells of about equal size by
quantile splits along the widest axes, whose boxes travel with the tasks; and, in
larger tables, parts of every cell that is still crowded, cut along the part's own
widest axis until all hold a bounded number of points. The parts' boxes are a
table. A query looks into its own part, which bounds how far its neighbours can be,
and then only into parts whose bounding box is nearer than that bound: cells by
their boxes, their parts by a join on the cell. Parts are processed in blocks of
bounded size on both sides, so the number of points that a query is compared with
does not follow the number of points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.ordering import with_positions
from gridloom.operators.sums import batch_array, moments, vector_size
from gridloom.session import bounded_lookup, checkpoint

CELL_POINTS = 2_000
# Cells, and then parts, with more points than this are cut further.
CROWDED_POINTS = 8_000
FANOUT = 4
MAX_LEVELS = 6
BLOCK_ROWS = 8_000
# Points of a leaf, within which a task compares all pairs; from this number of axes
# on boxes prune little, and a block is one leaf.
LEAF_POINTS, WIDE = 48, 16
NEAR = "array<struct<distance:double,pid:bigint,w:bigint,payload:array<double>>>"


def distinct_points(df: DataFrame, *aggregates) -> DataFrame:
    """Distinct positions of ``x`` with an id ``pid``, a count ``w``, its running
    total ``upto`` and a ``payload`` array made of the given aggregates."""
    payload = F.array(*[F.lit(None).cast("double")]) if not aggregates else F.array(*aggregates)
    grouped = df.groupBy("x").agg(
        F.count(F.lit(1)).alias("w"), payload.alias("payload")
    )
    return with_positions(grouped, ["x"], weight="w").withColumnRenamed("position", "pid")


@dataclass
class Index:
    points: DataFrame
    axes: list[int]
    # Per level: cut points of every cell of that level.
    cuts: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray
    # Largest difference of an axis ("maximum"), straight distance ("euclidean"), or
    # straight with codes: (axes that are numbers, width of a differing code).
    metric: str | tuple[int, float] = "euclidean"
    # (cell, part, n, low, high) of all parts, and how crowded ones were cut.
    parts: DataFrame | None = None
    part_cuts: list[DataFrame] = field(default_factory=list)
    cached: DataFrame | None = None

    def __getstate__(self):
        # The geometry travels to the tasks, the tables do not.
        return self.__dict__ | {"points": None, "parts": None, "part_cuts": [], "cached": None}

    @property
    def cells(self) -> int:
        return len(self.sizes)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(x), int)
        for axis, cuts in zip(self.axes, self.cuts):
            cell = cell * FANOUT + (x[:, axis][:, None] > cuts[cell]).sum(1)
        return cell

    def box_distance(self, x: np.ndarray, cells=slice(None)) -> np.ndarray:
        """Distance of every row to every cell's bounding box."""
        low, high = self.low[cells], self.high[cells]
        total = np.zeros((len(x), len(low)))
        for j in range(x.shape[1]):
            value = x[:, j][:, None]
            gap = np.maximum(np.maximum(low[:, j] - value, value - high[:, j]), 0)
            if isinstance(self.metric, tuple) and j >= self.metric[0]:
                gap = np.where(gap > 0, self.metric[1], 0.0)
            total = np.maximum(total, gap) if self.metric == "maximum" else total + gap * gap
        return total if self.metric == "maximum" else np.sqrt(total)

    def near_cells(self, x: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """Cells with points whose box is within the bound (by row and cell) of each
        row. Rows are taken in groups that lie together, so that most cells are ruled
        out for a group at once."""
        out: list = [None] * len(x)
        for group in leaves_of(x, LEAF_POINTS if x.shape[1] < WIDE else len(x)):
            least, most = x[group].min(0), x[group].max(0)
            gaps = np.maximum(np.maximum(self.low - most, least - self.high), 0.0)
            away = _gap_length(gaps, self.metric) * (1 - 1e-9)
            cells = np.flatnonzero((away <= bound[group].max(0)) & (self.sizes > 0))
            close = self.box_distance(x[group], cells) <= bound[np.ix_(group, cells)]
            for i, row in zip(group, close):
                out[i] = cells[row]
        return out

    def place(self, queries: DataFrame) -> DataFrame:
        """``queries`` (x) with their ``cell`` and ``part``."""
        placed = _mapped(queries, self.cell_of, "cell", "bigint").withColumn("part", F.lit(1).cast("bigint"))
        for cuts in self.part_cuts:
            placed = _descended(placed, cuts)
        return placed


def _mapped(df: DataFrame, function, column: str, kind: str) -> DataFrame:
    @F.pandas_udf(kind)
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(function(np.stack(x.to_numpy()))) if len(x) else [])

    return df.withColumn(column, apply("x"))


def build_index(points: DataFrame, metric: str | tuple[int, float] = "euclidean") -> Index:
    """Cells over the points by repeated quantile cuts, a level per pass, and parts
    of the cells that are crowded."""
    points = points.persist()
    n, d = points.count(), vector_size(points)
    levels = 0
    while levels < MAX_LEVELS and n / FANOUT**levels > CELL_POINTS:
        levels += 1
    axes, cuts = [], []
    if levels:
        spread = np.diag(moments(points, d=d).covariance)
        widest = [int(j) for j in np.argsort(-spread)]
        axes = [widest[i % d] for i in range(levels)]
    index = Index(points, [], [], np.zeros((1, d)), np.zeros((1, d)), np.zeros(1), metric, cached=points)
    for level, axis in enumerate(axes):
        placed = _mapped(points, index.cell_of, "cell", "bigint")
        found = (
            placed.groupBy("cell")
            .agg(
                F.percentile_approx(
                    F.get("x", F.lit(axis)),
                    F.array(*[F.lit((j + 1) / FANOUT) for j in range(FANOUT - 1)]),
                    F.lit(1000),
                ).alias("q")
            )
            .collect()
        )
        table = np.full((FANOUT**level, FANOUT - 1), np.inf)
        for row in found:
            table[row.cell] = row.q
        cuts.append(table)
        index.axes, index.cuts = axes[: level + 1], cuts
    cells = FANOUT**levels
    index.low, index.high, index.sizes = _boxes(points, index, cells, d)
    index.points = index.place(points)
    if index.sizes.max(initial=0) > CROWDED_POINTS:
        _cut_crowded(index, d)
    else:
        rows = [(c, 1, int(n)) for c, n in enumerate(index.sizes) if n > 0]
        index.parts = points.sparkSession.createDataFrame(rows, "cell bigint, part bigint, n bigint")
    return index


def _boxes(points, index, cells, d):
    def partial(batches):
        low, high = np.full((cells, d), np.inf), np.full((cells, d), -np.inf)
        sizes = np.zeros(cells)
        for batch in batches:
            if batch.num_rows:
                x = batch_array(batch.column(0))
                cell = index.cell_of(x)
                np.minimum.at(low, cell, x)
                np.maximum.at(high, cell, x)
                sizes += np.bincount(cell, minlength=cells)
        seen = np.nonzero(sizes)[0]
        yield pa.RecordBatch.from_pydict(
            {
                "cell": np.repeat(seen, d),
                "axis": np.tile(np.arange(d), len(seen)),
                "low": low[seen].ravel(),
                "high": high[seen].ravel(),
                "rows": np.repeat(sizes[seen], d),
            }
        )

    rows = (
        points.select("x")
        .mapInArrow(partial, "cell long, axis long, low double, high double, rows double")
        .groupBy("cell", "axis")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
        .toPandas()
    )
    low, high, sizes = np.full((cells, d), np.inf), np.full((cells, d), -np.inf), np.zeros(cells)
    low[rows.cell, rows.axis], high[rows.cell, rows.axis] = rows.low, rows.high
    sizes[rows.cell] = rows.rows
    return low, high, sizes


def _part_boxes(points: DataFrame, d: int) -> DataFrame:
    low, high = (F.array(*[f(F.get("x", F.lit(i))) for i in range(d)]) for f in (F.min, F.max))
    return points.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"))


def _descended(placed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of a part that was cut move to its child: four times the part's number
    and how many cut points lie below their value."""
    names = [F.col(c) for c in placed.columns if c != "part"]
    cuts = bounded_lookup(cuts.select("cell", "part", "axis", "cuts"), cuts.count())
    value = F.get("x", F.col("axis"))
    below = F.size(F.filter("cuts", lambda c: c < value))
    child = F.when(F.col("axis").isNull(), F.col("part")).otherwise(F.col("part") * FANOUT + below)
    return placed.join(cuts, ["cell", "part"], "left").select(*names, child.alias("part"))


def _cut_crowded(index: Index, d: int) -> None:
    """Cut parts along their widest axis until none is crowded.

    Positions are distinct, so a crowded part has an axis with a spread, and a cut
    below its largest value leaves points on both sides.
    """
    while True:
        boxes = checkpoint(_part_boxes(index.points, d))
        wide = boxes.filter(F.col("n") > CROWDED_POINTS)
        spread = F.zip_with("high", "low", lambda a, b: a - b)
        axis = F.array_position(spread, F.array_max(spread)).cast("int") - 1
        wide = wide.select("cell", "part", axis.alias("axis"), F.get("low", axis).alias("least"), F.get("high", axis).alias("most"))
        wide = checkpoint(wide)
        rows = wide.count()
        if not rows:
            index.parts = boxes
            return
        values = index.points.join(bounded_lookup(wide, rows), ["cell", "part"])
        shares = F.array(*[F.lit((j + 1) / FANOUT) for j in range(FANOUT - 1)])
        found = values.groupBy("cell", "part", "axis", "least", "most").agg(
            F.percentile_approx(F.get("x", F.col("axis")), shares, F.lit(1000)).alias("q")
        )
        inner = F.array_distinct(F.filter("q", lambda v: v < F.col("most")))
        middle = F.array((F.col("least") + F.col("most")) / 2)
        cuts = found.select("cell", "part", "axis", F.when(F.size(inner) > 0, inner).otherwise(middle).alias("cuts"))
        index.part_cuts.append(checkpoint(cuts))
        index.points = checkpoint(_descended(index.points, index.part_cuts[-1]))


def _box_distance(metric):
    """Distance of a row's ``x`` to its box (``low``, ``high``)."""
    gaps = F.zip_with(
        F.zip_with("low", "x", lambda a, v: F.greatest(a - v, F.lit(0.0))),
        F.zip_with("x", "high", lambda v, b: F.greatest(v - b, F.lit(0.0))),
        lambda a, b: F.greatest(a, b),
    )
    if metric == "maximum":
        return F.array_max(gaps)
    if isinstance(metric, tuple):
        gaps = F.transform(gaps, lambda g, j: F.when((j >= metric[0]) & (g > 0), F.lit(float(metric[1]))).otherwise(g))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g))


def near_boxes(index: Index, queries: DataFrame, facts: list[str], bounds: Callable) -> DataFrame:
    """``queries`` (x and ``facts``) once for each part whose box is within their
    bound; ``bounds`` gives it from arrays of the facts, by query and cell."""

    @F.pandas_udf("array<struct<cell:bigint,bound:double>>")
    def cells(x: pd.Series, *values: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        rows = np.stack(x.to_numpy())
        bound = np.broadcast_to(bounds(*[v.to_numpy() for v in values]), (len(rows), index.cells))
        out = []
        for at, limit in zip(index.near_cells(rows, bound), bound):
            out.append([{"cell": int(c), "bound": float(b)} for c, b in zip(at, limit[at])])
        return pd.Series(out)

    near = queries.withColumn("_near", F.explode(cells("x", *facts)))
    near = near.select(*queries.columns, F.col("_near.cell").alias("cell"), F.col("_near.bound").alias("_bound"))
    if not index.part_cuts:
        return near.withColumn("part", F.lit(1).cast("bigint")).drop("_bound")
    boxes = bounded_lookup(index.parts.select("cell", "part", "low", "high"), index.parts.count())
    return near.join(boxes, "cell").filter(_box_distance(index.metric) <= F.col("_bound")).drop("low", "high", "_bound")


def release(index: Index) -> None:
    """Free what the index holds in memory."""
    if index.cached is not None:
        index.cached.unpersist()


def block_work(index: Index, queries: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Apply ``work(queries, points)`` to every block of queries placed in a part
    and every block of that part's points."""
    keys = ["cell", "part"]
    counts = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"))
    plan = index.parts.select(*keys, "n").join(counts, keys)
    plan = checkpoint(
        plan.select(
            *keys,
            F.ceil(F.col("n") / BLOCK_ROWS).alias("pblocks"),
            F.ceil(F.col("asked") / BLOCK_ROWS).alias("qblocks"),
        )
    )
    plan = bounded_lookup(plan, plan.count())
    # Queries may come from the points: the aliases tell the two sides apart.
    left = queries.join(plan, keys).select(
        *[F.col(c).alias(c) for c in keys],
        F.pmod(F.xxhash64("qid"), F.col("qblocks")).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pblocks") - 1)).alias("pb"),
        "qid",
        F.col("x").alias("qx"),
        *[c for c in queries.columns if c not in (*keys, "qid", "x")],
    )
    right = index.points.join(plan, keys).select(
        *keys,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qblocks") - 1)).alias("qb"),
        F.pmod(F.xxhash64("pid"), F.col("pblocks")).alias("pb"),
        "pid",
        "x",
        "w",
        "payload",
    )
    blocks = [*keys, "qb", "pb"]
    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(work, schema)


def distances(q: np.ndarray, p: np.ndarray, metric: str | tuple[int, float] = "euclidean"):
    """Row ranges of the queries with their exact distances to all points."""
    step = max(1, int(4_000_000 / max(1, p.size)))
    # An axis at a time is quicker for a few axes than sums along short rows.
    by_axis = p.shape[1] < 8
    for start in range(0, len(q), step):
        part = q[start : start + step]
        if by_axis:
            yield start, _by_axis(part, p, metric)
            continue
        gaps = part[:, None, :] - p[None, :, :]
        if isinstance(metric, tuple):
            gaps[:, :, metric[0] :] = np.where(gaps[:, :, metric[0] :] != 0, metric[1], 0.0)
        yield start, np.abs(gaps).max(2) if metric == "maximum" else np.sqrt((gaps**2).sum(2))


def _by_axis(q, p, metric):
    total = np.zeros((len(q), len(p)))
    for j in range(p.shape[1]):
        gaps = np.subtract.outer(q[:, j], p[:, j])
        if metric == "maximum":
            np.maximum(total, np.abs(gaps, out=gaps), out=total)
            continue
        if isinstance(metric, tuple) and j >= metric[0]:
            gaps = np.where(gaps != 0, metric[1], 0.0)
        total += np.multiply(gaps, gaps, out=gaps)
    return total if metric == "maximum" else np.sqrt(total, out=total)


def leaves_of(x: np.ndarray, size: int = LEAF_POINTS) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size``, halved along their widest axis;
    equal rows stay a group of any size."""
    out, waiting = [], [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        inside = x[rows]
        spread = inside.max(0) - inside.min(0)
        axis = int(spread.argmax())
        if not spread[axis] > 0:
            out.append(rows)
            continue
        order = np.argpartition(inside[:, axis], len(rows) // 2)
        waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def leaf_boxes(x: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.concatenate(leaves)
    starts = np.concatenate([[0], np.cumsum([len(rows) for rows in leaves])[:-1]])
    return np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts)


def _gap_length(gaps: np.ndarray, metric) -> np.ndarray:
    """Length of differences (last axis) that are not below zero."""
    if metric == "maximum":
        return gaps.max(-1)
    if isinstance(metric, tuple):
        gaps[..., metric[0] :] = np.where(gaps[..., metric[0] :] != 0, metric[1], 0.0)
    return np.sqrt((gaps**2).sum(-1))


def near_leaves(q: np.ndarray, p: np.ndarray, metric: str | tuple[int, float]):
    """Groups of queries (row numbers) with ``within(radius)``: the rows of ``p`` in
    all leaves whose box may be that near to the group's box, nearest leaf first.

    The boxes' distance has a margin for rounding, so no point within the radius is
    left out."""
    size = LEAF_POINTS if p.shape[1] < WIDE else max(len(p), len(q))
    leaves = leaves_of(p, size)
    low, high = leaf_boxes(p, leaves)
    sizes = np.array([len(rows) for rows in leaves])
    for group in leaves_of(q, size):
        least, most = q[group].min(0), q[group].max(0)
        away = _gap_length(np.maximum(np.maximum(low - most, least - high), 0.0), metric) * (1 - 1e-9)
        order = away.argsort(kind="stable")

        def within(radius, away=away[order], order=order):
            return np.concatenate([leaves[i] for i in order[: np.searchsorted(away, radius, side="right")]] or [np.zeros(0, int)])

        def enough(k, order=order):
            upto = np.searchsorted(np.cumsum(sizes[order]), k) + 1
            return np.concatenate([leaves[i] for i in order[:upto]])

        yield group, within, enough


def _nearest_in_block(k: int, metric):
    def work(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", "distance", "pid", "w", "payload"]
        if not len(queries) or not len(points):
            return pd.DataFrame({n: [] for n in names})
        q, p = np.stack(queries.qx.to_numpy()), np.stack(points.x.to_numpy())
        pid, w, payload = points.pid.to_numpy(), points.w.to_numpy(), points.payload.to_numpy()
        keep = min(k, len(p))
        gap, best = np.zeros((len(q), keep)), np.zeros((len(q), keep), int)
        if metric == "euclidean" and p.shape[1] >= WIDE:
            for start in range(0, len(q), 1000):
                here = slice(start, start + 1000)
                gap[here], best[here] = _best_wide(q[here], p, pid, keep)
            found = [gap, pid[best], w[best], payload[best]]
            return pd.DataFrame({"qid": queries.qid.to_numpy(), **{n: list(v) for n, v in zip(names[1:], found)}})
        for group, within, enough in near_leaves(q, p, metric):
            # The nearest leaves bound the k-th distance of every query of the group.
            start = enough(keep)
            limit = max(np.partition(gaps, keep - 1, axis=1)[:, keep - 1].max() for _, gaps in distances(q[group], p[start], metric))
            rows = within(limit)
            for first, gaps in distances(q[group], p[rows], metric):
                here = group[first : first + len(gaps)]
                gap[here], best[here] = _best(gaps, pid[rows], rows, keep)
        found = [gap, pid[best], w[best], payload[best]]
        return pd.DataFrame({"qid": queries.qid.to_numpy(), **{n: list(v) for n, v in zip(names[1:], found)}})

    return work


def _best_wide(q, p, pid, keep):
    """As ``_best`` for many axes: squared distances by a matrix product, less exact,
    leave those that may be among the nearest, which are then measured exactly."""
    sizes = (p**2).sum(1)
    about = (q**2).sum(1)[:, None] + sizes - 2 * q @ p.T
    limit = np.partition(about, keep - 1, axis=1)[:, keep - 1]
    margin = 8 * np.finfo(float).eps * (p.shape[1] + 8) * ((q**2).sum(1) + sizes.max())
    row, at = np.nonzero(about <= (limit + 2 * margin)[:, None])
    gaps = np.sqrt(((q[row] - p[at]) ** 2).sum(1))
    order = np.lexsort((pid[at], gaps, row))
    row, at, gaps = row[order], at[order], gaps[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])[:, None] + np.arange(keep)
    return gaps[first], at[first]


def _best(gaps, pid, rows, keep):
    """Distances and rows of the ``keep`` nearest, the smallest ids of equals."""
    # All points as near as the k-th, then in order.
    limit = np.partition(gaps, keep - 1, axis=1)[:, keep - 1]
    row, at = np.nonzero(gaps <= limit[:, None])
    order = np.lexsort((pid[at], gaps[row, at], row))
    row, at = row[order], at[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    best = at[first[:, None] + np.arange(keep)]
    return np.take_along_axis(gaps, best, 1), rows[best]


def _listed(found: DataFrame) -> DataFrame:
    """(qid, near) of (qid, distance, pid, w, payload), arrays of one length."""
    return found.select("qid", F.arrays_zip("distance", "pid", "w", "payload").cast(NEAR).alias("near"))


def nearest(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(qid, near): the ``k`` nearest distinct points of every query, in order.

    ``queries`` has ``qid`` and ``x``. Equal distances are ordered by ``pid``.
    """
    schema = "qid bigint, distance array<double>, pid array<bigint>, w array<bigint>, payload array<array<double>>"
    work = _nearest_in_block(k, index.metric)
    own = index.place(queries.select("qid", "x"))
    first = _merged(_listed(block_work(index, own, work, schema)), k).persist()
    if index.cells == 1 and not index.part_cuts:
        return first
    bound = F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).otherwise(
        F.lit(float("inf"))
    )
    # A query whose own part is empty has no list yet: it is left unbounded.
    limits = own.withColumnsRenamed({"cell": "own_cell", "part": "own_part"}).join(
        first.select("qid", bound.alias("bound")), "qid", "left"
    )
    limits = limits.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    further = near_boxes(index, limits, ["bound"], lambda bound: bound[:, None])
    elsewhere = (F.col("cell") != F.col("own_cell")) | (F.col("part") != F.col("own_part"))
    further = further.filter(elsewhere).select("qid", "x", "cell", "part")
    second = _listed(block_work(index, further, work, schema))
    return _merged(first.unionByName(second), k)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query out of its blocks."""
    order = Window.partitionBy("qid").orderBy("n.distance", "n.pid")
    return (
        parts.select("qid", F.explode("near").alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list("n")).alias("near"))
    )


def within(index: Index, queries: DataFrame, radius: float, work: Callable, schema: str):
    """Apply ``work`` to all blocks that can hold pairs within ``radius``."""
    limits = queries.select("qid", "x").withColumn("bound", F.lit(float(radius)))
    placed = near_boxes(index, limits, ["bound"], lambda bound: bound[:, None]).drop("bound")
    return block_work(index, placed, work, schema)
