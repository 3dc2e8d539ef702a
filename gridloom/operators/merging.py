"""Agglomeration of weighted points by mutual nearest partners.

Every round, each cluster finds the partner whose union costs least in squared
deviations (Ward), and all pairs that are each other's nearest merge at once. No
merger of two others can bring a cluster nearer to a third than the nearer of the
two was, so the mergers and their costs are those of the one-at-a-time method, in
another order. A round leaves about two thirds of the clusters; the partner search
is the neighbour index with a bound that takes weights into account, and the last
few clusters - a bounded number - are merged on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import neighbours
from gridloom.operators.components import connected_components
from gridloom.operators.neighbours import Index, block_work, build_index, distances, near_boxes
from gridloom.session import checkpoint

# Clusters that are merged on the driver.
SMALL = 2_000
FOUND = "qid bigint, cost double, tie bigint, pid bigint"


def _tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of an unordered pair: equal costs are ordered by it, so that equal
    distances all over a table still give many mutual pairs."""
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(2)).astype(np.int64)


def cheapest(x, w, ids, y, v, others):
    """(cost, tie, partner) of the cheapest union of every row with another id; the
    cost is infinite where there is none."""
    cost, tie, partner = np.full(len(x), np.inf), np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64)
    for start, gaps in distances(x, y):
        part = slice(start, start + len(gaps))
        own = w[part][:, None]
        union = gaps**2 * (own * v[None] / (own + v[None]))
        union[ids[part][:, None] == others[None]] = np.inf
        low = union.min(1)
        row, at = np.nonzero(union == low[:, None])
        ties = _tie(ids[part][row], others[at])
        order = np.lexsort((ties, row))
        row, at, ties = row[order], at[order], ties[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        cost[part], tie[part], partner[part] = low, ties[first], others[at[first]]
    return cost, tie, partner


def _search(index: Index) -> DataFrame:
    """(qid, cost, tie, pid): the cheapest partner of every point of the index."""

    def work(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"qid": [], "cost": [], "tie": [], "pid": []})
        ids, others = q.qid.to_numpy(), p.pid.to_numpy()
        found = cheapest(
            np.stack(q.qx.to_numpy()), q.qw.to_numpy(float), ids, np.stack(p.x.to_numpy()), p.w.to_numpy(float), others,
        )
        return pd.DataFrame({"qid": ids, "cost": found[0], "tie": found[1], "pid": found[2]})

    queries = index.points.select(F.col("pid").alias("qid"), "x", F.col("w").alias("qw"), "cell", "part")
    first = block_work(index, queries, work, FOUND)
    first = checkpoint(_best(first))
    if index.cells == 1 and not index.part_cuts:
        return first
    least = np.ones(index.cells)
    for row in index.points.groupBy("cell").agg(F.min("w").alias("least")).collect():
        least[row.cell] = row.least

    def bounds(cost: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How far a cheaper partner can be, by query and cell."""
        w = w[:, None]
        return np.sqrt(cost[:, None] * (w + least) / (w * least)) * (1 + 1e-9)

    known = queries.withColumnsRenamed({"cell": "own_cell", "part": "own_part"}).join(first.select("qid", "cost"), "qid", "left")
    known = known.withColumn("cost", F.coalesce("cost", F.lit(float("inf"))))
    further = near_boxes(index, known, ["cost", "qw"], bounds)
    elsewhere = (F.col("cell") != F.col("own_cell")) | (F.col("part") != F.col("own_part"))
    further = further.filter(elsewhere).select("qid", "x", "qw", "cell", "part")
    return _best(first.unionByName(block_work(index, further, work, FOUND)))


def _best(found: DataFrame) -> DataFrame:
    best = F.min(F.struct("cost", "tie", "pid")).alias("m")
    return found.filter(F.col("cost") < float("inf")).groupBy("qid").agg(best).select("qid", "m.*")


def _merged(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``points`` (pid, x, w) after the mergers ``pairs`` (keep, gone)."""
    to = pairs.select(F.col("gone").alias("pid"), "keep")
    moved = points.join(to, "pid", "left").withColumn("gone", F.col("keep").isNotNull())
    # At most two rows each.
    both = moved.groupBy(F.coalesce("keep", "pid").alias("pid")).agg(F.sort_array(F.collect_list(F.struct("gone", "x", "w"))).alias("m"))
    one, two = F.get("m", F.lit(0)), F.get("m", F.lit(1))
    w = one["w"] + F.coalesce(two["w"], F.lit(0.0))
    middle = F.zip_with(one["x"], two["x"], lambda a, b: (a * one["w"] + b * two["w"]) / (one["w"] + two["w"]))
    return both.select("pid", F.coalesce(middle, one["x"]).alias("x"), w.alias("w"))


def _merge_small(rows: list) -> list[tuple]:
    """(keep, gone, cost) of all mergers of a bounded number of clusters."""
    ids = np.array([r.pid for r in rows], np.int64)
    x, w = np.array([r.x for r in rows], float), np.array([r.w for r in rows], float)
    out = []
    while len(ids) > 1:
        cost, _, partner = cheapest(x, w, ids, x, w, ids)
        order = np.argsort(ids)
        other = order[np.searchsorted(ids[order], partner)]
        keep = np.flatnonzero((other[other] == np.arange(len(ids))) & (ids < ids[other]))
        gone = other[keep]
        out += list(zip(ids[keep].tolist(), ids[gone].tolist(), cost[keep].tolist()))
        total = w[keep] + w[gone]
        x[keep] = (x[keep] * w[keep, None] + x[gone] * w[gone, None]) / total[:, None]
        w[keep] = total
        rest = np.ones(len(ids), bool)
        rest[gone] = False
        ids, x, w = ids[rest], x[rest], w[rest]
    return out


def merge_points(points: DataFrame, small: int | None = None) -> DataFrame:
    """(keep, gone, cost): all mergers of ``points`` (pid, x, w), down to one cluster.
    A cluster keeps the smaller id, so every id but one is ``gone`` once."""
    small = SMALL if small is None else small
    spark, found = points.sparkSession, []
    points = checkpoint(points.select("pid", "x", F.col("w").cast("double").alias("w")))
    while points.count() > small:
        index = build_index(points.withColumn("payload", F.array(F.lit(None).cast("double"))))
        nearest = checkpoint(_search(index))
        back = nearest.select(F.col("qid").alias("pid"), F.col("pid").alias("qid"))
        pairs = nearest.join(back, ["qid", "pid"]).filter("qid < pid")
        found.append(checkpoint(pairs.select(F.col("qid").alias("keep"), F.col("pid").alias("gone"), "cost")))
        points = checkpoint(_merged(points, found[-1]))
        neighbours.release(index)
    out = spark.createDataFrame(_merge_small(points.collect()), "keep bigint, gone bigint, cost double")
    for more in found:
        out = out.unionByName(more)
    return checkpoint(out)


def cut(points: DataFrame, merges: DataFrame, clusters: int | None = None) -> DataFrame:
    """(id, component) of every ``pid``: what is left together when the dearest
    mergers are undone, down to ``clusters`` groups (all mergers stand without)."""
    edges = merges.select(F.col("keep").alias("src"), F.col("gone").alias("dst"), "cost")
    if clusters is not None:
        # A merger takes one cluster away: undo all but (points - clusters) of them.
        undone = max(merges.count() - (points.count() - clusters), 0)
        dear = edges.orderBy(F.desc("cost"), F.desc("src"), F.desc("dst")).limit(undone).select("dst")
        edges = edges.join(F.broadcast(dear), "dst", "left_anti")
    return connected_components(points.select(F.col("pid").alias("id")), edges)
