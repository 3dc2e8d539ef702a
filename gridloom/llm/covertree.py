"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are whole numbers. Queries and data are each cut into blocks of bounded
size, and every pair of blocks is one group of one Spark task: it indexes both
sides in a cover tree and walks node pairs together. The inner product of any
two members is at most <q, x> + |q| R + |x| r + r R for centres q, x and covering
radii r, R; a pair below the worst k-th score of its query group is pruned.

Equal vectors are one point that carries only its k + 1 smallest ids: no query
(which leaves out its own row) can return more of them, so nothing is lost and a
vector that a third of the rows share is not searched again and again. Each
block pair returns at most k rows a query; the best k of all blocks follow from
one window over these.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Distinct vectors of a data block and queries of a query block.
DATA_BLOCK, QUERY_BLOCK = 16_384, 1_024
LEAF = 512
# Centres of children keep this part of the radius apart; most children of a node.
SHRINK, ARITY = 1.3, 8
SCALE = 64
RESULT = "query_id long, vec_id long, score long"


def whole_numbers(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as long; null if the vector is null or
    empty or holds a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class CoverTree:
    """A cover tree in arrays: every node has a centre point, a covering radius
    (the largest distance of any point below it) and its points as a range of
    ``order``. The centres of a node's children are more than its radius divided by
    ``SHRINK`` apart from each other; each point belongs to the nearest of them."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.begin, self.end, self.radius, self.centre, self.children = [], [], [], [], []
        if len(points):
            self._grow(0, len(points), 0, leaf)
        self.norm = np.sqrt((self.points[self.centre] ** 2).sum(axis=1)) if self.centre else np.zeros(0)
        # Bounds are compared with exact scores, so rounding may only raise them.
        self.radius = np.array(self.radius) * (1 + 1e-12) + 1e-9

    def _distance(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _grow(self, begin: int, end: int, centre: int, leaf: int) -> None:
        """All nodes below a range of points, without recursion.

        The first point beyond ``reach`` of all centres so far becomes the next
        centre, ``ARITY`` at most; then every point joins its nearest centre.
        """
        work = [self._node(begin, end, centre)]
        while work:
            node = work.pop()
            begin, end = self.begin[node], self.end[node]
            if end - begin <= leaf or self.radius[node] == 0:
                continue
            rows, reach = self.order[begin:end].copy(), self.radius[node] / SHRINK
            nearest = self._distance(rows, self.centre[node])
            owner, centres = np.zeros(len(rows), np.int64), [self.centre[node]]
            while len(centres) < ARITY:
                far = np.flatnonzero(nearest > reach)
                if not len(far):
                    break
                centres.append(int(rows[far[0]]))
                distance = self._distance(rows, centres[-1])
                closer = distance < nearest
                owner[closer] = len(centres) - 1
                nearest = np.minimum(nearest, distance)
            self.order[begin:end] = rows[np.argsort(owner, kind="stable")]
            place = begin
            for i, size in enumerate(np.bincount(owner, minlength=len(centres)).tolist()):
                child = self._node(place, place + size, centres[i])
                self.children[node].append(child)
                work.append(child)
                place += size

    def _node(self, begin: int, end: int, centre: int) -> int:
        self.begin.append(begin)
        self.end.append(end)
        self.centre.append(centre)
        self.radius.append(float(self._distance(self.order[begin:end], centre).max()))
        self.children.append([])
        return len(self.begin) - 1


def search_block(query_ids, queries: np.ndarray, copies: list[np.ndarray], data: np.ndarray, k: int, leaf: int = LEAF) -> pd.DataFrame:
    """The best ``k`` rows of a data block for each query of a query block.

    ``copies`` holds the ids of every data vector in rising order."""
    left, right = CoverTree(queries, max(1, leaf // 4)), CoverTree(data, leaf)
    size = queries.shape[1] if queries.ndim == 2 else 0
    # Points in the order of their smallest id: a score and that place make one
    # number without ties. A row of the answer belongs to one of the best k + 1
    # points so ordered, as each better point has at least one better row, the
    # query's own aside.
    place = np.empty(len(data), np.int64)
    place[np.argsort([x[0] for x in copies], kind="stable")] = np.arange(len(data))
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(size, 1) + 1
    # Doubles are exact below 2^53, longs below 2^63; beyond, Python's numbers.
    kind = np.float64 if most * (len(data) + 1) < 2**52 else np.int64 if most * (len(data) + 1) < 2**62 else object
    exact_q, exact_x = queries.astype(kind), data.astype(kind)
    scale, minus = kind(len(data) + 1) if kind is not object else len(data) + 1, place.astype(kind)
    lowest = -(2**62) if kind is not object else -(1 << 400)
    found = np.full((len(queries), k + 1), lowest, dtype=kind)
    found_at = np.full((len(queries), k + 1), -1, np.int64)
    worst = np.full(len(queries), -np.inf)
    centres = right.points[right.centre] if len(data) else right.points

    def bound(a: int, nodes: np.ndarray) -> np.ndarray:
        middle = centres[nodes] @ left.points[left.centre[a]]
        value = middle + left.norm[a] * right.radius[nodes] + right.norm[nodes] * left.radius[a] + left.radius[a] * right.radius[nodes]
        return value + np.abs(value) * 1e-9 + 1e-6

    def leaves(a: int, b: int):
        rows = left.order[left.begin[a] : left.end[a]]
        points = right.order[right.begin[b] : right.end[b]]
        scores = exact_q[rows] @ exact_x[points].T
        hit = scores >= worst[rows][:, None]
        some = np.flatnonzero(hit.any(axis=1))
        if not len(some):
            return
        rows = rows[some]
        values = np.hstack([found[rows], np.where(hit[some], scores[some] * scale - minus[points], lowest)])
        at = np.hstack([found_at[rows], np.broadcast_to(points, (len(rows), len(points)))])
        keep = np.argpartition(values, values.shape[1] - k - 1, axis=1)[:, -(k + 1) :]
        found[rows], found_at[rows] = np.take_along_axis(values, keep, 1), np.take_along_axis(at, keep, 1)
        least = found[rows].min(axis=1)
        # Back to the score, rounded down.
        worst[rows] = np.where(least == lowest, -np.inf, np.array(least // scale, np.float64) - (0 if kind is np.float64 else 1 + np.abs(np.array(least // scale, np.float64)) * 1e-9))

    def walk(a: int, nodes: np.ndarray):
        """Node pairs of one query node, the most promising first."""
        stack = [(a, nodes)]
        while stack:
            a, nodes = stack.pop()
            rows = left.order[left.begin[a] : left.end[a]]
            bounds = bound(a, nodes)
            keep = bounds >= worst[rows].min()
            nodes, bounds = nodes[keep], bounds[keep]
            if not len(nodes):
                continue
            if left.children[a]:
                # The queries split first; their groups get tighter bounds.
                stack += [(child, nodes) for child in reversed(left.children[a])]
                continue
            todo = sorted(zip(-bounds, nodes.tolist(), strict=True))
            while todo:
                value, b = todo.pop(0)
                if -value < worst[rows].min():
                    break
                if right.children[b]:
                    below = np.array(right.children[b])
                    found = bound(a, below)
                    good = found >= worst[rows].min()
                    for v, c in zip(-found[good], below[good].tolist(), strict=True):
                        insort(todo, (v, c))
                else:
                    leaves(a, b)

    if len(queries) and len(data):
        walk(0, np.array([0]))
    out = []
    for i in range(len(queries)):
        for p in found_at[i][found_at[i] >= 0]:
            score = min(max(int(sum(exact_q[i] * exact_x[p])), -(2**63)), 2**63 - 1) if kind is object else int(exact_q[i] @ exact_x[p])
            out += [(score, int(x), i) for x in copies[p] if x != query_ids[i]]
    out.sort(key=lambda r: (r[2], -r[0], r[1]))
    frame = pd.DataFrame(out, columns=["score", "vec_id", "row"]).astype(np.int64)
    frame = frame[frame.groupby("row").cumcount() < k]
    return pd.DataFrame({"query_id": np.asarray(query_ids, np.int64)[frame["row"]], "vec_id": frame["vec_id"].to_numpy(), "score": frame["score"].to_numpy()})


def top_k(vectors: DataFrame, queries: DataFrame, k: int, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of every
    query row, ties to smaller ids, its own id left out.

    Both tables have vec_id and v (array of long, one length); rows with a null id
    or vector take no part. Fewer than ``k`` candidates give all of them. A query
    id that repeats is searched once for each distinct vector and its rows are
    ranked together; a repeated data row counts once. Scores beyond a long are cut
    to its range before they are ranked.
    """
    data = vectors.filter("vec_id IS NOT NULL AND v IS NOT NULL").select("vec_id", "v")
    # Copies meet by value; each keeps its smallest ids, merged before the shuffle.
    points = (
        data.distinct()
        .withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id")))
        .filter(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asked = queries.filter("vec_id IS NOT NULL AND v IS NOT NULL").select(F.col("vec_id").alias("query_id"), "v").distinct()
    counts = data.agg(F.count("*")).first()[0], asked.count()
    blocks = [max(1, -(-counts[0] // data_block)), max(1, -(-counts[1] // query_block))]
    data_side = points.withColumn("x", F.pmod(F.xxhash64("v"), F.lit(blocks[0]))).withColumn(
        "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[1] - 1).cast("long")))
    )
    query_side = asked.withColumn("y", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks[1]))).withColumn(
        "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks[0] - 1).cast("long")))
    )

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        return search_block(
            left["query_id"].to_numpy(),
            np.stack(left["v"].tolist()),
            [np.asarray(x, np.int64) for x in right["ids"]],
            np.stack(right["v"].tolist()),
            k,
        )

    found = query_side.groupBy("x", "y").cogroup(data_side.groupBy("x", "y")).applyInPandas(work, RESULT)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
