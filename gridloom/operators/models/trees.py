"""Randomised trees and AdaBoost.

Extra trees grow level by level: per open node a few random cuts are tried, and
one pass over the rows counts labels on both sides of all of them. The driver
holds the tree structure, up to a bound; open nodes beyond it are grown to their end
in tasks, which hold all rows of a node, and are kept as a table. AdaBoost fits Spark's own small trees on weights
that are kept as a column.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.models.base import (
    SEED,
    Fitted,
    Training,
    array_output,
    arrays,
    numeric_output,
    scorer,
)
from gridloom.operators.sums import batch_array
from gridloom.session import checkpoint

# Levels and nodes of one model that the driver holds (and each task); nodes are split
# breadth first. What is still open then goes to tasks, except for nodes too large for one.
MAX_LEVELS, MAX_NODES = 30, 2_000_000
# Numbers of the rows of open nodes that one task grows, and that one job moves to them.
SUBTREE_NUMBERS, MOVED_NUMBERS = 2_000_000, 250_000_000
# Numbers that a pass may keep for its open nodes in each task; a level whose nodes
# need more takes several passes.
PASS_NUMBERS = 8_000_000
# Nodes whose numbers are added up in one group, and tasks that read the rows.
NODE_BLOCK, TASKS_PER_CORE = 4_096, 2


def extra_tree(t: Training) -> Fitted:
    return _grow(t, 1)


def extra_trees(t: Training) -> Fitted:
    return _grow(t, 200)


def descend(x: np.ndarray, roots, feature, cut, left, right) -> np.ndarray:
    """Leaf of every row in every tree (rows by trees)."""
    place = np.empty((len(x), len(roots)), np.int64)
    for i, root in enumerate(roots):
        place[:, i] = _leaf_of(x, root, feature, cut, left, right)
    return place


def _leaf_of(x, root, feature, cut, left, right):
    """Leaf of every row in one tree. Rows that have come to a leaf are done."""
    place = np.full(len(x), root, np.int64)
    rows = np.arange(len(x)) if feature[root] >= 0 else np.zeros(0, int)
    node = place[rows]
    while len(rows):
        node = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
        place[rows] = node
        inner = feature[node] >= 0
        rows, node = rows[inner], node[inner]
    return place


def _tried(d: int, classes: int) -> int:
    return max(1, int(np.sqrt(d))) if classes else d


def _grow(t: Training, count: int) -> Fitted:
    """All trees at once, a level at a time. Per level two passes: ranges of the
    tried features in every open node, then label sums on both sides of the drawn
    cuts. A node that is constant in all of them waits for the next level to try
    others, until one has a range."""
    draw = np.random.default_rng(SEED)
    tried = _tried(t.d, t.classes)
    labels = t.classes or 3
    room = max(1, PASS_NUMBERS // (tried * (labels + 2) + labels))
    # Every pass does much work for each row, so rows go to all cores, however few
    # files they come from.
    cores = t.df.sparkSession.sparkContext.defaultParallelism
    rows = t.df.select("x", "label").repartition(TASKS_PER_CORE * cores).persist()
    feature, cut = np.full(count, -1), np.zeros(count)
    left, right = np.full(count, -1), np.full(count, -1)
    value = np.zeros((count, t.classes or 1))
    roots, depth = np.arange(count), 0
    tree = roots
    # Features that a waiting node has not tried; nodes that go to tasks, and their rows.
    waiting, rest, held = {}, [], []
    level = roots
    while len(level):
        first, again = len(feature), []
        for start in range(0, len(level), room):
            nodes = level[start : start + room]
            later = np.array([int(node) in waiting for node in nodes])
            orders = [waiting.pop(int(node)) if wait else draw.permutation(t.d) for node, wait in zip(nodes, later)]
            choices = np.array([np.pad(o[:tried], (0, max(0, tried - len(o))), "edge") for o in orders])
            grown = _Frontier(roots, feature, cut, left, right, nodes, choices)
            low, high, sums = _ranges(rows, grown, t.classes, labels)
            cuts = _drawn(draw, low, high)
            value[nodes] = _leaf_values(sums, t.classes)
            usable = _usable(low, high, later)
            # Sums with a missing label are no number: such a node is not pure.
            impure = ~(_impurity(sums, t.classes) <= 1e-12)
            split = impure & usable.any(1)
            for i in np.flatnonzero(impure & ~split):
                if len(orders[i]) > tried:
                    waiting[int(nodes[i])] = orders[i][tried:]
                    again.append(nodes[i])
            # A split needs room for two more nodes; the first ones get it.
            space = max(0, (MAX_NODES - len(feature)) // 2) if depth < MAX_LEVELS else 0
            inside = sums.sum(1) if t.classes else sums[:, 0]
            over = split & (np.cumsum(split) > space) & (inside * (t.d + 1) <= SUBTREE_NUMBERS)
            rest.append(nodes[over])
            held.append(inside[over])
            split &= ~over
            if not split.any():
                continue
            at, few = nodes[split], np.flatnonzero(split)
            sides = _sides(rows, _Frontier(roots, feature, cut, left, right, at, choices[few]), cuts[few], t.classes, labels)
            loss = _impurity(sides, t.classes) + _impurity(sums[few][:, None] - sides, t.classes)
            best = np.where(usable[few], loss, np.inf).argmin(1)
            feature[at], cut[at] = choices[few, best], cuts[few, best]
            left[at] = len(feature) + 2 * np.arange(len(at))
            right[at] = left[at] + 1
            feature, left, right = (np.append(a, np.full(2 * len(at), -1)) for a in (feature, left, right))
            cut, tree = np.append(cut, np.zeros(2 * len(at))), np.append(tree, np.repeat(tree[at], 2))
            value = np.vstack([value, np.zeros((2 * len(at), value.shape[1]))])
        level, depth = np.concatenate([np.array(again, int), np.arange(first, len(feature))]), depth + 1
    params = {
        "roots": roots,
        "feature": feature,
        "cut": cut,
        "left": left,
        "right": right,
        "value": value,
        "classes": t.classes,
    }
    table = None
    rest, held = np.concatenate(rest), np.concatenate(held)
    if len(rest):
        # Jobs take as many trees as move a bounded number of rows, or one; their nodes
        # are packed into buckets that a task can hold.
        at_once = max(1, int(MOVED_NUMBERS / (t.rows * (t.d + 2))))
        order = np.lexsort((rest, tree[rest] // at_once))
        rest, full = rest[order], np.cumsum(held[order]) * (t.d + 1) // SUBTREE_NUMBERS
        bucket = np.unique(np.stack([tree[rest] // at_once, full]), axis=1, return_inverse=True)[1].ravel()
        order = rest.argsort()
        params |= {"rest": rest[order], "bucket": bucket[order], "rows": t.rows}
        table = _subtrees(rows, params, t, at_once)
    rows.unpersist()
    return Fitted("forest", params, table=table)


def _drawn(draw, low, high):
    """A cut between the bounds, at the lower one where rounding makes it the upper."""
    with np.errstate(all="ignore"):
        cuts = low + draw.uniform(size=low.shape) * (high - low)
    return np.where(cuts < high, cuts, low)


def _usable(low, high, later):
    """Tried features with a range; of nodes that try for a second time, the first."""
    usable = high > low
    usable[later] &= usable[later].cumsum(1) == 1
    return usable


def _open_rows(x, p, roots):
    """(row, node, bucket) of every row that lies in a node left to tasks."""
    row, node, bucket = [], [], []
    for root in roots:
        leaf = _leaf_of(x, root, p["feature"], p["cut"], p["left"], p["right"])
        at = np.searchsorted(p["rest"], leaf).clip(max=len(p["rest"]) - 1)
        found = np.flatnonzero(p["rest"][at] == leaf)
        row.append(found)
        node.append(leaf[found])
        bucket.append(p["bucket"][at[found]])
    return np.concatenate(row), np.concatenate(node), np.concatenate(bucket)


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array column."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x).ravel()))


_SUBTREE = "bucket bigint, nodes array<bigint>, feature array<bigint>, cut array<double>, left array<bigint>, right array<bigint>, value array<double>"


def _subtrees(rows, p, t: Training, at_once: int) -> DataFrame:
    """A row for each bucket: the trees below its nodes. A job takes ``at_once`` trees."""
    classes = t.classes

    def grow(part: pa.Table) -> pa.Table:
        x, y, node = (batch_array(part.column(c).combine_chunks()) for c in ("x", "label", "node"))
        draw = np.random.default_rng([SEED, int(node.min())])
        grown = _grown(x, y, node, classes, draw)
        number = part.column("bucket")[0].as_py()
        return pa.table({"bucket": [number], **{k: [v.ravel()] for k, v in grown.items()}})

    parts = []
    for start in range(0, len(p["roots"]), at_once):
        roots = p["roots"][start : start + at_once]

        def moved(batches, roots=roots):
            for batch in batches:
                if batch.num_rows:
                    x, y = batch_array(batch.column(0)), batch_array(batch.column(1)).astype(float)
                    row, node, bucket = _open_rows(x, p, roots)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.astype(np.int64)), pa.array(node.astype(np.int64)), _lists(x[row]), pa.array(y[row])],
                        names=["bucket", "node", "x", "label"],
                    )

        open_rows = rows.mapInArrow(moved, "bucket bigint, node bigint, x array<double>, label double")
        parts.append(checkpoint(open_rows.groupBy("bucket").applyInArrow(grow, _SUBTREE)))
    return reduce(DataFrame.unionByName, parts)


def _grown(x, y, node, classes, draw) -> dict[str, np.ndarray]:
    """Trees below the open nodes ``node`` (of each row), grown to their end as in
    ``_grow``; the first entries are the nodes themselves."""
    d, tried = x.shape[1], _tried(x.shape[1], classes)
    nodes, place = np.unique(node, return_inverse=True)
    columns = _label_columns(y, classes)
    feature, cut, left, right = np.full(len(nodes), -1), np.zeros(len(nodes)), np.full(len(nodes), -1), np.full(len(nodes), -1)
    value = np.zeros((len(nodes), classes or 1))

    def orders_of(n):
        return draw.permuted(np.tile(np.arange(d), (n, 1)), axis=1)

    level, orders, turn = np.arange(len(nodes)), orders_of(len(nodes)), np.zeros(len(nodes), int)
    rows = np.arange(len(x))
    while len(level):
        n = len(level)
        slot = np.full(len(feature), -1)
        slot[level] = np.arange(n)
        rows = rows[slot[place[rows]] >= 0]
        at = slot[place[rows]]

        def totals(inside, at=at, rows=rows, n=n):
            return np.stack([np.bincount(at[inside], c[rows[inside]], n) for c in columns], 1)

        sums = totals(slice(None))
        value[level] = _leaf_values(sums, classes)
        take = turn[:, None] * tried + np.arange(tried)
        choices = np.take_along_axis(orders, np.minimum(take, d - 1), 1)
        low, high = np.full((n, tried), np.inf), np.full((n, tried), -np.inf)
        for j in range(tried):
            values = x[rows, choices[at, j]]
            np.minimum.at(low[:, j], at, values)
            np.maximum.at(high[:, j], at, values)
        cuts, usable = _drawn(draw, low, high), _usable(low, high, turn > 0)
        impure = ~(_impurity(sums, classes) <= 1e-12)
        split = impure & usable.any(1)
        stuck = impure & ~split & ((turn + 1) * tried < d)
        sides = np.stack([totals(x[rows, choices[at, j]] <= cuts[at, j]) for j in range(tried)], 1)
        loss = _impurity(sides, classes) + _impurity(sums[:, None] - sides, classes)
        best = np.where(usable, loss, np.inf).argmin(1)[split]
        parent, first = level[split], len(feature)
        feature[parent], cut[parent] = choices[split, best], cuts[split, best]
        left[parent] = first + 2 * np.arange(len(parent))
        right[parent] = left[parent] + 1
        down = rows[split[at]]
        own = place[down]
        place[down] = np.where(x[down, feature[own]] <= cut[own], left[own], right[own])
        new = 2 * len(parent)
        feature, left, right = (np.append(a, np.full(new, -1)) for a in (feature, left, right))
        cut, value = np.append(cut, np.zeros(new)), np.vstack([value, np.zeros((new, value.shape[1]))])
        level = np.concatenate([level[stuck], np.arange(first, first + new)])
        orders, turn = np.vstack([orders[stuck], orders_of(new)]), np.append(turn[stuck] + 1, np.zeros(new, int))
    return {"nodes": nodes, "feature": feature, "cut": cut, "left": left, "right": right, "value": value}


class _Frontier:
    """The trees so far, their open nodes and the features tried in each."""

    def __init__(self, roots, feature, cut, left, right, nodes, choices):
        self.roots, self.cut = roots, cut
        self.feature, self.left, self.right = (a.astype(np.int32) for a in (feature, left, right))
        self.slot = np.full(len(feature), -1, np.int32)
        self.slot[nodes] = np.arange(len(nodes))
        self.choices = choices.astype(np.int32)

    def rows(self, x):
        """(row, slot) of every row that lies in an open node."""
        row, slot = [], []
        for root in self.roots:
            slots = self.slot[_leaf_of(x, root, self.feature, self.cut, self.left, self.right)]
            inside = np.flatnonzero(slots >= 0)
            row.append(inside)
            slot.append(slots[inside])
        return np.concatenate(row), np.concatenate(slot)


def _label_columns(y, classes):
    y = np.asarray(y, float)
    if classes:
        return (y == np.arange(classes)[:, None]).astype(float)
    return np.stack([np.ones(len(y)), y, y * y])


def _ranges(rows, grown, classes, labels):
    """Smallest and largest value of each tried feature, and label sums, per node."""
    n, tried = grown.choices.shape

    def add(table, x, y):
        row, slot = grown.rows(x)
        for j in range(tried):
            values = x[row, grown.choices[slot, j]]
            np.minimum.at(table[j], slot, values)
            np.maximum.at(table[tried + j], slot, values)
        for c, column in enumerate(_label_columns(y, classes)):
            np.add.at(table[2 * tried + c], slot, column[row])
        return slot

    found = _node_totals(rows, n, [np.minimum] * tried + [np.maximum] * tried + [np.add] * labels, add)
    return found[:tried].T, found[tried : 2 * tried].T, found[2 * tried :].T


def _sides(rows, grown, cuts, classes, labels):
    """Label sums left of every drawn cut (nodes by tried features by labels)."""
    n, tried = cuts.shape

    def add(table, x, y):
        row, slot = grown.rows(x)
        columns = _label_columns(y, classes)
        for j in range(tried):
            inside = x[row, grown.choices[slot, j]] <= cuts[slot, j]
            at, of = slot[inside], row[inside]
            for c, column in enumerate(columns):
                np.add.at(table[j * labels + c], at, column[of])
        return slot

    return _node_totals(rows, n, [np.add] * (tried * labels), add).T.reshape(n, tried, labels)


_EMPTY = {np.minimum: np.inf, np.maximum: -np.inf, np.add: 0.0}


def _node_totals(rows, n, rules, add):
    """Numbers of ``n`` nodes (a row of the result for each of ``rules``, which say
    how the numbers of two tasks become one). ``add`` puts the rows of a batch into
    a task's table and returns the nodes that it met; nodes without rows are zero.

    A task sends the nodes that it met, in blocks; blocks are added up in Spark.
    """
    schema = "block bigint, slots array<int>, numbers array<double>"
    empty = np.array([_EMPTY[r] for r in rules])

    def partial(batches):
        table, met = np.repeat(empty[:, None], n, axis=1), np.zeros(n, bool)
        for batch in batches:
            if batch.num_rows:
                met[add(table, batch_array(batch.column(0)), batch_array(batch.column(1)))] = True
        for start in range(0, n, NODE_BLOCK):
            slots = np.flatnonzero(met[start : start + NODE_BLOCK])
            if len(slots):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([start], pa.int64()),
                        pa.array([slots], pa.list_(pa.int32())),
                        pa.array([table[:, start + slots].ravel()], pa.list_(pa.float64())),
                    ],
                    names=["block", "slots", "numbers"],
                )

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        table, met = np.repeat(empty[:, None], NODE_BLOCK, axis=1), np.zeros(NODE_BLOCK, bool)
        for slots, numbers in zip(parts.slots, parts.numbers):
            numbers = np.asarray(numbers).reshape(len(rules), -1)
            for i, rule in enumerate(rules):
                table[i, slots] = rule(table[i, slots], numbers[i])
            met[slots] = True
        slots = np.flatnonzero(met)
        return pd.DataFrame({"block": parts.block[:1], "slots": [slots], "numbers": [table[:, slots].ravel()]})

    found = rows.mapInArrow(partial, schema).groupBy("block").applyInPandas(merge, schema).toPandas()
    out = np.zeros((len(rules), n))
    for block, slots, numbers in zip(found.block, found.slots, found.numbers):
        out[:, block + np.asarray(slots)] = np.asarray(numbers).reshape(len(rules), -1)
    return out


def _impurity(sums, classes):
    """Gini impurity times rows, or the sum of squared deviations (last axis)."""
    n = sums.sum(-1) if classes else sums[..., 0]
    rows = np.maximum(n, 1e-300)
    if classes:
        return np.where(n > 0, n - (sums**2).sum(-1) / rows, 0.0)
    return np.where(n > 0, np.maximum(sums[..., 2] - sums[..., 1] ** 2 / rows, 0.0), 0.0)


def _leaf_values(sums, classes):
    if classes:
        return sums / np.maximum(sums.sum(1, keepdims=True), 1e-300)
    return sums[:, 1:2] / np.where(sums[:, :1] > 0, sums[:, :1], 1.0)


@scorer("forest")
def _forest(fitted, df):
    p = arrays(fitted.params)
    tree = [p[n] for n in ("roots", "feature", "cut", "left", "right")]
    value, classes = p["value"], fitted.params["classes"]

    def told(mean):
        return mean.argmax(1) if classes else mean[:, 0]

    if fitted.table is None:
        return df.withColumn("prediction", numeric_output(lambda x: told(value[descend(x, *tree)].mean(1)))("x"))

    # Trees that end on the driver's nodes vote at once; the others where the nodes below are.
    def inside(x):
        leaf = descend(x, *tree)
        return (value[leaf] * ~np.isin(leaf, p["rest"])[:, :, None]).sum(1)

    # Rows of a bucket are dealt to so many tasks that each has about as many as were fitted on.
    points = df.select("x").distinct()
    points = points.select("x", F.xxhash64("x").alias("key")).persist()
    salts = max(1, -(-points.count() // max(1, int(p["rows"]))))

    def moved(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch_array(batch.column(0))
                row, node, bucket = _open_rows(x, p, p["roots"])
                salt = batch_array(batch.column(1))[row] % salts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.astype(np.int64)), pa.array(salt.astype(np.int64)), pa.array(node.astype(np.int64)), _lists(x[row])],
                    names=["bucket", "salt", "node", "x"],
                )

    def vote(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"x": pa.array([], pa.list_(pa.float64())), "votes": pa.array([], pa.list_(pa.float64()))})
        x, node = (batch_array(left.column(c).combine_chunks()) for c in ("x", "node"))
        names = ("nodes", "feature", "cut", "left", "right", "value")
        nodes, feature, cut, below, above, leaf = (right.column(c)[0].values.to_numpy() for c in names)
        place = np.searchsorted(nodes, node)
        rows = np.flatnonzero(feature[place] >= 0)
        while len(rows):
            own = place[rows]
            place[rows] = np.where(x[rows, feature[own]] <= cut[own], below[own], above[own])
            rows = rows[feature[place[rows]] >= 0]
        out = leaf.reshape(len(feature), -1)[place]
        # One row for each point of the bucket.
        _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        votes = np.zeros((len(first), out.shape[1]))
        np.add.at(votes, same.ravel(), out)
        return pa.table({"x": _lists(x[first]), "votes": _lists(votes)})

    open_rows = points.mapInArrow(moved, "bucket bigint, salt bigint, node bigint, x array<double>")
    tables = fitted.table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    keys = ["bucket", "salt"]
    votes = open_rows.groupBy(*keys).cogroup(tables.groupBy(*keys)).applyInArrow(vote, "x array<double>, votes array<double>")
    every = votes.unionByName(points.select("x", array_output(inside)("x").alias("votes")))
    width = range(classes or 1)
    summed = every.groupBy("x").agg(F.array(*[F.sum(F.get("votes", F.lit(c))) / float(len(p["roots"])) for c in width]).alias("votes"))
    found = checkpoint(summed.select(F.col("x").alias("at"), numeric_output(told)("votes").alias("prediction")))
    points.unpersist()
    return df.drop("prediction").join(found, F.col("x") == F.col("at"), "left").drop("at")


# --- AdaBoost ---------------------------------------------------------------

BOOSTING_ROUNDS = 100
CHECKPOINT_ROUNDS = 10


def _weighted_start(t):
    return t.df.select(
        "x", array_to_vector("x").alias("features"), "label", F.lit(1.0 / t.rows).alias("weight")
    )


def _renewed(rows, old, step):
    """Cache the reweighted rows and cut their lineage from time to time."""
    rows = checkpoint(rows) if (step + 1) % CHECKPOINT_ROUNDS == 0 else rows.persist()
    rows.count()
    old.unpersist()
    return rows


def boosted_classifier(t: Training) -> Fitted:
    """SAMME with trees of depth two."""
    rows, trees, amounts = _weighted_start(t).persist(), [], []
    for step in range(BOOSTING_ROUNDS):
        tree = DecisionTreeClassifier(
            maxDepth=2, maxBins=128, weightCol="weight", seed=SEED + step
        ).fit(rows)
        told = tree.transform(rows).withColumn(
            "wrong", (F.col("prediction") != F.col("label")).cast("double")
        )
        total, missed = told.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("wrong"))).first()
        error = missed / total
        if error <= 0:
            trees, amounts = [*trees, tree], [*amounts, 1.0]
            break
        if error >= 1 - 1 / t.classes:
            if not trees:
                raise ValueError("AdaBoost: the first tree is worse than random.")
            break
        amount = float(np.log((1 - error) / error) + np.log(t.classes - 1))
        trees, amounts = [*trees, tree], [*amounts, amount]
        scale = total * (1 - error) + missed * float(np.exp(amount))
        rows = _renewed(
            told.select(
                "x",
                "features",
                "label",
                (F.col("weight") * F.exp(amount * F.col("wrong")) / scale).alias("weight"),
            ),
            rows,
            step,
        )
    rows.unpersist()
    return Fitted("boosted", {"amounts": amounts, "classes": t.classes}, model=trees)


def boosted_regressor(t: Training) -> Fitted:
    """AdaBoost.R2 with linear loss and trees of depth three, on weights."""
    rows, trees, amounts = _weighted_start(t).persist(), [], []
    for step in range(BOOSTING_ROUNDS):
        tree = DecisionTreeRegressor(
            maxDepth=3, maxBins=128, weightCol="weight", seed=SEED + step
        ).fit(rows)
        told = tree.transform(rows).withColumn("gap", F.abs(F.col("prediction") - F.col("label")))
        total, worst, weighted = told.agg(
            F.sum("weight"), F.max("gap"), F.sum(F.col("weight") * F.col("gap"))
        ).first()
        loss = weighted / (total * worst) if worst > 0 else 0.0
        if loss <= 0:
            trees, amounts = [*trees, tree], [*amounts, 1.0]
            break
        if loss >= 0.5:
            if not trees:
                trees, amounts = [tree], [1.0]
            break
        beta = loss / (1 - loss)
        trees, amounts = [*trees, tree], [*amounts, float(np.log(1 / beta))]
        shrunk = F.col("weight") * F.pow(F.lit(beta), 1 - F.col("gap") / worst)
        rows = _renewed(
            told.select("x", "features", "label", (shrunk / total).alias("weight")), rows, step
        )
    rows.unpersist()
    return Fitted("boosted", {"amounts": amounts, "classes": 0}, model=trees)


def tree_arrays(model) -> tuple[np.ndarray, ...]:
    """A Spark decision tree as feature, cut, left, right and leaf value."""
    feature, cut, left, right, value = [], [], [], [], []

    def visit(node):
        at = len(feature)
        for column, entry in ((feature, -1), (cut, 0.0), (left, -1), (right, -1)):
            column.append(entry)
        value.append(node.prediction())
        if node.subtreeDepth() > 0:
            split = node.split()
            feature[at], cut[at] = split.featureIndex(), split.threshold()
            left[at] = visit(node.leftChild())
            right[at] = visit(node.rightChild())
        return at

    visit(model._call_java("rootNode"))
    return tuple(np.array(a) for a in (feature, cut, left, right, value))


@scorer("boosted")
def _boosted(fitted, df):
    """Weighted vote of the trees, or their weighted median."""
    if fitted.model is not None and "feature" not in fitted.params:
        fitted.params |= joined_trees(fitted.model)
        fitted.model = None
    p = arrays(fitted.params)
    tree = [p[n].astype(int if n != "cut" else float) for n in ("roots", "feature", "cut", "left", "right")]
    value, amounts, classes = p["value"], np.array(p["amounts"], float), fitted.params["classes"]

    def vote(x):
        told = value[descend(x, *tree)]
        if classes:
            scores = [((told == c) * amounts).sum(1) for c in range(classes)]
            return np.column_stack(scores).argmax(1)
        order = np.argsort(told, axis=1)
        upto = np.cumsum(amounts[order], axis=1)
        middle = (upto >= 0.5 * upto[:, -1:]).argmax(1)
        rows = np.arange(len(x))
        return told[rows, order[rows, middle]]

    return df.withColumn("prediction", numeric_output(vote)("x"))


def joined_trees(models) -> dict:
    """Boosted trees as one set of arrays."""
    trees = [tree_arrays(m) for m in models]
    roots, at = [], 0
    columns = [[], [], [], [], []]
    for feature, cut, left, right, value in trees:
        roots.append(at)
        shifted = (feature, cut, np.where(left >= 0, left + at, -1), np.where(right >= 0, right + at, -1), value)
        for column, part in zip(columns, shifted):
            column.append(part)
        at += len(feature)
    names = ("feature", "cut", "left", "right", "value")
    return {"roots": np.array(roots)} | {
        n: np.concatenate(c) for n, c in zip(names, columns)
    }
