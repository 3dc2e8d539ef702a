"""Work that must not grow faster than the table, on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.llm import components
from gridloom.operators import association, neighbours, ordering
from gridloom.operators.models import clusters, trees
from gridloom.operators.models.base import Training, apply_model
from gridloom.session import checkpoint


def test_tree_takes_one_pass_a_level(spark, monkeypatch):
    """All open nodes of a level are counted together, on all cores, and totals of
    many nodes are added up in blocks; leaves are the means of their rows."""
    df = spark.range(6000, numPartitions=1).select(
        F.array(F.col("id").cast("double"), (F.xxhash64("id") % 1000).cast("double")).alias("x"),
        (F.xxhash64("id", F.lit(1)) % 1000).cast("double").alias("label"),
    )
    passes, inner = [], trees._ranges

    def counted(rows, grown, *rest):
        passes.append((rows.rdd.getNumPartitions(), len(grown.choices)))
        return inner(rows, grown, *rest)

    monkeypatch.setattr(trees, "_ranges", counted)
    monkeypatch.setattr(trees, "NODE_BLOCK", 64)
    monkeypatch.setattr(trees, "MAX_LEVELS", 8)
    fitted = trees._grow(Training(df, 6000, 2), 12)
    nodes = len(fitted.params["feature"])
    assert len(passes) == 9 and sum(n for _, n in passes) == nodes > 2000
    assert all(parts > 1 for parts, _ in passes)
    one = {**fitted.params, "roots": fitted.params["roots"][:1]}
    fitted.params = one
    leaves = apply_model(fitted, df).groupBy("prediction").agg(F.avg("label").alias("mean")).collect()
    assert len(leaves) > 50 and max(abs(r.prediction - r.mean) for r in leaves) < 1e-9


def _guess(df):
    """Digits of the planner's guess of a table's size."""
    return len(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())


def test_checkpoints_do_not_pass_guesses_on(spark):
    """The size that the planner guesses grows with no round of a loop, and an exploded
    table has none that is too low."""
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(edges)
    assert found.select("component").distinct().count() == 1
    assert _guess(found) < 100
    long = spark.range(10).select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("v"))
    kept = checkpoint(long)
    assert kept.count() == 10_000 and _guess(kept) > 9


def _parity(spark, rows=400):
    """Rows that only small nodes tell apart, and three features that never change."""
    x = F.array(*[F.lit(1.0)] * 3, F.col("id").cast("double"))
    return spark.range(rows).select(x.alias("x"), (F.xxhash64("id") % 3 == 0).cast("double").alias("label"))


@pytest.mark.parametrize("name, bound", [("MAX_NODES", 60), ("MAX_LEVELS", 3), ("MAX_LEVELS", 200)])
def test_trees_grow_to_their_end(spark, monkeypatch, name, bound):
    """Beyond the driver's nodes and levels, too, and where the features tried first
    are constant; as in a single tree without bounds, every row gets its own label."""
    monkeypatch.setattr(trees, name, bound)
    monkeypatch.setattr(trees, "SUBTREE_NUMBERS", 500, raising=False)
    monkeypatch.setattr(trees, "MOVED_NUMBERS", 3000, raising=False)
    df = _parity(spark)
    fitted = trees._grow(Training(df, 400, 4, 2), 3)
    assert (fitted.table is None) == (bound == 200)
    again = df.unionByName(df).unionByName(df.withColumn("x", F.transform("x", lambda v: v + 0.0)))
    right = apply_model(fitted, again).agg(F.count(F.lit(1)), F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()
    assert tuple(right) == (1200, 1.0)
    assert bound == 200 or len(fitted.params["feature"]) < 500


def test_subtrees_hold_the_means_of_their_rows():
    draw = np.random.default_rng(5)
    x, y, node = draw.integers(0, 30, (500, 2)).astype(float), draw.normal(size=500), np.arange(500) % 3 + 7
    p = trees._grown(x, y, node, 0, draw)
    assert p["nodes"].tolist() == [7, 8, 9]
    for i in range(3):
        leaf = trees._leaf_of(x[node == 7 + i], i, p["feature"], p["cut"], p["left"], p["right"])
        for one in np.unique(leaf):
            inside = x[node == 7 + i][leaf == one]
            assert (inside == inside[0]).all()
            assert abs(p["value"][one, 0] - y[node == 7 + i][leaf == one].mean()) < 1e-9


def test_tree_splits_nodes_with_a_missing_label(spark):
    label = F.when(F.col("id") % 10 != 0, (F.col("id") % 7).cast("double"))
    df = spark.range(80).select(F.array(F.col("id").cast("double")).alias("x"), label.alias("label"))
    value = trees.extra_tree(Training(df, 80, 1)).params
    leaves = value["feature"] < 0
    assert np.isnan(value["value"][leaves]).sum() == 8 and leaves.sum() > 40


def test_descend_reaches_the_leaves():
    feature, cut = np.array([0, -1, 1, -1, -1, -1]), np.array([0.5, 0, 2.0, 0, 0, 0])
    left, right = np.array([1, -1, 3, -1, -1, -1]), np.array([2, -1, 4, -1, -1, -1])
    x = np.array([[0.5, 9.0], [0.6, 2.0], [0.6, 2.1]])
    assert trees.descend(x, [0, 5], feature, cut, left, right).tolist() == [[1, 5], [3, 5], [4, 5]]


def _block(x):
    queries = pd.DataFrame({"qid": np.arange(len(x)), "qx": list(x)})
    points = pd.DataFrame({"pid": np.arange(len(x))[::-1], "x": list(x), "w": 1, "payload": [np.zeros(1)] * len(x)})
    return queries, points


@pytest.mark.parametrize("metric, d", [("maximum", 3), ("euclidean", 2), ((2, 2.0), 3), ("euclidean", 20)])
def test_block_search_compares_few_pairs(monkeypatch, metric, d):
    """Equal to all pairs, with ties by id, without measuring them."""
    draw = np.random.default_rng(3)
    x = np.round(draw.uniform(0, 3, size=(2000, d)), 2 if d < 20 else 3)
    x[:, -1] = np.round(x[:, -1]) * 10 if d == 3 else x[:, -1]
    measured, inner = [], neighbours.distances

    def counted(q, p, *rest):
        measured.append(len(q) * len(p))
        return inner(q, p, *rest)

    monkeypatch.setattr(neighbours, "distances", counted)
    queries, points = _block(x)
    found = neighbours._nearest_in_block(4, metric)(queries, points)
    assert sum(measured) < 2000 * 2000 / 2
    gaps = x[:, None] - x[None]
    if isinstance(metric, tuple):
        gaps[:, :, metric[0] :] = np.where(gaps[:, :, metric[0] :] != 0, metric[1], 0.0)
    gaps = np.abs(gaps).max(2) if metric == "maximum" else np.sqrt((gaps**2).sum(2))
    pid = points.pid.to_numpy()
    order = np.array([np.lexsort((pid, row))[:4] for row in gaps])
    assert (np.stack(found.pid) == pid[order]).all()
    assert (np.stack(found.distance) == np.take_along_axis(gaps, order, 1)).all()


def test_cells_are_ruled_out_in_groups(monkeypatch):
    draw = np.random.default_rng(4)
    low = draw.normal(size=(500, 2))
    sizes = draw.integers(0, 3, 500)
    index = neighbours.Index(None, [], [], low, low + 0.1, sizes)
    x, bound = draw.normal(size=(400, 2)), np.broadcast_to(draw.uniform(0, 0.3, 400)[:, None], (400, 500))
    want = [np.flatnonzero(row & (sizes > 0)) for row in index.box_distance(x) <= bound]
    measured, inner = [], neighbours.Index.box_distance

    def counted(self, x, cells=slice(None)):
        out = inner(self, x, cells)
        measured.append(out.size)
        return out

    monkeypatch.setattr(neighbours.Index, "box_distance", counted)
    got = index.near_cells(x, bound)
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    assert sum(measured) < 400 * 500 / 4


def test_dbscan_block_links_as_all_pairs():
    draw = np.random.default_rng(5)
    x = np.round(draw.uniform(0, 20, size=(600, 2)), 1)
    queries, points = _block(x)
    points["pid"] = np.arange(600)
    edges = clusters._forest(0.5)(queries, points)
    parent = np.arange(600)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.5
    for a, b in zip(*np.nonzero(close)):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = [root(i) for i in range(600)]
    parent = np.arange(600)
    for a, b in zip(edges.src, edges.dst):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(i) for i in range(600)] == want


def test_bins_are_found_by_halving(spark):
    cuts = [float(v) for v in range(63)] + [5.0]
    values = [None, float("nan"), -1.0, 0.0, 0.5, 5.0, 5.1, 61.0, 62.0, 99.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(association._bin_of(F.col("v"), cuts)).collect()
    assert [r[0] for r in rows] == [None, 63, 0, 0, 1, 5, 6, 61, 62, 63]
    few = df.select(association._bin_of(F.col("v"), [5.0])).collect()
    assert [r[0] for r in few] == [None, 1, 0, 0, 0, 0, 1, 1, 1, 1]

    class Counted:
        compared = 0

        def __gt__(self, other):
            Counted.compared += 1
            return F.lit(True)

        def isNotNull(self):
            return F.lit(True)

    # Every cut point is written once, and lies on few paths.
    shown = str(association._bin_of(Counted(), cuts))
    assert Counted.compared == 63 and "+" not in shown


def test_neighbour_radii_are_worked_out_once(spark):
    df = spark.createDataFrame([(float(i * i % 37), "ab"[i % 2]) for i in range(60)], "v double, y string")
    found = association.information_nearest(df, "y", ["v"])
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert found.first().mutual_info >= 0


def test_brackets_of_many_quantiles_are_read_in_numpy(spark, monkeypatch):
    """A condition of thirty brackets is more than the JVM compiles."""
    groups, gathered = [], ordering._gathered
    monkeypatch.setattr(ordering, "_gathered", lambda table, group: groups.append(len(group)) or gathered(table, group))
    values = [float(i * i % 1009) if i % 7 else None for i in range(1500)]
    df = spark.createDataFrame([(v, -v if v is not None else float("nan")) for v in values], "a double, b double")
    shares = [j / 19 for j in range(20)]
    found = ordering.exact_quantiles(df, ["a", "b"], shares, one_pass_rows=0)
    kept = np.array([v for v in values if v is not None])
    assert found["a"] == pytest.approx(np.quantile(kept, shares)) and found["b"] == pytest.approx(np.quantile(-kept, shares))
    assert groups and max(groups) <= 30
