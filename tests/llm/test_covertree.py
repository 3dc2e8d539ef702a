import numpy as np
import pytest

from gridloom.llm import covertree


def brute(rows, queries, k):
    out = []
    data = {(i, tuple(v)) for i, v in rows}
    for q, v in {(i, tuple(v)) for i, v in queries}:
        scores = sorted((-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), i) for i, w in data if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_tree_covers_and_separates():
    points = np.random.default_rng(1).integers(-50, 50, (700, 5))
    tree = covertree.CoverTree(points, 8)
    assert sorted(tree.order) == list(range(700))
    for node, below in enumerate(tree.children):
        rows = tree.order[tree.begin[node] : tree.end[node]]
        assert (np.linalg.norm(points[rows] - points[tree.centre[node]], axis=1) <= tree.radius[node]).all()
        centres = points[[tree.centre[c] for c in below]]
        for i in range(len(centres)):
            for j in range(i):
                assert np.linalg.norm(centres[i] - centres[j]) > tree.radius[node] / 2 - 1e-6


@pytest.mark.parametrize("big", [60, 2**30, 2**40])
def test_blocks_copies_and_ties(spark, big):
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, (60, 4)) * (big // 3)
    rows = [(int(i), [int(x) for x in base[rng.integers(0, 60)]]) for i in rng.permutation(400)]
    rows += [(1000 + i, [int(x) for x in base[0]]) for i in range(100)]
    df = spark.createDataFrame([*rows, rows[3], (None, rows[0][1]), (5000, None)], "vec_id long, v array<long>")
    queries = df.filter("vec_id % 10 = 0")
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 7)
    for blocks in ((10**6, 10**6), (13, 9)):
        got = sorted(map(tuple, covertree.top_k(df, queries, 7, *blocks).collect()))
        if big < 2**40:
            assert got == want
        else:
            assert [g[3] for g in got] == [w[3] for w in want]


def test_few_rows_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0]), (20, [1.0, -0.01]), (3, None), (4, []), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [None, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    vectors = df.select("vec_id", covertree.whole_numbers("embedding").alias("v"), "rank")
    got = covertree.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 20, 32 * 64 - 64), (20, 1, 0, 32 * 64 - 64)]
    assert covertree.top_k(vectors.limit(0), vectors, 3).count() == 0
