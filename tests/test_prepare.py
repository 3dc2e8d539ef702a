import numpy as np
import pytest

from gridloom.operators import metrics, neighbours, quality, split, sums
from gridloom.operators import oversample as oversampling
from gridloom.operators.models import bayes
from gridloom.operators.models.base import Training
from gridloom.operators.oversample import oversample
from gridloom.operators.prepare import (
    Preparation,
    fit_preparation,
    resolve_config,
    select_features,
    split_names,
)
from gridloom.sources import tables


def arrays(preparation, df):
    return np.array([r.x for r in preparation.transform(df).collect()])


def test_config_falls_back():
    config = resolve_config({"scaling": "odd", "numeric_outliers": 3, "numeric_bins": [{"n_bins": 4}, {"column": "a", "strategy": "odd"}]})
    assert (config.scaling, config.numeric_outliers) == ("auto", "none")
    assert [(b.column, b.n_bins, b.strategy) for b in config.numeric_bins] == [("a", 5, "quantile")]


def test_feature_selection_errors(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, y int")
    assert select_features(df, "y", ["b", "a"], ["b"]) == ["b", "a"]
    assert select_features(df, None, None, ["a"]) == ["b", "y"]
    with pytest.raises(ValueError, match="Unknown feature"):
        select_features(df, "y", ["c"])
    with pytest.raises(ValueError, match="must not include"):
        select_features(df, "y", ["y"])
    with pytest.raises(ValueError, match="exclude_columns"):
        select_features(df, None, None, ["c"])
    with pytest.raises(ValueError, match="left after"):
        select_features(df, None, None, ["a", "b", "y"])
    assert split_names("a, b;c\n d ,") == ["a", "b", "c", "d"]


@pytest.mark.parametrize("mode,expected", [("standard", 0.0), ("minmax", 0.0), ("robust", 0.0), ("none", 3.0)])
def test_constant_columns_scale(spark, mode, expected):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "a double")
    prepared = fit_preparation(df, ["a"], resolve_config({"scaling": mode}))
    assert arrays(prepared, df).ravel().tolist() == [expected] * 3


def test_unseen_levels_and_roundtrip(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", None)], "t string, v double")
    new = spark.createDataFrame([("c", 5.0), (None, None)], "t string, v double")
    prepared = fit_preparation(train, ["t", "v"], resolve_config({}))
    assert prepared.feature_names == ["v", "t"]
    assert arrays(prepared, new).tolist() == [[5.0, -1.0], [1.5, 0.0]]
    again = Preparation.from_dict(prepared.to_dict())
    assert arrays(again, new).tolist() == arrays(prepared, new).tolist()


def test_bins_need_numbers(spark):
    df = spark.createDataFrame([("a", 1.0)], "t string, v double")
    with pytest.raises(ValueError, match="not numeric"):
        fit_preparation(df, ["t", "v"], resolve_config({"numeric_bins": [{"column": "t"}]}))


def test_split_is_stable_and_exact(spark, monkeypatch):
    rows = [(i, "a" if i % 10 else "b", float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, y string, v double")
    train, test = split.train_test_split(df, "y", 0.25)
    ids = sorted(r.id for r in test.collect())
    assert len(ids) == 125 and test.filter("y = 'b'").count() in (12, 13)
    assert sorted(r.id for r in train.collect()) == sorted(set(range(500)) - set(ids))
    other = split.train_test_split(df.repartition(9), "y", 0.25)[1]
    assert sorted(r.id for r in other.collect()) == ids
    monkeypatch.setattr(split, "SELECT_ROWS", 5)
    stepped = split.train_test_split(df, "y", 0.25)[1]
    assert sorted(r.id for r in stepped.collect()) == ids


def test_split_spreads_ten_distinct_rows(spark):
    rows = [(i, "a" if i % 2 else "b") for i in range(10) for _ in range(400)]
    df = spark.createDataFrame(rows, "v int, y string")
    train, test = split.train_test_split(df, "y", 0.2)
    counts = {r.v: r["count"] for r in test.groupBy("v").count().collect()}
    assert sum(counts.values()) == 800 and set(counts) == set(range(10))
    assert all(40 <= n <= 120 for n in counts.values())
    again = split.train_test_split(df.repartition(7), "y", 0.2)[1]
    assert {r.v: r["count"] for r in again.groupBy("v").count().collect()} == counts


def test_split_does_not_depend_on_how_copies_are_found(spark, monkeypatch):
    rows = [(i % 70, "a" if i % 3 else None) for i in range(200)] + [(900 + i, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "v int, c string")
    found = []
    for most in (200_000, 0):
        monkeypatch.setattr(split, "BROADCAST_ROWS", most)
        _, test = split.train_test_split(df, "v", stratify=False)
        found.append(sorted(map(str, test.collect())))
    assert found[0] == found[1] and len(found[0]) == 52


def test_split_divides_copies(spark, monkeypatch):
    monkeypatch.setattr(split, "_CHUNK", 7)
    df = spark.createDataFrame([(1, "a")] * 90 + [(2, "b")] * 10, "v int, y string")
    train, test = split.train_test_split(df, "y", 0.2)
    assert (train.count(), test.count()) == (80, 20)
    assert test.filter("y = 'b'").count() == 2
    single = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "v int, y string")
    train, test = split.train_test_split(single, "y", 0.2)
    assert (train.count(), test.count()) == (16, 4)


def test_oversample(spark):
    rows = [(float(i), float(i % 5), "big") for i in range(40)] + [(100.0 + i, 1.0, "small") for i in range(6)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    made = oversample(df, "y", ["a", "b"])
    assert {r.y: r["count"] for r in made.groupBy("y").count().collect()} == {"big": 40, "small": 40}
    low, high = made.filter("y = 'small'").selectExpr("min(a)", "max(a)").first()
    assert low >= 100 and high <= 105
    lone = df.filter("y = 'big'").unionByName(df.filter("y = 'small'").limit(1))
    with pytest.raises(ValueError, match="at least 2"):
        oversample(lone, "y", ["a", "b"])
    gaps = df.unionByName(spark.createDataFrame([(None, 1.0, "big")], df.schema))
    with pytest.raises(ValueError, match="NaN"):
        oversample(gaps, "y", ["a", "b"])


def test_oversample_text(spark):
    rows = [(float(i), "u" if i % 2 else "v", "big") for i in range(30)]
    rows += [(float(i), "w", "small") for i in range(4)]
    made = oversample(spark.createDataFrame(rows, "a double, t string, y string"), "y", ["a", "t"])
    small = made.filter("y = 'small'")
    assert small.count() == 30 and [r.t for r in small.select("t").distinct().collect()] == ["w"]


def test_oversample_any_number_of_levels(spark):
    rows = [(float(i), "big", f"t{i}") for i in range(3000)] + [(5000.0 + i, "small", f"s{i // 3:04d}") for i in range(2100 * 3 // 3)]
    made = oversample(spark.createDataFrame(rows, "a double, y string, t string"), "y", ["a", "t"])
    small = made.filter("y = 'small'")
    assert small.count() == 3000 and small.filter("t not like 's%'").count() == 0 and small.select("t").distinct().count() <= 700


def test_oversample_hot_position(spark, monkeypatch):
    monkeypatch.setattr(oversampling, "CHUNK", 10)
    rows = [(float(i), "x", "big") for i in range(200)] + [(1.5, "m", "small")] * 9 + [(9.5, "n", "small")]
    made = oversample(spark.createDataFrame(rows, "a double, t string, y string"), "y", ["a", "t"])
    small = made.filter("y = 'small'").collect()
    assert len(small) == 200 and all(1.5 <= r.a <= 9.5 and r.t in "mn" for r in small)
    assert len({r.a for r in small}) > 50


def test_mixed_distance(spark):
    draw = np.random.default_rng(1)
    x = np.column_stack([draw.normal(size=(300, 2)), draw.integers(0, 40, 300) * 0.02])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    index = neighbours.build_index(neighbours.distinct_points(df), (2, 0.7))
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "qid bigint, x array<double>")
    for r in neighbours.nearest(index, queries, 4).collect():
        gap = x - x[r.qid]
        want = np.sort(np.sqrt((gap[:, :2] ** 2).sum(1) + 0.49 * (gap[:, 2] != 0)))[:4]
        assert [e.distance for e in r.near] == pytest.approx(want.tolist(), abs=1e-12)


def test_macro_f1_counts_absent_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "b")], "label string, prediction string")
    row = metrics.classification_metrics(metrics.confusion(df)).first()
    assert row.accuracy == pytest.approx(2 / 3)
    assert row.f1_macro == pytest.approx((2 / 3 + 1 + 0) / 3)


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,b,d,t,f\n1,True,2020-01-01,x,1.5\n,False,2020-01-02,NA,\n3,True,2020-01-03,y,nan\n")
    df = tables.load_csv(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "b": "boolean", "d": "string", "t": "string", "f": "double"}
    assert df.filter("t is null").count() == 1 and df.filter("f is null").count() == 2
    assert tables.check_csv(spark, str(path)) == ["i", "b", "d", "t", "f"]
    assert tables.approximate_rows(spark, str(path)) == 3
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    with pytest.raises(ValueError, match="no data rows"):
        tables.load_csv(spark, str(empty))
    with pytest.raises(ValueError, match="Could not read CSV"):
        tables.load_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Upload"):
        tables.check_csv(spark, "a.txt")


def test_json_rows(spark, tmp_path):
    schema = spark.createDataFrame([(1, "a")], "n bigint, t string").schema
    made = tables.rows_to_table(spark, [{"n": 2, "t": "b", "extra": 1}], schema)
    assert [tuple(r) for r in made.collect()] == [(2, "b")]
    with pytest.raises(ValueError, match=r"Missing columns: \['t'\]"):
        tables.rows_to_table(spark, [{"n": 2}], schema)
    path = tmp_path / "r.json"
    path.write_text('[{"n": 1, "t": "a"}, {"n": 2}]')
    assert tables.load_json_rows(spark, str(path), schema).count() == 2


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('a,b\n"one\ntwo ""x""",1\nthree,2\n')
    rows = tables.load_csv(spark, str(path)).orderBy("b").collect()
    assert [(r.a, r.b) for r in rows] == [('one\ntwo "x"', 1), ("three", 2)]


def test_moments_keep_a_small_spread_of_large_values(spark):
    rows = [([1.7e9 + (i % 3), float(i)], float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "x array<double>, label double")
    found = sums.moments(df)
    assert abs(found.covariance[0, 0] - 2 / 3) < 1e-6
    counts, means, squares = bayes.class_sums(Training(df, 300, 2, 2), "diagonal")
    assert list(counts) == [150, 150] and abs(squares[0, 0] / 150 - 2 / 3) < 1e-6
    assert abs(means[0, 0] - 1.7e9 - 1) < 1e-6


def test_leakage_of_several_columns(spark):
    rows = [(i, i % 40, i % 7, f"c{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "row int, user_id int, other_id int, y string")
    assert [r.column for r in quality.leakage_hints(df, "y", "classification").collect()] == ["user_id"]
    both = {r.column: r.one_to_one for r in quality.one_to_one(df, ["user_id", "other_id"], "y").collect()}
    assert both == {"user_id": True, "other_id": False}
