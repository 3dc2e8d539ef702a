import numpy as np
import pytest

from gridloom.operators import association, charts, describe, quality, target
from gridloom.operators import ordering
from gridloom.operators.value_counts import value_counts
from gridloom.plans.profile import profile
from gridloom.functions.columns import missing_as_null


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("levels,task", [(20, "classification"), (21, "regression")])
def test_task_inference_boundary(spark, levels, task):
    df = frame(spark, [(i % levels, True) for i in range(60)], "y int, b boolean")
    assert target.infer_task(df, "y") == task
    assert target.infer_task(df, "b") == "classification"


def test_quantiles_by_brackets_match_numpy(spark, monkeypatch):
    draw = np.random.default_rng(1)
    # A third of the rows share one value.
    values = np.concatenate([draw.normal(size=2000), np.full(1000, 0.25), draw.exponential(size=77)])
    df = frame(spark, [(float(v),) for v in values], "v double").repartition(5)
    monkeypatch.setattr(ordering, "BRACKET_VALUES", 40)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.66, 0.99, 1.0]
    found = ordering.exact_quantiles(df, ["v"], probabilities, one_pass_rows=10)["v"]
    assert np.allclose(found, np.quantile(values, probabilities), rtol=0, atol=1e-15)
    assert found == pytest.approx(ordering.exact_quantiles(df, ["v"], probabilities)["v"])


def test_positions_do_not_depend_on_partitions(spark):
    df = frame(spark, [(i * 37 % 101, 1 + i % 3) for i in range(101)], "k int, w int")
    for parts in (1, 7):
        rows = ordering.with_positions(df.repartition(parts), ["k"], "w").orderBy("k").collect()
        assert [r.position for r in rows] == list(range(101))
        assert [r.upto for r in rows] == list(np.cumsum([r.w for r in rows]))


def test_missing_kinds_and_nulls(spark):
    rows = [(1, "nan", True, float("nan")), (None, None, None, 0.0), (1, "b", False, None)]
    df = missing_as_null(frame(spark, rows, "a int, b string, c boolean, d double"))
    missing = {r.column: r.missing_count for r in describe.missing_counts(df).collect()}
    assert missing == {"a": 1, "b": 1, "c": 1, "d": 2}
    counts = value_counts(df)
    top = describe.categorical_summary(counts, ["b", "c"]).collect()
    assert sorted(r.value for r in top if r.column == "b") == ["(null)", "(null)", "b"]
    assert sorted(r.value for r in top if r.column == "c") == ["(null)", "False", "True"]
    summary = {e["column"]: e for e in describe.numeric_summary(df)}
    assert summary["d"]["zero_pct"] == 100.0 and summary["d"]["non_null_count"] == 1
    empty = frame(spark, [(None,)], "z double")
    assert describe.numeric_summary(empty)[0]["note"] == "no_numeric_values"


def test_outlier_notes(spark):
    rows = [(float(i), 5.0, float(i) if i < 9 else None) for i in range(19)] + [(500.0, 5.0, None)]
    df = frame(spark, rows, "a double, b double, c double")
    found = {e["column"]: e for e in describe.outlier_shares(df)}
    assert found["a"]["iqr_outlier_pct"] == 5.0
    assert found["b"] == {"column": "b", "iqr_outlier_pct": 0.0, "note": "zero_iqr"}
    assert found["c"]["note"] == "too_few_values"


def test_wide_correlations_equal_native(spark):
    draw = np.random.default_rng(0)
    table = draw.normal(size=(200, 5)) + 1e4
    table[:, 4] = 3.0
    rows = [tuple(None if (i + j) % 11 == 0 else float(v) for j, v in enumerate(r)) for i, r in enumerate(table)]
    df = frame(spark, rows, ", ".join(f"c{j} double" for j in range(5)))
    columns = df.columns
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    native, wide = association._native_pairs(df, pairs), association._wide_pairs(df, columns)
    for pair in pairs:
        assert native[pair][0] == wide[pair][0]
        if "c4" in pair:
            assert wide[pair][1] is None
        else:
            assert wide[pair][1] == pytest.approx(native[pair][1], abs=1e-9)


@pytest.mark.parametrize("levels,n,flagged", [(24, 40, False), (25, 40, True), (49, 500, False), (50, 79, True), (50, 500, True), (80, 5000, True)])
def test_high_cardinality(spark, levels, n, flagged):
    df = frame(spark, [(f"v{i % levels}",) for i in range(n)], "t string")
    assert describe.high_cardinality_columns(df, value_counts(df)).count() == int(flagged)


def test_id_like_and_constant(spark):
    rows = [(i if i < 97 else 0, "k", None, i % 2 == 0) for i in range(100)]
    df = frame(spark, rows, "a int, b string, c int, d boolean")
    counts = value_counts(df)
    assert [r.column for r in describe.id_like_columns(df, counts).collect()] == ["a"]
    assert [tuple(r) for r in describe.constant_columns(counts).collect()] == [("b", "k")]


def test_duplicates_count_nulls_as_equal(spark):
    rows = [(1, None), (1, None), (None, "a"), (None, "a"), (None, "a"), (2, "b")]
    assert quality.duplicate_rows(frame(spark, rows, "a int, b string")).first()[0] == 3


@pytest.mark.parametrize("rows,levels,hit", [(30, 3, 1), (29, 3, 0), (30, 2, 0)])
def test_leakage(spark, rows, levels, hit):
    df = frame(spark, [(i % levels, f"c{i % levels}") for i in range(rows)], "user_id int, y string")
    assert quality.leakage_hints(df, "y", "classification").count() == hit
    assert quality.leakage_hints(df, "y", "regression").count() == 0


@pytest.mark.parametrize("name,label", [("my uuid", "uuid_or_guid"), ("row_id", "row_or_record_id"), ("user_id", "suffix_id"), ("the id", "id_token"), ("index", "index_like"), ("created_on", "datetime_like"), ("value", None)])
def test_name_patterns(name, label):
    assert quality.name_pattern(name) == label


def test_label_lengths(spark):
    rows = [("x" * n,) for n in (39, 40, 41, 63, 64, 65, 79, 80, 81)]
    df = frame(spark, rows, "t string")
    counts = value_counts(df)
    lengths = sorted(len(r.label) for r in charts.bars(counts).collect())
    assert lengths == [39, 40, 40, 40, 40, 40, 40, 40, 40]
    top = describe.categorical_summary(value_counts(df.filter("length(t) > 78")), ["t"])
    assert sorted(len(r.value) for r in top.collect()) == [78, 79, 80]
    one = describe.constant_columns(value_counts(df.filter("length(t) = 65"))).first()
    assert one.value_sample == "x" * 61 + "…"


@pytest.mark.parametrize("levels,bars", [(16, 16), (17, 17)])
def test_other_bar(spark, levels, bars):
    df = frame(spark, [(f"v{i % levels:02d}",) for i in range(100)], "t string")
    rows = charts.bars(value_counts(df)).orderBy("rank").collect()
    assert len(rows) == bars and sum(r.cnt for r in rows) == 100
    assert (rows[-1].label == "Other") == (levels == 17)


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(3).gamma(2.0, size=3000)
    df = frame(spark, [(float(v),) for v in values] + [(float("inf"),), (None,)], "v double")
    chart = charts.chart_documents(df, charts.spreads(df, ["v"]), [])["v"]
    edges = np.histogram_bin_edges(values, bins="auto")
    if len(edges) > 42:
        edges = np.histogram_bin_edges(values, bins=40)
    counts, _ = np.histogram(values, edges)
    assert [p["count"] for p in chart["points"]] == counts.tolist()
    assert len(chart["kde_x"]) == 96 and max(chart["kde_y"]) == pytest.approx(counts.max())
    few = frame(spark, [(1.0,), (2.0,)], "v double")
    assert charts.spreads(few, ["v"]) == {}
    flat = frame(spark, [(2.0,)] * 6, "v double")
    only = charts.chart_documents(flat, charts.spreads(flat, ["v"]), [])["v"]
    assert [p["count"] for p in only["points"]] == [6] and only["kde_x"] == []


def test_nearest_information_with_hot_values(spark):
    rows = [(0.0 if i % 3 == 0 else float(i), "a" if i % 2 else "b") for i in range(90)]
    df = frame(spark, rows, "x double, y string")
    found = association.information_nearest(df, "y", ["x"]).first().mutual_info
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    psi = lambda m: sum(1 / j for j in range(1, int(m))) - 0.5772156649015329
    total = psi(len(x)) + psi(3)
    for value, label in zip(x, y):
        gaps = np.sort(np.abs(x[y == label] - value))
        radius = gaps[3]
        inside = (np.abs(x - value) < radius).sum() if radius > 0 else (x == value).sum()
        total -= (psi((y == label).sum()) + psi(inside)) / len(x)
    assert found == pytest.approx(max(total, 0), abs=1e-9)


def test_profile_document(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").drop("o_orderdate")
    document = profile(df, target="o_orderstatus", order=["o_orderkey"])
    assert document["n_rows"] == df.count() and document["inferred_task"] == "classification"
    assert sum(document["class_distribution"].values()) == df.count()
    assert len(document["sample_rows"]) == 15
    assert document["distribution_charts"]["target"]["kind"] == "categorical"
    with pytest.raises(ValueError, match="is not in the CSV"):
        profile(df, target="nope")


def digamma_of(n):
    out = 0.0
    while n < 30:
        out, n = out - 1 / n, n + 1
    return out + np.log(n) - 1 / (2 * n) - 1 / (12 * n**2) + 1 / (120 * n**4)


def test_information_with_a_number_equals_all_pairs(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=250)
    y = x + draw.normal(size=250) * 0.3
    levels = draw.choice(["a", "b", "c"], 250)
    steps = draw.integers(0, 6, 250).astype(float)
    rows = [(float(a), float(b), str(c), float(d) if i % 9 else None) for i, (a, b, c, d) in enumerate(zip(x, y, levels, steps))]
    rows += [(1.0, None, "d", 2.0), *rows[:30], *rows[:30], *rows[:30], *rows[:5]]
    df = spark.createDataFrame(rows, "x double, y double, c string, s double")
    got = {r.column: r.mutual_info for r in association.information_continuous(df, "y", ["x", "c", "s"]).collect()}
    code = {"a": 0.0, "b": 1.0, "c": 2.0, "d": 3.0}
    for name, value in (("x", lambda r: r[0]), ("c", lambda r: code[r[2]]), ("s", lambda r: r[3])):
        both = np.array([(value(r), r[1]) for r in rows if r[1] is not None and value(r) is not None])
        both = both / both.std(0)
        gaps = np.abs(both[:, None] - both[None])
        away = gaps.max(2)
        np.fill_diagonal(away, np.inf)
        radius = np.sort(away, axis=1)[:, 2] * (1 - 1e-9)
        inside = (gaps <= radius[:, None, None]).sum(1)
        n = len(both)
        want = digamma_of(n) + digamma_of(3) - np.mean([digamma_of(a) + digamma_of(b) for a, b in inside])
        assert got[name] == pytest.approx(max(want, 0), abs=1e-9)
    assert got["x"] > 0.5
