import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridloom.operators import eigen, merging, neighbours, prepare, sums
from gridloom.operators.components import connected_components
from gridloom.operators.models import anomalies, base, bayes, clusters, decomposition, linear, native, registry
from gridloom.operators.models.base import Training, apply_model
from gridloom.plans import training
from gridloom.sources import store


def rows_of(spark, x, y=None):
    rows = [(v.tolist(), float(y[i]) if y is not None else 0.0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "x array<double>, label double").repartition(3)


def task(spark, x, y=None, classes=0):
    return Training(rows_of(spark, x, y), len(x), x.shape[1], classes)


@pytest.fixture(scope="module")
def line():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 3))
    return x, x @ [1.0, -2.0, 0.5] + 3 + draw.normal(size=300)


def weights(fitted):
    if fitted.model is not None:
        return np.append(fitted.model.coefficients.toArray(), fitted.model.intercept)
    return np.append(np.ravel(fitted.params["weights"]), fitted.params["intercept"])


def penalised(x, y, alpha):
    gap = x - x.mean(0)
    w = np.linalg.solve(gap.T @ gap + alpha * np.eye(x.shape[1]), gap.T @ (y - y.mean()))
    return np.append(w, y.mean() - x.mean(0) @ w)


def test_lines_against_closed_forms(spark, line):
    x, y = line
    t = task(spark, x, y)
    for fit, alpha in ((native.ordinary, 0), (native.ridge, 1), (linear.least_squares, 0), (linear.sgd_regressor, 0.03)):
        assert weights(fit(t)) == pytest.approx(penalised(x, y, alpha), abs=1e-6)
    assert weights(native.lasso(t)) == pytest.approx(weights(linear.lasso_path_end(t)), abs=1e-4)
    for fit in (linear.bayesian_ridge, linear.relevance_regression, linear.consensus_regression, linear.spatial_median_regression, linear.median_regression):
        assert weights(fit(t)) == pytest.approx([1, -2, 0.5, 3], abs=0.5)
    assert np.count_nonzero(weights(linear.matching_pursuit(t))[:3]) == 1


def test_tweedie_reaches_its_optimum(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(200, 2))
    y = np.exp(x @ [0.4, -0.3] + 1) * draw.gamma(2, 0.5, 200)
    w = weights(linear.tweedie(task(spark, x, y)))
    mu = np.exp(x @ w[:2] + w[2])
    residual = (mu - y) * mu ** (1 - 1.5)
    # The gradient of mean deviance and ridge vanishes.
    assert np.append(x.T @ residual / 200 + w[:2], residual.mean()) == pytest.approx([0, 0, 0], abs=1e-5)


def test_classifiers_separate_groups(spark):
    draw = np.random.default_rng(4)
    y = np.arange(240) % 3
    x = draw.normal(size=(240, 2)) + np.array([[0, 0], [6, 0], [0, 6]])[y]
    t = task(spark, x, y, 3)
    for fit in (linear.ridge_classifier, linear.linear_support_classifier, linear.kernel_support_classifier, bayes.linear_discriminant, bayes.quadratic_discriminant, bayes.gaussian_bayes):
        hits = apply_model(fit(t), t.df).filter("label = prediction").count()
        assert hits > 228, fit
    for name in ("perceptron", "passive_aggressive_classifier", "extra_tree", "knn", "decision_tree"):
        fitted = registry.supervised(name, "classification")[1](t)
        assert apply_model(fitted, t.df).filter("label = prediction").count() > 220, name


def test_negative_values_fail_where_required(spark):
    x = np.array([[1.0, -1.0], [2.0, 1.0]])
    for fit in (native.naive_bayes("multinomial"), bayes.categorical_bayes):
        with pytest.raises(ValueError, match="Negative"):
            fit(task(spark, x, np.array([0, 1]), 2))
    with pytest.raises(ValueError, match="Negative"):
        decomposition.nmf(task(spark, x))


def brute(points, queries, k):
    gaps = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(2))
    return np.sort(gaps, axis=1)[:, :k]


@pytest.mark.parametrize("cell_points,block_rows", [(2000, 4000), (20, 7)])
def test_neighbours_are_exact(spark, monkeypatch, cell_points, block_rows):
    monkeypatch.setattr(neighbours, "CELL_POINTS", cell_points)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block_rows)
    draw = np.random.default_rng(7)
    # A crowded corner and many copies of one position.
    x = np.vstack([draw.normal(size=(150, 3)), draw.normal(size=(60, 3)) * 0.01 + 4, np.tile([[1.0, 1, 1]], (70, 1))])
    points = neighbours.distinct_points(rows_of(spark, x).select("x"))
    index = neighbours.build_index(points)
    assert index.cells == (1 if cell_points == 2000 else 16)
    queries = index.points.select(F.col("pid").alias("qid"), "x")
    found = neighbours.nearest(index, queries, 6).join(queries, "qid").collect()
    unique = np.unique(x, axis=0)
    assert len(found) == len(unique)
    for r in found:
        expected = brute(unique, np.array([r.x]), 6)[0]
        assert [e.distance for e in r.near] == pytest.approx(expected.tolist(), abs=1e-12)


@pytest.mark.parametrize("metric", ["euclidean", "maximum"])
def test_crowded_cells_are_cut(spark, monkeypatch, metric):
    for name, value in (("CELL_POINTS", 30), ("MAX_LEVELS", 1), ("CROWDED_POINTS", 25), ("BLOCK_ROWS", 10)):
        monkeypatch.setattr(neighbours, name, value)
    draw = np.random.default_rng(8)
    # Most positions differ in one axis of three, by whole numbers.
    x = np.vstack([draw.normal(size=(120, 3)), np.column_stack([np.ones(90), np.zeros(90), np.arange(90)]), np.tile([[5.0, 5, 5]], (40, 1))])
    index = neighbours.build_index(neighbours.distinct_points(rows_of(spark, x).select("x")), metric)
    assert index.part_cuts and max(r.n for r in index.parts.collect()) <= 25
    asked = np.vstack([draw.normal(size=(30, 3)) * 3, x[:20], [[100.0, -50, 3]]])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid bigint, x array<double>")
    found = {r.qid: [e.distance for e in r.near] for r in neighbours.nearest(index, queries, 7).collect()}
    gaps = np.abs(asked[:, None] - np.unique(x, axis=0)[None])
    gaps = gaps.max(2) if metric == "maximum" else np.sqrt((gaps**2).sum(2))
    for i, row in enumerate(np.sort(gaps, axis=1)[:, :7]):
        assert found[i] == pytest.approx(row.tolist(), abs=1e-12)


def test_work_of_a_query_does_not_follow_the_table(spark, monkeypatch):
    for name, value in (("CELL_POINTS", 40), ("MAX_LEVELS", 1), ("CROWDED_POINTS", 40)):
        monkeypatch.setattr(neighbours, name, value)
    draw = np.random.default_rng(5)
    compared = []
    for n in (500, 4000):
        index = neighbours.build_index(neighbours.distinct_points(rows_of(spark, draw.uniform(size=(n, 2))).select("x")))
        points = index.points.select(F.col("pid").alias("qid"), "x").withColumn("bound", F.lit(1 / np.sqrt(n)))
        near = neighbours.near_boxes(index, points, ["bound"], lambda bound: bound[:, None])
        pairs = near.join(index.parts.select("cell", "part", "n"), ["cell", "part"]).agg(F.sum("n")).first()[0]
        compared.append(pairs / n)
    assert compared[1] < 1.3 * compared[0]


def ward_labels(x, k):
    """Ward's clusters by merging the cheapest pair again and again."""
    cost = ((x[:, None] - x[None]) ** 2).sum(2) / 2
    np.fill_diagonal(cost, np.inf)
    size, label = np.ones(len(x)), np.arange(len(x))
    for _ in range(len(x) - k):
        a, b = np.unravel_index(np.argmin(cost), cost.shape)
        row = ((size[a] + size) * cost[a] + (size[b] + size) * cost[b] - size * cost[a, b]) / (size[a] + size[b] + size)
        row[[a, b]] = np.inf
        cost[a], cost[:, a] = row, row
        cost[b], cost[:, b] = np.inf, np.inf
        size[a] += size[b]
        label[label == b] = a
    return label.tolist()


def same_groups(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def labels_of(fitted, x, df):
    found = {tuple(r.x): r.prediction for r in apply_model(fitted, df).collect()}
    return [found[tuple(v)] for v in x]


@pytest.mark.parametrize("small", [2_000, 60])
def test_ward_clusters(spark, monkeypatch, small):
    monkeypatch.setattr(merging, "SMALL", small)
    if small < 100:
        for name, value in (("CELL_POINTS", 30), ("MAX_LEVELS", 1), ("CROWDED_POINTS", 40), ("BLOCK_ROWS", 25)):
            monkeypatch.setattr(neighbours, name, value)
    draw = np.random.default_rng(3)
    x = np.vstack([draw.normal(size=(100, 3)), draw.normal(size=(70, 3)) + 3, draw.normal(size=(30, 3)) * 4])
    t = task(spark, x)
    assert same_groups(labels_of(clusters.agglomerative(t), x, t.df), ward_labels(x, 8))


def test_equal_distances_merge_in_few_rounds():
    rows = [Row(pid=i, x=[float(i)], w=1.0) for i in range(512)]
    merges = merging._merge_small(rows)
    assert len(merges) == 511 and len({m[1] for m in merges}) == 511
    cost = np.sort([m[2] for m in merges])
    assert cost[0] == 0.5 and (cost[:150] == 0.5).all()


def test_micro_clusters_do_not_depend_on_the_partitions(spark):
    draw = np.random.default_rng(4)
    x = np.vstack([draw.normal(size=(300, 2)) * 2, draw.normal(size=(100, 2)) * 0.05 + 9])
    found = []
    for parts in (1, 7):
        t = task(spark, x)
        t = Training(t.df.repartition(parts), t.rows, t.d)
        found.append(sorted((round(r.w), [round(v, 9) for v in r.x]) for r in clusters.micro_clusters(t, 0.5).collect()))
    assert found[0] == found[1] and sum(w for w, _ in found[0]) == 400 and 10 < len(found[0]) < 300
    # Cells of a side of twice the radius over the root of the width.
    keys = np.floor(x * np.sqrt(2))
    cells, of = np.unique(keys, axis=0, return_inverse=True)
    want = sorted((int((of.ravel() == c).sum()), np.round(x[of.ravel() == c].mean(0), 9).tolist()) for c in range(len(cells)))
    assert [w for w, _ in want] == [w for w, _ in found[0]]
    assert np.sort([c for _, c in want], axis=0) == pytest.approx(np.sort([c for _, c in found[0]], axis=0), abs=1e-8)
    radius = [np.sqrt(((x[of.ravel() == c] - x[of.ravel() == c].mean(0)) ** 2).sum(1).mean()) for c in range(len(cells))]
    assert max(radius) <= 0.5
    labels = labels_of(clusters.birch(task(spark, x)), x, task(spark, x).df)
    assert len(set(labels)) == 8


def test_more_centres_than_travel_with_the_tasks(spark, monkeypatch):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 2)) * 2
    t = task(spark, x)
    few = labels_of(clusters.birch(t), x, t.df)
    monkeypatch.setattr(clusters, "CENTRES", 3)
    assert labels_of(clusters.birch(t), x, t.df) == few


def test_leading_vectors_and_rings(spark):
    draw = np.random.default_rng(3)
    angle, radius = draw.uniform(0, 2 * np.pi, 200), np.repeat([1.0, 3.0], 100)
    x = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]) + draw.normal(size=(200, 2)) * 0.03
    t = task(spark, x)
    edges = clusters.affinities(neighbours.distinct_points(t.df.select("x")), 10).collect()
    weights = np.zeros((200, 200))
    for e in edges:
        weights[e.src, e.dst] = weights[e.dst, e.src] = e.weight
    matrix = weights / np.sqrt(np.outer(weights.sum(1), weights.sum(1)))
    vectors, values = eigen.leading_vectors(eigen.normalised(spark.createDataFrame(edges))[0], 5)
    assert values == pytest.approx(np.linalg.eigvalsh(matrix)[::-1][:5], abs=1e-6)
    v = np.zeros((200, 5))
    for r in vectors.collect():
        v[r.id] = r.v
    assert np.abs(matrix @ v - v * values).max() < 1e-3 and np.abs(v.T @ v - np.eye(5)).max() < 1e-6
    labels = labels_of(clusters.spectral(t, groups=2), x, t.df)
    assert len(set(labels[:100])) == len(set(labels[100:])) == 1 and labels[0] != labels[150]


def test_theil_sen_and_ransac_with_outliers(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(400, 3))
    y = x @ [2.0, -1.0, 0.5] + 4 + draw.normal(size=400) * 0.05
    y[::7] += 60
    t = task(spark, x, y)
    for fit in (linear.spatial_median_regression, linear.consensus_regression):
        p = fit(t).params
        assert np.ravel(p["weights"]) == pytest.approx([2.0, -1.0, 0.5], abs=0.1) and p["intercept"] == pytest.approx(4, abs=0.3)
    lines = linear.subset_lines(t, 500)
    assert 400 <= lines.count() <= 500 and linear.subset_lines(t, 20).count() <= 20
    points = draw.normal(size=(300, 2)) * [1, 5] + 3
    middle = linear.spatial_median(rows_of(spark, points), 2, tolerance=1e-9)
    away = points - middle
    assert np.abs((away / np.sqrt((away**2).sum(1))[:, None]).sum(0)).max() < 1e-3


def test_envelope_with_many_outliers_in_one_place(spark):
    draw = np.random.default_rng(11)
    x = np.vstack([draw.normal(size=(420, 3)), draw.normal(size=(180, 3)) * 0.3 + [6, 6, 0]])
    fitted = anomalies.elliptic_envelope(task(spark, x), contamination=0.3)
    assert np.abs(fitted.params["centre"]).max() < 0.3
    labels = labels_of(fitted, x, task(spark, x).df)
    assert all(v == -1 for v in labels[420:]) and sum(v == -1 for v in labels[:420]) <= 2


def test_mixture_starts_apart(spark):
    draw = np.random.default_rng(12)
    centres = draw.permutation([[10.0 * i, 10.0 * (i * 5 % 8)] for i in range(8)])
    x = np.vstack([c + draw.normal(size=(40, 2)) * (0.2 + 0.1 * i) for i, c in enumerate(centres)])
    t = task(spark, x)
    assert same_groups(labels_of(clusters.gaussian_mixture(t), x, t.df), np.repeat(np.arange(8), 40).tolist())


def test_clip_bounds_of_the_batch(spark):
    rows = [(float(i), "a") for i in range(20)] + [(500.0, "b")]
    df = spark.createDataFrame(rows, "v double, c string")
    fitted = prepare.fit_preparation(df, ["v", "c"], prepare.resolve_config({"numeric_outliers": "clip_iqr"}))
    one = df.filter("v = 500")
    first = lambda p, d: p.transform(d).first().x[0]
    assert first(fitted, one) < 50 and first(fitted.refitted_clips(one), one) == 500
    assert first(prepare.Preparation.from_dict(fitted.to_dict()).refitted_clips(one), one) == 500
    assert fitted.refitted_clips(df).to_dict() == fitted.to_dict()


def test_feature_groups(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(200, 8))
    x = base[:, np.arange(20) % 8] + draw.normal(size=(200, 20)) * 0.01
    fitted = decomposition.feature_agglomeration(task(spark, x))
    assert fitted.facts["feature_labels"] == [j % 8 for j in range(20)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i,) for i in list(range(21)) + [30, 31, 40]], "id bigint")
    found = {r.id: r.component for r in connected_components(nodes, edges).collect()}
    assert all(found[i] == 0 for i in range(21)) and found[31] == 30 and found[40] == 40


def test_dbscan_with_copies(spark):
    draw = np.random.default_rng(9)
    x = np.vstack([draw.normal(size=(40, 2)) * 0.1, draw.normal(size=(40, 2)) * 0.1 + 5, [[20.0, 20.0]], np.tile([[-9.0, 9.0]], (5, 1))])
    t = task(spark, x)
    found = {tuple(r.x): r.prediction for r in apply_model(clusters.dbscan(t), t.df).collect()}
    labels = [found[tuple(v)] for v in x]
    assert labels[80] == -1 and len(set(labels[:40])) == 1 and len(set(labels[40:80])) == 1
    assert labels[81] >= 0 and len({labels[0], labels[40], labels[81]}) == 3


def test_decompositions(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(200, 12)) @ draw.normal(size=(12, 12))
    t = task(spark, x)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    facts = decomposition.incremental_pca(t).facts
    assert facts["explained_variance_ratio_sum"] == pytest.approx(values[:10].sum() / values.sum())
    narrow = task(spark, x[:, :3])
    with pytest.raises(ValueError, match="at most the number of features"):
        decomposition.incremental_pca(narrow)
    parts = np.abs(draw.normal(size=(3, 5)))
    mixed = np.abs(draw.normal(size=(120, 3))) @ parts
    fitted = decomposition.nmf(task(spark, mixed))
    assert fitted.facts["reconstruction_error"] < 0.1 * np.linalg.norm(mixed)


def test_agglomerative_splits_centred_data(spark):
    x = np.random.default_rng(1).normal(size=(200, 2))
    t = task(spark, x - x.mean(0))
    assert apply_model(clusters.agglomerative(t), t.df).select("prediction").distinct().count() == 8


def test_training_guards(spark):
    df = spark.createDataFrame([(i, float(i), "a") for i in range(9)], "x int, label double, t string")
    with pytest.raises(ValueError, match="at least 10 rows"):
        training.train(df, "t", "lda")
    with pytest.raises(ValueError, match="not in dataset"):
        training.train(df, "nope")
    many = spark.createDataFrame([(i, f"c{i}") for i in range(401)], "a int, y string")
    with pytest.raises(ValueError, match="too many distinct classes"):
        training.train(many, "y", "lda")
    wide = spark.createDataFrame([(i, float(i)) for i in range(40)], "a int, y double")
    with pytest.raises(ValueError, match="classification only"):
        training.train(wide, "y", "lda")
    with pytest.raises(ValueError, match="SMOTE applies only"):
        training.train(wide, "y", "ridge", {"imbalance": "smote"})
    with pytest.raises(ValueError, match="At most 12"):
        training.compare(wide, "y", ["ridge"] * 13)
    with pytest.raises(ValueError, match="at least 5 rows"):
        training.fit_unsupervised(wide.limit(4), "clustering", "kmeans")


@pytest.mark.parametrize("algorithm", ["linear_regression", "knn", "decision_tree", "adaboost"])
def test_save_load_score(spark, tmp_path, algorithm, monkeypatch):
    from gridloom.operators.models import trees

    monkeypatch.setattr(trees, "BOOSTING_ROUNDS", 3)
    draw = np.random.default_rng(0)
    # Feature names that collide with internal column names.
    rows = [(float(v), "uv"[i % 2], float(2 * v + i % 2)) for i, v in enumerate(draw.normal(size=60))]
    df = spark.createDataFrame(rows, "x double, label string, y double")
    model = training.train(df, "y", algorithm)
    assert model.metadata["metrics"]["test_rows"] == 12 and len(model.metadata) == 13
    before = sorted(tuple(r) for r in training.score(model, df).collect())
    store.save_model(model, str(tmp_path / "m"), "d")
    loaded = store.load_model(spark, str(tmp_path / "m"))
    assert loaded.metadata["dataset_id"] == "d"
    after = sorted(tuple(r) for r in training.score(loaded, df).collect())
    assert np.allclose([r[3] for r in before], [r[3] for r in after])
    with pytest.raises(ValueError, match="Missing columns"):
        training.score(loaded, df.drop("x"))
    with pytest.raises(ValueError, match="missing"):
        store.load_model(spark, str(tmp_path / "none"))


def test_compare_marks_failures(spark, tmp_path):
    rows = [(float(i % 9), -float(i), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    runs = training.compare(df, "y", ["lda", "multinomial_nb", "lda", "gaussian_nb"])
    assert [(r["algorithm_id"], r["status"]) for r in runs] == [("lda", "completed"), ("multinomial_nb", "failed"), ("gaussian_nb", "completed")]
    store.log_runs(store.run_rows(spark, runs, "d"), str(tmp_path / "log"))
    lines = {r.algorithm_id: r for r in store.read_runs(spark, str(tmp_path / "log")).collect()}
    assert lines["lda"].metric_line.startswith("acc ") and lines["multinomial_nb"].metric_line == "—"
    with pytest.raises(ValueError, match="Unknown job"):
        store.read_runs(spark, str(tmp_path / "log"), "nope")


def test_smote_training_and_classes(spark):
    rows = [(float(i), float(i % 7), "small" if i % 10 == 0 else "big") for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    model = training.train(df, "y", "lda", {"imbalance": "smote"})
    assert model.metadata["metrics"]["train_rows"] == 144
    assert {r.prediction for r in training.score(model, df).collect()} <= {"big", "small"}


def test_labels_without_scoring(spark):
    draw = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v), float(w)) for v, w in draw.normal(size=(80, 2))], "a double, b double")
    model = training.fit_unsupervised(df, "clustering", "agglomerative")
    assert training.fitted_labels(model, df).count() == 80
    with pytest.raises(ValueError, match="score new rows"):
        training.score(model, df)


def test_leading_vectors_of_eigenvalues_close_to_one_take_few_products(spark, monkeypatch):
    # Eigenvalues of a ring of n: cos(2 pi k / n), each twice.
    n, made = 400, []
    edges = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst", "1D AS weight")
    times = eigen._times
    monkeypatch.setattr(eigen, "_times", lambda *a: made.append(1) or times(*a))
    vectors, values = eigen.leading_vectors(eigen.normalised(edges)[0], 3)
    assert values == pytest.approx([1.0] + [np.cos(2 * np.pi / n)] * 2, abs=1e-6)
    v = np.array([r.v for r in vectors.orderBy("id").collect()])
    moved = (np.roll(v, 1, 0) + np.roll(v, -1, 0)) / 2
    assert np.sqrt(((moved - v * values) ** 2).sum(0)).max() < 3e-4 and len(made) <= 220


def test_packed_rows_give_sums_and_exact_quantiles(spark):
    draw = np.random.default_rng(3)
    x = np.vstack([draw.normal(size=(700, 2)) * 1e-9, draw.normal(size=(500, 2)) * 1e12, np.zeros((301, 2))])
    t = task(spark, x, np.arange(len(x), dtype=float))

    def scores(x, y):
        return np.column_stack([x[:, 0], np.where(y % 3 == 0, np.nan, -x[:, 1]), np.full(len(x), np.nan)])

    with sums.PackedRows(t.df, ["x", "label"], 2) as rows:
        total = rows.sum(lambda x, y: np.array([len(x), y.sum(), *x.sum(0)]), 4)
        found = {p: rows.quantile(scores, 3, p) for p in (0.0, 0.25, 0.9371, 1.0)}
    y = np.arange(len(x))
    assert total == pytest.approx([len(x), y.sum(), *x.sum(0)])
    for p, (a, b, none) in found.items():
        assert a == pytest.approx(np.quantile(x[:, 0], p), rel=1e-12)
        assert b == pytest.approx(np.quantile(-x[y % 3 != 0, 1], p), rel=1e-12) and none is None


def test_models_of_many_passes_pack_their_rows_once(spark, monkeypatch):
    made = []
    start = sums.PackedRows.__init__
    monkeypatch.setattr(sums.PackedRows, "__init__", lambda self, *a: made.append(1) or start(self, *a))
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 2))
    t = task(spark, x, x @ [1.0, 2.0] + draw.normal(size=300))
    for fit in (linear.median_regression, linear.linear_support_regression, anomalies.elliptic_envelope):
        made.clear()
        fit(t)
        assert made == [1]


def test_topics_do_not_depend_on_how_rows_are_dealt(spark):
    """Every round sums over all rows: groups of features come out as topics."""
    rng = np.random.default_rng(5)
    shares = np.repeat(np.eye(3), 4, axis=1) / 4
    counts = [[float(v) for v in rng.multinomial(40, shares[i % 3])] for i in range(60)] + [[0.0] * 12]
    df = spark.createDataFrame([(c,) for c in counts], "x array<double>")
    found = []
    for parts in (1, 5):
        model = decomposition.topics(Training(df.repartition(parts), len(counts), 12))
        rows = apply_model(model, df).collect()
        found.append(np.array([r.embedding for r in rows]))
    np.testing.assert_allclose(found[0], found[1], atol=1e-6)
    assert np.allclose(found[0][:-1].sum(1), 1) and not found[0][-1].any()
    # Rows of different groups share next to nothing; those of a group the same topics.
    alike = found[0][:-1] @ found[0][:-1].T
    groups = np.arange(60) % 3
    same = groups[:, None] == groups[None]
    assert alike[same].mean() > 2 * alike[~same].mean()


def test_failing_metrics_end_the_run(spark, monkeypatch):
    def failing(fitted, df):
        return df.withColumn("prediction", F.raise_error(F.lit("no labels")).cast("double")).withColumn("score", F.lit(0.0))

    monkeypatch.setitem(base.SCORERS, "failing", failing)
    t = task(spark, np.arange(12.0).reshape(6, 2))
    for family in ("clustering", "anomaly"):
        with pytest.raises(Exception, match="no labels"):
            training.unsupervised_metrics(base.Fitted("failing"), t, family)
