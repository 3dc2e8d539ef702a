import itertools
import math

import numpy as np

from gridloom.llm import quality
from gridloom.llm.queries import QUERIES


def test_marginals_and_gradient_against_enumeration():
    rng = np.random.default_rng(0)
    x, weights = rng.normal(size=(7, 3)), rng.normal(size=3)
    table, per_text = rng.normal(size=(2, 2)), np.array([5, 2])
    p = quality.marginals(x, per_text, weights, table)[0]
    scores, want = x @ weights, []
    for begin, n in ((0, 5), (5, 2)):
        total, good = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(scores[begin + i] * s for i, s in enumerate(path)) + sum(table[a, b] for a, b in zip(path, path[1:])))
            total += w
            good += w * np.array(path)
        want += list(good / total)
    assert np.allclose(p, want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = [got[r.doc_id].predicted == r.quality for r in labels]
    print(len(right), sum(right))
    assert sum(right) >= 0.9 * len(right)
    pairs = [(got[a.doc_id].score > got[b.doc_id].score) for a in labels for b in labels if a.quality > b.quality]
    print(sum(pairs) / len(pairs))
    assert sum(pairs) >= 0.9 * len(pairs)


def test_odd_rows(spark):
    texts = ["", None, "\n\n", "A good line of words.\n$$$ %%% ***", "x " * 100_000, "one\n" * 50_000]
    rows = [(None if i == 1 else i, t, 0.5) for i, t in enumerate(texts)] + [(3, texts[3], 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (2, None), (4, 0), (77, 1)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].score == by_id[0].score and by_id[0].n_lines == 1 and by_id[5].n_lines == 50_001
    untrained = quality.score(df, quality.train(df, labels.limit(0)))
    assert {r.score for r in untrained.collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0
