import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import spelling
from gridloom.llm.queries import QUERIES


def one_edit(word):
    """All strings with one letter less, which near words share or reach."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def brute(counts):
    """Near words by comparing through shortened forms; forms and roots."""
    less = {w: one_edit(w) for w in counts}
    holders = {}
    for w, shorter in less.items():
        for s in shorter:
            holders.setdefault(s, set()).add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for s in less[w]:
            if s in near:
                near[w].add(s)
                near[s].add(w)
            for v in holders[s]:
                if v != w and len(v) == len(w) and sum(a != b for a, b in zip(v, w)) == 1:
                    near[w].add(v)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def counted(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = found(QUERIES["op12_spelling_variants"](spark, sf))
    assert got == brute(counted(rows)) and any(v[0] for v in got.values())


@pytest.mark.parametrize("bounds", [{}, {"sample": 300, "cell": 40, "block_words": 25, "block_queries": 60}])
def test_dense_words_in_many_cells(spark, bounds):
    random.seed(5)
    words = {"".join(random.choice("abcdeé") for _ in range(random.choice([5, 5, 6, 7]))) for _ in range(1500)}
    words |= {"anagram", "nagaram", "x" * 40_000, "x" * 40_001, "x" * 39_999 + "y", "aaaaa", "aaaaaa", "aaaaaaa", "ÀÿÀÿÀ", "ÀÿÀÿ÷"}
    counts = {w: random.choice([3, 4, 8, 9, 20, 50]) for w in words}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, cell int")
    assert found(spelling.group_variants(df, **bounds)) == brute(counts)


def test_texts(spark):
    rows = [(1, "Straße straße STRAßE straßen straßen Straßen strasse"), (2, None), (None, "Éclair éclair Éclair Éclair eclair"), (2, ""), (3, "abcde " * 5 + "abcdX " * 3), (3, "abcde " * 5)]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, n long, word string")
    assert found(spelling.spelling_variants(df)) == brute(counted(rows))
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "a bc")], "doc_id long, text string")).count() == 0


def test_boxes_prune_and_lose_nothing():
    random.seed(6)
    words = sorted({"".join(random.choice("etaoinshrdlu") for _ in range(random.choice([6, 7, 8]))) for _ in range(3000)})
    vectors = spelling.Letters(words).vectors()
    tree = spelling.Tree(vectors, 24)
    low, high = spelling._box_arrays(len(tree.child))
    for leaf in tree.leaves:
        low[leaf], high[leaf] = vectors[tree.rows[leaf]].min(0), vectors[tree.rows[leaf]].max(0)
    tree.fit_boxes(low, high)
    assert (tree.place(vectors) == np.repeat(tree.leaves, [len(tree.rows[i]) for i in tree.leaves])[np.argsort(np.concatenate([tree.rows[i] for i in tree.leaves]))]).all()
    reached = sum(len(rows) for _, rows in tree.search(vectors, False))
    assert reached < 0.25 * len(words) * len(tree.leaves)
    pairs = {(words[q], words[p]) for q, p in ((q, p) for x, y in spelling.near_pairs(words, words, np.full(len(words), 3)) for q, p in zip(x.tolist(), y.tolist()))}
    want = brute(dict.fromkeys(words, 1))
    assert Counter(w for pair in {tuple(sorted(p)) for p in pairs} for w in pair) == {w: v[3] for w, v in want.items() if v[3]}
