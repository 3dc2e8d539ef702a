import re

import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash
from gridloom.llm.components import components
from gridloom.llm.queries import QUERIES


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, budget=4):
    """Smallest index reachable of every fingerprint."""
    values = np.array(prints, np.uint64)
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= budget):
            a, b = group[i], group[j]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op9_simhash_duplicates"](spark, sf).collect()}
    prints = [brute_print(r.text) for r in rows]
    groups = brute_groups(prints)
    assert len(got) == len(rows)
    for row, value, g in zip(rows, prints, groups):
        assert got[row.doc_id].fingerprint == f"{value:016x}"
        assert got[row.doc_id].component_id == rows[g].doc_id
    assert len(set(groups)) < len(rows)


@pytest.mark.parametrize("leaf", [1, 2, 8])
def test_trie_finds_every_component(leaf):
    rng = np.random.default_rng(leaf)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [s ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 4)))) for s in seeds for _ in range(15)]
    low = [np.uint64(x) for x in (0, 1, 2, 3, 5, 15, 31, 2**64 - 1, 2**63)]
    values = np.unique(np.r_[seeds, near, low].astype(np.uint64))
    a, b = simhash.trie_links(values, None, 0, 0, 4, leaf)
    assert (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= 4).all()
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    forest = simhash.Forest(len(values))
    used = forest.join(np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b]))
    assert len(used) == len(a) < len(values)
    roots = forest.find(np.arange(len(values)))
    want = brute_groups(values)
    assert len(set(roots)) == len(set(want)) == len(set(zip(roots, want)))


def test_shared_levels_and_odd_rows(spark):
    texts = ["", None, "  \n", "one two", "One TWO", "a b c d e f g", "x " * 3000, "É a b c", "é a b c", "w" * 100_000]
    rows = [(i if i != 1 else None, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        assert by_id[i if i != 1 else None].fingerprint == f"{brute_print(t):016x}"
    assert by_id[None].component_id == by_id[2].component_id == 0
    assert by_id[4].component_id == 3
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_depth_does_not_change_links(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(-(2**63), 2**63 - 1, 300)
    values = sorted({int(s ^ (1 << int(b)) ^ (1 << int(c))) for s in seeds for b, c in rng.integers(0, 63, (5, 2))})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute_groups([v % 2**64 for v in values])
    for subtrie in (10**6, 40):
        found = {r.id: r.component for r in components(simhash.near_links(df, len(values), 4, subtrie)).collect()}
        groups = [found.get(v, v) for v in values]
        assert len(set(groups)) == len(set(want)) == len(set(zip(groups, want)))
