import random
import re
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import lines


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def sign(hashes):
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def block_keys(names, common=()):
    """The blocks (number, words, signature) of every line."""
    out = []
    for name in names:
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in name.split(" ") if w not in common]
        blocks = [[h for h in hashes if h % 8 == b] for b in range(8)]
        out.append({(b, len(x), sign(x)) for b, x in enumerate(blocks) if len(x) > 1})
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(docs):
    """New text of every (id, text)."""
    nodes = {}
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            if normal(line):
                nodes.setdefault(normal(line), []).append((i if i is not None else -1, n, text))
    names = list(nodes)
    times = Counter(w for name, places in nodes.items() for w in name.split(" ") for _ in set(places))
    most = max(100, int(0.01 * sum(len(set(p)) for p in nodes.values())))
    group, keys = list(range(len(names))), block_keys(names, {w for w, n in times.items() if n > most})
    for a in range(len(names)):
        for b in range(a):
            if keys[a] & keys[b] and group[a] != group[b]:
                longer = max(len(names[a]), len(names[b]))
                if distance(names[a], names[b]) <= longer * 0.2 + 1e-9:
                    low, high = sorted((group[a], group[b]))
                    group = [low if g == high else g for g in group]
    keep = {}
    for g, name in zip(group, names):
        keep[g] = min(([keep[g]] if g in keep else []) + nodes[name], key=lambda p: p[:2])
    of = {name: keep[g] for g, name in zip(group, names)}
    return [
        text and "\n".join(x for n, x in enumerate(text.split("\n")) if not normal(x) or of[normal(x)][:2] == (i if i is not None else -1, n))
        for i, text in docs
    ]


@pytest.fixture(scope="module")
def corpus():
    random.seed(6)
    vocabulary = ["".join(random.choices("abcdefgh", k=random.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(random.choices(vocabulary, k=n))
    pool = [say(random.randint(1, 25)) for _ in range(40)]
    for base in [say(60) for _ in range(4)]:
        for _ in range(15):
            words = base.split()
            words[random.randrange(60)] = random.choice(vocabulary)
            pool.append(" ".join(words))
    pool += ["", "***", "A, b", "a b!", "b a"]
    docs = [(None, "A b\nx1"), (0, None), (1, ""), (2, "y y\n" * 3000 + pool[-8])]
    for i in range(60):
        docs.append((100 - i, "\n".join(random.choice(pool).capitalize() for _ in range(random.randint(1, 6)))))
    return docs


def test_against_brute_force(spark, corpus):
    rows = [*corpus, corpus[10]]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, id string")
    got = lines.deduplicate_lines(df).collect()
    want = brute(corpus)
    expected = sorted([(i, t) for (i, _), t in zip(corpus, want)] + [(corpus[10][0], want[10])], key=str)
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == expected
    for r, text in ((r, dict(corpus)[r.doc_id]) for r in got):
        assert r.n_lines == len((text or "").split("\n")) and r.n_lines - r.n_removed >= 0
    assert sum(r.n_removed for r in got) > 3000


def bit_distance(a, b):
    """Myers' edit distance with whole numbers as bit vectors."""
    where = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = mask, 0
    for c in b:
        eq = where.get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | ~(cross | up) & mask, up & cross
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & mask, fall << 1 & mask
        up, down = fall | ~(eq | down | rise) & mask, rise & (eq | down)
    return score


def test_recall_against_edit_similarity_alone(spark):
    """Lines of the table that share three words in a row, however often."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    every = [normal(x) for t in docs for x in t.split("\n") if normal(x)]
    names = sorted(set(every))
    runs = {}
    for i, name in enumerate(names):
        words = name.split(" ")
        for k in range(max(len(words) - 2, 1)):
            runs.setdefault(tuple(words[k : k + 3]), set()).add(i)
    pairs = {p for same in runs.values() if len(same) <= 400 for p in combinations(sorted(same), 2)}
    letters = [Counter(n) for n in names]
    near = []
    for i, j in pairs:
        budget = int(max(len(names[i]), len(names[j])) * 0.2 + 1e-9)
        if max((letters[i] - letters[j]).total(), (letters[j] - letters[i]).total()) <= budget and bit_distance(names[i], names[j]) <= budget:
            near.append((i, j))
    times = Counter(w for name in every for w in name.split(" "))
    keys = block_keys(names, {w for w, n in times.items() if n > max(100, int(0.01 * len(every)))})
    met = sum(bool(keys[i] & keys[j]) for i, j in near)
    assert len(near) > 300 and met >= 0.9 * len(near)


def test_bounds_of_the_edit_distance(spark):
    random.seed(9)
    rows = []
    for _ in range(400):
        a = "".join(random.choices("aeioudlmcnrst xyz", k=random.randint(1, 30)))
        b = "".join(random.choice("aenrst ") if random.random() < 0.15 else c for c in a if random.random() > 0.1) or "a"
        rows.append((a, b))
    df = spark.createDataFrame(rows, "x string, y string")
    sides = [c.alias(p + n) for p, t in (("l_", "x"), ("r_", "y")) for c, n in zip(lines.letter_counts(F.col(t)), ["n_chars", "c0", "c1", "c2", "c3"])]
    got = df.select("x", "y", *sides).withColumn("may", lines.may_be_similar("l_", "r_")).collect()
    near = [distance(r.x, r.y) <= max(len(r.x), len(r.y)) * 0.2 + 1e-9 for r in got]
    assert all(r.may for r, n in zip(got, near) if n) and sum(near) > 50 and not all(r.may for r in got)
    assert [bit_distance(r.x, r.y) for r in got] == [distance(r.x, r.y) for r in got]


@pytest.mark.parametrize("rounds,left", [(8, 0), (1, 2), (0, 0)])
def test_links_do_not_depend_on_the_rounds(spark, monkeypatch, rounds, left):
    random.seed(12)
    base = ["w%d" % i for i in range(40)]
    names = {" ".join(base)}
    while len(names) < 60:
        words = random.choice(sorted(names)).split(" ")
        words[random.randrange(8, 40)] = "v%d" % random.randrange(900)
        names.add(" ".join(words))
    names = sorted(names)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, text string")
    monkeypatch.setattr(lines, "ROUNDS", rounds)
    monkeypatch.setattr(lines, "PAIRS_LEFT", left)
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(df).collect()}
    assert got == dict(enumerate(brute(list(enumerate(names)))))


def test_lines_of_common_words_meet_their_near_copies(spark):
    """Lines that no block holds: common words alone, few words, few letters."""
    random.seed(21)
    common = ["river", "stone", "under", "green", "light", "winter", "seven", "paper", "north", "glass", "bread", "house"]
    filler = [" ".join(random.sample(common, 12)) + " tail%dx%d end%d" % (i, i * 7, i * 31) for i in range(150)]
    pairs = [
        ("river stone under green light winter seven paper north glass", "river stone under green light winter seven paper north bread"),
        ("house bread glass north paper seven winter light green under stone river", "house bread glass north paper seven winter light green under stone river river"),
        ("river paper river paper river paper river glass house " * 20, "river paper river paper river paper river glass house " * 20 + "stone"),
        ("seven winter green paper stone house under", "seven winter green paper stone under"),
        ("green house paper winter seven it on", "green house paper winter seven to an"),
        ("telescope marmalade", "telescope marmalades"),
        ("elephants", "elephamts"),
        ("abcdefghijkl", "abdefghijkml"),
        ("abcd", "abcde"),
    ]
    other = [("abcd", "abxd"), ("glass river", "house under"), ("telescope marmalade", "telescope orangepeel")]
    names = [n for pair in pairs + other for n in pair] + filler
    names = [normal(n) for n in dict.fromkeys(names)]
    words = Counter(w for n in names for w in n.split(" "))
    most = max(100, int(0.01 * len(names)))
    assert all(words[w] > most for w in common)
    bare = block_keys([normal(x) for pair in pairs for x in pair], set(common))
    assert not any(bare[i] & bare[i + 1] for i in range(0, len(bare), 2))
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    gone = {r.text for r in df.join(lines.deduplicate_lines(df).filter("n_removed > 0").select("doc_id"), "doc_id").collect()}
    for a, b in pairs:
        a, b = normal(a), normal(b)
        assert distance(a, b) <= max(len(a), len(b)) * 0.2 and (b in gone or a in gone)
    assert not gone & {"abxd", "house under", "telescope orangepeel"}
    assert not gone & set(filler)


def test_short_lines_meet_all_lines_within_their_budget(spark):
    random.seed(22)
    names = list({"".join(random.choices("ab", k=random.randint(1, 14))) for _ in range(400)})
    df = spark.createDataFrame([(n,) for n in names], "norm string")
    keys = {r.norm: set(r.k) for r in df.select("norm", lines.letter_keys(F.col("norm")).alias("k")).collect()}
    near = [(a, b) for a, b in combinations(names, 2) if distance(a, b) <= max(len(a), len(b)) * 0.2 + 1e-9]
    assert len(near) > 100 and all(keys[a] & keys[b] for a, b in near)


def test_only_lines_that_may_meet_one_without_a_block_have_keys(spark):
    """Long lines of many voting words hold no key; the others meet as before."""
    random.seed(23)
    common = ["river", "stone", "under", "green", "light", "winter", "seven", "paper", "north", "glass"]
    long = [" ".join("w%dx%d" % (i, j) for j in range(30)) for i in range(200)]
    base = [random.sample(common, 9) + ["only%d" % i] for i in range(20)]
    bare = [" ".join(ws) for ws in base] + [" ".join(ws[:-1] + ["other%d" % i]) for i, ws in enumerate(base)]
    ids = list(enumerate(long + bare))
    hashes = [h for (h,) in spark.createDataFrame([(w,) for w in common], "w string").select(F.xxhash64("w")).collect()]
    found = lines.word_keys(spark.createDataFrame(ids, "id long, norm string"), hashes).collect()
    rows = {r.id: r for r in found if r["keys"]}
    assert set(rows) == set(range(len(long), len(ids))) and all(r.rest for r in rows.values())
    table = spark.createDataFrame(ids, "id long, norm string")
    members = lines.rest_members(table, spark.createDataFrame([(w,) for w in common], "common string")).collect()
    keys = {}
    for r in members:
        keys.setdefault(r.id, set()).add(r.key)
    assert len(members) == len(set(members))
    assert all(keys[len(long) + i] & keys[len(long) + 20 + i] for i in range(20))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.deduplicate_lines(empty).count() == 0
