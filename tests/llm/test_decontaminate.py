import random

from gridloom.llm import decontaminate
from gridloom.llm.queries import QUERIES


def distance(item, text):
    """Least edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_search_is_the_edit_distance():
    random.seed(2)
    for _ in range(300):
        item = "".join(random.choices("abc", k=random.randint(1, 12)))
        text = "".join(random.choices("abc", k=random.randint(0, 30)))
        assert decontaminate.search(decontaminate._letters(item), len(item), text)[0] == distance(item, text)


def edited(text, n):
    letters = list(text)
    for _ in range(n):
        at, kind = random.randrange(len(letters)), random.random()
        letters[at : at + (kind > 0.3)] = random.choice("xyz") if kind < 0.7 else ""
    return "".join(letters)


def test_against_brute_force(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [say(12) for _ in range(6)] + ["", None, "Ab  C", say(3)]
    items.append(items[0])
    texts = [None, "", "ab c", "xAB\n C d"]
    for i in range(60):
        inner = random.choice([t for t in items if t])
        texts.append(say(5) + " " + edited(inner, i % 6).replace(" ", "\n", i % 3).upper() + say(5))
    texts.append(say(20000) + items[1] + say(100))
    docs = [(None if i == 0 else i, t, 1) for i, t in enumerate(texts)] + [(7, texts[7], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = []
    for number, text, _ in docs:
        for k, item in enumerate(items):
            item = decontaminate.normal(item or "")
            if len(text or "") > 50000:
                if item and item in decontaminate.normal(text):
                    want.append((number, k, 0))
            elif item and (d := distance(item, decontaminate.normal(text or ""))) <= int(len(item) * 0.05):
                want.append((number, k, d))
    assert len(want) > 20
    for size in (10**6, 60):
        rows = decontaminate.contaminated(df, bench, block_chars=size).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == sorted(want)
        for r in rows:
            part = decontaminate.normal(texts[r.doc_id])[r.begin : r.end]
            assert distance(decontaminate.normal(items[r.item_id]), part) == r.distance
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_whole_table_holds_every_exact_passage(spark, sf):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert exact and exact <= got
