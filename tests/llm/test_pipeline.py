import hashlib

import numpy as np
import public_tokenizers
import tokenizers

import corpus_pipeline
from tests.llm.test_decontaminate import distance
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_simhash import brute_groups, brute_print
from gridloom.llm.decontaminate import normal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EN = "the and of that with this have from there which would about their other"
DE = "der die das und nicht mit einen auch wird sich oder wenn haben aber"


def folder(spark, tmp_path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, gone_id int, id int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def made():
    rng = np.random.default_rng(4)
    say = lambda words, n: " ".join(rng.choice(words.split(), n))
    item = "which of these seven numbers is the largest one that divides both sides"
    docs = [(i, say(DE if i % 3 == 0 else EN, 40) + "\n" + say(EN, 30), "de" if i % 3 == 0 else "en", f"s{i % 2}") for i in range(30)]
    docs += [(30, docs[4][1], "en", "s0"), (31, docs[5][1] + "\nshort end", "en", "s0"), (32, say(EN, 20) + " " + item.upper() + " " + say(EN, 9), "en", None)]
    docs += [(33, "", "en", "s1"), (34, None, None, None), (35, "123 $$$", None, "zz"), (None, say(EN, 25), "en", "s1"), docs[7]]
    return [(*d, len(d[1] or ""), 1, 2) for d in docs], [(1, item), (2, None), (3, "")]


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = made()
    sf = folder(spark, tmp_path, rows, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(path := f"{tmp_path}/out{k}")
        docs = spark.read.parquet(path)
        after = docs.collect()
        kept.append(len(after))
        key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=str)
        if name == "language":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {34, 35}
            assert 35 not in {r.doc_id for r in after}
        elif name == "lines":
            single = list({(r.doc_id, r.text): r for r in before})
            want = dict(zip(single, brute_lines(single)))
            assert key(after) == sorted(((r.doc_id, want[(r.doc_id, r.text)]) for r in before), key=str)
            assert all(r.n_chars == len(r.text or "") for r in after)
        elif name == "near_duplicates":
            order = sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
            groups = brute_groups([brute_print(r.text) for r in order])
            assert key(after) == key(r for i, r in enumerate(order) if groups[i] == i)
        elif name == "decontamination":
            hit = {r.doc_id for r in before for _, t in items if normal(t or "") and distance(normal(t), normal(r.text or "")) <= int(len(normal(t)) * 0.05)}
            assert hit == {32} and key(after) == key(r for r in before if r.doc_id not in hit)
        else:
            tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes() for r in before}
            assert {r.doc_id: r.ids_sha256 for r in after} == {i: hashlib.sha256(x).hexdigest() for i, x in ids.items()}
        if k < 4:
            assert set(COLUMNS) <= set(docs.columns) and after[0].gone_id == 1
    assert kept[0] > kept[2] > kept[3] == kept[4]
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, after))


def test_empty_table(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
