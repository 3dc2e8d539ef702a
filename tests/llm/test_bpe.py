import hashlib
import random

import numpy as np
import public_tokenizers
import tokenizers

from gridloom.llm import bpe
from gridloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)


def test_whole_table_equals_the_library(spark, sf):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in QUERIES["op3_bpe_coding"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids, text = expected(tokenizer, row.text)
        assert got[row.doc_id].n_tokens == len(ids) // 4
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_texts(spark):
    random.seed(3)
    letters = [chr(c) for c in range(0x20, 0x250)] * 3
    letters += [chr(c) for c in range(0x250, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    letters += ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", " ", "\n", "İ", "ΑΣ", "aaaa"] * 80
    texts = ["", None, "a" * 5000, "ab" * 3000, " ", "́", "x" * 3 + "<|endoftext|>"] + [
        "".join(random.choice(letters) for _ in range(random.randint(1, 60))) for _ in range(2000)
    ]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[9]], "doc_id long, text string, ids string")
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    got = bpe.encode_and_decode(df, PATH).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert (bytes(row.ids), row.decoded) == expected(tokenizer, texts[row.doc_id or 0])
    assert bpe.encode_and_decode(df.limit(0), PATH).count() == 0


def test_a_task_takes_a_batch_in_small_parts(spark, monkeypatch):
    """Memory of a task follows the part, not the batch."""
    random.seed(4)
    texts = [" ".join("w%d" % random.randrange(10**6) for _ in range(200)) for _ in range(900)] + [None, "é" * 300_000]
    taken = []
    encode = bpe.Coder.encode
    monkeypatch.setattr(bpe.Coder, "encode", lambda self, part: taken.append(sum(len(t.encode()) for t in part)) or encode(self, part))
    monkeypatch.setattr(bpe, "_coder", lambda path, shipped: bpe.Coder(bpe.Vocabulary.read(PATH)))

    class Frame:
        """Runs the task's function here, over one batch."""

        def __init__(self, df):
            self.df, self.sparkSession, self.schema = df, df.sparkSession, df.schema

        def select(self, *columns):
            return Frame(self.df.select(*columns))

        def mapInArrow(self, work, schema):
            self.out = list(work([self.df.toArrow().combine_chunks().to_batches()[0]]))
            return self

        def withColumnRenamed(self, *_):
            return self.out

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = bpe.encode_and_decode(Frame(df), PATH)
    assert sum(taken) == sum(len((t or "").encode()) for t in texts)
    assert sorted(taken)[-2] <= 250_000 and max(taken) == 600_000
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    got = {i: (bytes(x), d) for b in out for i, x, d in zip(*(c.to_pylist() for c in b.columns))}
    assert [got[i] for i in range(len(texts))] == [expected(tokenizer, t) for t in texts]
