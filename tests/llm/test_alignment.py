import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import alignment
from gridloom.llm.queries import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain_letters():
    """Letter of each byte in byte-level files, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    """Groups by common ends and links by comparing all tokens of a text."""
    one, two = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters, out, corpus = plain_letters(), [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(raw.decode(), add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, two.id_to_piece(i)) for i in two.encode(text or ""))]
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a = b = []
        spans = [[], []]
        for side, tokens in enumerate((a, b)):
            at = 0
            for i, x in tokens:
                spans[side].append((i, at, at + len(x)))
                at += len(x)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= cut) for side in spans))
            low = cut
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        corpus.update(links)
        out.append((len(a), len(b), groups, links))
    best = {}
    for (_, j), n in corpus.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (n_a, n_b, len(g), len(x), sum(corpus[p] == best[p[1]] for p in x), sum(corpus[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, x in out
    ]


TEXTS = [
    "plain words, and numbers 12345", "  two  spaces\tand\n\nbreaks", "Ünïcödé ﬁ ½ – “quotes” 漢字 🙂🙃", "<|endoftext|> in a text <s>x</s> <0x41>",
    "", None, " ", "▁ mark", "a\x00b\x7f", "word " * 300, "x" * 700, "tie tie tie", "tie tie tie", "éa", " 　", "don't they'll I'M",
]


def rows_of(df):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


@pytest.mark.parametrize("most", [alignment.PAIR_ROWS, 40, 0])
def test_against_brute_force(spark, most):
    rows = [(i if i % 5 else None, t, 1, 2) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, pairs int")
    got = rows_of(alignment.align_and_score(df, A, B, most=most))
    assert sorted(map(str, got)) == sorted(str((i, *w)) for (i, *_), w in zip(rows, brute(TEXTS)))


def test_query_on_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = sorted(rows, key=lambda r: len(r.text))[:120]
    got = rows_of(QUERIES["op13_tokenizer_alignment"](spark, sf))
    assert len(got) == len(rows) and sum(g[5] <= g[4] for g in got) == len(got)
    # Counts over the corpus need all texts; the rest is held text by text.
    want = {r.doc_id: w for r, w in zip(short, brute([r.text for r in short]))}
    assert {g[0]: (*g[1:5], g[7]) for g in got if g[0] in want} == {i: (*w[:4], w[6]) for i, w in want.items()}


def test_texts_of_groups(spark):
    df = spark.createDataFrame([(1, "hello wide world")], "doc_id long, text string")
    row = alignment.align(df, A, B).first()
    sides = [g.split("|") for g in row.groups.split(";")]
    one, two = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    assert [int(i) for g in sides for i in g[0].split(",")] == one.encode(" hello wide world").ids
    assert [int(i) for g in sides for i in g[1].split(",")] == two.encode("hello wide world")
    assert sum(p.n for p in row.pairs) == row.n_links


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_and_score(df, A, B).count() == 0


spans = st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(spans, spans)
def test_coalesce_with_gaps(one, two):
    sides = []
    for side in (one, two):
        at, out = 0, []
        for gap, size in side:
            out.append((at + gap, at + gap + size))
            at += gap + size
        sides.append(out)
    arrays = [np.array([s[k] for s in side], np.int64) for side in sides for k in (0, 1)]
    ga, gb, i, j = alignment.coalesce(*arrays)
    links = {(x, y) for x, (s, e) in enumerate(sides[0]) for y, (u, v) in enumerate(sides[1]) if s < v and u < e}
    assert set(zip(i.tolist(), j.tolist())) == links and len(i) == len(links)
    assert all((ga[x] == gb[y]) for x, y in links)
    every = sorted([(s, e, ("a", k)) for k, (s, e) in enumerate(sides[0])] + [(s, e, ("b", k)) for k, (s, e) in enumerate(sides[1])])
    number, reach, want = -1, -1, {}
    for s, e, name in every:
        number += s >= reach
        reach = max(reach, e)
        want[name] = number
    assert [want["a", k] for k in range(len(ga))] == ga.tolist() and [want["b", k] for k in range(len(gb))] == gb.tolist()
