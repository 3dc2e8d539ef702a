import random

from pyspark.sql import functions as F

from gridloom.llm import chat


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chats(chat.plain_turns(df))
    return out.select(
        "*",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.masked_text(F.col("formatted"), F.col("loss")).alias("masked"),
    ).collect()


def test_round_trip_of_control_strings(spark):
    random.seed(5)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "[TURN]", "[SEP]", "\\", "\\l", "\\e", "b", "é", "\n", "", "😀", "<", "["]
    rows = [
        (c, t, random.choice(["user", "assistant", "[SEP]x"]), "".join(random.choices(bits, k=random.randint(0, 9))), "x")
        for c in range(60)
        for t in range(random.randint(1, 7))
    ]
    got = {r.conv_id: r for r in chats(spark, rows)}
    for c in range(60):
        mine = sorted((t, role, x) for k, t, role, x, _ in rows if k == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(role, x) for _, role, x in mine]
        assert got[c].masked == "".join(x for _, role, x in mine if role == "assistant")
        text = got[c].formatted
        assert text.count("[TURN]") == len(mine) == text.count("[SEP]")
        assert text.count("</s>") == text.count("<s>") == 1


def test_nulls_ties_empty(spark):
    rows = [(None, None, None, None, "a"), (None, 1, "assistant", "x", "a"), (7, 2, "user", "b", "a"), (7, 2, "user", "b", "a"), (7, 2, "user", "a", "a"), (8, 0, "assistant", "é" * 100000, "a")]
    got = {r.conv_id: r for r in chats(spark, rows)}
    assert [(t.role, t.text) for t in got[None].turns] == [("", ""), ("assistant", "x")]
    assert [t.text for t in got[7].turns] == ["a", "b", "b"]
    assert got[7].masked == "" and len(got[8].masked) == 100000
    assert chats(spark, []) == []


def test_typed_parts(spark):
    def part(kind, text=None, ref=None, width=None, height=None, units=None):
        return (kind, text, ref, width, height, units)

    parts = [part("text", "see <s>"), part("image", ref="a[1].png", width=28, height=15), part("text", None),
             part("audio", ref=None, units=81), part("document", ref="d", units=3), part("odd", "t")]
    df = spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, "assistant", None)],
        f"conv_id long, turn long, role string, parts array<{chat.PART}>",
    )
    row = chat.format_chats(df).first()
    assert row.formatted == "<s>[TURN]user[SEP]see \\ls>[ATTACH image a\\b1].png][ATTACH audio ][ATTACH document d]t[TURN]assistant[SEP]</s>"
    assert [tuple(a) for a in row.attachments] == [("image", "a[1].png", 4), ("audio", None, 3), ("document", "d", 1536)]
    assert row.attachment_tokens == 4 + 3 + 1536
    assert [tuple(s) for s in row.loss] == [(len(row.formatted) - 4, 0)]
