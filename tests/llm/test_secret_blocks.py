import random
import re

from gridloom.llm import secrets
from gridloom.llm.queries import QUERIES
from tests.llm.test_secrets import ACCESS, ASSIGN, ENDPOINT, HALF, HEX

ROLE = {"access": 0, "assign": 1, "half": 1, "endpoint": 2}


def brute(text):
    text = text or ""
    base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    weak = [(m.start(), 3, "half", m.end()) for m in HALF.finditer(text)]
    weak += [(m.start(), 4, "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
    weak = [w for w in weak if not any(a <= w[0] and w[3] <= b for a, _, _, b in base)]
    block = lambda s: sum(m.end() <= s[0] for m in re.finditer(r"\n\s*\n", text))
    linked = []
    for w in weak:
        met = any(k in ROLE and ROLE[k] != ROLE[w[2]] and block(s) == block(w) for s in base + weak for k in [s[2]])
        near = any(s[2] == "access" and s[0] - 400 <= w[0] and w[3] <= s[3] + 400 for s in base)
        linked += [w] if met or near else []
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(base + linked))


def test_parts_meet_in_blocks_of_any_length(spark, tmp_path):
    half, end, access = "Ab/+" * 10, "https://s3.example.com/a", "AKIA" + "Z" * 16
    texts = [
        f"{half} {end}",
        f"password = {'x' * 14}\n{end}",
        f"{access}\n" + "line of a log\n" * 200 + half,
        f"{half}\n\n{end}",
        f"{half} {half}",
        f"{end} {'0123456789abcdef' * 2}",
        f"{access}\n \n\t\n{half}",
    ]
    want = [["half", "endpoint"], ["assign", "endpoint"], ["access", "half"], [], [], ["hex"], ["access", "half"]]
    random.seed(3)
    bits = [half, end, access, "token: " + "y" * 12, "\n", "\n\n", "\n \n", " ", "é😀 ", "w " * 90, "0123456789abcdef"]
    texts += ["".join(random.choices(bits, k=random.randint(2, 25))) for _ in range(300)] + [None, ""]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[1]], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_secret_scan"](spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1
    spans = {r.doc_id or 0: r.spans for r in got}
    assert [re.findall("[a-z]+", spans[i]) for i in range(7)] == want
    assert all(spans[i] == brute(t) for i, t in enumerate(texts))
    assert secrets.scan_secrets(spark.createDataFrame(rows[:1], "doc_id long, text string")).first().spans == []
