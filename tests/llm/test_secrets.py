import hashlib
import random
import re

from gridloom.llm import secrets
from gridloom.llm.queries import QUERIES

ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
HALF = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~%/-]*)?")


def brute(text):
    text = text or ""
    base = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    weak = [(m.start(), 3, "half", m.end()) for m in HALF.finditer(text)]
    weak += [(m.start(), 4, "endpoint", m.end()) for m in ENDPOINT.finditer(text)]
    scopes = [(a - secrets.REACH, b + secrets.REACH) for a, _, k, b in base if k == "access"]
    linked = [
        w
        for w in weak
        if not any(a <= w[0] and w[3] <= b for a, _, _, b in base) and any(lo <= w[0] and w[3] <= hi for lo, hi in scopes)
    ]
    write = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s))
    return write(base), write(base + linked)


def test_whole_table(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op10_secret_scan"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        base, spans = brute(row.text)
        assert got[row.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert got[row.doc_id].spans == spans


def test_made_texts(spark):
    random.seed(4)
    bits = ["token", "Secret", "api_key", "APIKEY", ": ", "=", '"', "'", " ", "x" * 11, "y" * 12, "AKIA", "AKIAABCDEFGHIJKLMN",
            "0123456789abcdef", "deadbeef", "é😀", "\n", "A" * 40, "b/+" * 13 + "b", "https://s3.example.com/a", " " * 300, "K"]
    texts = [None, "", "token: secret: abcdefghijklmnop", "token=secret=abcdefghijklmnop", "AKIAAKIA" + "B" * 14, "f" * 200_000 + " AKIA" + "Z" * 20 + " " + "q" * 40]
    texts += ["".join(random.choices(bits, k=random.randint(1, 40))) for _ in range(400)]
    rows = [(None if i == 0 else i, t, "k") for i, t in enumerate(texts)] + [(9, texts[9], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = secrets.scan_secrets(df).select("doc_id", secrets.written("base").alias("b"), secrets.written("spans").alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.b, r.s) == brute(texts[r.doc_id or 0]), texts[r.doc_id or 0]
    assert any(r.b != r.s for r in got)
    assert secrets.scan_secrets(df.limit(0)).count() == 0
