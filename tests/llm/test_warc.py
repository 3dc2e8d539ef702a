import hashlib

from gridloom.llm import warc
from gridloom.session import shared_folder


def brute(rows):
    """type and reference of every (page_id, html)."""
    known = {}
    for page, html in rows:
        known.setdefault(html or "", []).append(page)
    out = []
    for page, html in rows:
        body = (html or "").encode()
        ids = [p for p in known[html or ""] if p is not None]
        first = min(ids, default=None)
        again = len(body) >= 100 and len(known[html or ""]) > 1 and first is not None and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def read(spark, df):
    path = shared_folder(spark, "warc")
    warc.write_archives(df, path, file_bytes=2000)
    return warc.read_archives(spark, path)


def key(rows):
    return sorted(rows, key=str)


def test_repeats_odd_payloads_and_ties(spark):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    bodies = ["", None, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, long, long, "z" * 50000, "z" * 50000]
    rows = [(i + 1, f"http://a/{i}\r\nX: y", b) for i, b in enumerate(bodies)][::-1]
    rows += [rows[-5], (None, None, "y" * 100), (None, "u", "q" * 200)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    got = read(spark, df.repartition(3)).collect()
    assert all(r.sound for r in got)
    assert key([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]) == key(
        brute([(r[0], r[2]) for r in rows])
    )
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}
    assert texts[8] == long and texts[2] == ""
    assert {r.url for r in got if r.page_id == 1} == {"http://a/0%20%20X:%20y"}


def test_empty_and_whole_table(spark, sf):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert read(spark, empty).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = read(spark, pages).collect()
    want = brute([(r.page_id, r.html) for r in pages.collect()])
    assert key([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]) == key(want)
