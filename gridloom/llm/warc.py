"""WARC archives with revisit records for repeated payloads.

Only headers (id, payload digest, size) are shuffled to find repeats: the
smallest id of every digest is one grouped minimum, combined before the
shuffle. Headers are joined back to it (adaptive execution splits a digest
that holds a large share of the rows). Archives are written by Spark's text
writer, so tasks commit like any other output and can be run again: a record
ends in two line breaks, which serve as the writer's separator. Archive files
have a bounded size, and each is read back by its Content-Length headers.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import whole

# Payloads below this size are always stored.
SMALLEST_REVISIT = 100
# Aimed bytes of one archive file.
FILE_BYTES = 16 << 20
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = (
    "page_id long, record_type string, url string, payload_bytes long, payload_digest string, "
    "refers_to long, payload binary, sound boolean"
)


def resolve_revisits(pages: DataFrame, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat a payload.

    ``pages`` has page_id and html. Of equal payloads of ``smallest`` bytes or
    more, rows with the smallest page_id are responses and the others refer to
    it. A null page_id never is the response while a known id exists; repeated
    rows of the smallest id are all responses. Rows without a repeat are absent.
    """
    html = whole("html")
    headers = pages.select(
        "page_id",
        F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
    ).filter(F.col("bytes") >= smallest)
    firsts = (
        headers.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1 AND refers_to IS NOT NULL")
    )
    return (
        headers.join(firsts, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def _uuid(*parts: Column) -> Column:
    """A record id that depends on the parts alone."""
    digest = F.md5(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def archive_records(pages: DataFrame, date: str, smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """One column ``value``: a whole record without its closing line breaks."""
    html = whole("html")
    # Control characters and blanks cannot stand in a header line.
    url = F.regexp_replace(whole("url"), r"[\x00-\x20\x7F]", "%20")
    digest = F.sha2(F.encode(html, "UTF-8"), 256)
    revisits = resolve_revisits(pages, smallest).withColumnRenamed("page_id", "revisit_id")
    size = F.octet_length(html)
    rows = pages.select("page_id", html.alias("html"), url.alias("url"), digest.alias("digest"), size.alias("bytes"))
    rows = rows.join(
        revisits,
        rows.page_id.eqNullSafe(revisits.revisit_id) & (rows.digest == revisits.digest),
        "left",
    ).drop(revisits.digest)
    again = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        _uuid(number, F.col("url"), F.col("digest")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nX-Page-ID: "),
        number,
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            again,
            F.concat(
                F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nX-Refers-To-Page-ID: "),
                F.col("refers_to").cast("string"),
            ),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(
    pages: DataFrame,
    path: str,
    date: str = "2026-01-01T00:00:00Z",
    smallest: int = SMALLEST_REVISIT,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write deduplicated archives of ``pages`` (page_id, url, html) to ``path``.

    Null html is an empty payload and null url an empty address; an empty table
    writes no record. Other columns are not read. A file holds as many records as
    make up ``file_bytes`` on average and is compressed; payloads move at most once,
    to meet their revisit decisions.
    """
    mean = pages.agg(F.avg(F.octet_length(whole("html")) + 600)).first()[0] or 600
    records = archive_records(pages.select("page_id", "url", "html"), date, smallest)
    writer = records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", int(file_bytes // mean) + 1).text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, found by their Content-Length."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        head = data[at:split].decode("utf-8")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:] if ": " in line)
        begin = split + 4
        end = begin + int(fields["Content-Length"])
        body = data.index(b"\r\n\r\n", begin, end) + 4
        http = data[begin:body].decode("utf-8")
        yield {
            "page_id": int(fields["X-Page-ID"]) if fields.get("X-Page-ID") else None,
            "record_type": fields["WARC-Type"],
            "url": fields.get("WARC-Target-URI", ""),
            "payload_bytes": int(re.search(r"Content-Length: (\d+)", http)[1]),
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
            "refers_to": int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None,
            "payload": data[body:end] if fields["WARC-Type"] == "response" else None,
        }
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"Record at byte {at} does not end where its length says")
        at = end + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records below ``path``; ``sound`` says that size and digest of a stored
    payload are those of its header (true for revisits)."""

    def work(batches):
        for batch in batches:
            for data in batch["content"]:
                rows = []
                for row in parse_records(gzip.decompress(data)):
                    body = row["payload"]
                    row["sound"] = body is None or (
                        len(body) == row["payload_bytes"]
                        and hashlib.sha256(body).hexdigest() == row["payload_digest"]
                    )
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                if rows:
                    frame = pd.DataFrame(rows)
                    for c in ("page_id", "refers_to"):
                        frame[c] = pd.array([r[c] for r in rows], dtype="Int64")
                    yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInPandas(work, READ_SCHEMA)
