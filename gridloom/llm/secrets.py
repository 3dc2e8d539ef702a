"""Secret scans with linking of credential parts. DataFrame functions only.

Base findings (assignments, access identifiers, hexadecimal runs) stand by
themselves. Weak candidates - 40-letter base64 words that may be the secret
half of a key pair, and endpoints - are reported only when a complementary
part lies in the same scope. Parts are identifiers (access), secrets (assign,
half) and endpoints; parts of two of these roles complement each other. A scope
is a block of consecutive lines that are not blank, of any length, or the window
of ``REACH`` code points around an access identifier, which reaches over blank
lines. Blocks are numbered as the spans are found, and roles and candidates meet
on the document and the block. Windows and candidates meet in an interval join on
the document and the pieces of the window; since findings of a kind do not
overlap, a piece holds a bounded number of them, so both joins grow with the
findings alone.

Texts are read once and not shuffled: only spans leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import whole
from gridloom.session import checkpoint

REACH = 400
# The base patterns, and the least lengths they must reach.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Weak candidates, found whole by their surroundings.
HALF = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~%/-]*)?"
BASE_KINDS = ["assign", "access", "hex"]
SPAN = "struct<start:bigint,rank:int,kind:string,stop:bigint,block:int>"
# One or more blank lines.
BREAK = r"\n\s*\n"


def spans(text: Column, pattern: str, kind: str, rank: int, least: int | None = None) -> Column:
    """All matches of ``pattern`` as (start, rank, kind, stop, block), in code points.

    The text between matches comes from ``split``, the matches themselves from
    ``regexp_extract_all``: both take the leftmost matches that do not overlap,
    so the running sum of their lengths gives the places. No match holds a line
    break, so the blank lines between matches are counted there. ``least`` is a
    least length of the second group; shorter matches are dropped afterwards.
    """
    empty = F.array().cast(f"array<{SPAN}>")
    between = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).cast("long").alias("gap"), F.regexp_count(b, F.lit(BREAK)).alias("breaks"), m.alias("m")))
    good = (lambda m: F.lit(True)) if least is None else lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= least
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("block"), empty.alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        stop = begin + F.length(x["m"])
        block = acc["block"] + x["breaks"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), block.alias("block"))
        return F.struct(
            stop.alias("at"),
            block.alias("block"),
            F.when(good(x["m"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.when(text.rlike(pattern), F.aggregate(lengths, start, step, lambda acc: acc["spans"])).otherwise(empty)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_block: bool = False) -> DataFrame:
    """(doc_id, text_key, base, weak): base spans and weak candidates of every row."""
    text = whole(text_col)
    base = F.array_sort(
        F.concat(
            spans(text, ASSIGN, "assign", 0, ASSIGN_LEAST),
            spans(text, ACCESS, "access", 1),
            spans(text, HEX, "hex", 2),
        )
    )
    # A window needs an access identifier; in blocks any two roles may meet.
    weak = F.when(
        F.lit(True) if by_block else text.contains("AKIA"), F.concat(spans(text, HALF, "half", 3), spans(text, ENDPOINT, "endpoint", 4))
    ).otherwise(F.array().cast(f"array<{SPAN}>"))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), base.alias("base"), weak.alias("weak"))


def role() -> Column:
    return F.when(F.col("s.kind") == "access", 0).when(F.col("s.kind").isin("assign", "half"), 1).otherwise(2)


def link_parts(found: DataFrame, reach: int = REACH, by_block: bool = False) -> DataFrame:
    """(doc_id, text_key, linked): weak candidates inside the window of an access
    identifier or, ``by_block``, in a block with a part of another role. A
    candidate that lies in a base span is that finding again and is left out.
    Equal rows are one document here."""
    some = found.filter(F.size("weak") > 0).select("doc_id", "text_key", "base", "weak").distinct()
    access = (
        some.select("doc_id", "text_key", F.explode("base").alias("s"))
        .filter("s.kind = 'access'")
        .select("doc_id", "text_key", (F.col("s.start") - reach).alias("low"), (F.col("s.stop") + reach).alias("high"))
    )
    scopes = access.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / reach), F.floor(F.col("high") / reach))))
    loose = F.filter(
        "weak",
        lambda w: ~F.exists("base", lambda b: (b["start"] <= w["start"]) & (w["stop"] <= b["stop"])),
    )
    weak = some.select("doc_id", "text_key", F.explode(loose).alias("s"))
    parts = weak.withColumn("block", F.floor(F.col("s.start") / reach))
    p, q = parts.alias("p"), scopes.alias("q")
    inside = p.join(
        q,
        F.col("p.doc_id").eqNullSafe(F.col("q.doc_id"))
        & (F.col("p.text_key") == F.col("q.text_key"))
        & (F.col("p.block") == F.col("q.block"))
        & (F.col("p.s.start") >= F.col("q.low"))
        & (F.col("p.s.stop") <= F.col("q.high")),
        "left_semi",
    )
    inside = inside.select("doc_id", "text_key", "s")
    if by_block:
        strong = some.select("doc_id", "text_key", F.explode("base").alias("s")).filter("s.kind <> 'hex'")
        roles = (
            weak.unionByName(strong)
            .groupBy(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), F.col("s.block").alias("r_block"))
            .agg(F.min(role()).alias("low"), F.max(role()).alias("high"))
            .filter("low < high")
        )
        # The roles of such a block are two at least, so one differs from the candidate's.
        met = weak.join(
            roles,
            F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")) & (F.col("s.block") == F.col("r_block")),
            "left_semi",
        )
        inside = inside.unionByName(met).distinct()
    return inside.groupBy("doc_id", "text_key").agg(F.collect_list("s").alias("linked"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_block: bool = False) -> DataFrame:
    """One row per document row: doc_id, base and spans (base and linked weak
    spans in order of start, then kind). ``by_block`` takes blocks of lines as
    scopes besides the windows.

    Null and empty texts have no spans; null ids and repeated rows stay, each
    with its own spans; other columns are not read. Offsets are code points,
    the stop exclusive. Texts are taken whole.
    """
    # Written once, since the linking reads the spans again: texts are scanned
    # a single time.
    found = checkpoint(find_parts(docs, id_col, text_col, by_block))
    linked = link_parts(found, by_block=by_block).withColumnsRenamed({"doc_id": "linked_id", "text_key": "linked_key"})
    both = found.join(
        linked,
        found.doc_id.eqNullSafe(linked.linked_id) & (found.text_key == linked.linked_key),
        "left",
    )
    return both.select(
        F.col("doc_id").alias(id_col),
        "base",
        F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")))).alias("spans"),
    )


def written(spans_col: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
