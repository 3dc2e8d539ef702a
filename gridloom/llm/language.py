"""Language identification by Bayesian fusion of independent evidence.

For every row the posterior of a language is the product of

* the text likelihood: a trigram model fitted on a bounded sample of rows whose
  declared language is known;
* the declared language (markup or metadata), through a table of how often each
  declaration meets each language of the text;
* the address suffix, through such a table of its own;
* the host's prior: counts of the host, smoothed towards its domain, and that
  towards all rows, without the row's own share.

The tables are grouped aggregations over all rows. The text is read by one map;
only narrow rows (scores and addresses) are grouped and joined, and a host that
holds a large share of the rows is aggregated before the shuffle and split by
adaptive execution in the join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType

from gridloom.llm.common import chunks, whole
from gridloom.session import checkpoint

UNKNOWN = "und"
# A declared code is taken for a language if this many rows declare it, and this
# share of all rows with a declaration (so there are at most 1,000 languages).
LEAST_ROWS, LEAST_SHARE = 20, 0.001
# Rows of each declared language from which the trigram model is fitted.
SAMPLE_ROWS = 1000
BUCKETS = 1 << 13
CHUNK_CHARS = 1_000_000
# Weight of a parent in the host hierarchy, in rows, and of each table's prior.
STRENGTH = 5.0
# Trigrams beyond this number add no certainty: neighbouring ones are not independent.
FULL_WEIGHT = 60
THRESHOLD = 0.5

_BYTES = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)
COMMENTS, HTML_TAG = r"(?s)<!--.*?-->", r"(?is)<html\b[^>]*>"
MARKUP_LANG = r"""(?i)\slang\s*=\s*["']?([a-z]+)"""
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
TAGS = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def declared_in_markup(html: Column) -> Column:
    """Primary language code of the ``lang`` attribute of the first html tag outside
    comments, wherever it is, or null."""
    tag = F.regexp_extract(F.regexp_replace(html, COMMENTS, ""), HTML_TAG, 0)
    found = F.lower(F.regexp_extract(tag, MARKUP_LANG, 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Html without tags, comments, scripts and styles, which would read as text."""
    return F.regexp_replace(F.regexp_replace(html, TAGS, " "), r"&[a-zA-Z]+;|&#[0-9]+;", " ")


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams that hold a letter, and how many each text has."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) + 3 for r in raw])
    flat = _BYTES[np.frombuffer(b"".join(r + b"   " for r in raw), np.uint8)].astype(np.uint32)
    code = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
    good = code != 0x202020
    ends = np.cumsum(sizes)
    for e in (ends[:-1] - 2, ends[:-1] - 1):
        good[e] = False  # trigrams that reach into the next text
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
    of = np.add.reduceat(np.r_[good, False, False], np.r_[0, ends[:-1]], dtype=np.int64)
    return bucket[good], of


def declared_languages(rows: DataFrame, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> list[str]:
    """The declared codes with enough support, in alphabetical order."""
    counts = rows.filter("declared IS NOT NULL").groupBy("declared").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(least_rows, math.ceil(least_share * total))
    return sorted(r.declared for r in counts.filter(F.col("count") >= least).collect() if r.declared != UNKNOWN)


def fit_trigrams(rows: DataFrame, languages, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log probability of each bucket for each language, then for unknown text.

    From at most ``sample_rows`` rows of each declared language: those whose text
    has the smallest hashes. Copies share a hash and count once. A language of many
    rows is first cut to the share of the hashes that holds about four times the
    sample, so what is ranked has a bounded size however common a language is.
    """
    known = rows.filter(F.col("declared").isin(*languages)).select("declared", "text", F.xxhash64("text").alias("h"))
    found = {}
    if languages:
        found = {r.declared: r.n for r in known.groupBy("declared").agg(F.approx_count_distinct("h").alias("n")).collect()}
    near = F.lit(False)
    for name, n in found.items():
        share = 4 * sample_rows / max(n, 1)
        low = F.col("h") <= int(-(1 << 63) + share * (1 << 64)) if share < 0.9 else F.lit(True)
        near |= (F.col("declared") == name) & low
    rank = F.row_number().over(W.partitionBy("declared").orderBy("h"))
    cuts = (
        known.select("declared", "h").filter(near).distinct().withColumn("rank", rank).filter(F.col("rank") <= sample_rows)
        .groupBy("declared").agg(F.max("h").alias("cut")).collect()
    )
    counts = np.zeros((len(languages), BUCKETS))
    if cuts:
        chosen = F.lit(False)
        for row in cuts:
            chosen |= (F.col("declared") == row.declared) & (F.col("h") <= row.cut)

        def work(batches):
            for batch in batches:
                names = np.array(batch.column(0).to_pylist())
                texts = batch.column(1).to_pylist()
                for a, b in chunks(texts, [len(t) for t in texts], CHUNK_CHARS):
                    bucket, of = _trigrams(texts[a:b])
                    for name in np.unique(names[a:b]):
                        n = np.bincount(bucket[np.repeat(names[a:b] == name, of)], minlength=BUCKETS)
                        at = np.flatnonzero(n)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([str(name)] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())],
                            names=["declared", "bucket", "n"],
                        )

        sample = known.filter(chosen).dropDuplicates(["declared", "h"]).select("declared", "text")
        for row in sample.mapInArrow(work, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n")).collect():
            counts[languages.index(row.declared), row.bucket] = row.n
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    # Mostly flat, so that a text of several known languages is not unknown.
    unknown = 0.05 * share.sum(axis=0) / max(len(languages), 1) + 0.95 / BUCKETS
    return np.log(np.vstack([share, unknown])).astype(np.float32)


def text_scores(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(key, declared, host, scores array): log likelihoods of whole texts, the
    mean over all trigrams times at most ``FULL_WEIGHT`` of them."""
    shipped = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    schema = rows.select("key", "declared", "host").schema.add("scores", ArrayType(DoubleType()))
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def work(batches):
        table = shipped.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in chunks(texts, [len(t) for t in texts], CHUNK_CHARS):
                bucket, of = _trigrams(texts[a:b])
                starts = np.r_[0, np.cumsum(of)[:-1]]
                total = np.zeros((b - a, table.shape[1]))
                full = np.flatnonzero(of)
                if len(full):
                    total[full] = np.add.reduceat(table[bucket], starts[full], axis=0, dtype=np.float64)
                total *= (np.minimum(of, FULL_WEIGHT) / np.maximum(of, 1))[:, None]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a).cast(kinds[i]) for i in range(3)], pa.array(list(total), kinds[3])],
                    names=["key", "declared", "host", "scores"],
                )

    return rows.select("key", "declared", "host", "text").mapInArrow(work, schema)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def _sums(n: int) -> Column:
    return F.array(*[F.sum(F.col("p")[i]) for i in range(n)])


def _evidence_table(rows: DataFrame, column: str, classes: int) -> DataFrame:
    """Log of P(value | language) up to a constant, one row per value, from all rows
    that have letters."""
    counts = rows.filter("read").filter(F.col(column).isNotNull()).groupBy(column).agg(_sums(classes).alias("n"))
    totals = rows.filter(F.col(column).isNotNull()).agg(_sums(classes).alias("all")).first()[0]
    totals = [float(x or 0) for x in totals]
    everything = sum(totals) or 1.0
    logs = F.array(
        *[
            F.log(
                (F.col("n")[i] + STRENGTH * F.aggregate("n", F.lit(0.0), lambda a, x: a + x) / everything)
                / (totals[i] + STRENGTH)
            )
            for i in range(classes)
        ]
    )
    return counts.select(F.col(column).alias(f"{column}_value"), logs.alias(f"{column}_logs"), F.col("n").alias(f"{column}_n"))


def identify(rows: DataFrame, languages=None, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, language, probability, accepted) for every row of (key, text,
    declared, host); other columns are not read.

    ``language`` is the likeliest of ``languages`` (by default the declared codes
    with enough support) or ``und``, ties going to the earlier; a row is accepted
    if its language is known and has a posterior of ``threshold`` or more. Null
    texts and texts without letters have no text evidence, add to no table, and are
    judged by the rest: declaration, suffix or host, as far as other rows with
    letters share them. A row without any evidence is ``und`` and not accepted. A
    missing declaration or host adds nothing; a declaration that is never met with
    a language says little by its table. Repeated rows are judged one by one, texts
    are read whole, an empty table gives no rows.
    """
    rows = rows.select("key", whole("text").alias("text"), F.lower("declared").alias("declared"), F.lower("host").alias("host"))
    languages = declared_languages(rows) if languages is None else list(languages)
    names = [*languages, UNKNOWN]
    scored = text_scores(rows, fit_trigrams(rows, languages, sample_rows))
    labels = F.split("host", r"\.")
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1))
    domain = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host"))
    # Read by four groupings and the final join: written once, narrow as it is.
    # Text without letters has no scores and takes no part in the tables.
    n = len(names)
    nothing = F.array(*[F.lit(0.0)] * n)
    read = F.exists("scores", lambda s: s != 0)
    share = F.when(read, _softmax(F.col("scores"))).otherwise(nothing)
    scored = checkpoint(scored.select("*", suffix.alias("suffix"), domain.alias("domain"), read.alias("read"), share.alias("p")))
    whole_table = scored.agg(_sums(n).alias("n")).first()[0]
    overall = [(float(x or 0) + 1) / (sum(y or 0 for y in whole_table) + n) for x in whole_table]
    base = F.array(*[F.lit(x) for x in overall])
    hosts = scored.filter("host IS NOT NULL").groupBy("host", "domain").agg(_sums(n).alias("host_n"))
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("host_n")[i]) for i in range(n)]).alias("domain_n"))
    priors = hosts.join(domains, "domain").select(F.col("host").alias("prior_host"), "host_n", "domain_n")
    joined = scored.join(priors, F.col("host") == F.col("prior_host"), "left")
    for column in ("declared", "suffix"):
        evidence = _evidence_table(scored, column, n)
        joined = joined.join(evidence, F.col(column) == F.col(f"{column}_value"), "left")

    def without_own(counts):
        return F.zip_with(F.coalesce(counts, "p"), "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))

    def weight(counts):
        return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def smoothed(counts, parent):
        total = weight(counts)
        return F.zip_with(counts, parent, lambda c, q: (c + STRENGTH * q) / (total + STRENGTH))

    prior = smoothed(without_own("host_n"), smoothed(without_own("domain_n"), base))
    evidence = F.zip_with(F.coalesce("declared_logs", nothing), F.coalesce("suffix_logs", nothing), lambda a, b: a + b)
    total = F.zip_with(F.zip_with("scores", prior, lambda s, q: s + F.log(q)), evidence, lambda a, b: a + b)
    # Weights below a thousandth of a row are rounding of sums less the own share.
    grounds = [weight(without_own(c)) > 0.001 for c in ("declared_n", "suffix_n", "host_n", "domain_n")]
    known = F.col("read") | grounds[0] | grounds[1] | grounds[2] | grounds[3]
    posterior = joined.select("key", known.alias("known"), _softmax(total).alias("post"))
    best = F.array_max("post")
    language = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position("post", best).cast("int"))
    language = F.when(F.col("known"), language).otherwise(UNKNOWN)
    return posterior.select(
        "key",
        language.alias("language"),
        best.alias("probability"),
        ((language != UNKNOWN) & (best >= threshold)).alias("accepted"),
    )


def page_rows(pages: DataFrame, key: Column) -> DataFrame:
    """Web pages (url, html) as rows for ``identify``."""
    html = whole("html")
    return pages.select(
        key.alias("key"), visible_text(html).alias("text"), declared_in_markup(html).alias("declared"), host_of(F.col("url")).alias("host")
    )


def document_rows(docs: DataFrame, key: Column) -> DataFrame:
    """Documents (text, lang, source) as rows: the declared language is their
    metadata, the source stands for the host."""
    return docs.select(key.alias("key"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
