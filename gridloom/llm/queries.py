"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from gridloom.llm import alignment, bpe, chat, covertree, decontaminate, language, lines, mixing, quality, secrets, simhash, spelling, warc
from gridloom.llm.common import ORACLE, QUERIES, query, table  # noqa: F401
from gridloom.session import shared_folder


def coded_digests(coded):
    """Digest columns of encoded and decoded documents."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op3_bpe_coding")
def op3_bpe_coding(spark, sf):
    return coded_digests(bpe.encode_and_decode(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op6_warc_revisits")
def op6_warc_revisits(spark, sf):
    path = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b') AS x FROM t
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, x) AS i FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(11 + length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b')) + length(x)) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""


@query("op7_chat_formatting", OP7_SQL)
def op7_chat_formatting(spark, sf):
    marks = "</s>[INST] ok [/INST]"
    own = spark.sql(
        f"SELECT -1L AS conv_id, turn, role, '{marks}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)"
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = chat.format_chats(chat.plain_turns(rows))
    turns = chat.read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.masked_text(F.col("formatted"), F.col("loss"))
    return chats.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_secret_scan")
def op10_secret_scan(spark, sf):
    found = secrets.scan_secrets(table(spark, sf, "documents"), by_block=True)

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(k) for k in secrets.BASE_KINDS],
        F.sha2(F.encode(secrets.written("base"), "UTF-8"), 256).alias("base_sha256"),
        secrets.written("spans").alias("spans"),
    )


@query("op9_simhash_duplicates")
def op9_simhash_duplicates(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op8_decontamination")
def op8_decontamination(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_language_id")
def op5_language_id(spark, sf):
    """All documents and all pages together: one row each, with the id of its table."""
    none = F.lit(None).cast("long")
    documents = language.document_rows(
        table(spark, sf, "documents"), F.struct(F.col("doc_id"), none.alias("page_id"))
    )
    pages = language.page_rows(table(spark, sf, "pages"), F.struct(none.alias("doc_id"), F.col("page_id")))
    found = language.identify(documents.unionByName(pages))
    return found.select("key.doc_id", "key.page_id", "language", "probability", "accepted")


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id",
        quality.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
        "good_lines",
        "n_lines",
    )


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, d.v)]) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


@query("op2_exact_top_k", OP2_SQL)
def op2_exact_top_k(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", covertree.whole_numbers("embedding").alias("v"))
    return covertree.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query("op4_line_dedup")
def op4_line_dedup(spark, sf):
    cleaned = lines.deduplicate_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15)) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS i FROM s
), l AS (
  SELECT *, ((SELECT 1.5::DOUBLE * sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), f AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM l WHERE weight * level <= cap ORDER BY i LIMIT 1)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS turns FROM f
), g AS (
  SELECT *, floor(target - turns * source_size + 0.5) AS extra FROM e
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, turns, extra,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.key) AS words, count(*) OVER (PARTITION BY d.source, d.key) AS n
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(turns * size + CASE WHEN upto <= extra THEN size
  WHEN upto - words < extra THEN least(size, floor((extra - upto + words) / n)) ELSE 0 END AS BIGINT) AS taken
FROM p"""


@query("op11_source_mixing", OP11_SQL)
def op11_source_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, sf):
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_and_score(table(spark, sf, "documents"), *files)


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf):
    return spelling.spelling_variants(table(spark, sf, "documents"))
