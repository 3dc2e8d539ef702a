"""A corpus pipeline made of the operators in ``gridloom.llm``.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame
that is written as Parquet and read again as the next stage's documents. All but
the last return the columns of ``documents``. A stage decides on narrow rows - a
document is told by its id and a hash of its text - and texts stay where they lie.

Null ids and texts, empty texts and tables, long texts and additional columns pass
every stage; rows that repeat in id and text are one document until the
near-duplicate stage, which keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, language, lines, simhash
from gridloom.llm.common import free_names, whole
from gridloom.llm.queries import coded_digests
from gridloom.session import checkpoint, shared_folder


def document_key() -> Column:
    return F.struct("doc_id", F.xxhash64(whole("text")).alias("text_key"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` less the documents in ``keys`` (key), a table that is written once."""
    number, digest = free_names(docs, "gone_id", "gone_key")
    keys = checkpoint(keys.select(F.col("key.doc_id").alias(number), F.col("key.text_key").alias(digest)).distinct())
    return docs.join(
        lines.lookup(keys, keys.count()),
        F.col("doc_id").eqNullSafe(F.col(number)) & (F.xxhash64(whole("text")) == F.col(digest)),
        "left_anti",
    )


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty stay."""
    found = language.identify(language.document_rows(docs, document_key()))
    return without(docs, found.filter("NOT accepted"))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that loses all of them stays, with an empty text."""
    cleaned = lines.deduplicate_lines(docs)
    return cleaned.withColumn("n_chars", F.length(whole("text")).cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates - fingerprints of four-word shingles that
    differ in four bits or fewer - the document with the smallest id stays; of rows
    that repeat in id and text, one."""
    keyed = docs.select(document_key().alias("key"), "text")
    groups = checkpoint(simhash.near_duplicates(keyed, id_col="key"))
    kept = without(docs, groups.filter(~F.col("key").eqNullSafe(F.col("component_id"))))
    twins = groups.groupBy("key").count().filter("count > 1").select("key")
    if twins.isEmpty():
        return kept
    single = without(kept, twins)
    key, twin = free_names(docs, "key", "twin")
    again = kept.withColumn(key, document_key()).join(
        twins.select(F.col("key").alias(twin)), F.col(key).eqNullSafe(F.col(twin)), "left_semi"
    )
    return single.unionByName(again.dropDuplicates([key]).select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = docs.select(document_key().alias("key"), "text")
    hits = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return without(docs, hits)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return coded_digests(bpe.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", identify_language),
    ("lines", deduplicate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("bpe", encode),
]
# Fitted models, signatures and tokens are beyond SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
