"""Mixing sources to target weights by capped water-filling.

Every source gets its share of the mix by weight, but never more than a maximum
number of epochs of its own words. Sources whose share would exceed that are
clamped there; what they leave is dealt again to the others by weight, until no
share is above its limit. A target is then met by whole repetitions of every
document and one seeded fractional repetition: documents in the order of a seeded
hash until the words are used up. The document on the boundary gives its first
words, so a source meets its target to the word, however long its documents.

Documents are read once; what stays is one narrow row for each (id, source, words,
hash), written to the shared folder. Words are summed by source before the shuffle,
so a source that holds a third of all rows is a few partial sums. The boundary of a
fractional repetition is found by counting words in slices of the hash, twice, and
then among the few hashes of the slice on the boundary: rows are never sorted and a
source is never gathered. Only one row for each source is joined to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import free_names, whole
from gridloom.operators.ordering import with_positions
from gridloom.session import bounded_lookup, checkpoint

WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, 42
# Bits of the hash, and of the slices of each of the two counts.
KEY_BITS, SLICE_BITS = 60, 12


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def hash_key(seed: int, *columns: Column) -> Column:
    """60 bits of the MD5 of the seed and the columns; null reads as an empty text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), *parts), "UTF-8"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def ranked_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``sources`` (source) with a weight: ``weights`` in turn over the sources by
    code point, null last."""
    placed = with_positions(sources.withColumn("absent", F.col("source").isNull()), ["absent", "source"])
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    return placed.select("source", turn.alias("weight"))


def water_fill(sources: DataFrame, words: float) -> DataFrame:
    """``sources`` (weight, cap) with ``target``: shares of ``words`` by weight, none
    above its cap.

    A share at the common level is weight x level. Clamping the sources above
    their caps raises the level for the others, so the clamped ones only grow in
    number and the rounds end; every round is two sums and a count. Sources with
    a null, zero or negative weight get nothing; if all caps together are below
    ``words``, every target is its cap. Sums of whole weights and caps are exact,
    so reruns agree.
    """
    weight, cap = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)), F.col("cap")
    able = weight > 0
    level, before = None, -1
    while True:
        above = F.lit(False) if level is None else weight * F.lit(level) > cap
        row = sources.filter(able).agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~above, weight)), F.lit(0.0)).alias("open"),
        ).first()
        if row.n == before or not row.open:
            break
        before, level = row.n, max(words - row.full, 0.0) / row.open
    if not row.open:
        return sources.withColumn("target", F.when(able, cap).otherwise(0.0))
    return sources.withColumn("target", F.when(able, F.least(cap, weight * F.lit(level))).otherwise(0.0))


def _slices(rows: DataFrame, state: DataFrame, digit: Column) -> DataFrame:
    """``state`` (s_source, before, extra) narrowed to the slice of ``rows`` in which
    the running number of words passes ``extra``: (s_source, extra, before, slice)."""
    counted = rows.groupBy("source", digit.alias("slice")).agg(F.sum("size").alias("words"))
    joined = counted.join(state, F.col("source").eqNullSafe(F.col("s_source")))
    # At most 2^12 slices of each source stand in one window.
    running = joined.withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("s_source").orderBy("slice").rowsBetween(W.unboundedPreceding, 0)))
    over = running.filter("upto > extra").groupBy("s_source", "extra").agg(F.min(F.struct("slice", (F.col("upto") - F.col("words")).alias("before"))).alias("m"))
    return over.select("s_source", "extra", "m.before", "m.slice")


def boundaries(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, edge, each): documents of a source with a hash below ``edge`` are
    taken once more, those at ``edge`` give at most ``each`` words.

    A source whose words do not exceed its ``extra`` has no row. Rows of equal
    hashes - repeats of one document - share what is left evenly.
    """
    spark = rows.sparkSession
    state = sources.filter("extra > 0").select(F.col("source").alias("s_source"), F.lit(0).cast("long").alias("before"), "extra")
    left = rows
    for turn in range(2):
        digit = F.shiftright("key", KEY_BITS - SLICE_BITS * (turn + 1))
        state = checkpoint(_slices(left, state, digit))
        near = bounded_lookup(state.select("s_source", "slice"), state.count())
        inside = left.join(near, F.col("source").eqNullSafe(F.col("s_source")) & (digit == F.col("slice")))
        left = checkpoint(inside.select("source", "key", "size"))
        state = state.drop("slice")
    # About 2^-24 of the distinct hashes of a source are left.
    keys = left.groupBy("source", "key").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    joined = keys.join(state, F.col("source").eqNullSafe(F.col("s_source")))
    running = joined.withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("s_source").orderBy("key").rowsBetween(W.unboundedPreceding, 0)))
    edge = F.struct("key", F.floor((F.col("extra") - F.col("upto") + F.col("words")) / F.col("n")).alias("each"))
    found = running.filter("upto > extra").groupBy("s_source").agg(F.min(edge).alias("m"))
    return found.select(F.col("s_source").alias("e_source"), F.col("m.key").alias("edge"), F.col("m.each").alias("each"))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, weight, target, copies, taken) of every row.

    ``size`` counts the words of the text, ``share`` is the mix as a multiple of
    all words, ``epochs`` the most that a source repeats, and ``weights`` has one
    weight a source (source, weight), by default 5, 2, 1 in turn by code point with
    the null source last; a source that is missing there gets nothing. ``copies``
    counts whole repetitions of a document and ``taken`` its words in the mix; the
    words beyond the whole copies are the text's first words. A source takes its
    target rounded to words; among repeats of one document on the boundary, less
    than a word each may be missing.

    Null and empty texts have size 0 and are taken 0 words; null sources are a
    source, null ids and repeated rows pass one by one, long texts are counted
    whole, and an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        hash_key(seed, F.col(id_col), F.col(text_col)).alias("key"),
    )
    rows = checkpoint(rows)
    sizes = checkpoint(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    if weights is None:
        weights = ranked_weights(sizes.select("source"))
    weights = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight"))
    weighted = sizes.join(weights, F.col("source").eqNullSafe(F.col("w_source")), "left")
    weighted = checkpoint(weighted.select("source", "source_size", "weight", (F.col("source_size") * float(epochs)).alias("cap")))
    filled = water_fill(weighted, share * total)
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    extra = F.floor(F.col("target") - turns * F.col("source_size") + 0.5)
    filled = checkpoint(filled.select("source", "source_size", "weight", "target", turns.alias("turns"), extra.alias("extra")))
    edges = boundaries(rows, filled)
    filled = filled.join(edges, F.col("source").eqNullSafe(F.col("e_source")), "left")
    filled = checkpoint(filled.withColumnRenamed("source", "f_source").drop("e_source"))
    named = rows.join(bounded_lookup(filled, filled.count()), F.col("source").eqNullSafe(F.col("f_source")))
    more = (
        F.when(F.col("extra") <= 0, 0)
        .when(F.col("edge").isNull() | (F.col("key") < F.col("edge")), F.col("size"))
        .when(F.col("key") == F.col("edge"), F.least("size", "each"))
        .otherwise(0)
    )
    copies = F.col("turns") + (more == F.col("size")).cast("long")
    taken = F.col("turns") * F.col("size") + more
    return named.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "weight",
        "target",
        F.when(F.col("size") > 0, copies).otherwise(0).cast("long").alias("copies"),
        taken.cast("long").alias("taken"),
    )


def repeated(docs: DataFrame, taken_col: str = "taken", size_col: str = "size", text_col: str = "text") -> DataFrame:
    """The mix itself: every document of ``docs`` as often as it is taken, with the
    column ``copy`` (from 1); the last copy may hold its first words only.

    ``docs`` carries the size and the words taken, as joined from ``mix``; rows with
    nothing to take go.
    """
    copy = free_names(docs, "copy")[0]
    taken, size = F.col(taken_col), F.col(size_col)
    out = docs.filter(taken > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size).cast("long"))))
    rest = (taken - (F.col(copy) - 1) * size).cast("int")
    cut = F.array_join(F.slice(F.split(text_col, WORD_END, rest + 1), F.lit(1), rest), "")
    return out.withColumn(text_col, F.when(rest >= size, F.col(text_col)).otherwise(cut))
