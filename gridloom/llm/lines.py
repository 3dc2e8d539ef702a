"""Fuzzy line deduplication. DataFrame functions only.

Every line is normalised and signed with a SimHash in eight blocks: a word's hash
deals it to a block, and the block's 64 bits are voted by its words alone. A
replaced word changes two blocks at most, so lines that differ in a few words agree
in a block (pigeonhole); a SimHash of all words together flips bits all over the
signature instead, and loses most such lines. Words that are found all over the
table do not vote, and a block of a single word is no key, so blocks select. A line
left without a block by that meets, with all its words, every line that agrees with
it in all words but two, in three of five groups of its words (more than nine), or
in all letters but two (up to fourteen).

Two lines link if they meet by such a key and their edit similarity is 0.8 or more;
of every connected group the first occurrence (smallest document id, then line
number) stays. Members of a block key meet in rounds of stars, not in pairs. First every
line is compared with one other, the smallest that it shares a key with, and those
that link are one group; then all members of a key are compared with one of another
group, and the next round takes the next one. Once few pairs of different groups
are left, these are compared; cheap bounds of the edit distance go first.

Texts are normalised once and written to the shared folder. Distinct lines are
shuffled once by id, and their words are summed there. A key or line that holds a
large share of the rows is the larger side of a join on a shuffled key, which
adaptive execution splits; counts and minima combine before the shuffle.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import free_names, whole
from gridloom.llm.components import components
from gridloom.session import checkpoint, shared_folder

SIMILARITY, BLOCKS, LEAST_WORDS = 0.8, 8, 2
# A word that is found more often than in this share of the lines, and this number
# of times, does not vote. There are at most 100 such words for each word of an
# average line.
COMMON_SHARE, COMMON_TIMES = 0.01, 100
# Letters whose numbers bound the edit distance from below, and the rounds of stars
# before the pairs that are left are compared, or their number for each member.
CLASSES, ROUNDS, PAIRS_LEFT = ("aou", "eiy", "nrst", "dlmc"), 8, 2
# Lines without a block: the most words that are left out one by one, the groups that
# the words of longer lines are dealt to, and the most letters that are left out.
FEW_WORDS, GROUPS, FEW_LETTERS = 9, 5, 14
# Rows of a lookup (ids, or documents that lose lines) that may be broadcast.
LOOKUP_ROWS = 50_000
# Bits i and i + 32 of a hash, each in a lane of 32 bits that cannot run over.
PAIR = 0x0000000100000001


@contextmanager
def freed_shuffles(spark: SparkSession):
    """While open, shuffle files go as soon as the step that wrote them is over:
    every step here ends in a written table that the next one reads."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a checkpoint that is packed,
    for tables of many rows a line. Its known size may make joins on it few and large tasks, so
    that lines to be compared are not kept so."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def normal(line: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, line, id, norm) of every line with a letter or digit."""
    text = whole(text_col)
    lines = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("line", "raw")
    )
    lines = lines.select("doc_id", "text_key", "line", normal(F.col("raw")).alias("norm")).filter("norm <> ''")
    return lines.select("doc_id", "text_key", "line", F.xxhash64("norm").alias("id"), "norm")


def common_words(lines: DataFrame) -> DataFrame:
    """(common): the words that do not vote."""
    counts = lines.select(F.explode(F.split("norm", " ")).alias("common")).groupBy("common").count()
    least = max(COMMON_TIMES, int(COMMON_SHARE * lines.count()))
    return checkpoint(counts.filter(F.col("count") > least).select("common"))


def signatures(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(key, id) of every distinct line and block: the key holds the block, its n words
    and 64 bits; bit i is one if it is set in more than half of the hashes of the words,
    repeats included."""
    words = lines.groupBy("id").agg(F.first("norm").alias("norm")).select("id", F.explode(F.split("norm", " ")).alias("w"))
    words = words.join(lookup(common, common.count()), F.col("w") == F.col("common"), "left_anti").select("id", F.xxhash64("w").alias("h"))
    words = words.withColumn("block", F.col("h").bitwiseAND(BLOCKS - 1))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(PAIR))).alias(f"s{i}") for i in range(32)]
    # Rows are dealt by id already: no further shuffle.
    summed = words.groupBy("id", "block").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= LEAST_WORDS)
    # Both lanes at once: 2 * ones - n - 1 + 2^30 has bit 30 set if 2 * ones > n
    # (a text holds fewer than 2^30 words, so no lane reaches the next one).
    middle = (F.lit((1 << 30) - 1) - F.col("n")) * F.lit((1 << 32) + 1)
    sig = F.lit(0).cast("long")
    for i in range(32):
        ones = F.col(f"s{i}") + F.col(f"s{i}") + middle
        sig = sig.bitwiseOR(F.shiftleft(F.shiftrightunsigned(ones, 30).bitwiseAND(F.lit(PAIR)), i))
    return summed.select("id", "block", "n", sig.alias("sig")).select(F.xxhash64("block", "n", "sig").alias("key"), "id")


def lookup(table: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast up to a measured number of narrow rows; beyond it the
    join shuffles."""
    return F.broadcast(table) if rows <= LOOKUP_ROWS else table


def letter_counts(norm: Column) -> list[Column]:
    """n_chars and the number of letters of each class."""
    size = F.length(norm)
    return [size.alias("n_chars"), *[(size - F.length(F.translate(norm, c, ""))).alias(f"c{i}") for i, c in enumerate(CLASSES)]]


def may_be_similar(a: str, b: str, similarity: float = SIMILARITY) -> Column:
    """Whether the letter counts of ``a`` and ``b`` (column prefixes) leave an edit
    distance within the budget: no letter class, nor all of them and the rest
    together, may need more letters added or taken away."""
    size = [F.col(f"{x}n_chars") for x in (a, b)]
    counts = [[F.col(f"{x}c{i}") for i in range(len(CLASSES))] for x in (a, b)]
    gaps = [x - y for x, y in zip(*counts)]
    gaps.append(size[0] - size[1] - sum(gaps[1:], gaps[0]))
    budget = F.greatest(*size) * (1 - similarity) + 1e-9
    more = sum([F.greatest(g, F.lit(0)) for g in gaps[1:]], F.greatest(gaps[0], F.lit(0)))
    less = sum([F.greatest(-g, F.lit(0)) for g in gaps[1:]], F.greatest(-gaps[0], F.lit(0)))
    return (more <= budget) & (less <= budget)


def similar(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of line ids whose edit distance is at most 1 - similarity
    of the longer line. Close pairs are found within narrow bands first."""
    x, y = (texts.select(F.col("id").alias(i), F.col("norm").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    both = pairs.distinct().join(x, "a").join(y, "b")
    both = both.withColumn("budget", F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - similarity) + 1e-9).cast("int"))
    bands = [F.expr(f"budget > {n} AND levenshtein(x, y, {n}) >= 0") for n in (16, 64, 256, 1024, 4096)]
    close = reduce(or_, bands) | F.expr("levenshtein(x, y, budget) >= 0")
    return both.filter(close).select("a", "b")


def _without_one(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(text))
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def letter_keys(norm: Column) -> Column:
    """Hashes of a short line less one letter or two, as many as its budget and that
    of a longer partner allow: lines within the budget share one (FastSS)."""
    one = _without_one(norm)
    two = F.flatten(F.transform(one, _without_one))
    # A budget of one needs a partner of five letters, one of two a partner of ten.
    size = F.length(norm)
    some = F.when((size < 4) | (size > FEW_LETTERS), F.array().cast("array<string>"))
    some = some.when(size < 8, F.concat(F.array(norm), one)).otherwise(F.concat(F.array(norm), one, two))
    return F.transform(some, lambda t: F.xxhash64(F.lit("letters"), t))


def usable_groups(words: Column) -> Column:
    """Bits of the three of five groups of ``words`` in which no two voting words share
    a block, as in all of a line without a block."""
    zero = F.lit(0).cast("long")

    def place(w: Column) -> Column:
        # Nine bits for a group: its blocks, and one for a block that came twice.
        shift = (w["h"] % GROUPS * (BLOCKS + 1)).cast("int")
        bit = F.when(w["block"].isNull(), zero).otherwise(F.call_function("shiftleft", zero + 1, shift + w["block"]))
        return F.struct(bit.alias("bit"), F.call_function("shiftleft", zero + (1 << BLOCKS), shift).alias("twice"))

    def seen(a: Column, w: Column) -> Column:
        return a.bitwiseOR(F.when(a.bitwiseAND(w["bit"]) != 0, w["twice"]).otherwise(w["bit"]))

    def kept(a: Column) -> Column:
        bits = zero
        for i, groups in enumerate(combinations(range(GROUPS), GROUPS - 2)):
            x, y, z = (F.shiftrightunsigned(a, g * (BLOCKS + 1)).bitwiseAND((2 << BLOCKS) - 1) for g in groups)
            alone = (x.bitwiseOR(y).bitwiseOR(z) < 1 << BLOCKS) & (x.bitwiseAND(y) == 0) & (x.bitwiseOR(y).bitwiseAND(z) == 0)
            bits = bits + F.when(alone, F.lit(1 << i).cast("long")).otherwise(zero)
        return bits

    return F.aggregate(F.transform(words, place), zero, seen, kept)


def line_words(common: list[int]) -> Column:
    """(h, n, block) of the words of ``norm``; ``block`` is null for those that do not
    vote, by their hashes ``common``."""
    hashed = F.transform(F.split("norm", " "), lambda w: F.struct(F.xxhash64(w).alias("h"), F.length(w).cast("long").alias("n")))

    def word(w: Column) -> Column:
        block = w["h"].bitwiseAND(BLOCKS - 1).cast("int")
        block = F.when(~w["h"].isin(common), block) if common else F.when(F.lit(True), block)
        return F.struct(F.shiftrightunsigned(w["h"], 24).alias("h"), w["n"].alias("n"), block.alias("block"))

    return F.transform(hashed, word)


def word_keys(texts: DataFrame, common: list[int]) -> DataFrame:
    """(id, norm, rest, keys): hashes of the words of each line of ``texts`` (id, norm),
    in any order, less up to two words (few words) or two of their groups (many). What is
    left holds two fifths of the letters or more, or a third of them, and no two voting
    words of a block, as all words of a line without a block (``rest``)."""
    # Step by step, so that nothing is worked out once for every use.
    zero = F.lit(0).cast("long")
    texts = texts.select("id", "norm", line_words(common).alias("words"))
    several = F.size(F.split("norm", " ")) >= FEW_WORDS - 1
    texts = texts.select("*", F.when(several, usable_groups(F.col("words"))).otherwise(zero).alias("usable"))
    # Most lines have too many voting words to share a key with one without a block.
    texts = texts.filter((F.size(F.split("norm", " ")) <= FEW_WORDS) | (F.col("usable") != 0) | (F.length("norm") <= FEW_LETTERS))
    size, none = F.size("words"), F.array().cast("array<bigint>")
    blocks = F.transform(F.filter("words", lambda w: w["block"].isNotNull()), lambda w: w["block"])

    def total(name: str) -> Column:
        return F.aggregate("words", zero, lambda a, w: a + w[name])

    def part(name: str, group: int) -> Column:
        added = F.aggregate("words", zero, lambda a, w: a + F.when(w["h"] % GROUPS == group, w[name]).otherwise(zero))
        return F.when(F.col("usable") != 0, added).alias(f"{name}{group}")

    # Four bits for the voting words of a block, of few words.
    lane = F.aggregate("words", zero, lambda a, w: a + lane_of(w))
    texts = texts.select(
        "*", total("h").alias("h"), total("n").alias("n"), F.when(size <= FEW_WORDS, lane).alias("lanes"), blocks.alias("blocks"),
        *[part(x, g) for x in "hn" for g in range(GROUPS)],
    )

    def holds(lanes: Column, n: Column) -> Column:
        return (n * 5 >= F.col("n") * 2) & (lanes.bitwiseAND(0xEEEEEEEE) == 0)

    def less_two(w: Column, i: Column) -> Column:
        others = F.filter("words", lambda v, j: (j > i) & holds(F.col("lanes") - lane_of(w) - lane_of(v), F.col("n") - w["n"] - v["n"]))
        return F.transform(others, lambda v: F.col("h") - w["h"] - v["h"])

    whole_line = F.when(F.col("lanes").bitwiseAND(0xEEEEEEEE) == 0, F.array("h")).otherwise(none)
    one = F.transform(F.filter("words", lambda w: holds(F.col("lanes") - lane_of(w), F.col("n") - w["n"])), lambda w: F.col("h") - w["h"])
    few = F.concat(whole_line, one, F.flatten(F.transform("words", less_two)))
    many = [
        F.when(
            (F.col("usable").bitwiseAND(1 << i) != 0) & (sum([F.col(f"n{g}") for g in kept[1:]], F.col(f"n{kept[0]}")) * 3 >= F.col("n")),
            F.xxhash64(F.lit("groups"), *[F.lit(g) for g in kept], *[f"h{g}" for g in kept]),
        )
        for i, kept in enumerate(combinations(range(GROUPS), GROUPS - 2))
    ]
    # Lines of one word more or less have keys of a kind in common.
    keys = F.concat(
        F.when(size <= FEW_WORDS, F.transform(few, lambda h: F.xxhash64(F.lit("words"), h))).otherwise(none),
        F.when(F.col("usable") != 0, F.array_compact(F.array(*many))).otherwise(none),
    )
    return texts.select("id", "norm", (F.size("blocks") == F.size(F.array_distinct("blocks"))).alias("rest"), keys.alias("keys"))


def lane_of(w: Column) -> Column:
    return F.when(w["block"].isNull(), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), w["block"] * 4))


def shared_keys(keys: DataFrame, *wanted: Column) -> DataFrame:
    """(key, id) of the keys in ``keys`` (key, id, no pair twice) that two lines or more
    share, of those ``wanted``. A key of two lines is told by its ends alone."""
    ends = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"), *wanted)
    ends = kept_table(ends.filter(" AND ".join(["n > 1", *["wanted"] * len(wanted)])), "ends")
    two = ends.filter("n = 2").select("key", F.explode(F.array("least", "most")).alias("id"))
    more = ends.filter("n > 2").select("key")
    return two.unionByName(keys.select("key", "id").join(lookup(more, more.count()), "key"))


def rest_members(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(key, id) of the keys that a line without a block shares with another line."""
    # At most 100 hashes for each word of an average line (``common_words``).
    hashes = [r[0] for r in common.select(F.xxhash64("common")).collect()]
    keys = word_keys(lines.select("id", "norm"), hashes)
    keys = keys.select("id", "rest", F.explode(F.concat("keys", letter_keys(F.col("norm")))).alias("key"))
    keys = kept_table(keys.distinct(), "rest_keys")
    return shared_keys(keys, F.max("rest").alias("wanted"))


def key_members(sigs: DataFrame) -> DataFrame:
    """(key, id) of the block keys that two lines or more share."""
    return shared_keys(sigs)


def _grouped(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return members.withColumn("g", F.col("id"))
    return members.join(groups, "id", "left").withColumn("g", F.coalesce("g", "id"))


def line_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that connect all lines that links of ``members`` (key, id and
    letter counts) connect; ``texts`` is (id, norm)."""
    size = members.count()
    least = members.groupBy("key").agg(F.min("id").alias("a"))
    first = members.join(least, "key").filter("a <> id").groupBy("id").agg(F.min("a").alias("a"))
    links = checkpoint(similar(first.select("a", F.col("id").alias("b")), texts))
    groups, found = None, links
    for turn in range(ROUNDS + 1):
        if found.count() * 50 > size:
            # Links join groups; so few that little would change do not.
            groups = checkpoint(components(links).select("id", F.col("component").alias("g")))
        placed = _grouped(members, groups)
        sizes = placed.groupBy("key", "g").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        square = F.sum(F.col("n").cast("double") * F.col("n"))
        spread = sizes.groupBy("key").agg(
            F.count("*").alias("groups"),
            ((F.sum("n").cast("double") * F.sum("n") - square) / 2).alias("pairs"),
            F.min(F.struct("first", "g")).alias("hub"),
        )
        spread = checkpoint(spread.filter("groups > 1").select("key", "pairs", F.col("hub.first").alias("hub"), F.col("hub.g").alias("hub_g")))
        pairs = spread.agg(F.sum("pairs")).first()[0]
        if not pairs:
            break
        placed = checkpoint(placed.join(spread.select("key", "hub", "hub_g"), "key"))
        last = turn == ROUNDS or pairs <= PAIRS_LEFT * size
        if last:
            sides = [placed.select("key", *[F.col(c).alias(f"{p}{c}") for c in placed.columns if c != "key"]) for p in ("l_", "r_")]
            met = sides[0].join(sides[1], "key").filter((F.col("l_id") < F.col("r_id")) & (F.col("l_g") != F.col("r_g")) & may_be_similar("l_", "r_"))
            tried = met.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
        else:
            # Every member of another group against the smallest line of the key,
            # which has then met all others and goes.
            hubs = placed.filter("id = hub").select("key", *[F.col(c).alias(f"h_{c}") for c in ("n_chars", *[f"c{i}" for i in range(len(CLASSES))])])
            met = placed.filter("g <> hub_g").join(hubs, "key").filter(may_be_similar("h_", ""))
            tried = met.select(F.col("hub").alias("a"), F.col("id").alias("b"))
            members = placed.filter("id <> hub").select(*members.columns)
        found = checkpoint(similar(tried, texts))
        links = checkpoint(links.unionByName(found))
        if last:
            break
    return links


def line_groups(lines: DataFrame) -> DataFrame:
    """(id, component) of every line id that links to another."""
    common = common_words(lines)
    met = key_members(kept_table(signatures(lines, common), "keys")).unionByName(rest_members(lines, common))
    members = checkpoint(met)
    ids = checkpoint(members.select(F.col("id").alias("wanted")).distinct())
    texts = lines.join(lookup(ids, ids.count()), F.col("id") == F.col("wanted"), "left_semi")
    texts = checkpoint(texts.groupBy("id").agg(F.first("norm").alias("norm")))
    members = checkpoint(members.join(texts.select("id", *letter_counts(F.col("norm"))), "id"))
    return components(line_links(members, texts))


def lost_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, lost): the numbers of the lines that each document loses."""
    lines = kept_table(split_lines(docs, id_col, text_col), "lines")
    groups = checkpoint(line_groups(lines))
    places = lines.select("doc_id", "text_key", "line", "id")
    # A twin row is the same place; it must not count as a repeat.
    place = F.struct("doc_id", "line", "text_key").alias("place")
    nodes = places.groupBy("id").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    nodes = checkpoint(nodes.join(groups, "id", "left").withColumn("g", F.coalesce("component", "id")))
    repeated = nodes.groupBy("g").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first <> last").select("g", "first")
    stay = checkpoint(nodes.join(repeated.withColumnRenamed("first", "keep"), "g").select(F.col("id").alias("repeated_id"), "keep"))
    lost = places.join(lookup(stay, stay.count()), F.col("id") == F.col("repeated_id")).filter(F.struct("doc_id", "line", "text_key") != F.col("keep"))
    return checkpoint(lost.groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lost")))


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and the columns n_lines
    and n_removed.

    Lines without letters or digits are never taken out. Null texts stay null and
    empty texts empty; a document that loses all lines has an empty text; a null id
    counts as the smallest. Rows that repeat in id and text are one document: they
    lose and keep the same lines. Long texts and lines are taken whole. Other
    columns stay; earlier columns of the two added names are replaced.
    """
    spark = docs.sparkSession
    lost_id, lost_key, gone = free_names(docs, "lost_id", "lost_key", "lost")
    with freed_shuffles(spark):
        lost = lost_lines(docs, id_col, text_col).toDF(lost_id, lost_key, gone)
        size = lost.agg(F.count("*") + F.sum(F.size(gone)) / 8).first()[0] or 0
    text = whole(text_col)
    rest = docs.drop("n_lines", "n_removed")
    both = rest.join(
        lookup(lost, int(size)), F.col(id_col).eqNullSafe(F.col(lost_id)) & (F.xxhash64(text) == F.col(lost_key)), "left"
    )
    parts = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    shorter = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    return both.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(shorter).alias(c) if c == text_col else F.col(c) for c in rest.columns],
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
