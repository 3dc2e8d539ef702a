"""Alignment of the tokens of two tokenizers by interval coalescing.

Both tokenizers cut the bytes of a text; a token is an interval of byte offsets.
All tokens of both sides, of many texts on one axis, are sorted by start, the
running maximum of their ends is taken, and a group breaks where a start reaches
it. Within the groups, every pair of overlapping tokens is a link.

Spark deals out the texts; one map encodes and aligns them, and writes for every
text its groups and how often each pair of ids is linked. Link counts of all texts
are one aggregation, combined before the shuffle. To hold every link against them,
the most frequent pairs - a bounded number - are broadcast, so hot pairs never move;
only links of the rarer pairs are shuffled, if there are more pairs than the bound.
The files of the tokenizers, of bounded size, are read by the driver and broadcast.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import byte_letters
from gridloom.llm.common import chunks, whole
from gridloom.llm.lines import freed_shuffles
from gridloom.session import checkpoint, shared_folder

CHUNK_CHARS = 1_000_000
# Pairs of ids that may be broadcast with their counts (about 40 bytes each).
PAIR_ROWS = 1_000_000
B_BITS = 32


# Fixed value: how byte-level files of this kind cut a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Longer texts go through the slower of two equal coders, which takes any length.
LONG_TEXT = 1_000_000


class ByteLevel:
    """A byte-level BPE file (JSON); control strings in texts are plain text.

    Where the ids follow the order of the merges - a token's id is then its rank -
    the faster coder by ranks gives the same ids.
    """

    def __init__(self, content: bytes):
        self.coder = tokenizers.Tokenizer.from_str(content.decode("utf-8"))
        self.coder.encode_special_tokens = True
        letter = {c: b for b, c in enumerate(byte_letters())}
        size = max(self.coder.get_vocab(True).values()) + 1
        file = json.loads(content)
        added = {t["id"] for t in file["added_tokens"]}
        names = [self.coder.id_to_token(i) or "" for i in range(size)]
        self.bytes = [
            t.encode() if i in added or any(c not in letter for c in t) else bytes(letter[c] for c in t) for i, t in enumerate(names)
        ]

        self.ranked = self._by_ranks(file, added)

    def _by_ranks(self, file: dict, added: set[int]) -> tiktoken.Encoding | None:
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        plain = (
            made == list(range(256, 256 + len(made)))
            and sorted(self.bytes[:256]) == [bytes([b]) for b in range(256)]
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and file.get("normalizer") is None
            and not model.get("ignore_merges")
        )
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in added}
        return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if plain else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of the texts with a space before them."""
        if self.ranked is None:
            return [e.ids for e in self.coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [
            self.ranked.encode_ordinary(" " + t) if len(t) <= LONG_TEXT else self.coder.encode(" " + t, add_special_tokens=False).ids
            for t in texts
        ]


class Pieces:
    """A sentencepiece model, which puts a space before a text itself."""

    def __init__(self, content: bytes):
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self.coder.get_piece_size()
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.coder.id_to_piece(i)) for i in range(n))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of every range, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def coalesce(a_starts, a_ends, b_starts, b_ends) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group number of every A and B interval, and the links (index of A, of B).

    The intervals of one side are sorted, not empty and do not overlap each other.
    """
    starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
    # Stable: of equal starts, A comes first.
    order = np.lexsort((starts,))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.r_[False, starts[order][1:] >= reach[:-1]] if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    # Overlapping tokens share a group; B tokens that end after A starts and start
    # before A ends are neighbours.
    low = np.searchsorted(b_ends, a_starts, "right")
    n = np.maximum(np.searchsorted(b_starts, a_ends, "left") - low, 0)
    return group[: len(a_starts)], group[len(a_starts) :], np.repeat(np.arange(len(a_starts)), n), ranges(low, n)


@dataclass
class Side:
    """Tokens of the texts of a chunk, on one axis of bytes."""

    ids: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _side(found: list[list[int]], sizes: np.ndarray) -> Side:
    n = np.array([len(x) for x in found], np.int64)
    ids = np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
    ends = np.cumsum(sizes[ids])
    return Side(ids, np.repeat(np.arange(len(found)), n), ends - sizes[ids], ends)


class Aligner:
    """Aligns texts in one Python worker."""

    def __init__(self, first, second):
        self.coders = (first, second)
        self.sizes = [np.array([len(b) for b in c.bytes], np.int64) for c in self.coders]
        numbers = [str(i).encode() for i in range(max(map(len, self.sizes)))]
        # Decimal digits of every id, with room for a mark behind them.
        self.widths = np.array([len(x) for x in numbers], np.int64)
        width = int(self.widths.max(initial=0)) + 1
        self.digits = np.frombuffer(b"".join(x.ljust(width) for x in numbers), np.uint8).reshape(-1, width)

    def tokens(self, texts: list[str]) -> list[list[list[int]]]:
        """Ids of both sides; none where a text is empty or bytes do not agree."""
        found = [c.encode(texts) for c in self.coders]
        for i, text in enumerate(texts):
            raw = (" " + text).encode("utf-8", "replace") if text else b""
            if not text or any(b"".join(map(c.bytes.__getitem__, ids[i])) != raw for c, ids in zip(self.coders, found)):
                for ids in found:
                    ids[i] = []
        return found

    def _written(self, a: Side, b: Side, ga: np.ndarray, gb: np.ndarray, n: int) -> pa.Array:
        """Groups of every text as ``a1,a2|b1;a3|b2,b3``."""
        groups = int(max(ga.max(initial=-1), gb.max(initial=-1))) + 1
        upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=groups)) for g in (ga, gb))
        at_a = np.arange(len(ga)) + np.r_[0, upto_b][ga]
        at_b = np.arange(len(gb)) + upto_a[gb]
        total = len(ga) + len(gb)
        ids, text, mark = np.empty(total, np.int64), np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[at_a], ids[at_b], text[at_a], text[at_b] = a.ids, b.ids, a.text, b.text
        mark[at_a[np.arange(len(ga)) + 1 == upto_a[ga]]] = ord("|")
        mark[at_b[np.arange(len(gb)) + 1 == upto_b[gb]]] = ord(";")
        more = np.r_[text[1:] == text[:-1], False] if total else np.zeros(0, bool)
        widths, out = self.widths[ids], self.digits[ids]
        out[np.arange(total), widths] = mark
        out = out[np.arange(out.shape[1]) < (widths + more)[:, None]]
        ends = np.cumsum(widths + more)
        last = np.cumsum(np.bincount(text, minlength=n))
        offsets = np.r_[0, np.r_[0, ends][last]].astype(np.int32)
        return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))

    def align(self, texts: list[str]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups and pairs of every text."""
        n = len(texts)
        a, b = (_side(ids, s) for ids, s in zip(self.tokens(texts), self.sizes))
        ga, gb, i, j = coalesce(a.starts, a.ends, b.starts, b.ends)
        firsts = np.r_[True, ga[1:] != ga[:-1]] if len(ga) else np.zeros(0, bool)
        per_text = [np.bincount(x, minlength=n) for x in (a.text, b.text, a.text[firsts], a.text[i])]
        # Pairs of ids by text: sorted, then counted as runs. Text, A id and B id
        # make one number: texts of a chunk x vocabularies stay below 2^62.
        first, second = (len(x) for x in self.sizes)
        key = np.sort((a.text[i] * first + a.ids[i]) * second + b.ids[j])
        runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times, key = np.diff(np.r_[runs, len(key)]), key[runs]
        text, pair = key // (first * second), (key // second % first) << B_BITS | key % second
        offsets = np.r_[0, np.cumsum(np.bincount(text, minlength=n))].astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int32())], ["pair", "n"])
        return [
            *[pa.array(x, pa.int64()) for x in per_text],
            self._written(a, b, ga, gb, n),
            pa.ListArray.from_arrays(pa.array(offsets), pairs),
        ]


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(name: str, shipped) -> Aligner:
    """One aligner for each pair of files and Python worker, kept between tasks."""
    if name not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(*[(ByteLevel if c[:1] == b"{" else Pieces)(c) for c in shipped.value])
    return _ALIGNERS[name]


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs) of every whole text.

    ``first`` (A) and ``second`` (B) are paths of a byte-level JSON file or a
    sentencepiece model; both cut the text with a space before it. ``groups`` is
    ``a1,a2|b1;a3|b2,b3``, ids in order; ``pairs`` has every linked pair of ids
    (A id x 2^32 + B id) with the number of links ``n``. Texts that are null or
    empty, or whose tokens do not join to the same bytes, have no tokens: zeros, an
    empty text and an empty list. Null ids and repeated rows pass one by one, long
    texts are taken whole, an empty table gives no rows; other columns are not read.
    """
    contents = []
    for path in (first, second):
        with open(path, "rb") as file:
            contents.append(file.read())
    shipped = docs.sparkSession.sparkContext.broadcast(contents)
    name = f"{first}\n{second}"
    columns = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"]

    def work(batches):
        aligner = _aligner(name, shipped)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in chunks(texts, [len(t) for t in texts], CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *aligner.align(texts[x:y])], names=columns)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(
        work,
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<pair: long, n: int>>",
    )
    return out.withColumnRenamed("id", id_col)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best) of every linked pair of ids in ``aligned`` (pairs):
    ``best`` if no other pair of its B id is linked more often."""
    counts = checkpoint(aligned.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("count")))
    own = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    # One row for each B id: bounded by the vocabulary.
    top = counts.groupBy(own.alias("b")).agg(F.max("count").alias("top"))
    return checkpoint(counts.join(F.broadcast(top), own == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best")))


def hold_links(aligned: DataFrame, key: str, most: int = PAIR_ROWS) -> DataFrame:
    """(key, n_best, count_sum) of every row of ``aligned`` (key, pairs) with links:
    links whose count is their B id's highest, and the sum of the counts of all
    links. ``key`` tells the rows apart; ``most`` pairs are broadcast at once, the
    result does not depend on it."""
    counts = link_counts(aligned)
    # The least power of two that leaves at most ``most`` pairs above it.
    sizes = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().orderBy(F.desc("power")).collect()
    least, kept = 1 << 62, 0
    for row in sizes:
        if kept + row["count"] > most:
            break
        least, kept = 1 << row.power, kept + row["count"]
    common, rare = counts.filter(F.col("count") >= least), counts.filter(F.col("count") < least)
    links = aligned.select(key, F.inline("pairs"))
    sums = [
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("count")).alias("count_sum"),
    ]
    held = links.join(F.broadcast(common), "pair").groupBy(key).agg(*sums)
    if kept < sum(r["count"] for r in sizes):
        rest = links.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy(key).agg(*sums)
        held = held.unionByName(rest).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return held


def align_and_score(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", most: int = PAIR_ROWS) -> DataFrame:
    """The counts of ``align`` for every row, with groups_sha256 (empty without
    tokens), n_best and count_sum; see there for nulls and odd texts."""
    spark = docs.sparkSession
    path = shared_folder(spark, "aligned")
    aligned = align(docs, first, second, id_col, text_col).withColumnRenamed(id_col, "id")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.encode("groups", "UTF-8"), 256))
    # The number of a row holds once it is written.
    narrow = aligned.select(F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs")
    narrow.write.option("compression", "zstd").parquet(path)
    narrow = spark.read.parquet(path)
    with freed_shuffles(spark):
        held = checkpoint(hold_links(narrow.select("row", "pairs"), "row", most)).withColumnRenamed("row", "held_row")
    out = narrow.drop("pairs").join(held, F.col("row") == F.col("held_row"), "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
