"""SimHash near-duplicates by a binary trie joined with itself.

Every document becomes a 64-bit fingerprint; equal fingerprints are one node of
the link graph, so copies never meet in pairs. Fingerprints within an error
budget are found by walking pairs of trie nodes together: the differing bits of
the two paths add up, and a pair is pruned once they exceed the budget.

The upper levels of the trie are shared out by Spark: the node pairs at a depth
that follows the number of fingerprints are the tasks' work, and each gets the
sorted fingerprints of its one or two subtries. A subtrie has a bounded expected
size at any scale, and only pairs within the budget exist, so a fingerprint is
sent to a number of pairs that grows with a power of the depth, not with the
table. A task reports a spanning forest of its links, never all of them.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, whole
from gridloom.llm.components import components
from gridloom.session import checkpoint

BITS, BUDGET, WORDS, SEED = 64, 4, 4, 42
# Expected fingerprints of a subtrie, and the least depth of the shared levels.
SUBTRIE, LEAST_DEPTH = 1 << 19, 4
# Trie nodes of this size or less are compared leaf by leaf.
LEAF = 8
CHUNK_CHARS, CHUNK_PAIRS = 4_000_000, 1 << 20
FIND_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle of a text."""
    words = FIND_WORDS(text.encode("utf-8", "replace").translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    n = max(len(words) - width + 1, 1)
    stops = (ends[width - 1 :] if len(words) >= width else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    found = [digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)]
    return np.array(found, np.uint64)


def fingerprint_of(texts: list[str], width: int = WORDS) -> np.ndarray:
    """64-bit fingerprints as signed numbers."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i, text in enumerate(texts):
        hashes, ones = _hashes(text, width), np.zeros(BITS, np.int64)
        for a in range(0, len(hashes), 1 << 16):
            part = hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[ones * 2 > len(hashes)].sum(dtype=np.uint64)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text. Null and empty texts,
    and texts without words, have fingerprint 0."""

    def work(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts, [len(t) for t in texts], CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(fingerprint_of(texts[a:b], width), pa.int64())],
                    names=["id", "fp"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(work, f"id {kind}, fp long")




class Forest:
    """Union-find over positions, fed with whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[x]
            if np.array_equal(up, x):
                return x
            x = self.root[up]

    def join(self, a: np.ndarray, b: np.ndarray):
        """Add links; returns the indexes of those that joined two trees."""
        used = []
        left = np.arange(len(a))
        while len(left):
            ra, rb = self.find(a[left]), self.find(b[left])
            apart = ra != rb
            left, ra, rb = left[apart], ra[apart], rb[apart]
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            # Every root takes one of its links at most, so no cycle arises.
            first = np.unique(high, return_index=True)[1]
            self.root[high[first]] = low[first]
            used.append(left[first])
        return np.concatenate(used) if used else left


def _halves(values, low, high, bit):
    """Where each range of sorted values splits at ``bit``."""
    above = (1 << 64) - (2 << bit)
    middle = values[low] & np.uint64(above) | np.uint64(1 << bit)
    return np.clip(np.searchsorted(values, middle), low, high)


def trie_links(left: np.ndarray, right: np.ndarray | None, depth: int, diff: int, budget: int, leaf: int = LEAF):
    """A spanning forest of the links between (or, without ``right``, within)
    sorted distinct fingerprints that share ``depth`` leading bits on each side.

    Node pairs are ranges of the two arrays. All pairs of a level are split at
    once; the children that keep within the budget go on, and small ones are
    compared leaf by leaf. Ranges are taken in bounded batches, deepest first.
    """
    same = right is None
    values = left if same else np.concatenate([left, right])
    n, total = len(left), len(values)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    forest = Forest(total)
    one = lambda x: np.array([x], np.int64)
    other = (0, n) if same else (n, total)
    work = [(one(0), one(n), one(other[0]), one(other[1]), one(diff), BITS - depth)]
    # Ranges of the right side index into ``values`` too, each half being sorted.

    def split(low, high, bit):
        if same:
            return _halves(left, low, high, bit)
        out = np.empty_like(low)
        mine = low < n
        out[mine] = _halves(left, low[mine], high[mine], bit)
        out[~mine] = _halves(right, low[~mine] - n, high[~mine] - n, bit) + n
        return out

    def compare(a0, a1, b0, b1):
        sizes = (a1 - a0) * (b1 - b0)
        for f, t in chunks(sizes, sizes.tolist(), CHUNK_PAIRS):
            size = sizes[f:t]
            pair = np.repeat(np.arange(f, t), size)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            width = (b1 - b0)[pair]
            i, j = a0[pair] + step // width, b0[pair] + step % width
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            near &= i < j
            i, j = i[near], j[near]
            used = forest.join(i, j)
            links.append((i[used], j[used]))

    while work:
        a0, a1, b0, b1, d, left_bits = work.pop()
        if len(a0) > CHUNK_PAIRS:
            half = len(a0) // 2
            work.append((a0[half:], a1[half:], b0[half:], b1[half:], d[half:], left_bits))
            work.append((a0[:half], a1[:half], b0[:half], b1[:half], d[:half], left_bits))
            continue
        small = ((a1 - a0 <= leaf) & (b1 - b0 <= leaf)) | (left_bits == 0)
        # Subtries whose remaining bits fit into the budget are linked as chains.
        close = ~small & (d + left_bits <= budget)
        if small.any():
            compare(a0[small], a1[small], b0[small], b1[small])
        for f, g, h, k in zip(a0[close], a1[close], b0[close], b1[close], strict=True):
            chain = np.r_[np.arange(f, g), np.arange(h, k)]
            used = forest.join(chain[:-1], chain[1:])
            links.append((chain[:-1][used], chain[1:][used]))
        go = ~small & ~close
        a0, a1, b0, b1, d = a0[go], a1[go], b0[go], b1[go], d[go]
        if not len(a0):
            continue
        am, bm = split(a0, a1, left_bits - 1), split(b0, b1, left_bits - 1)
        low = np.concatenate([a0, am, a0, am])
        high = np.concatenate([am, a1, am, a1])
        low2 = np.concatenate([b0, bm, bm, b0])
        high2 = np.concatenate([bm, b1, b1, bm])
        diffs = np.concatenate([d, d, d + 1, d + 1])
        keep = (diffs <= budget) & (high > low) & (high2 > low2)
        if same:
            keep &= low <= low2
        work.append((low[keep], high[keep], low2[keep], high2[keep], diffs[keep], left_bits - 1))
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    return values[i].view(np.int64), values[j].view(np.int64)


def near_links(distinct: DataFrame, count: int, budget: int = BUDGET, subtrie: int = SUBTRIE, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within the budget."""
    depth = least_depth
    while count >> depth > subtrie:
        depth += 1
    # Partners of each shared node: the differing bits name them, so nothing but
    # the masks (their number depends on the depth alone) is sent along.
    masks = [m for m in range(1 << depth) if m.bit_count() <= budget]
    node = F.shiftrightunsigned("fp", BITS - depth)
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in masks])) if len(masks) <= 64 else F.explode(
        F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << depth) - 1).cast("long")), lambda m: F.bit_count(m) <= budget)
    )
    sent = distinct.select("fp", node.alias("node"), mask.alias("mask")).select(
        "fp",
        F.least("node", F.col("node").bitwiseXOR(F.col("mask"))).alias("low"),
        F.greatest("node", F.col("node").bitwiseXOR(F.col("mask"))).alias("high"),
        (F.col("node") > F.col("node").bitwiseXOR(F.col("mask"))).alias("side"),
    )

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["side"].to_numpy()
        values = frame["fp"].to_numpy().view(np.uint64)
        if key[0] == key[1]:
            a, b = trie_links(np.sort(values), None, depth, 0, budget)
        else:
            one, two = np.sort(values[~side]), np.sort(values[side])
            diff = (int(key[0]) ^ int(key[1])).bit_count()
            a, b = (np.zeros(0, np.int64),) * 2
            if len(one) and len(two):
                a, b = trie_links(one, two, depth, diff, budget)
        return pd.DataFrame({"a": a, "b": b})

    return sent.groupBy("low", "high").applyInPandas(work, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, budget: int = BUDGET
) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    ``fingerprint`` is written as 16 hexadecimal digits; ``component_id`` is the
    smallest id reachable over links of ``budget`` or fewer differing bits.
    Texts without words share fingerprint 0. Repeated rows stay; a null id never
    names a component unless no other id is there; other columns are not read.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, width))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("id").alias("first")))
    groups = components(near_links(distinct.select("fp"), distinct.count(), budget))
    return named_groups(prints, distinct, groups).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def named_groups(prints: DataFrame, distinct: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, fp, component_id) of every row of ``prints`` (id, fp): the smallest id
    of the group of its fingerprint, by ``distinct`` (fp, first) and ``groups``
    (id, component)."""
    labelled = distinct.join(groups.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "component").select(F.col("fp").alias("named_fp"), "component_id")
    return prints.join(named, prints.fp == named.named_fp).select("id", "fp", "component_id")
