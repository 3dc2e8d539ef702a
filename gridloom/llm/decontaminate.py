"""Benchmark decontamination by pigeonhole pieces and bit-parallel distance.

An item of m letters may be hit with k = floor(m * rate) edits. It is cut into
k + 1 pieces, one of which any such hit holds unchanged. One automaton finds
the pieces of all items in a text; the window around each hit is verified with
Myers' bit-parallel distance, so only true hits within the budget are reported.

Documents are scanned where they lie, without a shuffle. The items are the
stated query set: they are taken in blocks of bounded size, and each block is
broadcast for one scan of all documents.
"""

from __future__ import annotations

import uuid
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.common import whole

RATE = 0.05
# Letters of items that one automaton holds.
BLOCK_CHARS = 1_000_000
SCHEMA = "item_id {item}, distance int, item_chars int, begin long, end long"


def normal(text: str) -> str:
    """Lower case, single blanks."""
    return " ".join(text.lower().split())


def search(peq: dict[str, int], size: int, text) -> tuple[int, int]:
    """Least edit distance of a pattern to any part of ``text``, and where the
    first such part ends (Myers, one machine word of any length)."""
    mask, high = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score, best, at = mask, 0, size, size, 0
    get = peq.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, i
        ph = ph << 1 & mask
        pv = mh << 1 & mask | ~(xv | ph) & mask
        mv = ph & xv
    return best, at


def _letters(text: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(text):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


class Items:
    """Items of one block, searched together."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        # Equal texts are searched once and reported for each id.
        by_text: dict[str, list] = {}
        for number, text in items:
            if text := normal(text):
                by_text.setdefault(text, []).append(number)
        self.texts, self.ids = list(by_text), list(by_text.values())
        self.budgets = [int(len(t) * rate) for t in self.texts]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (text, k) in enumerate(zip(self.texts, self.budgets, strict=True)):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        self.tables: dict[int, tuple] = {}

    def hits(self, text: str) -> list[tuple[object, int, int, int, int]]:
        """(item id, distance, item size, begin, end) in the normalised text: the
        best place of every item, the first among equals."""
        if self.empty:
            return []
        windows: dict[int, dict[int, None]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for item, offset in places:
                windows.setdefault(item, {})[end + 1 - size - offset] = None
        found = []
        for item, origins in windows.items():
            m, k = len(self.texts[item]), self.budgets[item]
            if item not in self.tables:
                self.tables[item] = (_letters(self.texts[item]), _letters(self.texts[item][::-1]))
            ahead, back = self.tables[item]
            best, low, high = (k + 1, 0, 0), None, None
            for origin in [*sorted(origins), None]:
                if origin is not None and low is not None and origin - k <= high:
                    high = origin + m + k
                    continue
                if low is not None:
                    distance, at = search(ahead, m, text[max(low, 0) : high])
                    if distance < best[0]:
                        end = max(low, 0) + at
                        size = search(back, m, text[max(end - m - k, 0) : end][::-1])[1]
                        best = (distance, end - size, end)
                if origin is not None:
                    low, high = origin - k, origin + m + k
            if best[0] <= k:
                found += [(number, best[0], m, best[1], best[2]) for number in self.ids[item]]
        return found


_ITEMS: dict[str, Items] = {}


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(id, item_id, distance, item_chars, begin, end) for every document row and
    benchmark item that its whole text holds within the error budget.

    Case and runs of white space do not count; begin and end are places in the
    text so normalised. ``benchmark`` has item_id and text. Null and empty texts
    hold nothing, null and empty items are nowhere; repeated rows are reported
    again, repeated item texts for each of their ids; null ids stay.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", whole("text").alias("text")).filter("text <> ''").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + SCHEMA.format(item=benchmark.schema["item_id"].dataType.simpleString())

    def scan(block: int) -> DataFrame:
        mine = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        shipped = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        key = uuid.uuid4().hex

        def work(batches):
            if key not in _ITEMS:
                _ITEMS.clear()
                _ITEMS[key] = Items(shipped.value, rate)
            searched = _ITEMS[key]
            for batch in batches:
                rows = [
                    (number, *hit)
                    for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                    for hit in searched.hits(normal(text))
                ]
                if rows:
                    types = [batch.schema.field(0).type, item_type, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    columns = zip(zip(*rows, strict=True), types, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)

        item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
        names = ["id", "item_id", "distance", "item_chars", "begin", "end"]
        return docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(work, schema)

    return reduce(DataFrame.unionByName, map(scan, range(blocks))).withColumnRenamed("id", id_col)
