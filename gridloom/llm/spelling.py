"""Spelling variants by k-d trees over letter-count vectors.

One inserted, deleted or replaced letter changes the counts of a word's letters by
an L1 distance of at most two: a replaced letter takes one away and adds one, an
inserted letter adds one. So near words are looked for, for each pair of lengths
that can be near, in boxes of letter counts: a box is pruned once a word would need
more than one letter added (or taken away) to reach it. What is left is verified
letter by letter.

The upper levels of the tree are fitted on a bounded sample of the words and cut
all words into cells, whose exact boxes are one aggregation; at most 4,096 cells
exist, so the tree has a bounded size at any scale. A word is sent to its own cell
and to every cell that its search reaches - a number that grows with the square of
the tree's depth at most. Crowded cells are split into blocks by counts, queries as
well as words, so a task has a bounded load. In a task, a k-d tree over the block is
walked by all queries together. Links are never listed: a task returns for each of
its words the number of near words and the most frequent one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.alignment import ranges
from gridloom.llm.common import whole
from gridloom.llm.lines import freed_shuffles
from gridloom.session import bounded_lookup, checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LETTERS, LEAST_COUNT, SLIP = 5, 3, 97
# Counts kept apart: a-z, and six for all other letters together by code point.
DIMS = 32
# Words that the upper levels are fitted on, words of a cell, and the most cells.
SAMPLE_WORDS, CELL_WORDS, MOST_CELLS = 50_000, 8192, 4096
# Words, and queries, of one task's block; words of a leaf of its tree.
BLOCK_WORDS, BLOCK_QUERIES, LEAF = 16_384, 262_144, 24
CHUNK_QUERIES, CHUNK_LETTERS = 32_768, 4_000_000
SAME, LONGER, HOME = 1, 2, 4


def spelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word) of every run of letters, with a slip in one of 97 by its checksum."""
    low = F.translate(whole(text_col), UPPER, LOWER)
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LETTERS)
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")), "UTF-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the distinct words that are long and frequent enough."""
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Letters:
    """Words as one flat array of code points, and their count vectors."""

    def __init__(self, words: list[str]):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def vectors(self) -> np.ndarray:
        """Letter counts, then the length."""
        code = self.flat.astype(np.int64)
        plain = (code >= 97) & (code <= 122)
        dim = np.where(plain, code - 97, 26 + code % (DIMS - 26))
        at = np.repeat(np.arange(len(self.sizes)), self.sizes) * DIMS + dim
        counts = np.bincount(at, minlength=len(self.sizes) * DIMS).reshape(-1, DIMS)
        small = self.sizes.max(initial=0) < 30_000
        return np.c_[counts, self.sizes].astype(np.int16 if small else np.int32)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether word x becomes word y (as long, or one longer) by one edit."""
        out = np.zeros(len(x), bool)
        sizes = self.sizes[x]
        cut = np.searchsorted(np.cumsum(sizes), np.arange(CHUNK_LETTERS, sizes.sum() + CHUNK_LETTERS, CHUNK_LETTERS))
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(x)]):
            if a < b:
                out[a:b] = self._near(x[a:b], y[a:b], sizes[a:b])
        return out

    def _near(self, x, y, sizes):
        ends = np.cumsum(sizes)
        first = ends - sizes
        place = ranges(np.zeros(len(x), np.int64), sizes)
        left, right = self.flat[ranges(self.starts[x], sizes)], self.flat[at := ranges(self.starts[y], sizes)]
        differ = left != right
        longer = self.sizes[y] > sizes
        wrong = np.add.reduceat(differ, first, dtype=np.int64)
        # Before the inserted letter both words agree, behind it they are shifted.
        agree = np.minimum.reduceat(np.where(differ, place, np.repeat(sizes, sizes)), first)
        shifted = self.flat[np.minimum(at + 1, len(self.flat) - 1)]
        off = (left != shifted) & (place >= np.repeat(agree, sizes))
        return np.where(longer, np.add.reduceat(off, first, dtype=np.int64) == 0, wrong == 1)


class Tree:
    """A k-d tree over count vectors: cuts, and boxes of what lies in each node."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.dim, self.value, self.child, self.rows = [], [], [], []
        self._grow(vectors, np.arange(len(vectors)), leaf)
        self.child = np.array(self.child)
        self.leaves = np.flatnonzero(self.child < 0)
        self.low = self.high = None

    def _grow(self, vectors, rows, leaf) -> int:
        me = len(self.dim)
        found = self._cut(vectors[rows]) if len(rows) > leaf else None
        for column, x in ((self.dim, -1), (self.value, 0), (self.child, -1), (self.rows, rows)):
            column.append(x)
        if found is not None:
            self.dim[me], self.value[me] = found
            below = vectors[rows, found[0]] <= found[1]
            self._grow(vectors, rows[below], leaf)  # the left child is the next node
            self.child[me] = self._grow(vectors, rows[~below], leaf)
            self.rows[me] = None
        return me

    @staticmethod
    def _cut(own: np.ndarray):
        """The length while it varies, then the count that halves the words best."""
        best, found = 0, None
        for dims in ([DIMS], range(DIMS)):
            for d in dims:
                middle = int(np.partition(own[:, d], len(own) // 2)[len(own) // 2])
                for value in (middle - 1, middle):
                    below = int((own[:, d] <= value).sum())
                    if min(below, len(own) - below) > best:
                        best, found = min(below, len(own) - below), (d, value)
            if found is not None:
                return found
        return found

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf (node number) of every vector."""
        out = np.zeros(len(vectors), np.int64)
        work = [(0, np.arange(len(vectors)))]
        while work:
            node, rows = work.pop()
            if self.child[node] < 0:
                out[rows] = node
                continue
            below = vectors[rows, self.dim[node]] <= self.value[node]
            work += [(n, r) for n, r in ((node + 1, rows[below]), (self.child[node], rows[~below])) if len(r)]
        return out

    def fit_boxes(self, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of the leaves by node number (others are ignored); empty leaves have
        low above high and are never reached."""
        self.low, self.high = low, high
        for node in range(len(self.child) - 1, -1, -1):
            if self.child[node] >= 0:
                pair = [node + 1, self.child[node]]
                low[node], high[node] = low[pair].min(0), high[pair].max(0)

    def search(self, queries: np.ndarray, longer: bool):
        """(leaf, query indices) that may hold words as long as the query, or one
        longer, at one edit."""
        work = [(0, np.arange(len(queries)))]
        while work:
            node, rows = work.pop()
            own, low, high = queries[rows], self.low[node], self.high[node]
            size = own[:, DIMS] + longer
            fits = (size >= low[DIMS]) & (size <= high[DIMS])
            fits &= np.maximum(low[:DIMS] - own[:, :DIMS], 0).sum(1) <= 1
            fits &= np.maximum(own[:, :DIMS] - high[:DIMS], 0).sum(1) <= (0 if longer else 1)
            rows = rows[fits]
            if not len(rows):
                continue
            if self.child[node] < 0:
                yield node, rows
            else:
                work += [(node + 1, rows), (self.child[node], rows)]


def _box_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, DIMS + 1), 1 << 30, np.int64), np.full((n, DIMS + 1), -(1 << 30), np.int64)


def near_pairs(words: list[str], queries: list[str], modes: np.ndarray):
    """(query, word) index pairs at one edit, by a k-d tree over ``words``."""
    text, asked = Letters(words), Letters(queries)
    both = Letters([*queries, *words])
    points, probes = text.vectors(), asked.vectors()
    tree = Tree(points, LEAF)
    low, high = _box_arrays(len(tree.child))
    for leaf in tree.leaves:
        low[leaf], high[leaf] = points[tree.rows[leaf]].min(0), points[tree.rows[leaf]].max(0)
    tree.fit_boxes(low, high)
    tree.low, tree.high = low.astype(points.dtype), high.astype(points.dtype)
    for mode in (SAME, LONGER):
        active = np.flatnonzero(modes & mode)
        for a in range(0, len(active), CHUNK_QUERIES):
            part = active[a : a + CHUNK_QUERIES]
            found = []
            for leaf, rows in tree.search(probes[part], mode == LONGER):
                inside = tree.rows[leaf]
                for b in range(0, len(rows), 4096):
                    some = rows[b : b + 4096]
                    gap = points[inside][None, :, :] - probes[part[some]][:, None, :]
                    fits = gap[:, :, DIMS] == (mode == LONGER)
                    gap = gap[:, :, :DIMS]
                    fits &= np.abs(gap).sum(2) <= (1 if mode == LONGER else 2)
                    q, p = np.nonzero(fits)
                    found.append((part[some[q]], inside[p]))
            if found:
                q, p = (np.concatenate(x) for x in zip(*found))
                good = both.near(q, p + len(queries))
                yield q[good], p[good]


def _vectors_of(words: DataFrame) -> DataFrame:
    """(v) letter counts of every word, as 32-bit integers."""

    def work(batches):
        for batch in batches:
            found = Letters(batch.column(0).to_pylist()).vectors().astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in found], pa.binary())], names=["v"])

    return words.select("word").mapInArrow(work, "v binary")


def fit_cells(words: DataFrame, count: int, sample: int = SAMPLE_WORDS, cell: int = CELL_WORDS) -> Tree:
    """The upper levels of the tree, from the words with the smallest hashes."""
    hashed = words.select("word", F.xxhash64("word").alias("h"))
    if count > sample:
        # The sample has ``sample`` words up to chance, at most twice as many.
        hashed = hashed.filter(F.col("h") <= int(-(1 << 63) + sample / count * (1 << 64))).limit(2 * sample)
    raw = b"".join(bytes(r.v) for r in _vectors_of(hashed).collect())
    vectors = np.frombuffer(raw, "<i4").reshape(-1, DIMS + 1)
    vectors = vectors[np.lexsort(vectors.T)]
    cells = min(max(count // cell, 1), MOST_CELLS)
    return Tree(vectors, max(len(vectors) // cells, 1))


def _slim(tree: Tree) -> Tree:
    tree.rows = None
    return tree


def placed_words(words: DataFrame, tree: Tree) -> DataFrame:
    """(word, n, cell) of every word."""
    shipped = words.sparkSession.sparkContext.broadcast(tree)

    def work(batches):
        for batch in batches:
            cells = shipped.value.place(Letters(batch.column(0).to_pylist()).vectors())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=["word", "n", "cell"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, cell int")


def cell_boxes(placed: DataFrame, tree: Tree) -> Tree:
    """``tree`` with the exact boxes of its cells: least and greatest counts, one
    aggregation whose result has 33 numbers for each cell."""

    def work(batches):
        low, high = _box_arrays(len(tree.child))
        for batch in batches:
            cells = batch.column(1).to_numpy()
            vectors = Letters(batch.column(0).to_pylist()).vectors().astype(np.int64)
            order = np.argsort(cells, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cells[order]) != 0]) if len(order) else []
            if len(order):
                own = cells[order][starts]
                low[own] = np.minimum(low[own], np.minimum.reduceat(vectors[order], starts))
                high[own] = np.maximum(high[own], np.maximum.reduceat(vectors[order], starts))
        cell, dim = np.nonzero(high >= low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32()) for x in (cell, dim, low[cell, dim], high[cell, dim])], names=["cell", "dim", "low", "high"]
        )

    boxes = placed.select("word", "cell").mapInArrow(work, "cell int, dim int, low int, high int")
    low, high = _box_arrays(len(tree.child))
    for r in boxes.groupBy("cell", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).toLocalIterator():
        low[r.cell, r.dim], high[r.cell, r.dim] = r.low, r.high
    tree.fit_boxes(low, high)
    return tree


def sent_queries(placed: DataFrame, tree: Tree) -> DataFrame:
    """(cell, word, n, mode): every word with each cell that its search reaches. Of
    two cells, the search for words of the same length goes to the later one."""
    shipped = placed.sparkSession.sparkContext.broadcast(tree)

    def work(batches):
        for batch in batches:
            vectors, home = Letters(batch.column(0).to_pylist()).vectors(), batch.column(2).to_numpy()
            rows, cells, modes = [], [], []
            for mode in (SAME, LONGER):
                for cell, found in shipped.value.search(vectors, mode == LONGER):
                    found = found[home[found] <= cell] if mode == SAME else found
                    rows.append(found)
                    cells.append(np.full(len(found), cell))
                    modes.append(np.where(home[found] == cell, mode | HOME, mode))
            row, cell, mode = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cells, modes))
            # One row for both modes of a word and a cell.
            key, at = np.unique(cell * len(home) + row, return_inverse=True)
            merged = np.zeros(len(key), np.int64)
            np.bitwise_or.at(merged, at, mode)
            take = pa.array(key % max(len(home), 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key // max(len(home), 1), pa.int32()), batch.column(0).take(take), batch.column(1).take(take), pa.array(merged, pa.int32())],
                names=["cell", "word", "n", "mode"],
            )

    return placed.mapInArrow(work, "cell int, word string, n long, mode int")


def _best(x, y, words, counts):
    """For each word of ``x``: number of its partners ``y``, and the most frequent
    (ties: the smallest)."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[y], -counts[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.r_[first, len(x)]), y[first]


def compare_block(key, table):
    """Near words of one block: its words against its queries."""
    mode = table.column("mode").to_numpy()
    words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
    points, asked = np.flatnonzero(mode == 0), np.flatnonzero(mode)
    pairs = [
        (asked[q], points[p])
        for q, p in near_pairs([words[i] for i in points], [words[i] for i in asked], mode[asked])
    ]
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (list(zip(*pairs)) or ((), ())))
    # Two words of one cell of the same length meet twice: once counts.
    same = np.array([len(words[i]) == len(words[j]) and words[i] > words[j] for i, j in zip(x.tolist(), y.tolist())], bool)
    keep = ~(same & (mode[x] & HOME > 0)) if len(x) else same
    x, y = x[keep], y[keep]
    # A word may stand in the block as a word and as a query: by its first place.
    place = {}
    one = np.array([place.setdefault(w, i) for i, w in enumerate(words)], np.int64)
    own, near, best = _best(np.r_[one[x], one[y]], np.r_[one[y], one[x]], words, counts)
    return pa.table(
        {
            "word": pa.array([words[i] for i in own], pa.string()),
            "n_near": pa.array(near, pa.int64()),
            "best_n": pa.array(counts[best], pa.int64()),
            "best": pa.array([words[i] for i in best], pa.string()),
        }
    )


def near_words(words: DataFrame, sample: int = SAMPLE_WORDS, cell: int = CELL_WORDS, block_words: int = BLOCK_WORDS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n) that has near
    words: their number, and the most frequent of them (ties: the smallest). The
    bounds decide on the work's division only."""
    tree = _slim(fit_cells(words, words.count(), sample, cell))
    placed = checkpoint(placed_words(words, tree))
    tree = cell_boxes(placed, tree)
    queries = checkpoint(sent_queries(placed, tree))
    points = placed.select("cell", "word", "n", F.lit(0).alias("mode"))

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    # One row for each cell: at most 4,096 or so.
    grid = blocks(points, block_words, "across").join(blocks(queries, block_queries, "down"), "cell")
    grid = F.broadcast(checkpoint(grid))

    def part(n: str) -> Column:
        return F.pmod(F.xxhash64("word"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    columns = ["cell", "word", "n", "mode"]
    dealt = points.join(grid, "cell").select(*columns, part("across").alias("i"), every("down").alias("j")).unionByName(
        queries.join(grid, "cell").select(*columns, every("across").alias("i"), part("down").alias("j"))
    )
    found = dealt.groupBy("cell", "i", "j").applyInArrow(compare_block, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("m")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", (-F.col("m.minus")).alias("best_n"), F.col("m.best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the end, twice as far each
    round. A form is at least twice as frequent as its word, so chains are short."""
    jumps = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        far = jumps.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = checkpoint(jumps.join(bounded_lookup(far, far.count()), "root", "left"))
        jumps = moved.select("word", F.coalesce("far", "root").alias("root"))
        if moved.filter("far IS NOT NULL").isEmpty():
            return jumps


def group_variants(words: DataFrame, ratio: int = 2, **bounds) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n).

    ``form`` is the near word - one letter inserted, deleted or replaced - that is
    most frequent (ties: the smallest in code-point order), if it is at least
    ``ratio`` times as frequent as the word, else null; ``root`` is where the forms
    lead. Words are distinct and not null; an empty table gives no rows; long words
    are compared whole; other columns are not read.
    """
    with freed_shuffles(words.sparkSession):
        words = checkpoint(words.select("word", "n"))
        found = checkpoint(near_words(words, **bounds))
        forms = found.join(words, "word").filter(F.col("best_n") >= ratio * F.col("n")).select("word", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
        forms = checkpoint(forms)
        roots = checkpoint(last_forms(forms))
    out = words.join(found.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(roots, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``group_variants`` of all words of whole texts, with slips made by checksum.

    Null and empty texts have no words; a null id reads as an empty one in the
    checksum; repeated rows count as often as they are there.
    """
    return group_variants(count_words(spelled(docs, id_col, text_col)), **bounds)
