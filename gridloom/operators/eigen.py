"""Leading eigenvectors of a large sparse symmetric matrix given as a table.

A block of vectors is a row of numbers for each id. Multiplying it is a join on the
entries and a grouped sum; inner products of blocks are sums over rows. Each round
filters the block by a Chebyshev polynomial, which keeps the eigenvalues above the
least one found so far, and takes the best vectors within it (Rayleigh-Ritz) as the
next start, so only matrices as wide as the blocks are on the driver. The entries
stay dealt by id, so that a product is one shuffle, and several products are one job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.sums import batch_array, sum_over_rows
from gridloom.session import checkpoint

# Vectors beyond those wanted, and rounds.
SPARE, ROUNDS = 8, 40
# Highest degree of a filter, and how much it may favour an eigenvalue of one over
# the least one found: beyond it vectors of a round would lose their digits.
DEGREE, FAVOUR = 100, 1e4
# Products between two checkpoints.
CHAIN = 10


def normalised(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (src, dst, weight) of D^-1/2 W D^-1/2 and the degrees (id, degree) of
    an undirected graph, each of whose edges (src, dst, weight) is given once."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    both = checkpoint(both)
    degrees = checkpoint(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")))
    for side in ("src", "dst"):
        own = degrees.select(F.col("id").alias(side), (1 / F.sqrt("degree")).alias("factor"))
        both = both.join(own, side).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
    return checkpoint(both), degrees


def _dealt(entries: DataFrame) -> DataFrame:
    """(src, dst, weight, own): the entries and a row of weight zero from each id to
    itself, which carries its own values along; dealt by ``src`` and kept."""
    own = entries.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("own"))
    return entries.select("src", "dst", "weight", F.lit(0.0).alias("own")).unionByName(own).repartition("src").persist()


def _times(table: DataFrame, block: DataFrame, width: int, slope: float, shift: float, before: bool) -> DataFrame:
    """(id, c, p): slope * M + shift times the columns c of the block, less its columns
    p where ``before``; the block's own c are the new p."""
    gain = F.col("weight") * F.lit(float(slope)) + F.col("own") * F.lit(float(shift))
    sums = []
    for j in range(width):
        value = gain * F.col(f"c{j}")
        sums.append(F.sum(value - F.col("own") * F.col(f"p{j}") if before else value).alias(f"c{j}"))
    sums += [F.sum(F.col("own") * F.col(f"c{j}")).alias(f"p{j}") for j in range(width)]
    return table.join(block, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(*sums)


def _degree(least: float) -> int:
    """Of the filter that damps eigenvalues from -1 to ``least``."""
    return int(max(1, min(DEGREE, np.arccosh(FAVOUR) / np.arccosh((3 - least) / (1 + least)))))


def _filtered(table: DataFrame, block: DataFrame, width: int, least: float) -> DataFrame:
    """(id, c, p): the matrix times the filtered block, and the filtered block as p."""
    middle, half = (least - 1) / 2, (least + 1) / 2
    for step in range(_degree(least)):
        twice = 2 if step else 1
        block = _times(table, block, width, twice / half, -twice * middle / half, step > 0)
        if step % CHAIN == CHAIN - 1:
            block = checkpoint(block)
    return checkpoint(_times(table, block, width, 1.0, 0.0, False))


def _combined(space: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """(id, c): the space's columns times a matrix, row by row."""
    width = matrix.shape[1]
    out = ["id", *[f"c{j}" for j in range(width)]]

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([batch_array(c) for c in batch.columns[1:]]) @ matrix
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, j]) for j in range(width)]], names=out)

    schema = ", ".join(["id bigint", *[f"{c} double" for c in out[1:]]])
    return checkpoint(space.select("id", *names).mapInArrow(work, schema))


def leading_vectors(entries: DataFrame, wanted: int, tolerance: float = 1e-4, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, v) with the ``wanted`` eigenvectors of the largest eigenvalues, and these.

    ``entries`` (src, dst, weight) hold both triangles of a matrix with eigenvalues
    between -1 and 1. Rounds end when every vector's residual under half of the
    matrix is within the tolerance. The start is drawn by hashes of the ids, so
    results repeat.
    """
    table = _dealt(entries)
    ids = checkpoint(entries.select(F.col("src").alias("id")).distinct())
    width = min(wanted + SPARE, ids.count())
    block = ids.select("id", *[(F.xxhash64("id", F.lit(j)) / F.lit(float(1 << 63))).alias(f"c{j}") for j in range(width)])
    least = 0.0
    for turn in range(rounds + 1):
        space = _filtered(table, block, width, least)
        base, image = [f"p{j}" for j in range(width)], [f"c{j}" for j in range(width)]

        def products(*columns, width=width):
            x, y = np.column_stack(columns[:width]), np.column_stack(columns[width:])
            return np.concatenate([(a.T @ b).ravel() for a, b in ((x, x), (x, y), (y, y))])

        gram, inner, outer = sum_over_rows(space, [*base, *image], products, 3 * width * width).reshape(3, width, width)
        # Scaled to unit columns; directions that are nearly dependent are left out.
        scale = 1 / np.sqrt(np.diag(gram).clip(min=1e-300))
        values, vectors = np.linalg.eigh(gram * np.outer(scale, scale))
        good = values > 1e-10 * values.max()
        basis = scale[:, None] * vectors[:, good] / np.sqrt(values[good])
        small = basis.T @ inner @ basis
        found, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-found)
        found, matrix = found[order], basis @ turned[:, order]
        rest = (
            np.einsum("ij,ik,kj->j", matrix, outer, matrix)
            - 2 * found * np.einsum("ij,ik,kj->j", matrix, inner, matrix)
            + found**2 * np.einsum("ij,ik,kj->j", matrix, gram, matrix)
        )
        done = np.sqrt(rest[:wanted].clip(min=0)).max() / 2 <= tolerance or turn == rounds
        if done:
            matrix, found = matrix[:, :wanted], found[:wanted]
        # A space that is no wider makes a narrower block.
        width, least = matrix.shape[1], float(np.clip(found[-1], -0.5, 1 - 1e-6))
        block = _combined(space, base, matrix)
        if done:
            table.unpersist()
            return block.select("id", F.array(*[f"c{j}" for j in range(width)]).alias("v")), found
