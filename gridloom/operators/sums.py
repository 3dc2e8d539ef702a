"""Totals of numpy statistics over all rows.

Most of the modelling here needs only sums over rows: Gram matrices, class
moments, gradients, expected counts. ``sum_over_rows`` computes such a sum as
one Spark job: each task reduces its own Arrow batches to one small vector and
a shuffle adds the vectors up by position. The row data never leaves the tasks.

Models that pass over the same rows many times pack them first (``PackedRows``): a
row of the kept table is then a matrix of some thousand rows, which a pass reads
without converting single values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Widest statistic one pass may return to the driver (about 64 MB of doubles).
MAX_STATISTIC = 8_000_000
TASKS_PER_CORE = 4
# Bytes of a matrix of packed rows.
BLOCK_BYTES = 1 << 20
# Bits of a number that a pass of ``PackedRows.quantile`` settles.
DIGITS = (16, 12, 12, 12, 12)


def digamma(values: np.ndarray) -> np.ndarray:
    shifted, out = np.array(values, float), np.zeros_like(values, float)
    for _ in range(8):
        out -= 1 / shifted
        shifted += 1
    inverse = 1 / shifted**2
    return (
        out + np.log(shifted) - 0.5 / shifted
        - inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252))
    )


def trigamma(values: np.ndarray) -> np.ndarray:
    shifted, out = np.array(values, float), np.zeros_like(values, float)
    for _ in range(8):
        out += 1 / shifted**2
        shifted += 1
    inverse = 1 / shifted**2
    return out + 1 / shifted + inverse / 2 + inverse / shifted * (1 / 6 - inverse * (1 / 30 - inverse / 42))


def batch_array(column: pa.Array) -> np.ndarray:
    """An Arrow column as numpy: arrays become a matrix, NULLs become NaN."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def sum_over_rows(
    df: DataFrame,
    columns: list[str],
    statistic: Callable[..., np.ndarray],
    size: int,
) -> np.ndarray:
    """Sum of ``statistic(*columns)`` (a vector of ``size``) over all batches."""

    def total(batch):
        return statistic(*[batch_array(c) for c in batch.columns])

    return _added(df.select(*columns), total, size)


def _added(df: DataFrame, statistic: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of the statistics of all batches."""
    if size > MAX_STATISTIC:
        raise ValueError(f"Too many features: a statistic of {size} numbers.")

    def partial(batches):
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += statistic(batch)
                seen = True
        if seen:
            kept = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.int64()), pa.array(total[kept], pa.float64())],
                names=["position", "value"],
            )

    # A task takes several file splits, so that the number of partial vectors
    # follows the number of cores and not the size of the table.
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    rows = (
        df.coalesce(tasks)
        .mapInArrow(partial, "position long, value double")
        .groupBy("position")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    out = np.zeros(size)
    for row in rows:
        out[row.position] = row.value
    return out


class PackedRows:
    """Columns of numbers (``x``, an array of ``d``, first) as a kept table of matrices,
    for models that read all rows in many passes; gone at the end of the ``with``."""

    def __init__(self, df: DataFrame, columns: list[str], d: int):
        width = d + len(columns) - 1
        most = max(1, BLOCK_BYTES // (8 * max(width, 1)))
        self.d, self.width = d, width

        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    rows = np.column_stack([np.asarray(batch_array(c), float) for c in batch.columns])
                    blocks = [rows[i : i + most].tobytes() for i in range(0, len(rows), most)]
                    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["block"])

        self.blocks = df.select(*columns).mapInArrow(pack, "block binary").persist()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.blocks.unpersist()

    def sum(self, statistic: Callable[..., np.ndarray], size: int) -> np.ndarray:
        """Sum of ``statistic(*columns)`` over all matrices."""
        d, width = self.d, self.width

        def total(batch):
            out = np.zeros(size)
            for block in batch.column(0):
                rows = np.frombuffer(block.as_buffer()).reshape(-1, width)
                out += statistic(rows[:, :d], *[rows[:, j] for j in range(d, width)])
            return out

        return _added(self.blocks, total, size)

    def quantile(self, scores: Callable[..., np.ndarray], k: int, share: float) -> list[float | None]:
        """The linear-interpolated quantile of each of the ``k`` columns that ``scores``
        makes of the rows. Exact: numbers are ordered as their bits are, and every pass
        counts the next bits of those that agree with the wanted one so far."""
        # Prefix of the wanted number and its rank among those with this prefix.
        wanted, sizes, used = {}, None, 0
        for bits in DIGITS:
            places = sorted({(i, prefix) for (i, _), (prefix, _) in wanted.items()}) if wanted else [(i, 0) for i in range(k)]

            def count(*columns, used=used, bits=bits, places=places):
                found = np.asarray(scores(*columns), float)
                counts = np.zeros((len(places), 1 << bits))
                for row, (i, prefix) in zip(counts, places):
                    values = _ordered_bits(found[:, i][~np.isnan(found[:, i])])
                    if used:
                        values = values[values >> np.uint64(64 - used) == np.uint64(prefix)]
                    digit = (values >> np.uint64(64 - used - bits)) & np.uint64((1 << bits) - 1)
                    row += np.bincount(digit.astype(np.int64), minlength=1 << bits)
                return counts.ravel()

            counts = self.sum(count, len(places) << bits).reshape(len(places), -1)
            if sizes is None:
                sizes = counts.sum(1).astype(int)
                for i in range(k):
                    position = share * (sizes[i] - 1)
                    if sizes[i]:
                        wanted |= {(i, r): (0, r) for r in (math.floor(position), math.ceil(position))}
            row_of = {place: upto for place, upto in zip(places, counts.cumsum(1))}
            for key, (prefix, rank) in wanted.items():
                upto = row_of[key[0], prefix]
                digit = int(np.searchsorted(upto, rank, side="right"))
                wanted[key] = ((prefix << bits) | digit, rank - int(upto[digit - 1] if digit else 0))
            used += bits
        out = []
        for i in range(k):
            if not sizes[i]:
                out.append(None)
                continue
            position = share * (sizes[i] - 1)
            low, high = (_number(wanted[i, r][0]) for r in (math.floor(position), math.ceil(position)))
            out.append(low + (high - low) * (position - math.floor(position)))
        return out


_SIGN = 1 << 63


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = np.ascontiguousarray(values).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(_SIGN))


def _number(bits: int) -> float:
    """The double with these ordered bits."""
    plain = bits ^ _SIGN if bits & _SIGN else ~bits & ((1 << 64) - 1)
    return float(np.array([plain], np.uint64).view(float)[0])


def vector_size(df: DataFrame, column: str = "x") -> int:
    first = df.select(F.size(column).alias("d")).first()
    return int(first.d) if first else 0


def first_values(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The values of one row, as a shift for sums of squares (zero without rows)."""
    row = df.select(*columns).first()
    if row is None:
        return np.zeros(len(columns))
    values = np.concatenate([np.atleast_1d(np.asarray(v if v is not None else 0.0, float)) for v in row])
    return np.where(np.isfinite(values), values, 0.0)


class Moments:
    """First and second moments of x (and of targets y), weighted when asked."""

    def __init__(self, packed: np.ndarray, d: int, k: int, shift: np.ndarray):
        self.d, self.k = d, k
        width = d + k
        self.n = float(packed[0])
        sums = packed[1 : 1 + width]
        second = packed[1 + width :].reshape(width, width)
        mean = sums / self.n if self.n else sums
        # Centred cross products of [x, y]; the sums are of values less a shift, so
        # that large values with a small spread keep their digits.
        self.centred = second - np.outer(sums, mean)
        self.mean = mean + shift
        self.raw = self.centred + self.n * np.outer(self.mean, self.mean)

    @property
    def x_mean(self) -> np.ndarray:
        return self.mean[: self.d]

    @property
    def y_mean(self) -> np.ndarray:
        return self.mean[self.d :]

    @property
    def sxx(self) -> np.ndarray:
        return self.centred[: self.d, : self.d]

    @property
    def sxy(self) -> np.ndarray:
        return self.centred[: self.d, self.d :]

    @property
    def syy(self) -> np.ndarray:
        return self.centred[self.d :, self.d :]

    @property
    def covariance(self) -> np.ndarray:
        return self.sxx / self.n


def moments(
    df: DataFrame,
    x: str = "x",
    targets: list[str] | None = None,
    weight: str | None = None,
    d: int | None = None,
    classes: int = 0,
) -> Moments:
    """Count, sums and cross products of ``x`` and the targets in one pass.

    With ``classes`` the single target holds class codes and enters as that
    many 0/1 indicator columns.
    """
    d = d or vector_size(df, x)
    targets = targets or []
    k = classes if classes else len(targets)
    width = d + k
    shift = np.zeros(width)
    start = first_values(df, [x] if classes else [x, *targets])
    if len(start) in (d, width):
        shift[: len(start)] = start

    def statistic(features, *rest):
        parts = [features]
        for values in rest[: len(targets)]:
            values = np.asarray(values, float)
            parts.append(
                (values[:, None] == np.arange(classes)).astype(float)
                if classes
                else values[:, None]
            )
        table = np.hstack(parts) - shift
        w = np.asarray(rest[-1], float) if weight else np.ones(len(table))
        weighted = table * w[:, None]
        return np.concatenate([[w.sum()], weighted.sum(0), (table.T @ weighted).ravel()])

    columns = [x, *targets] + ([weight] if weight else [])
    packed = sum_over_rows(df, columns, statistic, 1 + width + width * width)
    return Moments(packed, d, k, shift)
