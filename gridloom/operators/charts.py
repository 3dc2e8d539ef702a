"""Data behind distribution charts: histograms, density curves and bars."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import (
    as_number,
    bar_label,
    is_finite,
    numeric_columns,
)
from gridloom.operators.describe import aggregate_by_column
from gridloom.operators.ordering import exact_quantiles
from gridloom.operators.sums import sum_over_rows
from gridloom.operators.value_counts import top_values, value_counts
from gridloom.session import spread_small

MAX_EDGES, FEW_BINS = 42, 40
FEATURE_BARS, CLASS_BARS = 16, 24
CHART_COLUMNS = 20

HISTOGRAM_SCHEMA = "column string, bin int, x_lo double, x_hi double, cnt bigint"
DENSITY_SCHEMA = "column string, point int, x double, density double"


@dataclass(frozen=True)
class Spread:
    """What a numeric chart needs to know about its column."""

    n: int
    low: float
    high: float
    std: float
    q1: float
    q3: float

    @property
    def constant(self) -> bool:
        return abs(self.high - self.low) < 1e-15

    @property
    def bins(self) -> int:
        """Bin count: Freedman–Diaconis with a √n floor, or Sturges if finer."""
        if self.constant:
            return 1
        extent = self.high - self.low
        by_quartiles = max(
            2.0 * (self.q3 - self.q1) * self.n ** (-1.0 / 3.0), extent / math.sqrt(self.n) / 2
        )
        width = min(by_quartiles, extent / (math.log2(self.n) + 1.0))
        bins = int(math.ceil(extent / width))
        return bins if bins + 1 <= MAX_EDGES else FEW_BINS

    @property
    def edges(self) -> np.ndarray:
        return np.linspace(self.low, self.high, self.bins + 1)

    @property
    def bandwidth(self) -> float:
        iqr, extent = self.q3 - self.q1, self.high - self.low
        sigma = min(self.std, iqr / 1.34) if iqr > 0 else self.std
        if sigma <= 0 or not math.isfinite(sigma):
            sigma = extent / 10.0
        width = sigma * self.n ** (-1.0 / 5.0)
        return width if width > 0 and math.isfinite(width) else extent / 20.0

    @property
    def grid(self) -> np.ndarray:
        return np.linspace(self.low, self.high, min(96, max(48, self.n)))


def _finite(name: str) -> Column:
    value = as_number(name)
    return F.when(is_finite(value), value)


def spreads(df: DataFrame, columns: list[str]) -> dict[str, Spread]:
    """Spread of every column that has at least three finite values."""
    if not columns:
        return {}
    table = df.select(*[_finite(c).alias(f"c{i}") for i, c in enumerate(columns)])
    facts = aggregate_by_column(
        table,
        table.columns,
        lambda c: [F.count(c), F.min(c), F.max(c), F.stddev_pop(c), F.count(F.lit(1))],
    )
    charted = [s for s in table.columns if facts[s][0] >= 3]
    rows = facts["c0"][4]
    quartiles = exact_quantiles(table, charted, [0.25, 0.75], rows=rows)
    return {
        columns[int(s[1:])]: Spread(*facts[s][:4], *quartiles[s]) for s in charted
    }


def chart_statistics(
    df: DataFrame, known: dict[str, Spread]
) -> dict[str, tuple[np.ndarray, np.ndarray | None]]:
    """Bin counts and kernel density of every charted column in one pass.

    Each task counts its values per bin and sums the Gaussian kernel over them
    per grid point, so no row is ever paired with a grid row in Spark. The
    density is None below five values or for a constant column.
    """
    if not known:
        return {}
    rows = max(s.n for s in known.values())
    table = spread_small(
        df.select(*[_finite(c).alias(f"c{i}") for i, c in enumerate(known)]), rows
    )
    plan = [
        (s.edges, s.grid if s.n >= 5 and not s.constant else None, s.bandwidth)
        for s in known.values()
    ]
    sizes = [
        size for edges, grid, _ in plan for size in (len(edges) - 1, 0 if grid is None else len(grid))
    ]
    ends = np.cumsum(sizes)

    def statistic(*columns):
        sums = []
        for values, (edges, grid, width) in zip(columns, plan):
            values = np.asarray(values, float)
            values, weights = np.unique(values[~np.isnan(values)], return_counts=True)
            # Left edges are inclusive; the last bin includes its right edge.
            place = np.searchsorted(edges, values, side="right") - 1
            place = np.clip(place, 0, len(edges) - 2)
            sums.append(np.bincount(place, weights, len(edges) - 1).astype(float))
            if grid is None:
                sums.append(np.zeros(0))
            else:
                kernel = np.exp(-0.5 * ((grid[:, None] - values[None, :]) / width) ** 2)
                sums.append(kernel @ weights)
        return np.concatenate(sums)

    totals = np.split(sum_over_rows(table, table.columns, statistic, int(ends[-1])), ends[:-1])
    out = {}
    for i, (c, s) in enumerate(known.items()):
        density = totals[2 * i + 1]
        scale = s.n * s.bandwidth * math.sqrt(2 * math.pi)
        out[c] = (totals[2 * i], density / scale if len(density) else None)
    return out


def histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bin counts per column, empty bins included (at most 41 per column)."""
    known = spreads(df, columns)
    rows = [
        (c, b, float(s.edges[b]), float(s.edges[b + 1]), int(counts[b]))
        for (c, s), (counts, _) in zip(known.items(), chart_statistics(df, known).values())
        for b in range(s.bins)
    ]
    return df.sparkSession.createDataFrame(rows, HISTOGRAM_SCHEMA)


def density_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Kernel density per column on its grid (48 to 96 points)."""
    known = spreads(df, columns)
    rows = [
        (c, i, float(x), float(v))
        for (c, s), (_, values) in zip(known.items(), chart_statistics(df, known).values())
        if values is not None
        for i, (x, v) in enumerate(zip(s.grid, values))
    ]
    return df.sparkSession.createDataFrame(rows, DENSITY_SCHEMA)


def bars(counts: DataFrame, max_bars: int = FEATURE_BARS) -> DataFrame:
    """The most frequent values per column and the sum of the others."""
    top = top_values(counts, max_bars)
    shown = top.select("column", "rank", bar_label(F.col("value")).alias("label"), "cnt")
    rest = (
        counts.groupBy("column")
        .agg(F.sum("cnt").alias("total"))
        .join(top.groupBy("column").agg(F.sum("cnt").alias("kept")), "column")
        .filter(F.col("total") > F.col("kept"))
        .select(
            "column",
            F.lit(max_bars + 1).alias("rank"),
            F.lit("Other").alias("label"),
            (F.col("total") - F.col("kept")).alias("cnt"),
        )
    )
    return shown.unionByName(rest)


@dataclass
class ChartSet:
    numeric: dict[str, Spread]
    categorical: list[str]
    truncated: bool

    @property
    def note(self) -> str | None:
        if not self.truncated:
            return None
        return (
            f"Feature charts limited to the first {CHART_COLUMNS} numeric and "
            f"{CHART_COLUMNS} non-numeric columns in file order."
        )


def choose_charts(df: DataFrame, target: str | None = None) -> ChartSet:
    """First 20 numeric columns with enough values and first 20 others."""
    features = [c for c in df.columns if c != target]
    numbers = set(numeric_columns(df))
    measured = spreads(df, [c for c in features if c in numbers])
    numeric, categorical, truncated = {}, [], False
    for c in features:
        chosen = numeric if c in numbers else categorical
        if len(chosen) >= CHART_COLUMNS:
            truncated = True
        elif c not in numbers:
            categorical.append(c)
        elif c in measured:
            numeric[c] = measured[c]
    return ChartSet(numeric, categorical, truncated)


def numeric_chart(spread: Spread, counts: np.ndarray, values: np.ndarray | None) -> dict:
    """One chart document: bins with the curve scaled to the highest bin."""
    points = [
        {
            "x_lo": round(float(spread.edges[b]), 6),
            "x_hi": round(float(spread.edges[b + 1]), 6),
            "count": int(counts[b]),
            "kde": None,
        }
        for b in range(spread.bins)
    ]
    chart = {
        "kind": "numeric",
        "non_null_count": spread.n,
        "points": points,
        "kde_x": [],
        "kde_y": [],
        "x_min": spread.low,
        "x_max": spread.high,
    }
    if values is not None:
        grid, peak = spread.grid, counts.max()
        if values.max() > 0 and peak > 0:
            values = values / values.max() * peak
        middles = (spread.edges[:-1] + spread.edges[1:]) / 2
        for point, height in zip(points, np.interp(middles, grid, values)):
            point["kde"] = round(float(height), 6)
        chart["kde_x"] = [round(float(v), 6) for v in grid]
        chart["kde_y"] = [round(float(v), 6) for v in values]
    return chart


def chart_documents(
    df: DataFrame, numeric: dict[str, Spread], categorical: list[str], max_bars: int = FEATURE_BARS
) -> dict[str, dict]:
    """Chart documents of the given columns."""
    measured = chart_statistics(df, numeric)
    out = {c: numeric_chart(s, *measured[c]) for c, s in numeric.items()}
    if categorical:
        counts = value_counts(df, categorical).persist()
        present = {
            r.column: r.cnt
            for r in counts.filter("value is not null")
            .groupBy("column")
            .agg(F.sum("cnt").alias("cnt"))
            .collect()
        }
        for c in categorical:
            out[c] = {"kind": "categorical", "non_null_count": present.get(c, 0), "bars": []}
        for row in bars(counts, max_bars).orderBy("column", "rank").collect():
            out[row.column]["bars"].append({"label": row.label, "count": row.cnt})
        counts.unpersist()
    return out
