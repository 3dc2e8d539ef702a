"""Feature preparation: clip, impute, bin, scale and encode.

``fit_preparation`` measures the constants on the training rows; the resulting
``Preparation`` is plain data and turns any table with the same columns into
one array column ``x`` with built-in expressions (and a lookup join only for
text columns with very many levels).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.columns import (
    as_number,
    balanced_sum,
    categorical_columns,
    clip_between,
    numeric_columns,
    ref,
)
from gridloom.operators.describe import aggregate_by_column
from gridloom.operators.ordering import exact_quantiles, with_positions
from gridloom.operators.value_counts import value_counts
from gridloom.session import bounded_lookup

SCALINGS = ("auto", "none", "standard", "minmax", "robust")
OUTLIERS = ("none", "clip_iqr")
IMBALANCE = ("none", "smote")
STRATEGIES = ("uniform", "quantile")
# Levels up to which codes are written into the expression itself.
INLINE_LEVELS = 256


@dataclass(frozen=True)
class BinSpec:
    column: str
    n_bins: int = 5
    strategy: str = "quantile"


@dataclass(frozen=True)
class PrepareConfig:
    feature_columns: tuple[str, ...] | None = None
    scaling: str = "auto"
    numeric_outliers: str = "none"
    imbalance: str = "none"
    numeric_bins: tuple[BinSpec, ...] = ()

    def to_dict(self) -> dict:
        out = asdict(self)
        out["feature_columns"] = list(self.feature_columns) if self.feature_columns else None
        out["numeric_bins"] = [asdict(b) for b in self.numeric_bins]
        return out


def resolve_config(options: dict | None) -> PrepareConfig:
    """Options as a config; values outside the allowed ones become defaults."""
    options = options or {}

    def choice(name, allowed):
        value = options.get(name, allowed[0])
        return value if value in allowed else allowed[0]

    bins = []
    for entry in options.get("numeric_bins") or []:
        if isinstance(entry, dict) and entry.get("column"):
            strategy = entry.get("strategy", "quantile")
            bins.append(
                BinSpec(
                    str(entry["column"]),
                    int(entry.get("n_bins", 5)),
                    strategy if strategy in STRATEGIES else "quantile",
                )
            )
    features = options.get("feature_columns")
    return PrepareConfig(
        tuple(map(str, features)) if isinstance(features, (list, tuple)) else None,
        choice("scaling", SCALINGS),
        choice("numeric_outliers", OUTLIERS),
        choice("imbalance", IMBALANCE),
        tuple(bins),
    )


def select_features(
    df: DataFrame,
    target: str | None = None,
    features: tuple[str, ...] | list[str] | None = None,
    exclude: list[str] | None = None,
) -> list[str]:
    """Feature names: the listed ones in order, else all but target and excluded."""
    available = [c for c in df.columns if c != target]
    if features:
        if target in features:
            raise ValueError("feature_columns must not include the target column.")
        unknown = [c for c in features if c not in available]
        if unknown:
            raise ValueError(f"Unknown feature columns: {unknown}")
        return list(features)
    unknown = [c for c in exclude or [] if c not in df.columns]
    if unknown:
        raise ValueError(f"exclude_columns not in dataset: {unknown}")
    kept = [c for c in available if c not in (exclude or [])]
    if not kept:
        raise ValueError("No feature columns left after exclusions.")
    return kept


def split_names(text: str) -> list[str]:
    """Column names from free text, separated by commas, semicolons or lines."""
    for mark in (";", "\n"):
        text = text.replace(mark, ",")
    return [name.strip() for name in text.split(",") if name.strip()]


@dataclass
class NumericPlan:
    """Constants of one numeric column."""

    column: str
    median: float
    clip: tuple[float, float] | None = None
    centre: float = 0.0
    scale: float = 1.0
    cuts: list[float] | None = None

    def filled(self) -> Column:
        value = as_number(self.column)
        if self.clip:
            value = clip_between(value, *self.clip)
        return F.coalesce(value, F.lit(self.median))

    def expression(self) -> Column:
        value = self.filled()
        if self.cuts is not None:
            return balanced_sum([(value >= F.lit(c)).cast("double") for c in self.cuts])
        if self.centre == 0.0 and self.scale == 1.0:
            return value
        return (value - F.lit(self.centre)) / F.lit(self.scale)


@dataclass
class TextPlan:
    """Most frequent value and codes of one categorical column.

    ``levels`` lists the sorted values of a small vocabulary; a larger one stays
    a table and is joined.
    """

    column: str
    fill: str
    size: int
    levels: list[str] | None = None

    def filled(self) -> Column:
        return F.coalesce(_text(self.column), F.lit(self.fill))


def _text(name: str) -> Column:
    return ref(name).cast("string")


@dataclass
class Preparation:
    binned: list[NumericPlan] = field(default_factory=list)
    plain: list[NumericPlan] = field(default_factory=list)
    text: list[TextPlan] = field(default_factory=list)
    # (column, value, code) of the vocabularies too large to inline.
    vocabulary: DataFrame | None = None
    # Whether numbers are clipped, also where the fitted rows gave no bounds.
    clipping: bool = False

    def refitted_clips(self, df: DataFrame) -> Preparation:
        """This preparation with the clip bounds of the rows of ``df`` instead of
        those of the fitted rows; medians, scales, bins and codes stay."""
        names = [p.column for p in [*self.binned, *self.plain]]
        if not self.clipping or not names:
            return self
        clips = clip_bounds(df, names, exact_quantiles(df, names, [0.25, 0.75]))
        again = [[replace(p, clip=clips[p.column]) for p in plans] for plans in (self.binned, self.plain)]
        return replace(self, binned=again[0], plain=again[1])

    @property
    def feature_names(self) -> list[str]:
        return [p.column for p in [*self.binned, *self.plain, *self.text]]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The kept columns and the feature array ``x``; unseen levels are -1."""
        joined = []
        for i, plan in enumerate(self.text):
            if plan.levels is None:
                codes = self.vocabulary.filter(F.col("column") == plan.column).select(
                    F.col("value").alias(f"_value{i}"), F.col("code").alias(f"_code{i}")
                )
                df = df.join(
                    bounded_lookup(codes, plan.size),
                    plan.filled() == F.col(f"_value{i}"),
                    "left",
                ).drop(f"_value{i}")
                code = F.col(f"_code{i}")
            elif not plan.levels:
                code = F.lit(None)
            else:
                codes = F.create_map(
                    *[F.lit(v) for k, level in enumerate(plan.levels) for v in (level, float(k))]
                )
                code = F.element_at(codes, plan.filled())
            joined.append(F.coalesce(code.cast("double"), F.lit(-1.0)))
        numbers = [p.expression().cast("double") for p in [*self.binned, *self.plain]]
        kept = [ref(c) for c in keep or []]
        return df.select(*kept, F.array(*numbers, *joined).alias("x"))

    def to_dict(self) -> dict:
        return {
            "binned": [asdict(p) for p in self.binned],
            "plain": [asdict(p) for p in self.plain],
            "text": [asdict(p) for p in self.text],
            "clipping": self.clipping,
        }

    @classmethod
    def from_dict(cls, data: dict, vocabulary: DataFrame | None = None) -> Preparation:
        def number(entry):
            clip = entry["clip"]
            return NumericPlan(**{**entry, "clip": tuple(clip) if clip else None})

        return cls(
            [number(e) for e in data["binned"]],
            [number(e) for e in data["plain"]],
            [TextPlan(**e) for e in data["text"]],
            vocabulary,
            data.get("clipping", False),
        )


def scaling_for(mode: str, wants_scale: bool) -> str:
    if mode == "auto":
        return "standard" if wants_scale else "none"
    return mode


def fit_preparation(
    df: DataFrame, features: list[str], config: PrepareConfig, wants_scale: bool = False
) -> Preparation:
    """Measure all constants on ``df``: quartiles, medians, scales, edges, codes."""
    table = df.select(*[ref(c) for c in features])
    numbers, text = numeric_columns(table), categorical_columns(table)
    specs = {b.column: b for b in config.numeric_bins}
    for c in specs:
        if c not in numbers:
            raise ValueError(f"Binning column {c!r} is not numeric or not in feature columns.")
    if not numbers and not text:
        raise ValueError("No usable columns after preprocessing split.")
    rows = table.count()
    plans = _numeric_plans(table, numbers, config, rows)
    plain = [plans[c] for c in numbers if c not in specs]
    _fit_scales(table, plain, scaling_for(config.scaling, wants_scale), rows)
    binned = [plans[c] for c in numbers if c in specs]
    _fit_bins(table, binned, specs, rows)
    coded, vocabulary = _fit_text(table, text)
    return Preparation(binned, plain, coded, vocabulary, config.numeric_outliers == "clip_iqr")


def clip_bounds(df: DataFrame, numbers: list[str], quartiles: dict) -> dict:
    """IQR fences by column; none with fewer than four values or without a spread."""
    counts = aggregate_by_column(df, numbers, lambda c: [F.count(as_number(c))])
    out = {}
    for c, found in quartiles.items():
        q1, q3 = found[0], found[-1]
        fenced = counts[c][0] >= 4 and q3 - q1 > 0
        out[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if fenced else None
    return out


def _numeric_plans(table, numbers, config, rows):
    """Median and clip bounds. Clipping at the IQR fences never moves a median."""
    quartiles = exact_quantiles(table, numbers, [0.25, 0.5, 0.75], rows=rows)
    clips = clip_bounds(table, numbers, quartiles) if config.numeric_outliers == "clip_iqr" else {}
    # A column without any value is filled with zero.
    return {c: NumericPlan(c, 0.0 if q[1] is None else q[1], clips.get(c)) for c, q in quartiles.items()}


def _filled_table(table, plans):
    return table.select(*[p.filled().alias(f"c{i}") for i, p in enumerate(plans)])


def _fit_scales(table, plans, mode, rows):
    if not plans or mode == "none":
        return
    filled = _filled_table(table, plans)
    if mode == "robust":
        quartiles = exact_quantiles(filled, filled.columns, [0.25, 0.5, 0.75], rows=rows)
        for i, plan in enumerate(plans):
            q1, plan.centre, q3 = quartiles[f"c{i}"]
            plan.scale = (q3 - q1) or 1.0
        return
    measure = (
        (lambda c: [F.avg(c), F.stddev_pop(c), F.min(c), F.max(c)])
        if mode == "standard"
        else (lambda c: [F.min(c), F.max(c) - F.min(c), F.min(c), F.max(c)])
    )
    for i, (centre, scale, low, high) in enumerate(
        aggregate_by_column(filled, filled.columns, measure).values()
    ):
        # Rounding can leave a constant column a tiny deviation; it divides by 1.
        plans[i].centre, plans[i].scale = centre, 1.0 if low == high else scale


def _fit_bins(table, plans, specs, rows):
    if not plans:
        return
    filled = _filled_table(table, plans)
    for i, plan in enumerate(plans):
        spec = specs[plan.column]
        bins = max(2, min(50, int(spec.n_bins)))
        shares = [j / bins for j in range(bins + 1)]
        column = filled.select(f"c{i}")
        if spec.strategy == "uniform":
            low, high = column.agg(F.min(f"c{i}"), F.max(f"c{i}")).first()
            edges = [low + (high - low) * share for share in shares]
        else:
            edges = exact_quantiles(column, [f"c{i}"], shares, rows=rows)[f"c{i}"]
        # Edges that nearly coincide are merged; the outer ones are open.
        kept = edges[:1]
        for edge in edges[1:]:
            if edge - kept[-1] > 1e-8:
                kept.append(edge)
        plan.cuts = kept[1:-1]


def _fit_text(table, columns):
    """Fill values and sorted codes from one table of value counts.

    Values are ranked by one distributed sort of the distinct values. Only small
    vocabularies come to the driver; the others stay a table.
    """
    if not columns:
        return [], None
    text = table.select(*[_text(c).alias(c) for c in columns])
    counts = value_counts(text, columns).filter(F.col("value").isNotNull())
    placed = with_positions(counts, ["column", "value"])
    facts = {
        r.column: r
        for r in placed.groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min("position").alias("start"),
            # Most frequent first, the smallest of equals.
            F.min(F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("v"))).alias("top"),
        )
        .collect()
    }
    small = [c for c, r in facts.items() if r["size"] <= INLINE_LEVELS]
    levels: dict[str, list[str]] = {c: [] for c in small}
    if small:
        for r in placed.filter(F.col("column").isin(small)).orderBy("position").collect():
            levels[r.column].append(r.value)
    plans = []
    for c in columns:
        r = facts.get(c)
        # A column without any value: every row is an unseen level.
        plans.append(
            TextPlan(c, r.top.v, r["size"], levels.get(c)) if r else TextPlan(c, "", 0, [])
        )
    large = [c for c in facts if c not in levels]
    vocabulary = None
    if large:
        starts = F.create_map(*[F.lit(v) for c in large for v in (c, facts[c].start)])
        vocabulary = placed.filter(F.col("column").isin(large)).select(
            "column",
            "value",
            (F.col("position") - F.element_at(starts, F.col("column"))).alias("code"),
        )
    return plans, vocabulary
