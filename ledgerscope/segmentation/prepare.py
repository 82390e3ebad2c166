"""Winsorise, impute and robustly scale the segmentation features."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.functions import numbers
from ledgerscope.operators.quantiles import column_quantiles, order_statistics
from ledgerscope.schemas import SEGMENTATION_FEATURES, require_columns

ID = "customer_id"
OWN = "_own"  # a column of this name passes through the steps as it is
# Quartiles no further apart than this differ by binary noise only.
SPREAD_TOLERANCE = 1e-12


@dataclass
class ScalingParams:
    """Fitted numbers per feature; small enough to live in expressions."""

    bounds: dict[str, tuple[float, float]]
    medians: dict[str, float] = field(default_factory=dict)
    centers: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return list(self.bounds)

    def rows(self) -> list[tuple]:
        return [(f, *map(float, self.bounds[f]), self.medians.get(f), self.centers.get(f), self.scales.get(f))
                for f in self.features]


PARAMS_SCHEMA = "feature string, lower double, upper double, median double, center double, scale double"


def _carried(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in (ID, OWN)]


def segmentation_features(df: DataFrame, features: list[str] = SEGMENTATION_FEATURES) -> DataFrame:
    """Id and numeric features; what is not a finite number is missing."""
    require_columns(df.columns, features, "Customer feature table")
    return df.select(*_carried(df), *[numbers.to_number(F.col(f)).alias(f) for f in features])


def _check_quantiles(lower: float, upper: float) -> None:
    if not 0 <= lower < upper <= 1:
        raise ValueError("Clipping quantiles must satisfy 0 <= lower < upper <= 1")


def _refuse_empty(features: list[str], counts: dict[str, int]) -> None:
    empty = sorted(f for f in features if not counts[f])
    if empty:
        raise ValueError(f"Features without any value cannot be segmented on: {empty}")


def clipping_bounds(numeric: DataFrame, features: list[str], lower: float = 0.005,
                    upper: float = 0.995) -> dict[str, tuple[float, float]]:
    """Exact quantile bounds per feature."""
    _check_quantiles(lower, upper)
    found = column_quantiles(numeric, features, [lower, upper])
    _refuse_empty(features, {f: len(found[f]) for f in features})
    return {f: tuple(sorted((found[f][lower], found[f][upper]))) for f in features}


def winsorize(numeric: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return numeric.select(*_carried(numeric), *[numbers.clip(F.col(f), lo, hi).alias(f) for f, (lo, hi) in bounds.items()])


def impute(clipped: DataFrame, medians: dict[str, float]) -> DataFrame:
    return clipped.select(*_carried(clipped), *[F.coalesce(F.col(f), F.lit(m)).alias(f) for f, m in medians.items()])


@dataclass
class _Ranks:
    """Where the wanted quantiles of one feature lie among its known values.

    Imputing adds copies of the median, which slot in right after the lower
    middle value. A rank of the imputed column is therefore a rank of the known
    values, or the median itself (``None``).
    """

    known: int
    rows: int

    def plain(self, prob: float) -> tuple[int, int, float]:
        spot = prob * (self.known - 1)
        return math.floor(spot), math.ceil(spot), spot - math.floor(spot)

    def imputed(self, prob: float) -> tuple[int | None, int | None, float]:
        spot = prob * (self.rows - 1)
        middle, added = (self.known - 1) // 2, self.rows - self.known

        def source(rank: int) -> int | None:
            if rank <= middle:
                return rank
            return None if rank <= middle + added else rank - added

        return source(math.floor(spot)), source(math.ceil(spot)), spot - math.floor(spot)


def fit_scaling(df: DataFrame, features: list[str] = SEGMENTATION_FEATURES, lower: float = 0.005,
                upper: float = 0.995) -> ScalingParams:
    """Bounds of the raw values, medians of the clipped ones, median and IQR of the imputed ones.

    Clipping keeps the order of values, and imputing only adds the median, so one
    selection of ranks over the raw values serves all three steps.
    """
    _check_quantiles(lower, upper)
    numeric = segmentation_features(df, features)
    sizes = numeric.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f).alias(f) for f in features]).first()
    _refuse_empty(features, sizes.asDict())
    ranks = {f: _Ranks(sizes[f], sizes["_rows"]) for f in features}
    needed = {}
    for f, r in ranks.items():
        spots = [r.plain(p) for p in (lower, 0.5, upper)] + [r.imputed(p) for p in (0.25, 0.5, 0.75)]
        needed[f] = sorted({i for low, high, _ in spots for i in (low, high) if i is not None})
    lookup = F.create_map(*[c for f in features for c in (F.lit(f), F.array(*[F.lit(i).cast("bigint") for i in needed[f]]))])
    found = order_statistics(numeric, [], features, lambda total: lookup[F.col("measure")]).collect()
    value = {f: {} for f in features}
    for row in found:
        value[row["measure"]][row["rank"]] = row["value"]

    params = ScalingParams({})
    for f, r in ranks.items():
        between = lambda a, b, share: a + (b - a) * share
        raw = lambda low, high, share: between(value[f][low], value[f][high], share)
        low, high = sorted((raw(*r.plain(lower)), raw(*r.plain(upper))))
        clipped = lambda rank: min(max(value[f][rank], low), high)
        a, b, share = r.plain(0.5)
        median = between(clipped(a), clipped(b), share)
        filled = lambda rank: median if rank is None else clipped(rank)
        quartiles = [between(filled(a), filled(b), share) for a, b, share in (r.imputed(p) for p in (0.25, 0.5, 0.75))]
        width = quartiles[2] - quartiles[0]
        params.bounds[f], params.medians[f], params.centers[f] = (low, high), median, quartiles[1]
        # A feature without spread keeps its own unit instead of vanishing.
        params.scales[f] = width if width > SPREAD_TOLERANCE else 1.0
    return params


def scale(df: DataFrame, params: ScalingParams) -> DataFrame:
    """Id and scaled features under their own names; expressions only.

    Winsorised, imputed and scaled in one short expression each, so that the code of all features stays below what the JVM
    compiles: a known value is clipped and scaled, a missing one is the scaled median.
    """
    require_columns(df.columns, params.features, "Customer feature table")
    return df.select(*_carried(df), *[_scaled(F.col(f), params, f).alias(f) for f in params.features])


def _scaled(c: Column, params: ScalingParams, feature: str) -> Column:
    (low, high), center, width = params.bounds[feature], params.centers[feature], params.scales[feature]
    x = c.try_cast("double")
    known = (F.greatest(F.least(x, F.lit(high)), F.lit(low)) - F.lit(center)) / F.lit(width)
    return F.when(F.abs(x) < F.lit(float("inf")), known).otherwise(F.lit((params.medians[feature] - center) / width))


def assert_finite(scaled: DataFrame, features: list[str]) -> DataFrame:
    """Raise when any scaled value is missing, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    found = scaled.agg(*[F.count_if(bad(c)).alias(c) for c in features]).first().asDict()
    wrong = {c: n for c, n in found.items() if n}
    if wrong:
        raise ValueError(f"Prepared segmentation values are not finite: {wrong}")
    return scaled


def assemble(scaled: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="vector").transform(scaled)
