"""Stored sketches that merge: quantiles and distinct counts over any union of groups, without another scan.

The exact operators stay the default. A sketch has a fixed size whatever the group holds, so it is built with partial
aggregation, written once per fine group (month and location, say), and merged for any coarser one.

* KLL quantile sketches: the rank of a returned value is off by about 1.33 % of all rows at ``k`` = 200 and by 0.33 % at
  the default of 800 (99 % confidence).
* HLL distinct sketches: a relative standard error of 1.04 / sqrt(2**lg_k), 0.4 % at the default of 16.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KLL_K = 800
HLL_LG_K = 16


def quantile_sketches(df: DataFrame, group_cols: list[str], measures: list[str], k: int = KLL_K) -> DataFrame:
    """One row per (group, measure) with ``sketch``; missing values do not count, a measure without values gives no row."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])
    long = df.select(*group_cols, F.inline(cells)).where(F.col("v").isNotNull())
    return long.groupBy(*group_cols, "measure").agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def merge_quantile_sketches(sketches: DataFrame, group_cols: list[str], k: int = KLL_K) -> DataFrame:
    """Sketches of coarser groups, from those of finer ones."""
    return sketches.groupBy(*group_cols, "measure").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """The sketches' rows with (prob, value) in place of the sketch: a value that occurs, of about that rank."""
    cells = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs])
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], F.inline(cells))


def distinct_sketches(df: DataFrame, group_cols: list[str], names: dict[str, str], lg_k: int = HLL_LG_K) -> DataFrame:
    """One row per group with a sketch of the distinct non-missing values of each column (column -> name)."""
    return df.groupBy(*group_cols).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(name) for c, name in names.items()])


def distinct_estimates(sketches: DataFrame, group_cols: list[str], names: list[str]) -> DataFrame:
    """Distinct counts of coarser groups (of all rows without ``group_cols``), from stored sketches alone."""
    return sketches.groupBy(*group_cols).agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])
