"""Exact order statistics and quantiles by distributed selection.

``percentile`` keeps every distinct value of a group in one buffer, which fails
for a group that holds a large part of the data. Selection instead narrows down
where each wanted rank lies: a bounded histogram per (group, measure), reduced
on the map side, tells which bucket holds the rank, and only that bucket is
split further. What is shuffled are histograms, and at the end the distinct
values of buckets that are known to be small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerscope.operators.keys import BROADCAST_KEYS
from ledgerscope.session import cut_lineage

FIRST_RESOLUTION = 1024
SPLIT = 4096
SMALL_BUCKET = 1_000_000


def _long_form(df: DataFrame, group_cols: list[str], measures: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])
    return df.select(*group_cols, F.inline(pairs)).where(F.col("v").isNotNull())


def _coarse_bucket(v: Column) -> Column:
    """Monotone in the value and bounded in number: log-spaced on both sides of zero."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * FIRST_RESOLUTION)


def _histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and value range per bucket, with the number of rows in earlier buckets."""
    buckets = rows.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.withColumn("before", F.sum("n").over(upto) - F.col("n"))


def _inside(long: DataFrame, intervals: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Rows that fall into an open interval; intervals of one key never overlap."""
    small = F.broadcast(intervals) if count <= BROADCAST_KEYS else intervals
    return long.join(small, keys).where(F.col("v").between(F.col("low"), F.col("high")))


def _holds(rank: str) -> Column:
    return (F.col(rank) >= F.col("before")) & (F.col(rank) < F.col("before") + F.col("n"))


def order_statistics(df: DataFrame, group_cols: list[str], measures: list[str], wanted: Callable[[Column], Column],
                     small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Values at given 0-based ranks: one row per (group, measure, rank) with ``value`` and ``total``.

    ``wanted`` turns the number of non-missing values of a (group, measure) into
    an array of ranks; it may also refer to the column ``measure``. Ranks outside
    the data give no row.
    """
    keys = [*group_cols, "measure"]
    long = _long_form(df, group_cols, measures)
    columns = [*keys, "total", "rank", "offset", "n", "low", "high"]

    first = _histogram(long.withColumn("bucket", _coarse_bucket(F.col("v"))), keys)
    first = first.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    asked = first.withColumn("rank", F.explode(F.array_distinct(wanted(F.col("total"))))).where(_holds("rank"))
    targets = cut_lineage(asked.withColumn("offset", F.col("rank") - F.col("before")).select(columns))

    while True:
        undecided = targets.where(F.col("low") < F.col("high"))
        state = undecided.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("largest")).first()
        decided = targets.where(F.col("low") == F.col("high"))
        if not state["rows"]:
            return decided.select(*keys, "total", "rank", F.col("low").alias("value"))
        last = state["largest"] <= small_bucket
        inside = _inside(long, undecided.select(*keys, "low", "high").distinct(), keys, state["rows"])
        # Small buckets are resolved to single values, larger ones are split evenly by value.
        step = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * SPLIT)
        bucket = F.col("v") if last else F.least(step, F.lit(SPLIT - 1))
        cells = inside.select(*keys, F.col("low").alias("origin"), "v", bucket.alias("bucket"))
        finer = _histogram(cells, [*keys, "origin"])
        narrowed = undecided.select(*keys, "total", "rank", "offset", F.col("low").alias("origin")).join(
            finer, [*keys, "origin"]).where(_holds("offset"))
        narrowed = narrowed.withColumn("offset", F.col("offset") - F.col("before")).select(columns)
        both = decided.unionByName(narrowed)
        if last:
            return both.select(*keys, "total", "rank", F.col("low").alias("value"))
        targets = cut_lineage(both)


def group_quantiles(df: DataFrame, group_cols: list[str], measures: list[str], probs: list[float],
                    small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Linear-interpolated quantiles: one row per (group, measure, prob) with ``value``.

    Missing values do not count; a measure with no values at all gives no row.
    """
    keys = [*group_cols, "measure"]
    spots = lambda total: [F.lit(float(p)) * (total - 1) for p in probs]

    def wanted(total: Column) -> Column:
        return F.array(*[end(s).cast("bigint") for s in spots(total) for end in (F.floor, F.ceil)])

    found = order_statistics(df, group_cols, measures, wanted, small_bucket)
    per_key = found.groupBy(*keys).agg(
        F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    cells = []
    for p, s in zip(probs, spots(F.col("total"))):
        a, b = F.col("at")[F.floor(s).cast("bigint")], F.col("at")[F.ceil(s).cast("bigint")]
        cells.append(F.struct(F.lit(float(p)).alias("prob"), (a + (b - a) * (s - F.floor(s))).alias("value")))
    return per_key.select(*keys, F.inline(F.array(*cells)))


def wide_quantiles(quantiles: DataFrame, group_cols: list[str], names: dict[tuple[str, float], str]) -> DataFrame:
    """One column per (measure, prob), one row per group (one row in all without groups)."""
    cells = [F.max(F.when((F.col("measure") == m) & (F.col("prob") == p), F.col("value"))).alias(name)
             for (m, p), name in names.items()]
    return quantiles.groupBy(*group_cols).agg(*cells)


def column_quantiles(df: DataFrame, measures: list[str], probs: list[float],
                     small_bucket: int = SMALL_BUCKET) -> dict[str, dict[float, float]]:
    """Quantiles over all rows as small driver values (measures x probs numbers)."""
    out: dict[str, dict[float, float]] = {m: {} for m in measures}
    for r in group_quantiles(df, [], measures, probs, small_bucket).collect():
        out[r["measure"]][r["prob"]] = r["value"]
    return out
