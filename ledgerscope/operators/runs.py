"""Run-length rows: how often each value of a measure comes per key, and what follows from them.

A key's values are never gathered. Counting them combines on the map side, so even a value of a third of all rows
costs one row per task; medians come from running counts over a range sort, which spreads one key's values
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.operators.ordering import with_running_total
from ledgerscope.session import new_folder, write_and_read


def run_lengths(df: DataFrame, key: str, numbers: list[str], labels: list[str]) -> DataFrame:
    """(key, measure, number, label, n) for the non-missing values of all measures, from one pass over ``df``.

    The runs are written to the shared folder, as several aggregates read them.
    """
    def cell(name: str, number: Column | None = None, label: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("measure"), (F.lit(None) if number is None else number).cast("double").alias("number"),
                        (F.lit(None) if label is None else label).cast("string").alias("label"))

    cells = [cell(c, number=F.col(c)) for c in numbers] + [cell(c, label=F.col(c)) for c in labels]
    long = df.select(key, F.inline(F.array(*cells))).where("number IS NOT NULL OR label IS NOT NULL")
    counted = long.groupBy(key, "measure", "number", "label").agg(F.count(F.lit(1)).alias("n"))
    return write_and_read(counted, new_folder(df.sparkSession, "runs"))


def medians(runs: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """One row per key with the median of each number measure, under the names given; null without values."""
    chosen = runs.where(F.col("measure").isin(*names)).select(key, "measure", "number", "n")
    ranked = with_running_total(chosen, [key, "measure"], F.col("number"), "n", "upto", "total")
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1  # 1-based ranks of the middle
    middle = ranked.where((F.col("upto") >= lower) & (F.col("upto") - F.col("n") < upper))
    at = {m: F.when(F.col("measure") == m, F.col("number")) for m in names}
    return middle.groupBy(key).agg(*[(F.min(v) + (F.max(v) - F.min(v)) * 0.5).alias(names[m]) for m, v in at.items()])


def modes(runs: DataFrame, key: str, names: dict[str, str], distinct: dict[str, str]) -> DataFrame:
    """One row per key with the most frequent label of each measure (ties: the smallest), and numbers of distinct labels."""
    def of(measure: str, value: Column) -> Column:
        return F.when(F.col("measure") == measure, value)

    best = {m: F.min(of(m, F.struct((-F.col("n")).alias("n"), "label"))) for m in names}
    return runs.where(F.col("label").isNotNull()).groupBy(key).agg(
        *[b["label"].alias(names[m]) for m, b in best.items()],
        *[F.count(of(m, F.lit(1))).alias(name) for m, name in distinct.items()])
