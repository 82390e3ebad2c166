"""Most frequent value per key, and first row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def primary_value(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent non-null value per key, ties to the smallest value.

    Two mergeable aggregates: counts per (key, value), then the best (count, value)
    pair per key. No key's values are gathered anywhere.
    """
    counts = (df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
              .groupBy(key, value).agg(F.count(F.lit(1)).alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("best")).select(key, F.col("best.v").alias(name))


def first_row_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in ascending order, missing values last, as one mergeable minimum."""
    rest = [c for c in df.columns if c != key and c not in order]
    ranked = [x for c in order for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    packed = df.groupBy(key).agg(F.min(F.struct(*ranked, *rest)).alias("row"))
    return packed.select(key, "row.*").select(*df.columns)
