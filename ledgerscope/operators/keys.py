"""Key checks and key joins. Every check pre-aggregates by key, so a hot key costs one row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Broadcast a key list only up to this many keys (a few tens of MB of ids).
BROADCAST_KEYS = 500_000


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null keys, surplus rows of repeated keys (nulls are repeats of each other)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat an earlier key."""
    return key_problems(df, key).select("duplicate_rows")


def _refuse(key: str, null_keys: int, duplicate_rows: int) -> None:
    if null_keys:
        raise ValueError(f"{key} contains missing values ({null_keys} rows)")
    if duplicate_rows:
        raise ValueError(f"{key} must be unique ({duplicate_rows} surplus rows)")


def assert_unique_key(df: DataFrame, key: str) -> DataFrame:
    """Return ``df`` when ``key`` is never null and unique, else raise."""
    found = key_problems(df, key).first()
    _refuse(key, found["null_keys"], found["duplicate_rows"])
    return df


def one_to_one_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a key that both sides must hold at most once; one pass over the keys checks both."""
    sides = left.select(key, F.lit(0).alias("_side")).union(right.select(key, F.lit(1)))
    per_key = sides.groupBy(key).agg(*[F.count_if(F.col("_side") == s).alias(f"n{s}") for s in (0, 1)])
    found = per_key.agg(*[c for s in (0, 1) for c in (
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col(f"n{s}"))), F.lit(0)).alias(f"null{s}"),
        F.coalesce(F.sum(F.greatest(F.col(f"n{s}") - 1, F.lit(0))), F.lit(0)).alias(f"more{s}"))]).first()
    for s in (0, 1):
        _refuse(key, found[f"null{s}"], found[f"more{s}"])
    return left.join(right, key, how)


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, weight: str | None = None) -> DataFrame:
    """One row: child rows whose non-null key has no parent; ``weight`` holds the rows that a child row stands for.

    Child rows are counted per key first, so the anti join sees each key once.
    """
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    per_key = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_key")).agg(rows.alias("n"))
    known = parent.select(F.col(parent_key).alias("_key"))
    return per_key.join(known, "_key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))


def hot_keys(df: DataFrame, key: str, more_than: int) -> tuple[DataFrame | None, int]:
    """Keys with more than ``more_than`` rows, and how many there are (None when there are none).

    The list is at most ``rows / more_than`` long; callers check the count before broadcasting.
    """
    from ledgerscope.session import cut_lineage

    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = F.col("n") > more_than
    found = counts.agg(F.count_if(hot)).first()[0]
    return (cut_lineage(counts.where(hot).select(key)), found) if found else (None, 0)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only for a counted, short list; otherwise the planner decides."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df
