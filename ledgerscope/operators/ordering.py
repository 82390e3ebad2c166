"""Exact global positions without a single-partition window.

Rows are range-sorted, numbered inside their partition, and written once to the
shared folder. Partition offsets (one row per partition) then turn the local
numbers into global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerscope.session import new_folder, write_and_read

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _sorted_once(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    return write_and_read(placed, new_folder(df.sparkSession, "sorted")).withColumn("_part", F.shiftright("_place", _LOCAL_BITS))


def with_row_number(df: DataFrame, order: list[Column], name: str, total_name: str | None = None) -> DataFrame:
    """Add the 1-based position under a total order (end ``order`` with a unique key)."""
    placed = _sorted_once(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by the partition count, not by the data.
    by_part = Window.orderBy("_part")
    offsets = sizes.select(
        "_part",
        (F.sum("_n").over(by_part.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    local = F.col("_place").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + local + 1).cast("bigint"))
    if total_name:
        out = out.withColumn(total_name, F.col("_total"))
    return out.drop("_part", "_place", "_before", "_total")


def ntile_number(position: Column, total: Column, buckets: int) -> Column:
    """NTILE from a 1-based position: the first ``total % buckets`` buckets hold one row more."""
    small = F.floor(total / buckets).cast("bigint")
    extra = total % buckets
    in_large = extra * (small + 1)
    zero_based = position - 1
    large = F.floor(zero_based / (small + 1))
    rest = extra + F.floor((zero_based - in_large) / F.nullif(small, F.lit(0)))
    return (F.when(zero_based < in_large, large).otherwise(rest) + 1).cast("bigint")


def global_ntile(df: DataFrame, order: list[Column], buckets: int, name: str) -> DataFrame:
    """``NTILE(buckets) OVER (ORDER BY ...)`` over all rows, distributed."""
    numbered = with_row_number(df, order, "_position", "_rows")
    tile = ntile_number(F.col("_position"), F.col("_rows"), buckets)
    return numbered.withColumn(name, tile).drop("_position", "_rows")


def with_running_total(df: DataFrame, group: str | list[str], order: Column, weight: str, name: str,
                       total_name: str | None = None) -> DataFrame:
    """Add, per group, the weight of all rows up to and including this one, and on request that of the whole group.

    Rows are spread over range partitions of (group, order), so even one group
    holding every row is summed in parallel; the part windows stay partition-sized.
    """
    groups = [group] if isinstance(group, str) else group
    placed = _sorted_once(df, [*[F.col(g) for g in groups], order])
    local = Window.partitionBy("_part", *groups).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(*groups, "_part").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*groups, "_part", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"),
                           F.sum("_w").over(Window.partitionBy(*groups)).alias("_total"))
    summed = placed.withColumn(name, F.sum(weight).over(local))
    out = summed.join(offsets, [*groups, "_part"]).withColumn(name, F.col(name) + F.col("_before"))
    if total_name:
        out = out.withColumn(total_name, F.col("_total"))
    return out.drop("_part", "_place", "_before", "_total")
