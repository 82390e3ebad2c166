"""Reproducible sampling that does not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


_ORDER_BITS = 60


def sample_order(id_column: str, seed: int) -> Column:
    """The leading bits of md5("id:seed"), a number that other engines compute alike."""
    digest = F.md5(F.concat(F.col(id_column).cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, _ORDER_BITS // 4), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, id_column: str, max_rows: int, seed: int = 42,
                minimum: int = 2, total: int | None = None) -> DataFrame:
    """The ``max_rows`` rows with the smallest seeded id hash (all rows when there are no more).

    A hash threshold keeps a little more than ``max_rows`` candidates before the
    final order-and-limit, so that no task sends more than its share. The
    threshold is lowered in selectivity until it holds enough rows, which makes
    the result exactly the global top of the hash order.
    """
    size = max(minimum, max_rows)
    total = df.count() if total is None else total
    if total <= size:
        return df
    order = sample_order(id_column, seed)
    share = (size + 8 * math.sqrt(size) + 64) / total
    while True:
        candidates = df
        if share < 1:
            candidates = df.where(order <= F.lit(int(share * 2 ** _ORDER_BITS)))
            if candidates.count() < size:
                share *= 2
                continue
        return candidates.orderBy(order, F.col(id_column)).limit(size)
