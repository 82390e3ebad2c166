"""Helpers of the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ledgerscope.functions.numbers import round_half_up
from ledgerscope.workspace import Workspace, workspace


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` decimals, so that results compare across engines."""
    return df.select(*[
        round_half_up(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def on_workspace(build: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(workspace(spark, sf_dir))

    query.__name__ = getattr(build, "__name__", "query")
    return query


def on_warehouse(build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return on_workspace(lambda ws: build(ws.warehouse))
