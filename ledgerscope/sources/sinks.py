"""Sinks. Parquet is the hand-off between stages; CSV and JSON are for people."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def export_csv(df: DataFrame, path: str, sort_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with header and ISO dates. ``sort_by`` gives a total order, missing values last."""
    if sort_by:
        df = df.orderBy(*[F.col(c).asc_nulls_last() for c in sort_by])
    (df.write.mode(mode).option("header", True).option("escape", '"').option("dateFormat", "yyyy-MM-dd")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_json_record(spark: SparkSession, payload: dict, path: str) -> None:
    """One small record as sorted, indented JSON text, through Spark's file system layer."""
    text = json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
