"""Typed scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.functions.numbers import to_number
from ledgerscope.schemas import RAW_COLUMNS, RAW_CONTRACT, require_columns
from ledgerscope.sources.quoted_csv import read_quoted_csv

# Texts that a delimited source uses for "missing".
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def load_raw_transactions(spark: SparkSession, path: str, nrows: int | None = None, multi_line: bool = True) -> DataFrame:
    """Raw CSV with a header: the nine required columns, typed; other columns are not parsed.

    A missing file or column raises. ``nrows`` reads that many rows only. Quoted values may
    hold line breaks; large files are read in splits all the same (:mod:`ledgerscope.sources.quoted_csv`).
    ``multi_line=False`` saves the scan that looks for such values, where they are known not to occur.
    """
    text = read_quoted_csv(spark, path) if multi_line else spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    require_columns(text.columns, RAW_COLUMNS, "Raw dataset")
    source = text.limit(nrows) if nrows is not None else text
    typed = []
    for name, (_, dtype) in RAW_CONTRACT.items():
        c = F.col(f"`{name}`")
        c = F.when(~c.isin(MISSING_TOKENS), c)
        if dtype.typeName() == "double":
            c = to_number(c)
        elif dtype.typeName() == "long":
            # Columns with gaps are often written as 143207.0; a fraction is not a whole number.
            number = to_number(c)
            c = F.coalesce(c.try_cast("bigint"), F.when(number == F.floor(number), number.try_cast("bigint")))
        typed.append(c.alias(name))
    return source.select(typed)


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Processed table written by :mod:`ledgerscope.sources.sinks`; input splits replace chunks."""
    return spark.read.parquet(path)


def load_customer_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature table with the customer id checked: present, never null, unique."""
    from ledgerscope.operators.keys import assert_unique_key

    features = scan_table(spark, path)
    require_columns(features.columns, ["customer_id"], "Customer feature table")
    assert_unique_key(features, "customer_id")
    return features
