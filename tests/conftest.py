from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerscope.schemas import RAW_SCHEMA  # noqa: E402
from ledgerscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def raw(spark):
    """Four raw transactions with bad gender, placeholder birth date and invalid time."""
    rows = [
        ("T1", "C1", "10/1/94", "F", " mumbai ", 1000.0, "2/8/16", 143207, 25.0),
        ("T2", "C1", "10/1/94", "F", "MUMBAI", 1200.0, "3/8/16", 93015, 50.0),
        ("T3", "C2", "1/1/1800", "T", None, 500.0, "2/8/16", 250000, 100.0),
        ("T4", "C3", "4/4/57", "M", "JHAJJAR", 2000.0, "2/8/16", 141858, 200.0),
    ]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def one_column(spark, values, expression, dtype="string"):
    """Evaluate a column expression over a list of values, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {dtype}")
    return [r["x"] for r in df.select("i", expression(F.col("c")).alias("x")).orderBy("i").collect()]
