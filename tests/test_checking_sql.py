"""Every registered query of the library against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import statements
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry_is_complete():
    assert not set(oracle_sql()) - set(queries())
    assert sum(name.startswith("report_") and name[7:9].isdigit() for name in queries()) >= 32


@pytest.mark.parametrize("name", sorted(statements()))
def test_query_matches_sql(spark, con, name):
    assert difference(queries()[name](spark, SF), con, statements()[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 2
