"""Stage hand-offs of one input folder: raw -> clean -> features -> warehouse.

Each stage is written once to the shared folder on first use and then scanned,
so that a report reads only the columns it needs and a lost executor costs a
re-read, not a rebuild.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.plans.clean import clean_transactions
from ledgerscope.plans.features import build_customer_features
from ledgerscope.plans.warehouse import Warehouse, write_warehouse
from ledgerscope.session import new_folder, write_and_read
from ledgerscope.sources.tpch_raw import raw_transactions


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._root: str | None = None
        self._kept: dict[str, object] = {}

    def once(self, name: str, build: Callable[[], object]):
        """Result of ``build`` on first use, the same result afterwards."""
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    @property
    def root(self) -> str:
        if self._root is None:
            self._root = new_folder(self.spark, "ledgerscope")
        return self._root

    @property
    def raw(self) -> DataFrame:
        return raw_transactions(self.spark, self.sf_dir)

    @cached_property
    def clean(self) -> DataFrame:
        return write_and_read(clean_transactions(self.raw), f"{self.root}/clean")

    @cached_property
    def features(self) -> DataFrame:
        return write_and_read(build_customer_features(self.clean), f"{self.root}/features")

    @cached_property
    def warehouse(self) -> Warehouse:
        name = "ls_" + self.root.rsplit("-", 1)[-1]
        return write_warehouse(self.clean, self.features, f"{self.root}/warehouse", name)


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of this application for one input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]
