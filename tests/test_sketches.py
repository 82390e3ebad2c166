from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.quantiles import group_quantiles
from ledgerscope.operators.sketches import (
    distinct_estimates, distinct_sketches, merge_quantile_sketches, quantile_sketches, sketched_quantiles)
from ledgerscope.session import new_folder, write_and_read


@pytest.fixture
def table(spark):
    """Two months, one of them with two thirds of the rows; a measure with gaps and one without values."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "2016-01").otherwise("2016-02").alias("month"), (F.col("id") % 7).cast("string").alias("place"),
        F.when(F.col("id") % 5 != 0, (F.col("id") * 7919 % 10_007).cast("double") ** 2).alias("v"), F.lit(None).cast("double").alias("none"),
        (F.col("id") % 20_000).alias("who"))
    return write_and_read(rows, new_folder(spark, "sketch-test"))


def test_merged_quantiles_are_near_the_exact_ranks(spark, table):
    fine = write_and_read(quantile_sketches(table, ["month", "place"], ["v", "none"]), new_folder(spark, "sketches"))
    assert fine.count() == 14 and {r["measure"] for r in fine.collect()} == {"v"}
    for groups in (["month"], []):
        probs = [0.005, 0.25, 0.5, 0.75, 0.995]
        found = sketched_quantiles(merge_quantile_sketches(fine, groups), probs).collect()
        exact = {(*[r[g] for g in groups], r["prob"]): r["value"] for r in group_quantiles(table, groups, ["v"], probs).collect()}
        assert len(found) == len(exact)
        for r in found:
            rows = table.where(F.col("v").isNotNull())
            for g in groups:
                rows = rows.where(F.col(g) == r[g])
            below, upto, n = rows.agg(F.count_if(F.col("v") < r["value"]), F.count_if(F.col("v") <= r["value"]), F.count(F.lit(1))).first()
            assert below / n - 0.01 <= r["prob"] <= upto / n + 0.01
            assert (*[r[g] for g in groups], r["prob"]) in exact


def test_distinct_counts_roll_up_without_the_fact(spark, table):
    path = new_folder(spark, "distinct")
    fine = write_and_read(distinct_sketches(table, ["month", "place"], {"who": "customers", "none": "nothing"}), path)
    rolled = distinct_estimates(fine, ["month"], ["customers", "nothing"])
    assert path.rsplit("/", 1)[-1] in rolled.inputFiles()[0] and len(rolled.inputFiles()) == len(fine.inputFiles())
    exact = {r["month"]: r["n"] for r in table.groupBy("month").agg(F.count_distinct("who").alias("n")).collect()}
    for r in rolled.collect():
        assert abs(r["customers"] - exact[r["month"]]) <= 0.02 * exact[r["month"]] and r["nothing"] == 0
    assert abs(distinct_estimates(fine, [], ["customers"]).first()[0] - 20_000) <= 400
