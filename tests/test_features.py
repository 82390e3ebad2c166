from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerscope.plans.clean import clean_transactions
from ledgerscope.plans.features import build_customer_features
from ledgerscope.schemas import CLEAN_SCHEMA, FEATURE_COLUMNS


def test_one_row_per_customer(raw):
    rows = {r["customer_id"]: r for r in build_customer_features(clean_transactions(raw)).collect()}
    assert len(rows) == 3
    c1, c2 = rows["C1"], rows["C2"]
    assert (c1["transaction_count"], c1["total_transaction_amount"], c1["active_days"]) == (2, 75.0, 2)
    assert c1["distinct_locations"] == 1 and c1["primary_location"] == "MUMBAI" and c1["gender"] == "F"
    assert c2["is_single_transaction_customer"] and c2["transaction_amount_std"] == 0.0
    assert c2["night_transaction_share"] is None  # no valid time
    assert c2["gender"] is None and c2["primary_location"] is None and c2["distinct_locations"] == 0


def _clean(spark, rows):
    """Clean rows from (id, customer, amount, balance, location, hour)."""
    base = spark.createDataFrame(rows, "transaction_id string, customer_id string, transaction_amount_inr double, "
                                       "account_balance_inr double, customer_location string, transaction_hour int")
    given = set(base.columns)
    extra = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in CLEAN_SCHEMA if f.name not in given}
    return base.select(*[extra.get(c, F.col(c)) for c in CLEAN_SCHEMA.fieldNames()])


def test_null_customers_drop_and_empty_sums_are_zero(spark):
    rows = [("T1", None, 5.0, 1.0, "A", 1), ("T2", "C1", None, None, "B", 2), (None, "C1", None, None, "A", 3)]
    got = build_customer_features(_clean(spark, rows)).collect()
    assert len(got) == 1 and got[0]["total_transaction_amount"] == 0.0 and got[0]["transaction_count"] == 1
    assert got[0]["primary_location"] == "A"  # tie goes to the smallest value
    assert got[0]["average_transaction_amount"] is None and got[0]["transaction_amount_cv"] == 0.0
    assert got[0]["balance_to_total_spend_ratio"] is None and got[0]["log_average_transaction_amount"] is None
    assert got[0]["active_days"] is None


def test_missing_column_raises(raw):
    with pytest.raises(ValueError, match="daypart"):
        build_customer_features(clean_transactions(raw).drop("daypart"))


def test_a_customer_with_a_third_of_all_rows(spark):
    """Against pandas, for one hot customer and many small ones."""
    rows = [(f"T{i}", "HOT" if i % 3 == 0 else f"C{i % 40}", None if i % 11 == 0 else float(i * 7 % 101) / 4, float(i * 13 % 57),
             None if i % 13 == 0 else f"L{i * 5 % 7}", i % 24) for i in range(600)]
    clean = _clean(spark, rows).withColumn("daypart", F.when(F.col("transaction_hour") < 12, "morning").otherwise("evening"))
    got = build_customer_features(clean).toPandas().set_index("customer_id").sort_index()
    assert list(got.reset_index().columns) == FEATURE_COLUMNS
    by = pd.DataFrame(rows, columns=["id", "customer_id", "amount", "balance", "place", "hour"]).groupby("customer_id")
    for name, want in {
        "median_transaction_amount": by["amount"].median(), "median_account_balance": by["balance"].median(),
        "distinct_locations": by["place"].nunique(), "transaction_count": by["id"].count(), "total_transaction_amount": by["amount"].sum(),
        "transaction_amount_std": by["amount"].std(), "primary_location": by["place"].agg(lambda x: x.mode().min()),
    }.items():
        pd.testing.assert_series_equal(got[name], want.sort_index(), check_names=False, check_dtype=False, rtol=1e-12)


def test_no_value_buffers_and_no_key_in_one_task(spark, raw):
    plan = build_customer_features(clean_transactions(raw))._jdf.queryExecution().toString()
    assert "percentile(" not in plan and "collect_set" not in plan and "mode(" not in plan


def test_result_does_not_depend_on_partitions(spark, raw):
    clean = clean_transactions(raw)
    a = build_customer_features(clean.repartition(1)).orderBy("customer_id").collect()
    b = build_customer_features(clean.repartition(7)).orderBy("customer_id").collect()
    assert a == b
