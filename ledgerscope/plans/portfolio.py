"""Interactive portfolio queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerscope.plans.views import COVERAGE_FIELDS, data_coverage, monthly_kpis, parameterised_query
from ledgerscope.plans.warehouse import Warehouse

AMOUNT, BALANCE = "transaction_amount_inr", "account_balance_inr"

# Display names of the coverage fields.
COVERAGE_LABELS = {
    "age": "Age", "gender": "Gender", "location": "Location", "balance": "Account balance",
    "date": "Transaction date", "time": "Transaction time", "amount": "Transaction amount",
}


def home_kpis(wh: Warehouse) -> DataFrame:
    return wh.fact_transaction.agg(
        F.count(F.lit(1)).alias("transactions"), F.count_distinct("customer_id").alias("customers"),
        F.sum(AMOUNT).alias("total_value"), F.avg(AMOUNT).alias("average_transaction"),
        F.avg(BALANCE).alias("average_balance"))


def portfolio_kpis(wh: Warehouse) -> DataFrame:
    weekend = F.avg(F.when(F.col("is_weekend") == 1, 1.0).otherwise(0.0)).alias("weekend_share")
    base = wh.fact_transaction.agg(
        F.count(F.lit(1)).alias("transactions"), F.count_distinct("customer_id").alias("customers"),
        F.sum(AMOUNT).alias("total_value"), F.avg(AMOUNT).alias("average_transaction"),
        F.avg(BALANCE).alias("average_balance"), weekend)
    return base.withColumn("transactions_per_customer", F.col("transactions") / F.nullif(F.col("customers"), F.lit(0)))


def monthly_series(wh: Warehouse) -> DataFrame:
    """Monthly figures with the month as its first day."""
    first_day = F.concat(F.col("transaction_month"), F.lit("-01")).try_cast("date")
    return monthly_kpis(wh).withColumn("transaction_month", first_day).orderBy("transaction_month")


def hourly_volume(wh: Warehouse) -> DataFrame:
    known = wh.fact_transaction.where(F.col("transaction_hour").isNotNull())
    return known.groupBy("transaction_hour").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.avg(AMOUNT).alias("average_transaction_amount")
    ).orderBy("transaction_hour")


def location_filter(wh: Warehouse, min_customers: int = 100, top: int = 30) -> DataFrame:
    """Best represented locations with at least ``min_customers``, as a bound SQL query."""
    return parameterised_query(wh, f"""
        SELECT location_name, transaction_count, unique_customers, total_transaction_amount_inr,
               average_transaction_amount_inr, average_account_balance_inr
        FROM vw_location_performance
        WHERE unique_customers >= ?
        ORDER BY unique_customers DESC, location_name
        LIMIT {int(top)}""", args=[min_customers])


def coverage_long(wh: Warehouse) -> DataFrame:
    """Missing count and share per field, in long form."""
    fields = [F.struct(F.lit(label).alias("field"), F.col(f"missing_{key}_count").alias("missing_records"))
              for key, label in COVERAGE_LABELS.items() if key in COVERAGE_FIELDS]
    long = data_coverage(wh).select("transaction_count", F.inline(F.array(*fields)))
    share = F.col("missing_records") / F.nullif(F.col("transaction_count"), F.lit(0))
    return long.select("field", "missing_records", share.alias("missing_share"))
