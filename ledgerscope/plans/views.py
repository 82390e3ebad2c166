"""The five views over the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerscope.functions.numbers import round_half_up
from ledgerscope.plans.warehouse import Warehouse
from ledgerscope.schemas import FEATURE_COLUMNS

AMOUNT, BALANCE = "transaction_amount_inr", "account_balance_inr"
ENRICHED_COLUMNS = [
    "transaction_id", "customer_id", "transaction_date", "transaction_time", "transaction_datetime",
    "transaction_month", "transaction_weekday", "transaction_hour", "daypart", "is_weekend",
    "transaction_amount_inr", "account_balance_inr", "balance_to_transaction_ratio",
]
COVERAGE_FIELDS = {
    "age": "customer_age", "gender": "gender", "location": "location_id", "balance": "account_balance_inr",
    "date": "transaction_date", "time": "transaction_time", "amount": "transaction_amount_inr",
}


def money_columns(average_balance: bool = True) -> list:
    """Rounded total and average amount, and optionally the average balance."""
    out = [round_half_up(F.sum(AMOUNT), 2).alias("total_transaction_amount_inr"),
           round_half_up(F.avg(AMOUNT), 2).alias("average_transaction_amount_inr")]
    if average_balance:
        out.append(round_half_up(F.avg(BALANCE), 2).alias("average_account_balance_inr"))
    return out


def transaction_enriched(wh: Warehouse) -> DataFrame:
    linked = wh.fact_transaction.join(wh.dim_location, "location_id", "left")
    return linked.select(*ENRICHED_COLUMNS, F.col("gender").alias("transaction_gender"),
                         F.col("customer_age").alias("transaction_customer_age"),
                         F.col("location_name").alias("transaction_location"))


def customer_360(wh: Warehouse) -> DataFrame:
    """Dimension and mart share their bucketing, so this join needs no shuffle."""
    person = wh.dim_customer.select("customer_id", "gender", "customer_age", "primary_location_id")
    mart = wh.customer_feature_mart.drop("customer_age", "primary_location_id")
    place = wh.dim_location.select(F.col("location_id").alias("primary_location_id"),
                                   F.col("location_name").alias("primary_location"))
    return person.join(mart, "customer_id").join(place, "primary_location_id", "left").select(FEATURE_COLUMNS)


def monthly_kpis(wh: Warehouse) -> DataFrame:
    weekend = F.avg(F.when(F.col("is_weekend") == 1, 1.0).otherwise(0.0))
    return wh.fact_transaction.where(F.col("transaction_month").isNotNull()).groupBy("transaction_month").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_distinct("customer_id").alias("active_customers"),
        *money_columns(),
        round_half_up(weekend * 100.0, 2).alias("weekend_transaction_pct"))


def location_performance(wh: Warehouse) -> DataFrame:
    """Facts are aggregated by location before the join, which then keeps empty locations."""
    per_place = wh.fact_transaction.where(F.col("location_id").isNotNull()).groupBy("location_id").agg(
        F.count("transaction_id").alias("transaction_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        *money_columns())
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return wh.dim_location.join(per_place, "location_id", "left").select(
        "location_id", "location_name", zero("transaction_count"), zero("unique_customers"),
        "total_transaction_amount_inr", "average_transaction_amount_inr", "average_account_balance_inr")


def data_coverage(wh: Warehouse) -> DataFrame:
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{k}_count") for k, c in COVERAGE_FIELDS.items()]
    return wh.fact_transaction.agg(F.count(F.lit(1)).alias("transaction_count"),
                                   F.count_distinct("customer_id").alias("unique_customers"), *missing)


VIEWS = {
    "vw_transaction_enriched": transaction_enriched,
    "vw_customer_360": customer_360,
    "vw_monthly_kpis": monthly_kpis,
    "vw_location_performance": location_performance,
    "vw_data_coverage": data_coverage,
}


def register_views(wh: Warehouse) -> None:
    """Make tables and views available to ``spark.sql``."""
    for name, df in wh.tables().items():
        df.createOrReplaceTempView(name)
    for name, build in VIEWS.items():
        build(wh).createOrReplaceTempView(name)


def parameterised_query(wh: Warehouse, query: str, args=None) -> DataFrame:
    """Read-only SQL over tables and views with bound ``?`` or ``:name`` values."""
    register_views(wh)
    return wh.spark.sql(query, args=args)
