"""The catalogue of 32 named reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerscope.functions import bands
from ledgerscope.functions.numbers import percent_of, round_half_up
from ledgerscope.operators.ordering import global_ntile
from ledgerscope.plans.views import (
    data_coverage, location_performance, money_columns, monthly_kpis)
from ledgerscope.plans.warehouse import Warehouse
from ledgerscope.schemas import DAYPARTS

TOTAL, AVERAGE, BALANCE = "total_transaction_amount", "average_transaction_amount", "average_account_balance"
RATIO, COUNT = "balance_to_total_spend_ratio", "transaction_count"


def rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def customers() -> Column:
    return rows("customer_count")


def mean(column: str, name: str, digits: int = 2) -> Column:
    return round_half_up(F.avg(column), digits).alias(name)


def rounded(column: str, name: str, digits: int = 2) -> Column:
    return round_half_up(F.col(column), digits).alias(name)


def mean_total() -> Column:
    return mean(TOTAL, "average_total_amount_inr")


def mean_value() -> Column:
    return mean(AVERAGE, "average_transaction_value_inr")


def mean_balance() -> Column:
    return mean(BALANCE, "average_account_balance_inr")


def mean_count() -> Column:
    return mean(COUNT, "average_transaction_count", 3)


def with_share(grouped: DataFrame, count: str, name: str, after: str) -> DataFrame:
    """Add percent of all rows; the window runs over the already small aggregate."""
    share = percent_of(F.col(count), F.sum(count).over(Window.partitionBy())).alias(name)
    place = grouped.columns.index(after) + 1
    return grouped.select(*grouped.columns[:place], share, *grouped.columns[place:])


def by_label(df: DataFrame, label: str, expression: Column, *measures: Column) -> DataFrame:
    return df.withColumn(label, expression).groupBy(label).agg(*measures)


def largest_first(df: DataFrame, label: str, count: str = "customer_count") -> DataFrame:
    return df.orderBy(F.desc(count), label)


# --- whole portfolio ---------------------------------------------------------

def portfolio_overview(wh: Warehouse) -> DataFrame:
    return wh.fact_transaction.agg(
        rows(COUNT), F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("location_id").alias("represented_locations"), *money_columns(),
        F.min("transaction_date").alias("first_transaction_date"),
        F.max("transaction_date").alias("last_transaction_date"))


def transaction_frequency(wh: Warehouse) -> DataFrame:
    per_count = wh.customer_feature_mart.groupBy(COUNT).agg(customers())
    return with_share(per_count, "customer_count", "customer_pct", "customer_count").orderBy(COUNT)


def single_vs_repeat(wh: Warehouse) -> DataFrame:
    kinds = by_label(wh.customer_feature_mart, "customer_type", bands.customer_type(F.col(COUNT)),
                     customers(), mean_total(), mean_value(), mean_balance())
    return largest_first(with_share(kinds, "customer_count", "customer_pct", "customer_count"), "customer_type")


def gender_profile(wh: Warehouse) -> DataFrame:
    people = wh.customer_feature_mart.join(wh.dim_customer.select("customer_id", "gender"), "customer_id")
    out = by_label(people, "gender", bands.known_or(F.col("gender")), customers(),
                   mean("customer_age", "average_age"), mean_count(), mean_total(), mean_balance())
    return largest_first(out, "gender")


def age_profile(wh: Warehouse) -> DataFrame:
    out = by_label(wh.customer_feature_mart, "age_band", bands.band(F.col("customer_age"), bands.AGE_BANDS),
                   customers(), mean_count(), mean_total(), mean_value(), mean_balance())
    return out.orderBy(bands.band_order(F.col("age_band"), bands.AGE_BANDS))


# --- locations ---------------------------------------------------------------

_PLACE_MONEY = ["total_transaction_amount_inr", "average_transaction_amount_inr", "average_account_balance_inr"]


def locations_by_customers(wh: Warehouse, top: int = 25) -> DataFrame:
    return (location_performance(wh).where(F.col("unique_customers") > 0)
            .orderBy(F.desc("unique_customers"), F.desc("total_transaction_amount_inr"), "location_name").limit(top)
            .select("location_name", "unique_customers", COUNT, *_PLACE_MONEY))


def locations_by_value(wh: Warehouse, top: int = 25) -> DataFrame:
    return (location_performance(wh).where(F.col(COUNT) > 0)
            .orderBy(F.desc_nulls_last("total_transaction_amount_inr"), "location_name").limit(top)
            .select("location_name", COUNT, "unique_customers", *_PLACE_MONEY))


def location_customer_value(wh: Warehouse, min_customers: int = 100, top: int = 25) -> DataFrame:
    """Customers are reduced per location id first, then named; unlocated customers form a group."""
    per_place = wh.customer_feature_mart.groupBy("primary_location_id").agg(
        customers(), mean(TOTAL, "average_customer_total_inr"), mean_value(), mean_balance(), mean_count())
    named = per_place.where(F.col("customer_count") >= min_customers).join(
        wh.dim_location.withColumnRenamed("location_id", "primary_location_id"), "primary_location_id", "left")
    return (named.orderBy(F.desc("average_customer_total_inr"), F.asc_nulls_first("location_name")).limit(top)
            .select("location_name", *[c for c in per_place.columns if c != "primary_location_id"]))


# --- time --------------------------------------------------------------------

def _activity(wh: Warehouse, key: str, customers: str = "unique_customers") -> DataFrame:
    return wh.fact_transaction.where(F.col(key).isNotNull()).groupBy(key).agg(
        rows(COUNT), F.count_distinct("customer_id").alias(customers), *money_columns(average_balance=False))


def daily_trend(wh: Warehouse) -> DataFrame:
    return _activity(wh, "transaction_date", "active_customers").orderBy("transaction_date")


def weekday_activity(wh: Warehouse) -> DataFrame:
    return _activity(wh, "transaction_weekday").orderBy(bands.weekday_order(F.col("transaction_weekday")))


def weekend_vs_weekday(wh: Warehouse) -> DataFrame:
    shared = with_share(_activity(wh, "is_weekend"), COUNT, "transaction_pct", "unique_customers")
    label = F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday").alias("period_type")
    return shared.orderBy("is_weekend").select(label, *[c for c in shared.columns if c != "is_weekend"])


def hourly_activity(wh: Warehouse) -> DataFrame:
    return _activity(wh, "transaction_hour").orderBy("transaction_hour")


def daypart_activity(wh: Warehouse) -> DataFrame:
    shared = with_share(_activity(wh, "daypart"), COUNT, "transaction_pct", "unique_customers")
    return shared.orderBy(bands.daypart_order(F.col("daypart")))


# --- distributions -----------------------------------------------------------

def amount_distribution(wh: Warehouse) -> DataFrame:
    known = wh.fact_transaction.where(F.col("transaction_amount_inr").isNotNull())
    out = by_label(known, "amount_band", bands.band(F.col("transaction_amount_inr"), bands.AMOUNT_BANDS),
                   rows(COUNT), money_columns()[0])
    return with_share(out, COUNT, "transaction_pct", COUNT).orderBy(
        bands.band_order(F.col("amount_band"), bands.AMOUNT_BANDS))


def _customer_bands(wh: Warehouse, label: str, source: str, table: list, *measures: Column,
                    share: bool = True) -> DataFrame:
    out = by_label(wh.customer_feature_mart, label, bands.band(F.col(source), table), customers(), *measures)
    if share:
        out = with_share(out, "customer_count", "customer_pct", "customer_count")
    return out.orderBy(bands.band_order(F.col(label), table))


def balance_distribution(wh: Warehouse) -> DataFrame:
    return _customer_bands(wh, "balance_band", BALANCE, bands.BALANCE_BANDS, mean_total(), mean_count())


def ratio_distribution(wh: Warehouse) -> DataFrame:
    return _customer_bands(wh, "ratio_band", RATIO, bands.RATIO_BANDS, mean_total(), mean_balance())


def activity_span(wh: Warehouse) -> DataFrame:
    return _customer_bands(wh, "active_span", "active_days", bands.SPAN_BANDS, mean_count(), mean_total(), share=False)


def _deciles(wh: Warehouse, source: str, label: str, columns: list[str], *measures: Column) -> DataFrame:
    known = wh.customer_feature_mart.where(F.col(source).isNotNull()).select("customer_id", *columns)
    tiled = global_ntile(known, [F.col(source), F.col("customer_id")], 10, label)
    return tiled.groupBy(label).agg(customers(), *measures).orderBy(label)


def spend_deciles(wh: Warehouse) -> DataFrame:
    return _deciles(
        wh, TOTAL, "spend_decile", [TOTAL, COUNT, BALANCE],
        round_half_up(F.min(TOTAL), 2).alias("minimum_total_inr"),
        round_half_up(F.max(TOTAL), 2).alias("maximum_total_inr"),
        mean(TOTAL, "average_total_inr"), mean_count(), mean_balance())


def balance_deciles(wh: Warehouse) -> DataFrame:
    return _deciles(
        wh, BALANCE, "balance_decile", [BALANCE, TOTAL, AVERAGE],
        round_half_up(F.min(BALANCE), 2).alias("minimum_balance_inr"),
        round_half_up(F.max(BALANCE), 2).alias("maximum_balance_inr"),
        mean(BALANCE, "average_balance_inr"), mean_total(), mean_value())


# --- customer lists ----------------------------------------------------------

def _top_customers(wh: Warehouse, keep: Column, order: list[Column], columns: list, top: int) -> DataFrame:
    """Filter and cut to the top rows on the bucketed mart, then add names to that short list."""
    mart = wh.customer_feature_mart.select(
        "customer_id", "customer_age", COUNT, TOTAL, AVERAGE, BALANCE, RATIO, "primary_location_id").where(keep)
    first = mart.join(wh.dim_customer.select("customer_id", "gender"), "customer_id").orderBy(
        *order, "customer_id").limit(top)
    place = wh.dim_location.select(F.col("location_id").alias("primary_location_id"),
                                   F.col("location_name").alias("primary_location"))
    named = first.join(place, "primary_location_id", "left")
    return named.orderBy(*order, "customer_id").select("customer_id", "gender", "customer_age", "primary_location",
                                                       *columns)


def _total_out() -> Column:
    return rounded(TOTAL, "total_transaction_amount_inr")


def _balance_out() -> Column:
    return rounded(BALANCE, "average_account_balance_inr")


def _ratio_out() -> Column:
    return rounded(RATIO, "balance_to_spend_ratio", 4)


def top_by_value(wh: Warehouse, top: int = 100) -> DataFrame:
    return _top_customers(wh, F.lit(True), [F.desc_nulls_last(TOTAL)],
                          [COUNT, _total_out(), rounded(AVERAGE, "average_transaction_amount_inr"), _balance_out()], top)


def top_by_balance(wh: Warehouse, top: int = 100) -> DataFrame:
    return _top_customers(wh, F.col(BALANCE).isNotNull(), [F.desc(BALANCE)],
                          [COUNT, _balance_out(), _total_out(), _ratio_out()], top)


def high_value_low_balance(wh: Warehouse, min_total: float = 10000, top: int = 100) -> DataFrame:
    keep = (F.col(TOTAL) >= min_total) & F.col(RATIO).isNotNull()
    return _top_customers(wh, keep, [F.asc(RATIO), F.desc(TOTAL)], [COUNT, _total_out(), _balance_out(), _ratio_out()], top)


def high_balance_low_activity(wh: Warehouse, top: int = 100) -> DataFrame:
    keep = (F.col(COUNT) == 1) & F.col(BALANCE).isNotNull()
    return _top_customers(wh, keep, [F.desc(BALANCE)], [_balance_out(), _total_out()], top)


def amount_outliers(wh: Warehouse, top: int = 100) -> DataFrame:
    order = [F.desc("transaction_amount_inr"), F.col("transaction_id")]
    largest = wh.fact_transaction.where(F.col("transaction_amount_inr").isNotNull()).orderBy(*order).limit(top)
    return largest.join(wh.dim_location, "location_id", "left").orderBy(*order).select(
        "transaction_id", "customer_id", "transaction_date", "transaction_time",
        F.col("location_name").alias("transaction_location"),
        rounded("transaction_amount_inr", "transaction_amount_inr"),
        rounded("account_balance_inr", "account_balance_inr"),
        rounded("balance_to_transaction_ratio", "balance_to_transaction_ratio", 4))


# --- customer groups ---------------------------------------------------------

def repeat_profile(wh: Warehouse) -> DataFrame:
    return wh.customer_feature_mart.where(F.col(COUNT) >= 2).groupBy(COUNT).agg(
        customers(), mean("active_days", "average_active_days"), mean_total(),
        mean("transaction_amount_cv", "average_amount_variability", 4),
        mean("account_balance_cv", "average_balance_variability", 4)).orderBy(COUNT)


def multi_location(wh: Warehouse) -> DataFrame:
    return wh.customer_feature_mart.where(F.col("distinct_locations") >= 2).groupBy("distinct_locations").agg(
        customers(), mean_count(), mean_total(), mean_balance()).orderBy("distinct_locations")


def daypart_preferences(wh: Warehouse) -> DataFrame:
    shares = {p: F.col(f"{p}_transaction_share") for p in DAYPARTS}
    out = by_label(wh.customer_feature_mart, "preferred_daypart", bands.preferred_daypart(shares),
                   customers(), mean_total(), mean_balance())
    return largest_first(with_share(out, "customer_count", "customer_pct", "customer_count"), "preferred_daypart")


def weekend_oriented(wh: Warehouse) -> DataFrame:
    known = wh.customer_feature_mart.where(F.col("weekend_transaction_share").isNotNull())
    out = by_label(known, "weekend_profile", bands.weekend_profile(F.col("weekend_transaction_share")),
                   customers(), mean_count(), mean_total(), mean_balance())
    return largest_first(out, "weekend_profile")


def value_matrix(wh: Warehouse, reference: str = "average") -> DataFrame:
    """Quadrants around the average (default) or median spend and balance.

    The averages are scalar subqueries over the mart.
    """
    known = wh.customer_feature_mart.where(F.col(TOTAL).isNotNull() & F.col(BALANCE).isNotNull())
    if reference == "median":
        from ledgerscope.operators.quantiles import column_quantiles

        middle = column_quantiles(known, [TOTAL, BALANCE], [0.5])
        spend_ref, balance_ref = F.lit(middle[TOTAL][0.5]), F.lit(middle[BALANCE][0.5])
    elif reference == "average":
        spend_ref = known.agg(F.avg(TOTAL)).scalar()
        balance_ref = known.agg(F.avg(BALANCE)).scalar()
    else:
        raise ValueError("reference must be 'average' or 'median'")
    quadrant = bands.value_quadrant(F.col(TOTAL), F.col(BALANCE), spend_ref, balance_ref)
    out = by_label(known, "value_quadrant", quadrant, customers(), mean_count(), mean_total(), mean_balance())
    return largest_first(with_share(out, "customer_count", "customer_pct", "customer_count"), "value_quadrant")


# Output name -> mart column of the feature summary.
SUMMARY_MEANS = {
    "mean_customer_age": "customer_age",
    "mean_transaction_count": "transaction_count",
    "mean_total_transaction_amount": "total_transaction_amount",
    "mean_average_transaction_amount": "average_transaction_amount",
    "mean_average_account_balance": "average_account_balance",
    "mean_transaction_amount_cv": "transaction_amount_cv",
    "mean_account_balance_cv": "account_balance_cv",
    "mean_weekend_share": "weekend_transaction_share",
    "mean_transaction_hour": "average_transaction_hour",
    "mean_balance_to_spend_ratio": "balance_to_total_spend_ratio",
}


def feature_summary(wh: Warehouse) -> DataFrame:
    return wh.customer_feature_mart.agg(customers(), *[mean(c, name, 4) for name, c in SUMMARY_MEANS.items()])


@dataclass(frozen=True)
class Report:
    name: str
    description: str
    build: Callable[[Warehouse], DataFrame]


REPORTS = [
    Report("01_portfolio_overview", "Headline counts, money totals and date range.", portfolio_overview),
    Report("02_data_quality_coverage", "Missing values in the transaction fact.", data_coverage),
    Report("03_customer_transaction_frequency", "Customers by number of transactions.", transaction_frequency),
    Report("04_single_vs_repeat_customers", "One-time against repeat customers.", single_vs_repeat),
    Report("05_gender_customer_profile", "Customer behaviour by gender.", gender_profile),
    Report("06_age_band_profile", "Customer behaviour by age band.", age_profile),
    Report("07_top_locations_by_customers", "Locations with the most customers.", locations_by_customers),
    Report("08_top_locations_by_value", "Locations with the highest total value.", locations_by_value),
    Report("09_location_customer_value", "Customer value in well represented locations.", location_customer_value),
    Report("10_monthly_kpis", "Monthly activity and money.", lambda wh: monthly_kpis(wh).orderBy("transaction_month")),
    Report("11_daily_transaction_trend", "Daily volume, customers and value.", daily_trend),
    Report("12_weekday_activity", "Activity by day of week.", weekday_activity),
    Report("13_weekend_vs_weekday", "Weekend against weekday activity.", weekend_vs_weekday),
    Report("14_hourly_activity", "Activity by hour.", hourly_activity),
    Report("15_daypart_activity", "Activity by daypart.", daypart_activity),
    Report("16_transaction_amount_distribution", "Transactions by amount band.", amount_distribution),
    Report("17_account_balance_distribution", "Customers by balance band.", balance_distribution),
    Report("18_transaction_value_deciles", "Customers by total-spend decile.", spend_deciles),
    Report("19_balance_deciles", "Customers by balance decile.", balance_deciles),
    Report("20_top_customers_by_total_value", "Customers with the highest total value.", top_by_value),
    Report("21_top_customers_by_balance", "Customers with the highest balances.", top_by_balance),
    Report("22_repeat_customer_profile", "Repeat customers by transaction count.", repeat_profile),
    Report("23_multi_location_customers", "Customers seen in several locations.", multi_location),
    Report("24_high_value_low_balance_customers", "High spend relative to balance.", high_value_low_balance),
    Report("25_high_balance_low_activity_customers", "High balance, one transaction.", high_balance_low_activity),
    Report("26_transaction_amount_outliers", "Largest single transactions.", amount_outliers),
    Report("27_balance_to_spend_ratio_distribution", "Customers by balance-to-spend band.", ratio_distribution),
    Report("28_customer_activity_span", "Customers by activity span.", activity_span),
    Report("29_customer_daypart_preferences", "Preferred daypart of each customer.", daypart_preferences),
    Report("30_weekend_oriented_customers", "Customers by weekend share.", weekend_oriented),
    Report("31_customer_value_matrix", "Spend and balance quadrants.", value_matrix),
    Report("32_segmentation_feature_summary", "Averages of the segmentation inputs.", feature_summary),
]
