"""Row-preserving cleaning of raw transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.functions import dates, numbers, text
from ledgerscope.schemas import CANONICAL_NAMES, CLEAN_COLUMNS, RAW_COLUMNS, require_columns

SORT_KEYS = ["transaction_date", "transaction_time", "transaction_id"]


def rename_columns(raw: DataFrame) -> DataFrame:
    """Nine raw names to their canonical names."""
    require_columns(raw.columns, RAW_COLUMNS, "Raw dataset")
    return raw.select(RAW_COLUMNS).withColumnsRenamed(CANONICAL_NAMES)


def reference_date(raw: DataFrame) -> DataFrame:
    """One row: the latest transaction date of the whole input, or the default."""
    latest = F.max(dates.parse_transaction_date(F.col("TransactionDate")))
    return raw.agg(F.coalesce(latest, F.lit(dates.DEFAULT_REFERENCE_DATE).cast("date")).alias("reference_date"))


def clean_transactions(raw: DataFrame, reference: Column | None = None) -> DataFrame:
    """One clean row per raw row, in the declared column order.

    The reference date is a scalar subquery that scans one column; pass
    ``reference`` to use a known date instead. Sorting is left to the sink.
    """
    base = rename_columns(raw)
    if reference is None:
        reference = reference_date(raw).scalar()
    # Staged, so that each parsed value is computed once and then referred to by name.
    parsed = base.select(
        text.strip_blank(F.col("transaction_id")).alias("transaction_id"),
        text.strip_blank(F.col("customer_id")).alias("customer_id"),
        text.clean_gender(F.col("gender")).alias("gender"),
        text.normalize_location(F.col("customer_location")).alias("customer_location"),
        numbers.to_number(F.col("account_balance_inr")).alias("account_balance_inr"),
        numbers.to_number(F.col("transaction_amount_inr")).alias("transaction_amount_inr"),
        dates.parse_transaction_date(F.col("transaction_date_raw")).alias("transaction_date"),
        dates.dob_candidate(F.col("customer_dob_raw")).alias("born"),
        dates.time_digits(F.col("transaction_time_raw")).alias("digits"),
    )
    parsed = parsed.withColumns({
        "customer_dob": dates.resolve_dob(F.col("born"), reference),
        "clock": dates.clock_parts(F.col("digits")),
    })
    day, hour = F.col("transaction_date"), F.col("clock.hour")
    amount, balance = F.col("transaction_amount_inr"), F.col("account_balance_inr")
    derived = {
        "customer_age": dates.age_in_years(day, F.col("customer_dob")),
        "transaction_time": F.col("clock.text"),
        "transaction_datetime": dates.combine_date_time(day, hour, F.col("clock.minute"), F.col("clock.second")),
        "transaction_hour": hour,
        "transaction_weekday": dates.day_name(day),
        "transaction_month": dates.year_month(day),
        "daypart": dates.daypart(hour),
        "is_weekend": dates.is_weekend(day),
        "balance_to_transaction_ratio": numbers.ratio_if_positive(balance, amount),
        "log_transaction_amount": numbers.log1p_floor0(amount),
        "log_account_balance": numbers.log1p_floor0(balance),
    }
    return parsed.select(*[derived.get(c, F.col(c)).alias(c) for c in CLEAN_COLUMNS])


def sorted_for_export(clean: DataFrame) -> DataFrame:
    """Date, time, id; missing values last. A range sort, used only before a file sink."""
    return clean.orderBy(*[F.col(c).asc_nulls_last() for c in SORT_KEYS])
