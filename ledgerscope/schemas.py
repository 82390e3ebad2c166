"""Declared column sets of every table."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(columns: list[tuple[str, str]]) -> T.StructType:
    """(name, type) pairs as a schema; needs no running session."""
    return T.StructType([T.StructField(name, _TYPES[dtype]) for name, dtype in columns])


# Raw column -> (canonical name, Spark type).
RAW_CONTRACT = {
    "TransactionID": ("transaction_id", T.StringType()),
    "CustomerID": ("customer_id", T.StringType()),
    "CustomerDOB": ("customer_dob_raw", T.StringType()),
    "CustGender": ("gender", T.StringType()),
    "CustLocation": ("customer_location", T.StringType()),
    "CustAccountBalance": ("account_balance_inr", T.DoubleType()),
    "TransactionDate": ("transaction_date_raw", T.StringType()),
    "TransactionTime": ("transaction_time_raw", T.LongType()),
    "TransactionAmount (INR)": ("transaction_amount_inr", T.DoubleType()),
}
RAW_COLUMNS = list(RAW_CONTRACT)
CANONICAL_NAMES = {raw: name for raw, (name, _) in RAW_CONTRACT.items()}
RAW_SCHEMA = T.StructType([T.StructField(raw, dtype) for raw, (_, dtype) in RAW_CONTRACT.items()])

# The columns of the data contract.
CLEAN_SCHEMA = _schema([
    ("transaction_id", "string"), ("customer_id", "string"), ("customer_dob", "date"),
    ("customer_age", "double"), ("gender", "string"), ("customer_location", "string"),
    ("account_balance_inr", "double"), ("transaction_date", "date"), ("transaction_time", "string"),
    ("transaction_datetime", "timestamp_ntz"), ("transaction_hour", "int"), ("transaction_weekday", "string"),
    ("transaction_month", "string"), ("daypart", "string"), ("is_weekend", "boolean"),
    ("transaction_amount_inr", "double"), ("balance_to_transaction_ratio", "double"),
    ("log_transaction_amount", "double"), ("log_account_balance", "double"),
])
CLEAN_COLUMNS = CLEAN_SCHEMA.fieldNames()

FEATURE_SCHEMA = _schema([
    ("customer_id", "string"), ("gender", "string"), ("customer_age", "double"), ("primary_location", "string"),
    ("distinct_locations", "bigint"), ("transaction_count", "bigint"), ("total_transaction_amount", "double"),
    ("average_transaction_amount", "double"), ("median_transaction_amount", "double"),
    ("minimum_transaction_amount", "double"), ("maximum_transaction_amount", "double"),
    ("transaction_amount_std", "double"), ("transaction_amount_cv", "double"),
    ("average_account_balance", "double"), ("median_account_balance", "double"),
    ("minimum_account_balance", "double"), ("maximum_account_balance", "double"),
    ("account_balance_std", "double"), ("account_balance_cv", "double"), ("first_transaction_date", "date"),
    ("last_transaction_date", "date"), ("active_days", "bigint"), ("transactions_per_active_day", "double"),
    ("average_transaction_hour", "double"), ("weekend_transaction_share", "double"),
    ("night_transaction_share", "double"), ("morning_transaction_share", "double"),
    ("afternoon_transaction_share", "double"), ("evening_transaction_share", "double"),
    ("late_evening_transaction_share", "double"), ("balance_to_total_spend_ratio", "double"),
    ("is_single_transaction_customer", "boolean"), ("log_total_transaction_amount", "double"),
    ("log_average_transaction_amount", "double"), ("log_average_account_balance", "double"),
])
FEATURE_COLUMNS = FEATURE_SCHEMA.fieldNames()

# Dayparts in clock order with the last hour of each.
DAYPARTS = {"night": 5, "morning": 11, "afternoon": 16, "evening": 20, "late_evening": 23}
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# The features of the segmentation.
SEGMENTATION_FEATURES = [
    "customer_age",
    "log_total_transaction_amount",
    "log_average_transaction_amount",
    "log_average_account_balance",
    "transaction_count",
    "transaction_amount_cv",
    "account_balance_cv",
    "active_days",
    "average_transaction_hour",
    "weekend_transaction_share",
    *[f"{part}_transaction_share" for part in DAYPARTS],
]


def require_columns(present, needed, what: str) -> None:
    """Raise with the sorted list of missing columns."""
    missing = sorted(set(needed) - set(present))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
