"""Pass/warn quality report over raw and clean transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerscope.operators.keys import duplicate_count
from ledgerscope.schemas import RAW_COLUMNS, require_columns

# Check name -> (threshold text, description).
CHECKS = {
    "raw_row_count": ("> 0", "Number of raw transactions."),
    "clean_row_count": ("equal raw_row_count", "Cleaning should not silently discard rows."),
    "duplicate_transaction_ids": ("0", "Transaction identifiers should be unique."),
    "missing_customer_ids": ("0", "Rows without customer identifiers cannot support segmentation."),
    "invalid_transaction_dates": ("0", "Transaction dates should parse successfully."),
    "invalid_transaction_times": ("0", "Transaction times should be valid HHMMSS values."),
    "missing_or_invalid_gender": ("reported", "Missing and non-M/F values are standardized to null."),
    "missing_or_invalid_dob": ("reported", "Includes missing, placeholder, and unparseable dates of birth."),
    "implausible_clean_age": ("0", "Clean ages must lie between 18 and 100."),
    "negative_transaction_amounts": ("0", "Negative amounts require domain investigation."),
    "negative_account_balances": ("reported", "Negative balances are retained but explicitly reported."),
    **{f"raw_missing__{c}": ("reported", f"Missing values in raw column {c}.") for c in RAW_COLUMNS},
}


def validate_raw_schema(raw: DataFrame) -> None:
    require_columns(raw.columns, RAW_COLUMNS, "Raw dataset")


def missing_profile(df: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """Null count of every column in one pass, one row."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"{prefix}{c}") for c in columns])


def _raw_counts() -> dict:
    """Aggregates over the raw table by name."""
    missing = {f"raw_missing__{c}": F.count_if(F.col(f"`{c}`").isNull()) for c in RAW_COLUMNS}
    return {"raw_row_count": F.count(F.lit(1)), "raw_genders": F.count("CustGender"), **missing}


def _clean_counts() -> dict:
    """Aggregates over the clean table by name."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    age = F.col("customer_age")
    return {
        "clean_row_count": F.count(F.lit(1)),
        "missing_customer_ids": missing("customer_id"),
        "invalid_transaction_dates": missing("transaction_date"),
        "invalid_transaction_times": missing("transaction_time"),
        "clean_genders": F.count("gender"),
        "missing_or_invalid_dob": missing("customer_dob"),
        "implausible_clean_age": F.count_if(age.isNotNull() & ~age.between(18, 100)),
        "negative_transaction_amounts": F.count_if(F.col("transaction_amount_inr") < 0),
        "negative_account_balances": F.count_if(F.col("account_balance_inr") < 0),
    }


# Counts that a check combines; the others use the count of their own name.
_BUILT_FROM = {"clean_row_count": ["clean_row_count", "raw_row_count"],
               "missing_or_invalid_gender": ["raw_genders", "clean_genders"]}


def _named_counts(df: DataFrame, counts: dict) -> DataFrame:
    """One pass; a row (name, value) per count."""
    one = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(f"c{i}").cast("bigint").alias("value")) for i, name in enumerate(counts)])))


def build_quality_report(raw: DataFrame, clean: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """One row (check, status, value, threshold, description) per check, all twenty by default.

    Only the counts that the chosen checks need are computed: at most one pass over each
    table, and one count per id for the duplicates. A handful of named counts is then turned
    into checks by one small aggregation.
    """
    validate_raw_schema(raw)
    checks = list(CHECKS) if checks is None else checks
    wanted = {c for name in checks for c in _BUILT_FROM.get(name, [name])}
    parts = []
    for table, known in ((raw, _raw_counts()), (clean, _clean_counts())):
        chosen = {n: c for n, c in known.items() if n in wanted}
        if chosen:
            parts.append(_named_counts(table, chosen))
    if "duplicate_transaction_ids" in wanted:
        repeats = duplicate_count(raw, "TransactionID")
        parts.append(repeats.select(F.lit("duplicate_transaction_ids").alias("name"), F.col("duplicate_rows").cast("bigint").alias("value")))
    counts = reduce(DataFrame.unionByName, parts)
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("of"))  # a few dozen numbers
    of = lambda name: F.col("of")[name]
    rows = []
    for name in checks:
        threshold, description = CHECKS[name]
        value = of("raw_genders") - of("clean_genders") if name == "missing_or_invalid_gender" else of(name)
        passed = value == 0
        if name == "raw_row_count":
            passed = value > 0
        elif name == "clean_row_count":
            passed = value == of("raw_row_count")
        rows.append(F.struct(
            F.lit(name).alias("check"), F.when(passed, "PASS").otherwise("WARN").alias("status"),
            value.alias("value"), F.lit(threshold).alias("threshold"), F.lit(description).alias("description")))
    return found.select(F.inline(F.array(*rows)))


def preparation_summary(raw: DataFrame, clean: DataFrame, features: DataFrame, quality: DataFrame) -> DataFrame:
    """One row of counts for the preparation record."""
    # Three counts and the warnings as named numbers of one row each, then side by side without a join.
    named = [
        quality.where(F.col("check") == "raw_row_count").select(F.lit("raw_rows").alias("name"), "value"),
        quality.where(F.col("check") == "clean_row_count").select(F.lit("clean_rows").alias("name"), "value"),
        features.agg(F.count_distinct("customer_id").alias("value")).select(F.lit("unique_customers").alias("name"), "value"),
        quality.agg(F.count_if(F.col("status") == "WARN").alias("value")).select(F.lit("quality_warnings").alias("name"), "value"),
    ]
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)
    return reduce(DataFrame.unionByName, named).agg(
        of("raw_rows"), of("clean_rows"), of("unique_customers"),
        F.lit(len(clean.columns)).cast("bigint").alias("clean_transaction_columns"),
        F.lit(len(features.columns)).cast("bigint").alias("customer_feature_columns"), of("quality_warnings"))
