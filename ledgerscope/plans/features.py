"""One row of behaviour per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.functions import dates, numbers
from ledgerscope.operators.keys import hot_keys, small_side
from ledgerscope.operators.runs import medians, modes, run_lengths
from ledgerscope.schemas import DAYPARTS, FEATURE_COLUMNS, FEATURE_SCHEMA, require_columns
from ledgerscope.session import ROWS_PER_TASK

# The input columns of the data contract.
NEEDED = [
    "transaction_id", "customer_id", "customer_age", "gender", "customer_location",
    "account_balance_inr", "transaction_date", "transaction_hour", "daypart", "is_weekend",
    "transaction_amount_inr",
]
KEY = "customer_id"
HOT_ROWS = 20_000
MEDIANS = {
    "customer_age": "customer_age",
    "transaction_amount_inr": "median_transaction_amount",
    "account_balance_inr": "median_account_balance",
}
MODES = {"gender": "gender", "customer_location": "primary_location"}


def _mergeable() -> list:
    """Aggregates whose partial state has a fixed size."""
    amount, balance = F.col("transaction_amount_inr"), F.col("account_balance_inr")
    part_count = [F.count_if(F.col("daypart") == p).alias(f"n_{p}") for p in DAYPARTS]
    return [
        F.count("transaction_id").alias("transaction_count"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("total_transaction_amount"),
        F.avg(amount).alias("average_transaction_amount"),
        F.min(amount).alias("minimum_transaction_amount"),
        F.max(amount).alias("maximum_transaction_amount"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias("transaction_amount_std"),
        F.avg(balance).alias("average_account_balance"),
        F.min(balance).alias("minimum_account_balance"),
        F.max(balance).alias("maximum_account_balance"),
        F.coalesce(F.stddev_samp(balance), F.lit(0.0)).alias("account_balance_std"),
        F.min("transaction_date").alias("first_transaction_date"),
        F.max("transaction_date").alias("last_transaction_date"),
        F.avg("transaction_hour").alias("average_transaction_hour"),
        F.avg(F.col("is_weekend").cast("double")).alias("weekend_transaction_share"),
        F.count("daypart").alias("n_timed"),
        *part_count,
    ]


def _derive(agg: DataFrame) -> DataFrame:
    total, count = F.col("total_transaction_amount"), F.col("transaction_count")
    avg_amount, avg_balance = F.col("average_transaction_amount"), F.col("average_account_balance")
    span = dates.span_days(F.col("first_transaction_date"), F.col("last_transaction_date"))
    derived = {
        "transaction_amount_cv": numbers.ratio_to_magnitude(F.col("transaction_amount_std"), avg_amount),
        "account_balance_cv": numbers.ratio_to_magnitude(F.col("account_balance_std"), avg_balance),
        "active_days": span,
        "transactions_per_active_day": count / F.col("active_days"),
        "balance_to_total_spend_ratio": numbers.ratio_if_positive(avg_balance, total),
        "is_single_transaction_customer": count == 1,
        "log_total_transaction_amount": numbers.log1p_floor0(total),
        "log_average_transaction_amount": numbers.log1p_floor0(avg_amount),
        "log_average_account_balance": numbers.log1p_floor0(avg_balance),
        **{f"{p}_transaction_share": F.col(f"n_{p}") / F.nullif(F.col("n_timed"), F.lit(0)) for p in DAYPARTS},
    }
    staged = agg.withColumn("active_days", derived.pop("active_days")).withColumns(derived)
    return staged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_SCHEMA])


def _from_runs(usable: DataFrame) -> DataFrame:
    """Sums, modes and medians by run-length rows: no customer's rows meet in one task."""
    sums = usable.groupBy(KEY).agg(*_mergeable())
    runs = run_lengths(usable, KEY, list(MEDIANS), list(MODES))
    sides = modes(runs, KEY, MODES, {"customer_location": "distinct_locations"})
    return sums.join(sides, KEY, "left").join(medians(runs, KEY, MEDIANS), KEY, "left")


def _mode(values: Column) -> Column:
    """Most frequent value of a sorted array, the smallest on ties; one walk over its runs. Null without values."""
    first, last = F.get(values, F.lit(0)), F.get(values, F.size(values) - 1)
    start = F.struct(first.alias("best"), F.lit(0).alias("n"), first.alias("value"), F.lit(0).alias("run"))

    def step(seen: Column, value: Column) -> Column:
        run = F.when(seen["value"] == value, seen["run"] + 1).otherwise(F.lit(1))
        more = run > seen["n"]
        return F.struct(F.when(more, value).otherwise(seen["best"]).alias("best"), F.when(more, run).otherwise(seen["n"]).alias("n"),
                        value.alias("value"), run.alias("run"))

    # Most customers have one value only.
    return F.when(first == last, first).otherwise(F.aggregate(values, start, step, lambda seen: seen["best"]))


def _from_lists(usable: DataFrame, rows: int) -> DataFrame:
    """The same from one shuffle by customer, which gathers a customer's values in short lists.

    The aggregation sorts a task's rows; tasks of about ``ROWS_PER_TASK`` rows sort them in memory.
    """
    lists = [F.sort_array(F.collect_list(c)).alias(f"_{c}") for c in [*MEDIANS, *MODES]]
    tasks = max(usable.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    grouped = usable.repartition(tasks, KEY).groupBy(KEY).agg(*_mergeable(), *lists)

    def median(values: Column) -> Column:
        n = F.size(values)
        low, high = F.get(values, F.floor((n - 1) / 2).cast("int")), F.get(values, F.floor(n / 2).cast("int"))
        return low.cast("double") + (high.cast("double") - low.cast("double")) * 0.5

    return grouped.select(
        *[c for c in grouped.columns if not c.startswith("_")],
        *[median(F.col(f"_{m}")).alias(name) for m, name in MEDIANS.items()], *[_mode(F.col(f"_{m}")).alias(name) for m, name in MODES.items()],
        F.size(F.array_distinct("_customer_location")).cast("bigint").alias("distinct_locations"))


def build_customer_features(clean: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """35 columns per customer; rows without a customer id do not count.

    Customers of at most ``hot_rows`` rows are summed up where one shuffle brings their rows together. The few larger
    ones, if there are any, take run-length rows, which spread one customer over many tasks.
    """
    require_columns(clean.columns, NEEDED, "Clean transaction table")
    usable = clean.where(F.col(KEY).isNotNull()).select(NEEDED)
    rows = usable.count()
    hot, found = hot_keys(usable, KEY, hot_rows)
    if not found:
        whole = _from_lists(usable, rows)
    else:
        hot = small_side(hot, found)
        few, many = _from_lists(usable.join(hot, KEY, "left_anti"), rows), _from_runs(usable.join(hot, KEY, "left_semi"))
        whole = few.unionByName(many.select(few.columns))
    return _derive(whole.withColumn("distinct_locations", F.coalesce("distinct_locations", F.lit(0))))
