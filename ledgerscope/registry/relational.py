"""Scans, cleaning expressions, feature building, quality checks and relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerscope.functions import bands, dates, numbers, text
from ledgerscope.operators import frequency, keys, ordering, quantiles, sampling, sketches
from ledgerscope.plans import clean as cleaning, features as featuring, quality, warehouse as wh_ops
from ledgerscope.plans.reports import with_share
from ledgerscope.registry.common import on_warehouse, on_workspace, rounded
from ledgerscope.schemas import CANONICAL_NAMES, CLEAN_SCHEMA, DAYPARTS, FEATURE_COLUMNS, RAW_COLUMNS
from ledgerscope.session import new_folder, write_and_read
from ledgerscope.sources import scans, sinks
from ledgerscope.workspace import Workspace

AMOUNT, BALANCE = "transaction_amount_inr", "account_balance_inr"


def _rows(name: str):
    return F.count(F.lit(1)).alias(name)


# --- scans and sinks ---------------------------------------------------------

def load_raw_transactions(ws: Workspace) -> DataFrame:
    path = new_folder(ws.spark, "raw-csv")
    sinks.export_csv(ws.raw, path)
    return rounded(scans.load_raw_transactions(ws.spark, path))


def export_table(ws: Workspace) -> DataFrame:
    path = new_folder(ws.spark, "clean-csv")
    sinks.export_csv(ws.clean, path, sort_by=cleaning.SORT_KEYS)
    return rounded(ws.spark.read.csv(path, header=True, schema=CLEAN_SCHEMA))


def scan_clean(ws: Workspace) -> DataFrame:
    ws.clean
    return rounded(scans.scan_table(ws.spark, f"{ws.root}/clean"))


def scan_features(ws: Workspace) -> DataFrame:
    ws.features
    return rounded(scans.scan_table(ws.spark, f"{ws.root}/features"))


# --- scalar expressions over the raw table -----------------------------------

def _expressions(table, key: str, columns):
    """Row id with expressions over a table. ``columns`` is a function: expressions need a session."""
    def build(ws: Workspace) -> DataFrame:
        return rounded(table(ws).select(key, *[c.alias(n) for n, c in columns().items()]))

    return on_workspace(build)


def _raw_expression(columns):
    return _expressions(lambda ws: cleaning.rename_columns(ws.raw), "transaction_id", columns)


def _clean_expression(columns):
    return _expressions(lambda ws: ws.clean, "transaction_id", columns)


def _feature_expression(columns):
    return _expressions(lambda ws: ws.features, "customer_id", columns)


def parse_customer_dob(ws: Workspace) -> DataFrame:
    raw = cleaning.rename_columns(ws.raw)
    reference = cleaning.reference_date(ws.raw).scalar()
    born = dates.parse_customer_dob(F.col("customer_dob_raw"), reference)
    return raw.select("transaction_id", born.alias("customer_dob"))


def parse_transaction_time(ws: Workspace) -> DataFrame:
    raw = cleaning.rename_columns(ws.raw)
    parts = raw.select("transaction_id", dates.parse_transaction_time(F.col("transaction_time_raw")).alias("t"))
    return parts.select("transaction_id", F.col("t.hour").alias("transaction_hour"),
                        F.col("t.minute").alias("transaction_minute"), F.col("t.second").alias("transaction_second"),
                        F.col("t.text").alias("transaction_time"), F.col("t.valid").alias("valid_transaction_time"))


def combine_date_time(ws: Workspace) -> DataFrame:
    raw = cleaning.rename_columns(ws.raw)
    parts = raw.select("transaction_id", dates.parse_transaction_date(F.col("transaction_date_raw")).alias("day"),
                       dates.parse_transaction_time(F.col("transaction_time_raw")).alias("t"))
    stamp = dates.combine_date_time(F.col("day"), F.col("t.hour"), F.col("t.minute"), F.col("t.second"))
    return parts.select("transaction_id", stamp.alias("stamp"))


def date_parts_of_dob(ws: Workspace) -> DataFrame:
    dob = text.strip_blank(F.col("CustomerDOB"))
    part = lambda i: F.nullif(F.regexp_extract(dob, r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$", i), F.lit("")).try_cast("int")
    return ws.raw.groupBy(part(1).alias("day"), part(2).alias("month"), part(3).alias("year")).agg(
        _rows("row_count"))


# --- projections and filters -------------------------------------------------

def not_null_filter(ws: Workspace) -> DataFrame:
    return ws.clean.where(F.col("customer_id").isNotNull() & F.col("customer_location").isNotNull()
                          & F.col("transaction_hour").isNotNull()).select("transaction_id", "customer_location")


def comparison_filter(wh) -> DataFrame:
    mart = wh.customer_feature_mart
    return rounded(mart.where((F.col("transaction_count") >= 2) & (F.col("total_transaction_amount") >= 100)
                              & (F.col("average_account_balance") < 5000)).select(
        "customer_id", "transaction_count", "total_transaction_amount", "average_account_balance"))


def membership_and_range(ws: Workspace) -> DataFrame:
    return rounded(ws.clean.where(F.col("gender").isin("M", "F") & F.col("customer_age").between(30, 50)
                                  & F.col("daypart").isin("night", "evening")).select(
        "transaction_id", "gender", "customer_age", "daypart"))


def having_minimum_group(wh) -> DataFrame:
    return wh.customer_feature_mart.groupBy("primary_location_id").agg(_rows("customer_count")).where(
        F.col("customer_count") >= 100)


def case_banding(wh) -> DataFrame:
    mart = wh.customer_feature_mart
    return mart.select(
        "customer_id",
        bands.customer_type(F.col("transaction_count")).alias("customer_type"),
        bands.band(F.col("customer_age"), bands.AGE_BANDS).alias("age_band"),
        bands.band(F.col("average_account_balance"), bands.BALANCE_BANDS).alias("balance_band"),
        bands.band(F.col("balance_to_total_spend_ratio"), bands.RATIO_BANDS).alias("ratio_band"),
        bands.band(F.col("active_days"), bands.SPAN_BANDS).alias("active_span"),
        F.when(F.col("weekend_transaction_share").isNotNull(),
               bands.weekend_profile(F.col("weekend_transaction_share"))).alias("weekend_profile"))


# --- joins -------------------------------------------------------------------

def fact_with_location(wh) -> DataFrame:
    return wh.fact_transaction.join(wh.dim_location, "location_id", "left").select("transaction_id", "location_name")


def mart_with_customer(wh) -> DataFrame:
    return wh.customer_feature_mart.select("customer_id", "transaction_count").join(
        wh.dim_customer.select("customer_id", "gender"), "customer_id")


def customer_with_location(wh) -> DataFrame:
    place = wh.dim_location.withColumnRenamed("location_id", "primary_location_id")
    return wh.dim_customer.join(place, "primary_location_id", "left").select("customer_id", "location_name")


def locations_with_facts(wh) -> DataFrame:
    per_place = wh.fact_transaction.groupBy("location_id").agg(F.count("transaction_id").alias("transaction_count"))
    return wh.dim_location.join(per_place, "location_id", "left").select(
        "location_name", F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"))


def against_portfolio_average(wh) -> DataFrame:
    mart = wh.customer_feature_mart
    reference = mart.agg(F.avg("total_transaction_amount")).scalar()
    return mart.select("customer_id", (F.col("total_transaction_amount") >= reference).alias("above_average"))


def validated_left_merge(ws: Workspace) -> DataFrame:
    ids = ws.features.select("customer_id", "transaction_count")
    places = frequency.primary_value(ws.clean, "customer_id", "customer_location", "primary_location")
    return keys.one_to_one_join(ids, places, "customer_id", how="left")


def location_id_lookup(ws: Workspace) -> DataFrame:
    linked = wh_ops.attach_location_id(ws.clean, "customer_location", "location_id", ws.warehouse.dim_location)
    return linked.select("transaction_id", "location_id")


# --- aggregates --------------------------------------------------------------

def global_aggregate(wh) -> DataFrame:
    return rounded(wh.fact_transaction.agg(
        _rows("row_count"), F.count(BALANCE).alias("known_balances"), F.avg(AMOUNT).alias("mean_amount"),
        F.min(AMOUNT).alias("smallest_amount"), F.max(AMOUNT).alias("largest_amount")))


def hash_aggregate(wh) -> DataFrame:
    return wh.fact_transaction.groupBy("transaction_month", "daypart").agg(
        _rows("row_count"), F.count(BALANCE).alias("known_balances"),
        numbers.round_half_up(F.sum(AMOUNT), 4).alias("total_amount"),
        numbers.round_half_up(F.avg(AMOUNT), 6).alias("mean_amount"),
        F.min(AMOUNT).alias("smallest_amount"), F.max(AMOUNT).alias("largest_amount"))


def distinct_counts(wh) -> DataFrame:
    return wh.fact_transaction.groupBy("transaction_month").agg(
        F.count_distinct("customer_id").alias("customers"), F.count_distinct("location_id").alias("locations"))


def conditional_aggregates(wh) -> DataFrame:
    return rounded(wh.fact_transaction.groupBy("location_id").agg(
        F.count_if(F.col("is_weekend") == 1).alias("weekend_rows"),
        F.avg(F.when(F.col("is_weekend") == 1, 1.0).otherwise(0.0)).alias("weekend_share"),
        F.count_if(F.col("gender").isNull()).alias("missing_gender")))


def _by_location(ws: Workspace, probs: list[float], names: dict) -> DataFrame:
    known = ws.clean.where(F.col("customer_location").isNotNull())
    found = quantiles.group_quantiles(known, ["customer_location"], sorted({m for m, _ in names}), probs)
    return rounded(quantiles.wide_quantiles(found, ["customer_location"], names))


def median_per_group(ws: Workspace) -> DataFrame:
    return _by_location(ws, [0.5], {(AMOUNT, 0.5): "median_amount", (BALANCE, 0.5): "median_balance",
                                    ("customer_age", 0.5): "median_age"})


def quantiles_per_group(ws: Workspace) -> DataFrame:
    return _by_location(ws, [0.005, 0.25, 0.995], {(AMOUNT, 0.005): "q005", (AMOUNT, 0.25): "q250",
                                                   (AMOUNT, 0.995): "q995"})


def sample_deviation(ws: Workspace) -> DataFrame:
    return rounded(ws.clean.groupBy("customer_id").agg(F.stddev_samp(AMOUNT).alias("amount_std")))


def boolean_mean(ws: Workspace) -> DataFrame:
    return rounded(ws.clean.groupBy("customer_location").agg(
        F.avg(F.col("is_weekend").cast("double")).alias("weekend_share")))


def primary_value(ws: Workspace) -> DataFrame:
    return frequency.primary_value(ws.clean, "customer_id", "customer_location", "primary_location")


def daypart_shares(ws: Workspace) -> DataFrame:
    timed = F.nullif(F.count("daypart"), F.lit(0))
    return rounded(ws.clean.groupBy("customer_location").agg(
        *[(F.count_if(F.col("daypart") == p) / timed).alias(f"{p}_share") for p in DAYPARTS]))


def build_customer_features(ws: Workspace) -> DataFrame:
    return rounded(featuring.build_customer_features(ws.clean))


def build_customer_features_hot_route(ws: Workspace) -> DataFrame:
    """The same table from rows dealt over many partitions, so that every customer's rows are spread."""
    return rounded(featuring.build_customer_features(ws.clean.repartition(64)))


def sketch_quantiles(ws: Workspace) -> DataFrame:
    """Quantiles per month from stored sketches per month and daypart, and whether their ranks are right to 1 % of the rows."""
    measures, probs = [AMOUNT, BALANCE], [0.005, 0.25, 0.5, 0.75, 0.995]
    fine = write_and_read(sketches.quantile_sketches(ws.clean, ["transaction_month", "daypart"], measures), new_folder(ws.spark, "quantile-sketches"))
    found = sketches.sketched_quantiles(sketches.merge_quantile_sketches(fine, ["transaction_month"]), probs)
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures])
    long = ws.clean.select("transaction_month", F.inline(cells)).where("v IS NOT NULL")
    same_month = F.col("f.transaction_month").eqNullSafe(F.col("r.transaction_month")) & (F.col("f.measure") == F.col("r.measure"))
    ranked = long.alias("r").join(found.alias("f"), same_month).groupBy("f.transaction_month", "f.measure", "prob").agg(
        F.avg((F.col("v") < F.col("value")).cast("double")).alias("below"), F.avg((F.col("v") <= F.col("value")).cast("double")).alias("upto"))
    return ranked.select("transaction_month", "measure", "prob", (
        (F.col("prob") >= F.col("below") - 0.01) & (F.col("prob") <= F.col("upto") + 0.01)).alias("near"))


def distinct_rollup(ws: Workspace) -> DataFrame:
    """Customers and locations per month from stored sketches per month and location, within 2 % of the exact numbers."""
    names = {"customer_id": "customers", "customer_location": "locations"}
    fine = write_and_read(sketches.distinct_sketches(ws.clean, ["transaction_month", "customer_location"], names), new_folder(ws.spark, "distinct-sketches"))
    rolled = sketches.distinct_estimates(fine, ["transaction_month"], list(names.values()))
    exact = ws.clean.groupBy("transaction_month").agg(*[F.count_distinct(c).alias(f"exact_{n}") for c, n in names.items()])
    near = [(F.abs(F.col(n) - F.col(f"exact_{n}")) <= 0.02 * F.col(f"exact_{n}")).alias(f"{n}_near") for n in names.values()]
    both = rolled.withColumnRenamed("transaction_month", "_month").join(exact, F.col("_month").eqNullSafe(F.col("transaction_month")))
    return both.select("transaction_month", *[F.col(f"exact_{n}").alias(n) for n in names.values()], *near)


def percent_of_total(wh) -> DataFrame:
    return with_share(wh.customer_feature_mart.groupBy("distinct_locations").agg(_rows("customer_count")),
                      "customer_count", "customer_pct", "customer_count")


def missing_profile(ws: Workspace) -> DataFrame:
    return quality.missing_profile(ws.clean, ws.clean.columns, "missing_")


# --- windows, sorts, sets ----------------------------------------------------

def total_over_groups(wh) -> DataFrame:
    counts = wh.fact_transaction.groupBy("daypart").agg(_rows("row_count"))
    return counts.withColumn("all_rows", F.sum("row_count").over(Window.partitionBy()))


def customer_ntile(wh) -> DataFrame:
    known = wh.customer_feature_mart.select("customer_id", "total_transaction_amount")
    tiled = ordering.global_ntile(known, [F.col("total_transaction_amount"), F.col("customer_id")], 10, "decile")
    return tiled.select("customer_id", "decile")


def first_transaction(ws: Workspace) -> DataFrame:
    rows = ws.clean.select("customer_id", "transaction_datetime", "transaction_id", "daypart")
    return frequency.first_row_per_key(rows, "customer_id", ["transaction_datetime", "transaction_id"])


def sorted_positions(ws: Workspace) -> DataFrame:
    order = [F.col(c).asc_nulls_last() for c in cleaning.SORT_KEYS]
    return ordering.with_row_number(ws.clean.select(cleaning.SORT_KEYS), order, "position").select(
        "transaction_id", "position")


def ordinal_sort(wh) -> DataFrame:
    days = wh.fact_transaction.where(F.col("transaction_weekday").isNotNull()).groupBy("transaction_weekday").agg(
        _rows("row_count"))
    place = bands.weekday_order(F.col("transaction_weekday"))
    return days.withColumn("place", place.cast("bigint")).orderBy("place")


def top_k(wh) -> DataFrame:
    return rounded(wh.fact_transaction.where(F.col(BALANCE).isNotNull()).select("transaction_id", BALANCE).orderBy(
        F.desc(BALANCE), "transaction_id").limit(100))


def head_and_tail(wh) -> DataFrame:
    """Twelve largest and twelve smallest customers by total amount."""
    mart = wh.customer_feature_mart.select("customer_id", "total_transaction_amount")
    head = mart.orderBy(F.desc("total_transaction_amount"), "customer_id").limit(12).withColumn("part", F.lit("head"))
    tail = mart.orderBy(F.asc("total_transaction_amount"), "customer_id").limit(12).withColumn("part", F.lit("tail"))
    return rounded(head.unionByName(tail))


def mixed_sort(wh) -> DataFrame:
    order = [F.asc("transaction_count"), F.desc_nulls_last("maximum_transaction_amount"), F.col("customer_id")]
    narrow = wh.customer_feature_mart.select("customer_id", "transaction_count", "maximum_transaction_amount")
    return ordering.with_row_number(narrow, order, "position").select("customer_id", "position")


def drop_duplicates(ws: Workspace) -> DataFrame:
    return ws.clean.select("customer_id", "transaction_month").dropDuplicates(["customer_id", "transaction_month"])


def append_tables(ws: Workspace) -> DataFrame:
    seen = ws.clean.select(F.col("customer_location").alias("location"), F.lit("transaction").alias("source"))
    home = ws.features.select(F.col("primary_location").alias("location"), F.lit("customer").alias("source"))
    return seen.unionByName(home).groupBy("source", "location").agg(_rows("row_count"))


def duplicate_counts(ws: Workspace) -> DataFrame:
    both = [keys.duplicate_count(ws.clean, c).select(F.lit(c).alias("column"), "duplicate_rows")
            for c in ("transaction_id", "customer_id", "customer_location")]
    return both[0].unionByName(both[1]).unionByName(both[2])


def quality_check(name: str):
    return on_workspace(lambda ws: quality.build_quality_report(ws.raw, ws.clean, [name]))


def validate_raw_schema(ws: Workspace) -> DataFrame:
    """The raw table passes, and a table without one column is refused."""
    quality.validate_raw_schema(ws.raw)
    try:
        quality.validate_raw_schema(ws.raw.drop("CustGender"))
        refused = False
    except ValueError:
        refused = True
    return ws.raw.agg(_rows("row_count")).withColumn("refuses_missing_column", F.lit(refused))


_c = F.col
QUERIES = {
    # scans and sinks
    "load_raw_transactions": on_workspace(load_raw_transactions),
    "export_table": on_workspace(export_table),
    "scan_clean": on_workspace(scan_clean),
    "scan_features": on_workspace(scan_features),
    # projections, filters, predicates
    "rename_columns": on_workspace(lambda ws: rounded(cleaning.rename_columns(ws.raw))),
    "project_columns": on_workspace(lambda ws: rounded(ws.features.select(FEATURE_COLUMNS))),
    "drop_columns": on_workspace(lambda ws: rounded(
        ws.raw.drop("CustomerDOB", "CustLocation", "TransactionDate", "TransactionTime"))),
    "clean_transactions": on_workspace(lambda ws: rounded(cleaning.clean_transactions(ws.raw))),
    "not_null_filter": on_workspace(not_null_filter),
    "comparison_filter_customers": on_warehouse(comparison_filter),
    "membership_and_range": on_workspace(membership_and_range),
    "conditional_null_out": _clean_expression(lambda: dict(positive_balance=F.when(_c(BALANCE) > 0, _c(BALANCE)), valid_hour=F.when(_c("transaction_hour") < 12, _c("transaction_hour")))),
    "having_minimum_group": on_warehouse(having_minimum_group),
    "case_banding": on_warehouse(case_banding),
    "coalesce_label": on_warehouse(lambda wh: wh.dim_customer.select("customer_id", bands.known_or(_c("gender")).alias("gender"))),
    "boolean_to_int": _clean_expression(lambda: dict(is_weekend=numbers.bool_to_int(_c("is_weekend")))),
    "sample_rows": on_workspace(lambda ws: rounded(sampling.sample_rows(
        ws.features.select("customer_id", "transaction_count", "total_transaction_amount"), "customer_id", 2000))),
    # joins
    "fact_with_location": on_warehouse(fact_with_location),
    "mart_with_customer": on_warehouse(mart_with_customer),
    "customer_with_location": on_warehouse(customer_with_location),
    "locations_with_facts": on_warehouse(locations_with_facts),
    "against_portfolio_average": on_warehouse(against_portfolio_average),
    "validated_left_merge": on_workspace(validated_left_merge),
    "location_id_lookup": on_workspace(location_id_lookup),
    "orphan_rows": on_warehouse(lambda wh: keys.orphan_rows(
        wh.fact_transaction, "customer_id", wh.customer_feature_mart.where(_c("transaction_count") > 1), "customer_id")),
    # aggregates
    "global_aggregate": on_warehouse(global_aggregate),
    "hash_aggregate": on_warehouse(hash_aggregate),
    "distinct_counts": on_warehouse(distinct_counts),
    "conditional_aggregates": on_warehouse(conditional_aggregates),
    "median_per_group": on_workspace(median_per_group),
    "quantiles_per_group": on_workspace(quantiles_per_group),
    "sample_deviation": on_workspace(sample_deviation),
    "boolean_mean": on_workspace(boolean_mean),
    "primary_value": on_workspace(primary_value),
    "daypart_shares": on_workspace(daypart_shares),
    "build_customer_features": on_workspace(build_customer_features),
    "sketch_quantiles": on_workspace(sketch_quantiles),
    "distinct_rollup": on_workspace(distinct_rollup),
    "build_customer_features_hot_route": on_workspace(build_customer_features_hot_route),
    "percent_of_total": on_warehouse(percent_of_total),
    "missing_profile": on_workspace(missing_profile),
    # windows
    "total_over_groups": on_warehouse(total_over_groups),
    "customer_ntile": on_warehouse(customer_ntile),
    "first_transaction": on_workspace(first_transaction),
    "surrogate_location_ids": on_workspace(lambda ws: wh_ops.build_dim_location(ws.clean, ws.features)),
    # sorts and top-k
    "sorted_positions": on_workspace(sorted_positions),
    "ordinal_sort": on_warehouse(ordinal_sort),
    "top_k": on_warehouse(top_k),
    "head_and_tail": on_warehouse(head_and_tail),
    "mixed_sort": on_warehouse(mixed_sort),
    # set operations
    "collect_locations": on_workspace(lambda ws: wh_ops.collect_locations(ws.clean, ws.features)),
    "drop_duplicates": on_workspace(drop_duplicates),
    "append_tables": on_workspace(append_tables),
    "duplicate_counts": on_workspace(duplicate_counts),
    # scalar expressions
    "strip_blank": _raw_expression(lambda: dict(gender=text.strip_blank(_c("gender")), location=text.strip_blank(_c("customer_location")))),
    "upper_text": _raw_expression(lambda: dict(gender=text.upper_text(_c("gender")))),
    "regex_replace": _raw_expression(lambda: dict(spaces=text.collapse_spaces(_c("customer_location")), commas=text.tidy_commas(_c("customer_location")),
        legal=text.drop_illegal(text.upper_text(_c("customer_location"))))),
    "normalize_location": _raw_expression(lambda: dict(customer_location=text.normalize_location(_c("customer_location")))),
    "regex_extract": on_workspace(date_parts_of_dob),
    "zero_pad_and_slice": _raw_expression(lambda: dict(padded=F.lpad(_c("transaction_time_raw").cast("string"), 6, "0"),
        first_two=F.substring(F.lpad(_c("transaction_time_raw").cast("string"), 6, "0"), 1, 2))),
    "concat_text": _clean_expression(lambda: dict(stamp=F.concat(_c("transaction_date").cast("string"), F.lit("T"), _c("transaction_time")))),
    "to_number": _raw_expression(lambda: dict(day=numbers.to_number(_c("transaction_date_raw")), dob_year=numbers.to_number(
        F.right(_c("customer_dob_raw"), F.lit(2))))),
    "parse_transaction_date": _raw_expression(lambda: dict(transaction_date=dates.parse_transaction_date(_c("transaction_date_raw")))),
    "parse_customer_dob": on_workspace(parse_customer_dob),
    "parse_transaction_time": on_workspace(parse_transaction_time),
    "date_difference": _clean_expression(lambda: dict(days=F.datediff("transaction_date", "customer_dob").cast("bigint"),
        century_earlier=F.add_months("transaction_date", -1200))),
    "calendar_parts": _clean_expression(lambda: dict(weekday=dates.day_name(_c("transaction_date")), weekend=dates.is_weekend(_c("transaction_date")),
        month=dates.year_month(_c("transaction_date")), iso=_c("transaction_date").cast("string"))),
    "combine_date_time": on_workspace(combine_date_time),
    "daypart_bins": _clean_expression(lambda: dict(daypart=dates.daypart(_c("transaction_hour")))),
    "clip_and_log": _clean_expression(lambda: dict(log_balance=numbers.log1p_floor0(_c(BALANCE)), clipped=numbers.clip(_c(BALANCE), 0.0, 5000.0),
        magnitude=F.abs(BALANCE), whole=F.floor(BALANCE).cast("bigint"))),
    "safe_ratio": _clean_expression(lambda: dict(ratio=numbers.ratio_if_positive(_c(BALANCE), _c(AMOUNT)))),
    "round_half_up": _feature_expression(lambda: dict(two=numbers.round_half_up(_c("average_transaction_amount"), 2),
        three=numbers.round_half_up(_c("average_transaction_amount"), 3),
        four=numbers.round_half_up(_c("average_account_balance"), 4))),
    "preferred_daypart": _feature_expression(lambda: dict(preferred_daypart=bands.preferred_daypart(
        {p: _c(f"{p}_transaction_share") for p in DAYPARTS}))),
    "neg_log10": _feature_expression(lambda: dict(value=numbers.neg_log10(_c("night_transaction_share")))),
    "segment_labels": _feature_expression(lambda: dict(segment_name=bands.segment_name(_c("transaction_count") - 1),
        segment_description=bands.segment_description(_c("transaction_count") - 1))),
    # quality
    "validate_raw_schema": on_workspace(validate_raw_schema),
    "quality_report": on_workspace(lambda ws: quality.build_quality_report(ws.raw, ws.clean)),
    **{f"quality_{name}": quality_check(name) for name in quality.CHECKS if not name.startswith("raw_missing")},
    "quality_raw_missing": on_workspace(lambda ws: quality.build_quality_report(
        ws.raw, ws.clean, [n for n in quality.CHECKS if n.startswith("raw_missing__")])),
}
