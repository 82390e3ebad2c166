"""Checking SQL of scans, expressions, features, quality checks and relational operators."""

from __future__ import annotations

from oracle.base import (
    CLEAN_COLUMNS, CLEAN_DOUBLES, DAYPARTS, FEATURE_DOUBLES, FEATURE_EXACT, GENDER, LOCATION, STRIP, TX_DATE, b,
    floor0_log, pct, r6, rnd)
from oracle.reports import AGE, BALANCE, PREFERRED, RATIO, REPORTS, SPAN, TYPE, WEEKEND

RAW = ["TransactionID", "CustomerID", "CustomerDOB", "CustGender", "CustLocation", "CustAccountBalance",
       "TransactionDate", "TransactionTime", "TransactionAmount (INR)"]
CANONICAL = ["transaction_id", "customer_id", "customer_dob_raw", "gender", "customer_location",
             "account_balance_inr", "transaction_date_raw", "transaction_time_raw", "transaction_amount_inr"]
q = lambda name: f'"{name}"'
money = lambda name: rnd(q(name), 6)
ID = '"TransactionID" AS transaction_id'

RAW_SQL = "SELECT " + ", ".join(
    f"{money(c)} AS {q(c)}" if c in ("CustAccountBalance", "TransactionAmount (INR)") else q(c) for c in RAW) + " FROM raw"
CLEAN_SQL = "SELECT " + ", ".join(r6(c) if c in CLEAN_DOUBLES else c for c in CLEAN_COLUMNS) + " FROM clean"
FEATURE_SQL = (f"SELECT {', '.join(FEATURE_EXACT)}, is_single_transaction_customer, {r6(*FEATURE_DOUBLES)} FROM features")
MART_SQL = ("SELECT " + ", ".join(c for c in FEATURE_EXACT if c not in ("gender", "primary_location"))
            + f", primary_location_id, is_single_transaction_customer, {r6(*FEATURE_DOUBLES)} FROM mart")
FACT_SQL = "SELECT location_id, " + ", ".join(
    r6(c) if c in CLEAN_DOUBLES else c for c in CLEAN_COLUMNS if c != "customer_location") + " FROM fact"
ENRICHED = ("transaction_id, customer_id, transaction_date, transaction_time, transaction_datetime, transaction_month, "
            "transaction_weekday, transaction_hour, daypart, is_weekend, "
            + r6("transaction_amount_inr", "account_balance_inr", "balance_to_transaction_ratio"))


def quantile(p: float, x: str, name: str) -> str:
    return f"{rnd(f'quantile_cont({x}, {p})', 6)} AS {name}"


def tables_count() -> str:
    pairs = {"dim_location": "dim_location", "dim_customer": "dim_customer", "fact_transaction": "fact",
             "customer_feature_mart": "mart"}
    return " UNION ALL ".join(f"SELECT '{label}' AS table_name, count(*) AS row_count FROM {source}"
                              for label, source in pairs.items())


def union_counts(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS \"check\", {b(sql)} AS violations" for label, sql in parts.items())


def orphans(child: str, column: str, parent: str, key: str) -> str:
    return f"(SELECT count(*) FROM {child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent}))"


def repeats(table: str, column: str) -> str:
    return f"(SELECT count(*) - count(DISTINCT {column}) FROM {table})"


def count_where(table: str, rule: str) -> str:
    return f"(SELECT count(*) FILTER (WHERE NOT ({rule})) FROM {table})"


LINKS = {
    "fact_transaction.customer_id": orphans("fact", "customer_id", "dim_customer", "customer_id"),
    "fact_transaction.location_id": orphans("fact", "location_id", "dim_location", "location_id"),
    "dim_customer.primary_location_id": orphans("dim_customer", "primary_location_id", "dim_location", "location_id"),
    "customer_feature_mart.customer_id": orphans("mart", "customer_id", "dim_customer", "customer_id"),
    "customer_feature_mart.primary_location_id": orphans("mart", "primary_location_id", "dim_location", "location_id"),
}
KEYS = {
    "dim_location.location_id key": repeats("dim_location", "location_id"),
    "dim_location.location_name key": repeats("dim_location", "location_name"),
    "dim_customer.customer_id key": repeats("dim_customer", "customer_id"),
    "fact_transaction.transaction_id key": repeats("fact", "transaction_id"),
    "customer_feature_mart.customer_id key": repeats("mart", "customer_id"),
    "fact_transaction.customer_id not null": count_where("fact", "customer_id IS NOT NULL"),
    "customer_feature_mart.transaction_count not null": count_where("mart", "transaction_count IS NOT NULL"),
}
DOMAINS = {
    "dim_customer.gender domain": count_where("dim_customer", "gender IN ('M', 'F')"),
    "dim_customer.customer_age domain": count_where("dim_customer", "customer_age BETWEEN 18 AND 100"),
    "fact_transaction.gender domain": count_where("fact", "gender IN ('M', 'F')"),
    "fact_transaction.transaction_hour domain": count_where("fact", "transaction_hour BETWEEN 0 AND 23"),
    "fact_transaction.is_weekend domain": count_where("fact", "is_weekend IN (0, 1)"),
    "customer_feature_mart.is_single_transaction_customer domain":
        count_where("mart", "is_single_transaction_customer IN (0, 1)"),
}
ORPHAN_TX = "(SELECT count(*) FROM fact WHERE customer_id NOT IN (SELECT customer_id FROM dim_customer))"

# check -> (value, threshold, description, pass rule on the value v)
_count = lambda table, rule: f"(SELECT count(*) FROM {table} WHERE {rule})"
QUALITY = {
    "raw_row_count": ("(SELECT count(*) FROM raw)", "> 0", "Number of raw transactions.", "v > 0"),
    "clean_row_count": ("(SELECT count(*) FROM clean)", "equal raw_row_count",
                        "Cleaning should not silently discard rows.", "v = (SELECT count(*) FROM raw)"),
    "duplicate_transaction_ids": ('(SELECT count(*) - count(DISTINCT "TransactionID") FROM raw)', "0",
                                  "Transaction identifiers should be unique.", "v = 0"),
    "missing_customer_ids": (_count("clean", "customer_id IS NULL"), "0",
                             "Rows without customer identifiers cannot support segmentation.", "v = 0"),
    "invalid_transaction_dates": (_count("clean", "transaction_date IS NULL"), "0",
                                  "Transaction dates should parse successfully.", "v = 0"),
    "invalid_transaction_times": (_count("clean", "transaction_time IS NULL"), "0",
                                  "Transaction times should be valid HHMMSS values.", "v = 0"),
    "missing_or_invalid_gender": ('(SELECT count("CustGender") FROM raw) - (SELECT count(gender) FROM clean)', "reported",
                                  "Missing and non-M/F values are standardized to null.", "v = 0"),
    "missing_or_invalid_dob": (_count("clean", "customer_dob IS NULL"), "reported",
                               "Includes missing, placeholder, and unparseable dates of birth.", "v = 0"),
    "implausible_clean_age": (_count("clean", "customer_age < 18 OR customer_age > 100"), "0",
                              "Clean ages must lie between 18 and 100.", "v = 0"),
    "negative_transaction_amounts": (_count("clean", "transaction_amount_inr < 0"), "0",
                                     "Negative amounts require domain investigation.", "v = 0"),
    "negative_account_balances": (_count("clean", "account_balance_inr < 0"), "reported",
                                  "Negative balances are retained but explicitly reported.", "v = 0"),
    **{f"raw_missing__{c}": (_count("raw", f"{q(c)} IS NULL"), "reported", f"Missing values in raw column {c}.", "v = 0")
       for c in RAW},
}


def quality(*names: str) -> str:
    rows = []
    for name in names:
        value, threshold, description, rule = QUALITY[name]
        rows.append(f"SELECT '{name}' AS \"check\", CASE WHEN {rule} THEN 'PASS' ELSE 'WARN' END AS status, v AS value, "
                    f"'{threshold}' AS threshold, '{description}' AS description FROM (SELECT {b(value)} AS v)")
    return " UNION ALL ".join(rows)


ALL_CHECKS = list(QUALITY)
SUMMARY = (f"SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM clean) AS clean_rows, "
           "(SELECT count(*) FROM features) AS unique_customers, CAST(19 AS BIGINT) AS clean_transaction_columns, "
           "CAST(35 AS BIGINT) AS customer_feature_columns, "
           f"(SELECT count(*) FILTER (WHERE status = 'WARN') FROM ({quality(*ALL_CHECKS)})) AS quality_warnings")


def catalogue() -> str:
    """Row and column counts of every report."""
    widths = {"01": 8, "02": 9, "03": 3, "04": 6, "05": 6, "06": 6, "07": 6, "08": 6, "09": 6, "10": 7, "11": 5, "12": 5,
              "13": 6, "14": 5, "15": 6, "16": 4, "17": 5, "18": 7, "19": 7, "20": 8, "21": 8, "22": 6, "23": 5, "24": 8,
              "25": 6, "26": 8, "27": 5, "28": 4, "29": 5, "30": 5, "31": 6, "32": 11}
    parts = []
    for name, sql in REPORTS.items():
        parts.append(f"SELECT '{name}' AS name, 'success' AS status, (SELECT count(*) FROM ({sql})) AS row_count, "
                     f"CAST({widths[name[:2]]} AS BIGINT) AS column_count")
    return " UNION ALL ".join(parts)


def _title(name: str) -> str:
    return " ".join(w[:1].upper() + w[1:].lower() for w in name.split("_"))


LOC = '"CustLocation"'
SQL = {
    "load_raw_transactions": RAW_SQL,
    "export_table": CLEAN_SQL,
    "scan_clean": CLEAN_SQL,
    "scan_features": FEATURE_SQL,
    "load_customer_features": FEATURE_SQL,
    "rename_columns": "SELECT " + ", ".join(
        (money(c) if c in ("CustAccountBalance", "TransactionAmount (INR)") else q(c)) + f" AS {n}"
        for c, n in zip(RAW, CANONICAL)) + " FROM raw",
    "project_columns": FEATURE_SQL,
    "drop_columns": f'SELECT "TransactionID", "CustomerID", "CustGender", {money("CustAccountBalance")} AS "CustAccountBalance", '
                    f'{money("TransactionAmount (INR)")} AS "TransactionAmount (INR)" FROM raw',
    "clean_transactions": CLEAN_SQL,
    "not_null_filter": "SELECT transaction_id, customer_location FROM clean WHERE customer_id IS NOT NULL "
                       "AND customer_location IS NOT NULL AND transaction_hour IS NOT NULL",
    "comparison_filter_customers": "SELECT customer_id, transaction_count, "
        + r6("total_transaction_amount", "average_account_balance")
        + " FROM mart WHERE transaction_count >= 2 AND total_transaction_amount >= 100 AND average_account_balance < 5000",
    "membership_and_range": f"SELECT transaction_id, gender, {r6('customer_age')}, daypart FROM clean "
        "WHERE gender IN ('M', 'F') AND customer_age BETWEEN 30 AND 50 AND daypart IN ('night', 'evening')",
    "conditional_null_out": f"SELECT transaction_id, CASE WHEN account_balance_inr > 0 THEN {rnd('account_balance_inr', 6)} END "
        "AS positive_balance, CASE WHEN transaction_hour < 12 THEN transaction_hour END AS valid_hour FROM clean",
    "having_minimum_group": "SELECT primary_location_id, count(*) AS customer_count FROM mart GROUP BY 1 HAVING count(*) >= 100",
    "case_banding": f"SELECT customer_id, {TYPE} AS customer_type, {AGE} AS age_band, {BALANCE} AS balance_band, "
        f"{RATIO} AS ratio_band, {SPAN} AS active_span, CASE WHEN weekend_transaction_share IS NOT NULL THEN {WEEKEND} END "
        "AS weekend_profile FROM mart",
    "coalesce_label": "SELECT customer_id, coalesce(gender, 'Unknown') AS gender FROM dim_customer",
    "boolean_to_int": "SELECT transaction_id, CAST(is_weekend AS INTEGER) AS is_weekend FROM clean",
    "fact_with_location": "SELECT transaction_id, location_name FROM fact LEFT JOIN dim_location USING (location_id)",
    "mart_with_customer": "SELECT customer_id, transaction_count, gender FROM mart JOIN dim_customer USING (customer_id)",
    "customer_with_location": "SELECT customer_id, location_name FROM dim_customer LEFT JOIN dim_location "
                              "ON location_id = primary_location_id",
    "locations_with_facts": "SELECT location_name, count(transaction_id) AS transaction_count FROM dim_location "
                            "LEFT JOIN fact USING (location_id) GROUP BY 1",
    "against_portfolio_average": "SELECT customer_id, total_transaction_amount >= (SELECT avg(total_transaction_amount) FROM mart) "
                                 "AS above_average FROM mart",
    "validated_left_merge": "SELECT customer_id, transaction_count, primary_location FROM features",
    "location_id_lookup": "SELECT transaction_id, location_id FROM fact",
    "orphan_rows": "SELECT count(*) AS orphans FROM fact WHERE customer_id NOT IN "
                   "(SELECT customer_id FROM mart WHERE transaction_count > 1)",
    "global_aggregate": "SELECT count(*) AS row_count, count(account_balance_inr) AS known_balances, "
        + ", ".join(f"{rnd(f'{f}(transaction_amount_inr)', 6)} AS {n}" for f, n in
                    (("avg", "mean_amount"), ("min", "smallest_amount"), ("max", "largest_amount"))) + " FROM fact",
    "hash_aggregate": "SELECT transaction_month, daypart, count(*) AS row_count, count(account_balance_inr) AS known_balances, "
        f"{rnd('sum(transaction_amount_inr)', 4)} AS total_amount, {rnd('avg(transaction_amount_inr)', 6)} AS mean_amount, "
        "min(transaction_amount_inr) AS smallest_amount, max(transaction_amount_inr) AS largest_amount FROM fact GROUP BY ALL",
    "distinct_counts": "SELECT transaction_month, count(DISTINCT customer_id) AS customers, "
                       "count(DISTINCT location_id) AS locations FROM fact GROUP BY 1",
    "conditional_aggregates": f"SELECT location_id, count(*) FILTER (WHERE is_weekend = 1) AS weekend_rows, "
        f"{rnd('avg(is_weekend)', 6)} AS weekend_share, count(*) - count(gender) AS missing_gender FROM fact GROUP BY 1",
    "median_per_group": f"SELECT customer_location, {quantile(0.5, 'transaction_amount_inr', 'median_amount')}, "
        f"{quantile(0.5, 'account_balance_inr', 'median_balance')}, {quantile(0.5, 'customer_age', 'median_age')} "
        "FROM clean WHERE customer_location IS NOT NULL GROUP BY 1",
    "quantiles_per_group": f"SELECT customer_location, {quantile(0.005, 'transaction_amount_inr', 'q005')}, "
        f"{quantile(0.25, 'transaction_amount_inr', 'q250')}, {quantile(0.995, 'transaction_amount_inr', 'q995')} "
        "FROM clean WHERE customer_location IS NOT NULL GROUP BY 1",
    "sample_deviation": f"SELECT customer_id, {rnd('stddev_samp(transaction_amount_inr)', 6)} AS amount_std FROM clean GROUP BY 1",
    "boolean_mean": f"SELECT customer_location, {rnd('avg(CAST(is_weekend AS INT))', 6)} AS weekend_share FROM clean GROUP BY 1",
    "primary_value": "SELECT * FROM places",
    "daypart_shares": "SELECT customer_location, " + ", ".join(
        rnd(f"(count(*) FILTER (WHERE daypart = '{p}') / nullif(CAST(count(daypart) AS DOUBLE), 0))", 6) + f" AS {p}_share"
        for p in DAYPARTS) + " FROM clean GROUP BY 1",
    "build_customer_features": FEATURE_SQL,
    "build_customer_features_hot_route": FEATURE_SQL,
    "sketch_quantiles": " UNION ALL ".join(
        f"SELECT transaction_month, '{m}' AS measure, CAST(p AS DOUBLE) AS prob, TRUE AS near FROM "
        f"(SELECT DISTINCT transaction_month FROM clean WHERE {m} IS NOT NULL) CROSS JOIN (VALUES (0.005), (0.25), (0.5), (0.75), (0.995)) t(p)"
        for m in ("transaction_amount_inr", "account_balance_inr")),
    "distinct_rollup": "SELECT transaction_month, count(DISTINCT customer_id) AS customers, count(DISTINCT customer_location) AS locations, "
                       "TRUE AS customers_near, TRUE AS locations_near FROM clean GROUP BY 1",
    "percent_of_total": f"SELECT distinct_locations, count(*) AS customer_count, {pct()} AS customer_pct FROM mart GROUP BY 1",
    "missing_profile": "SELECT " + ", ".join(f"count(*) - count({c}) AS missing_{c}" for c in CLEAN_COLUMNS) + " FROM clean",
    "total_over_groups": f"SELECT daypart, count(*) AS row_count, {b('sum(count(*)) OVER ()')} AS all_rows FROM fact GROUP BY 1",
    "customer_ntile": f"SELECT customer_id, {b('ntile(10) OVER (ORDER BY total_transaction_amount, customer_id)')} AS decile FROM mart",
    "first_transaction": "SELECT customer_id, transaction_datetime, transaction_id, daypart FROM (SELECT *, row_number() OVER "
        "(PARTITION BY customer_id ORDER BY transaction_datetime NULLS LAST, transaction_id) AS place FROM clean) WHERE place = 1",
    "surrogate_location_ids": "SELECT * FROM dim_location",
    "sorted_positions": "SELECT transaction_id, row_number() OVER (ORDER BY transaction_date NULLS LAST, transaction_time NULLS LAST, "
        "transaction_id NULLS LAST) AS position FROM clean",
    "ordinal_sort": f"SELECT transaction_weekday, count(*) AS row_count, {b('min(isodow(transaction_date))')} AS place FROM fact "
                    "WHERE transaction_weekday IS NOT NULL GROUP BY 1",
    "top_k": f"SELECT transaction_id, {r6('account_balance_inr')} FROM (SELECT * FROM fact WHERE account_balance_inr IS NOT NULL "
             "ORDER BY account_balance_inr DESC, transaction_id LIMIT 100)",
    "head_and_tail": " UNION ALL ".join(
        f"SELECT customer_id, {r6('total_transaction_amount')}, '{part}' AS part FROM (SELECT * FROM mart "
        f"ORDER BY total_transaction_amount {way}, customer_id LIMIT 12)" for part, way in (("head", "DESC"), ("tail", "ASC"))),
    "mixed_sort": "SELECT customer_id, row_number() OVER (ORDER BY transaction_count, maximum_transaction_amount DESC NULLS LAST, customer_id) "
                  "AS position FROM mart",
    "collect_locations": "SELECT location_name FROM dim_location",
    "drop_duplicates": "SELECT DISTINCT customer_id, transaction_month FROM clean",
    "append_tables": "SELECT source, location, count(*) AS row_count FROM (SELECT 'transaction' AS source, customer_location AS location "
        "FROM clean UNION ALL SELECT 'customer', primary_location FROM features) GROUP BY ALL",
    "duplicate_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count(DISTINCT coalesce({c}, '<null>')) AS duplicate_rows FROM clean"
        for c in ("transaction_id", "customer_id", "customer_location")),
    "strip_blank": f'SELECT {ID}, {STRIP.format(q("CustGender"))} AS gender, {STRIP.format(LOC)} AS location FROM raw',
    "upper_text": f'SELECT {ID}, upper("CustGender") AS gender FROM raw',
    "regex_replace": f"SELECT {ID}, regexp_replace({LOC}, '\\s+', ' ', 'g') AS spaces, regexp_replace({LOC}, '\\s*,\\s*', ', ', 'g') "
        f"AS commas, regexp_replace(upper({LOC}), '[^A-Z0-9,()&/ .''-]', '', 'g') AS legal FROM raw",
    "normalize_location": f"SELECT {ID}, {LOCATION.format(LOC)} AS customer_location FROM raw",
    "regex_extract": "SELECT " + ", ".join(
        f"try_cast(regexp_extract(trim(\"CustomerDOB\"), '^(\\d{{1,2}})/(\\d{{1,2}})/(\\d{{2}}|\\d{{4}})$', {i}) AS INTEGER) AS {n}"
        for i, n in ((1, "day"), (2, "month"), (3, "year"))) + ", count(*) AS row_count FROM raw GROUP BY ALL",
    "zero_pad_and_slice": f"SELECT {ID}, lpad(CAST(\"TransactionTime\" AS VARCHAR), 6, '0') AS padded, "
                          "substr(lpad(CAST(\"TransactionTime\" AS VARCHAR), 6, '0'), 1, 2) AS first_two FROM raw",
    "concat_text": "SELECT transaction_id, CAST(transaction_date AS VARCHAR) || 'T' || transaction_time AS stamp FROM clean",
    "to_number": f'SELECT {ID}, try_cast("TransactionDate" AS DOUBLE) AS day, try_cast(right("CustomerDOB", 2) AS DOUBLE) AS dob_year FROM raw',
    "parse_transaction_date": f"SELECT {ID}, {TX_DATE.format(q('TransactionDate'))} AS transaction_date FROM raw",
    "parse_customer_dob": "SELECT transaction_id, customer_dob FROM parsed",
    "parse_transaction_time": "SELECT transaction_id, transaction_hour, transaction_minute, transaction_second, transaction_time, "
                              "transaction_time IS NOT NULL AS valid_transaction_time FROM parsed",
    "date_difference": "SELECT transaction_id, date_diff('day', customer_dob, transaction_date) AS days, "
                       "CAST(transaction_date - INTERVAL 100 YEAR AS DATE) AS century_earlier FROM clean",
    "calendar_parts": "SELECT transaction_id, transaction_weekday AS weekday, is_weekend AS weekend, transaction_month AS month, "
                      "CAST(transaction_date AS VARCHAR) AS iso FROM clean",
    "combine_date_time": "SELECT transaction_id, transaction_datetime AS stamp FROM clean",
    "daypart_bins": "SELECT transaction_id, daypart FROM clean",
    "clip_and_log": f"SELECT transaction_id, {rnd('(' + floor0_log('account_balance_inr') + ')', 6)} AS log_balance, "
        f"CASE WHEN account_balance_inr IS NOT NULL THEN {rnd('greatest(least(account_balance_inr, 5000e0), 0e0)', 6)} END AS clipped, "
        f"{rnd('abs(account_balance_inr)', 6)} AS magnitude, {b('floor(account_balance_inr)')} AS whole FROM clean",
    "safe_ratio": f"SELECT transaction_id, {rnd('balance_to_transaction_ratio', 6)} AS ratio FROM clean",
    "round_half_up": f"SELECT customer_id, {rnd(rnd('average_transaction_amount', 2).join('()'), 6)} AS two, "
        f"{rnd(rnd('average_transaction_amount', 3).join('()'), 6)} AS three, "
        f"{rnd(rnd('average_account_balance', 4).join('()'), 6)} AS four FROM features",
    "preferred_daypart": f"SELECT customer_id, {PREFERRED} AS preferred_daypart FROM features",
    "neg_log10": "SELECT customer_id, CASE WHEN night_transaction_share IS NOT NULL THEN "
        + rnd("(-log10(greatest(night_transaction_share, 2.2250738585072014e-308)))", 6) + " END AS value FROM features",
    "segment_labels": "SELECT customer_id, CASE transaction_count WHEN 1 THEN 'Limited History' WHEN 2 THEN 'Repeat Activity' "
        "ELSE 'Segment ' || (transaction_count - 1) END AS segment_name, CASE transaction_count WHEN 1 THEN "
        "'Low-observed-activity customers' WHEN 2 THEN 'Repeat and higher-observed-activity customers' "
        "ELSE 'Segment ' || (transaction_count - 1) END AS segment_description FROM features",
    "validate_raw_schema": "SELECT count(*) AS row_count, TRUE AS refuses_missing_column FROM raw",
    "quality_report": quality(*ALL_CHECKS),
    **{f"quality_{n}": quality(n) for n in ALL_CHECKS if not n.startswith("raw_missing")},
    "quality_raw_missing": quality(*[n for n in ALL_CHECKS if n.startswith("raw_missing")]),
    # warehouse
    "write_json_record": SUMMARY,
    "preparation_summary": SUMMARY,
    "write_warehouse": tables_count(),
    "table_counts": tables_count(),
    "report_catalogue_runner": catalogue(),
    "query_catalog": catalogue(),
    "run_manifest": f"SELECT count(*) AS query_count, count(*) FILTER (WHERE status = 'success') AS successful_queries, "
        f"count(*) FILTER (WHERE status <> 'success') AS failed_queries, {b('sum(row_count)')} AS exported_rows, "
        f"{b('sum(column_count)')} AS exported_columns, max_by(name, (row_count, name)) AS largest_report FROM ({catalogue()})",
    "exported_report": REPORTS["03_customer_transaction_frequency"],
    "parameterised_query": "SELECT daypart, count(*) AS transaction_count, "
        f"{rnd('max(transaction_amount_inr)', 6)} AS largest_amount FROM fact WHERE transaction_amount_inr >= 250 "
        "AND transaction_month >= '1997-01' GROUP BY 1",
    "warehouse_build_summary": "SELECT (SELECT count(*) FROM mart) AS customer_rows_loaded, (SELECT count(*) FROM fact) "
        "AS transaction_rows_loaded, (SELECT count(*) FROM dim_location) AS dim_location_rows, (SELECT count(*) FROM dim_customer) "
        "AS dim_customer_rows, (SELECT count(*) FROM fact) AS fact_transaction_rows, (SELECT count(*) FROM mart) "
        f"AS customer_feature_mart_rows, {b(' + '.join(LINKS.values()))} AS foreign_key_violations, {ORPHAN_TX} AS orphan_transactions",
    "dim_location": "SELECT * FROM dim_location",
    "dim_customer": f"SELECT customer_id, gender, {r6('customer_age')}, primary_location_id, first_transaction_date, "
                    "last_transaction_date FROM dim_customer",
    "customer_feature_mart": MART_SQL,
    "fact_transaction": FACT_SQL,
    "orphan_transactions": f"SELECT {ORPHAN_TX} AS orphan_transactions",
    "foreign_key_violations": union_counts(LINKS),
    "key_violations": union_counts(KEYS),
    "domain_violations": union_counts(DOMAINS),
    "integrity_gate": union_counts({"orphan_transactions": ORPHAN_TX, **LINKS, **KEYS, **DOMAINS}),
    "vw_transaction_enriched": f"SELECT {ENRICHED}, gender AS transaction_gender, {rnd('customer_age', 6)} AS transaction_customer_age, "
                               "location_name AS transaction_location FROM fact LEFT JOIN dim_location USING (location_id)",
    "vw_customer_360": f"SELECT {', '.join(FEATURE_EXACT)}, is_single_transaction_customer, {r6(*FEATURE_DOUBLES)} FROM people",
    "vw_monthly_kpis": "SELECT * FROM monthly",
    "vw_location_performance": "SELECT * FROM performance",
    "vw_data_coverage": "SELECT * FROM coverage",
    "report_31_with_median_reference": REPORTS["31_customer_value_matrix"].replace("avg(total_transaction_amount) AS spend",
        "quantile_cont(total_transaction_amount, 0.5) AS spend").replace("avg(average_account_balance) AS balance",
        "quantile_cont(average_account_balance, 0.5) AS balance"),
}
