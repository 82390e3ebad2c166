"""Shared stages of the checking SQL: raw -> clean -> features -> warehouse, as CTEs for DuckDB.

The stages are written independently of the Spark code: dates go through
``try_strptime``, the mode through ``row_number``, medians through ``quantile_cont``.
"""

from __future__ import annotations

import re

DAYPARTS = ["night", "morning", "afternoon", "evening", "late_evening"]

# The columns of the data contract.
CLEAN_COLUMNS = [
    "transaction_id", "customer_id", "customer_dob", "customer_age", "gender", "customer_location", "account_balance_inr",
    "transaction_date", "transaction_time", "transaction_datetime", "transaction_hour", "transaction_weekday",
    "transaction_month", "daypart", "is_weekend", "transaction_amount_inr", "balance_to_transaction_ratio",
    "log_transaction_amount", "log_account_balance",
]
CLEAN_DOUBLES = {"customer_age", "account_balance_inr", "transaction_amount_inr", "balance_to_transaction_ratio",
                 "log_transaction_amount", "log_account_balance"}
FEATURE_EXACT = ["customer_id", "gender", "primary_location", "distinct_locations", "transaction_count",
                 "first_transaction_date", "last_transaction_date", "active_days"]
FEATURE_DOUBLES = [
    "customer_age", "total_transaction_amount", "average_transaction_amount", "median_transaction_amount",
    "minimum_transaction_amount", "maximum_transaction_amount", "transaction_amount_std", "transaction_amount_cv",
    "average_account_balance", "median_account_balance", "minimum_account_balance", "maximum_account_balance",
    "account_balance_std", "account_balance_cv", "transactions_per_active_day", "average_transaction_hour",
    "weekend_transaction_share", *[f"{p}_transaction_share" for p in DAYPARTS], "balance_to_total_spend_ratio",
    "log_total_transaction_amount", "log_average_transaction_amount", "log_average_account_balance",
]
# The features of the segmentation.
SEGMENTATION = [
    "customer_age", "log_total_transaction_amount", "log_average_transaction_amount", "log_average_account_balance",
    "transaction_count", "transaction_amount_cv", "account_balance_cv", "active_days", "average_transaction_hour",
    "weekend_transaction_share", *[f"{p}_transaction_share" for p in DAYPARTS],
]


def rnd(x: str, digits: int = 2) -> str:
    """Half-up rounding, the same arithmetic on both engines."""
    return f"sign({x})*floor(abs(CAST({x} AS DOUBLE))*1e{digits}+0.500001)/1e{digits}"


def r6(*columns: str) -> str:
    return ", ".join(f"{rnd(c, 6)} AS {c}" for c in columns)


def b(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def pct(count: str = "count(*)") -> str:
    return rnd(f"(100e0*{count}/sum({count}) OVER ())", 2)


def floor0_log(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN ln(1e0+greatest({x},0e0)) END"


STAGES: dict[str, str] = {}

STAGES["raw"] = """
SELECT 'T' || o_orderkey AS "TransactionID",
       'C' || o_custkey || '-' || (o_orderkey % (1 + o_custkey % 40)) AS "CustomerID",
       CASE WHEN o_custkey % 41 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN '1/1/1800'
            WHEN o_custkey % 53 = 0 THEN '31/2/85'
            ELSE (1 + o_custkey % 28) || '/' || (1 + o_custkey % 12) || '/' || (30 + (o_custkey * 7) % 60) END
         AS "CustomerDOB",
       CASE WHEN o_orderkey % 199 = 0 THEN 'T' WHEN o_orderkey % 97 = 0 THEN NULL
            WHEN o_custkey % 2 = 0 THEN ' m' ELSE 'F' END AS "CustGender",
       CASE WHEN o_orderkey % 211 = 0 THEN NULL
            ELSE '  ' || lower(n_name) || '  ,' || CASE WHEN o_orderkey % 5 = 0 THEN 'north' ELSE 'Main' END || ' '
       END AS "CustLocation",
       CASE WHEN o_orderkey % 443 = 0 THEN NULL ELSE c_acctbal + CAST((o_orderkey % 7) * 10 AS DOUBLE) END
         AS "CustAccountBalance",
       day(o_orderdate) || '/' || month(o_orderdate) || '/' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0')
         AS "TransactionDate",
       CASE WHEN o_orderkey % 389 = 0 THEN 250000
            ELSE (o_orderkey * 7919 % 24) * 10000 + (o_orderkey * 31 % 60) * 100 + o_orderkey % 60 END
         AS "TransactionTime",
       CAST(floor(o_totalprice / CAST(1 + (o_orderkey * 7919) % 9973 AS DOUBLE) * 100e0) AS DOUBLE) / 100e0
         AS "TransactionAmount (INR)"
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""

STRIP = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"
LOCATION = (r"nullif(regexp_replace(regexp_replace(regexp_replace(upper(" + STRIP + r"), '\s+', ' ', 'g'), "
            r"'\s*,\s*', ', ', 'g'), '[^A-Z0-9,()&/ .''-]', '', 'g'), '')")
GENDER = "CASE WHEN upper(" + STRIP + ") IN ('M', 'F') THEN upper(" + STRIP + ") END"
TX_DATE = "CAST(try_strptime(" + STRIP + ", '%d/%m/%y') AS DATE)"

# The reference date, the birth date in two steps, the clock in three.
STAGES["ref"] = (f"""SELECT coalesce(max({TX_DATE.format('"TransactionDate"')}), DATE '2016-12-31') AS reference_date FROM raw""")
STAGES["dob"] = r"""
SELECT *, CASE WHEN candidate > reference_date THEN CAST(candidate - INTERVAL 100 YEAR AS DATE) ELSE candidate END AS moved
FROM (SELECT *, try_cast(lpad(CAST(CASE WHEN yy < 100 THEN yy + 1900 ELSE yy END AS VARCHAR), 4, 'x') || '-' || mm
                         || '-' || dd AS DATE) AS candidate
      FROM (SELECT raw.*, reference_date,
              lpad(regexp_extract("CustomerDOB", '^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$', 1), 2, '0') AS dd,
              lpad(regexp_extract("CustomerDOB", '^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$', 2), 2, '0') AS mm,
              try_cast(regexp_extract("CustomerDOB", '^\s*(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\s*$', 3) AS INT) AS yy,
              lpad(CAST("TransactionTime" AS VARCHAR), 6, '0') AS clock
            FROM raw CROSS JOIN ref))"""
STAGES["parsed"] = f"""
SELECT {STRIP.format('"TransactionID"')} AS transaction_id, {STRIP.format('"CustomerID"')} AS customer_id,
       CASE WHEN year(moved) > 1900 THEN moved END AS customer_dob, {GENDER.format('"CustGender"')} AS gender,
       {LOCATION.format('"CustLocation"')} AS customer_location, "CustAccountBalance" AS account_balance_inr,
       "TransactionAmount (INR)" AS transaction_amount_inr, {TX_DATE.format('"TransactionDate"')} AS transaction_date,
       CASE WHEN hh <= 23 AND mi <= 59 AND ss <= 59 THEN hh END AS transaction_hour,
       CASE WHEN hh <= 23 AND mi <= 59 AND ss <= 59 THEN mi END AS transaction_minute,
       CASE WHEN hh <= 23 AND mi <= 59 AND ss <= 59 THEN ss END AS transaction_second,
       CASE WHEN hh <= 23 AND mi <= 59 AND ss <= 59
            THEN substr(clock, 1, 2) || ':' || substr(clock, 3, 2) || ':' || substr(clock, 5, 2) END AS transaction_time
FROM (SELECT *, try_cast(substr(clock, 1, 2) AS INT) AS hh, try_cast(substr(clock, 3, 2) AS INT) AS mi,
             try_cast(substr(clock, 5, 2) AS INT) AS ss FROM dob)"""
STAGES["clean"] = f"""
SELECT transaction_id, customer_id, customer_dob,
       CASE WHEN floor(date_diff('day', customer_dob, transaction_date) / 365.2425e0) BETWEEN 18 AND 100
            THEN floor(date_diff('day', customer_dob, transaction_date) / 365.2425e0) END AS customer_age,
       gender, customer_location, account_balance_inr, transaction_date, transaction_time,
       CAST(CAST(transaction_date AS VARCHAR) || ' ' || transaction_time AS TIMESTAMP) AS transaction_datetime,
       transaction_hour, dayname(transaction_date) AS transaction_weekday,
       strftime(transaction_date, '%Y-%m') AS transaction_month,
       CASE WHEN transaction_hour BETWEEN 0 AND 5 THEN 'night' WHEN transaction_hour BETWEEN 6 AND 11 THEN 'morning'
            WHEN transaction_hour BETWEEN 12 AND 16 THEN 'afternoon' WHEN transaction_hour BETWEEN 17 AND 20 THEN 'evening'
            WHEN transaction_hour BETWEEN 21 AND 23 THEN 'late_evening' END AS daypart,
       coalesce(isodow(transaction_date) >= 6, FALSE) AS is_weekend, transaction_amount_inr,
       CASE WHEN transaction_amount_inr > 0 THEN account_balance_inr / transaction_amount_inr END
         AS balance_to_transaction_ratio,
       {floor0_log('transaction_amount_inr')} AS log_transaction_amount,
       {floor0_log('account_balance_inr')} AS log_account_balance
FROM parsed"""


def mode_of(column: str, name: str) -> str:
    return f"""SELECT customer_id, {column} AS {name} FROM (
  SELECT customer_id, {column}, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {column}) AS place
  FROM clean WHERE {column} IS NOT NULL GROUP BY customer_id, {column}) WHERE place = 1"""


STAGES["genders"] = mode_of("gender", "gender")
STAGES["places"] = mode_of("customer_location", "primary_location")
STAGES["grouped"] = f"""
SELECT customer_id, quantile_cont(customer_age, 0.5) AS customer_age,
       count(DISTINCT customer_location) AS distinct_locations, count(transaction_id) AS transaction_count,
       coalesce(sum(transaction_amount_inr), 0e0) AS total_transaction_amount,
       avg(transaction_amount_inr) AS average_transaction_amount,
       quantile_cont(transaction_amount_inr, 0.5) AS median_transaction_amount,
       min(transaction_amount_inr) AS minimum_transaction_amount, max(transaction_amount_inr) AS maximum_transaction_amount,
       coalesce(stddev_samp(transaction_amount_inr), 0e0) AS transaction_amount_std,
       avg(account_balance_inr) AS average_account_balance,
       quantile_cont(account_balance_inr, 0.5) AS median_account_balance,
       min(account_balance_inr) AS minimum_account_balance, max(account_balance_inr) AS maximum_account_balance,
       coalesce(stddev_samp(account_balance_inr), 0e0) AS account_balance_std,
       min(transaction_date) AS first_transaction_date, max(transaction_date) AS last_transaction_date,
       avg(transaction_hour) AS average_transaction_hour,
       avg(CAST(is_weekend AS INT)) AS weekend_transaction_share,
       {', '.join(f"count(*) FILTER (WHERE daypart = '{p}') / nullif(CAST(count(daypart) AS DOUBLE), 0) AS {p}_transaction_share" for p in DAYPARTS)}
FROM clean WHERE customer_id IS NOT NULL GROUP BY customer_id"""
STAGES["features"] = f"""
SELECT g.*, gender, primary_location,
       coalesce(transaction_amount_std / nullif(abs(average_transaction_amount), 0), 0e0) AS transaction_amount_cv,
       coalesce(account_balance_std / nullif(abs(average_account_balance), 0), 0e0) AS account_balance_cv,
       {b("date_diff('day', first_transaction_date, last_transaction_date) + 1")} AS active_days,
       transaction_count / CAST(date_diff('day', first_transaction_date, last_transaction_date) + 1 AS DOUBLE)
         AS transactions_per_active_day,
       CASE WHEN total_transaction_amount > 0 THEN average_account_balance / total_transaction_amount END
         AS balance_to_total_spend_ratio,
       transaction_count = 1 AS is_single_transaction_customer,
       {floor0_log('total_transaction_amount')} AS log_total_transaction_amount,
       {floor0_log('average_transaction_amount')} AS log_average_transaction_amount,
       {floor0_log('average_account_balance')} AS log_average_account_balance
FROM grouped g LEFT JOIN genders USING (customer_id) LEFT JOIN places USING (customer_id)"""
STAGES["dim_location"] = """
SELECT CAST(row_number() OVER (ORDER BY location_name) AS INTEGER) AS location_id, location_name
FROM (SELECT trim(customer_location) AS location_name FROM clean UNION SELECT trim(primary_location) FROM features)
WHERE location_name <> ''"""
STAGES["dim_customer"] = """
SELECT customer_id, gender, customer_age, location_id AS primary_location_id, first_transaction_date, last_transaction_date
FROM features LEFT JOIN dim_location ON location_name = trim(primary_location)"""
STAGES["mart"] = """
SELECT f.* EXCLUDE (gender, primary_location, is_single_transaction_customer),
       CAST(is_single_transaction_customer AS INTEGER) AS is_single_transaction_customer,
       location_id AS primary_location_id
FROM features f LEFT JOIN dim_location ON location_name = trim(primary_location)"""
STAGES["fact"] = """
SELECT c.* EXCLUDE (customer_location, is_weekend), CAST(is_weekend AS INTEGER) AS is_weekend, location_id
FROM clean c LEFT JOIN dim_location ON location_name = trim(customer_location)"""
STAGES["people"] = """
SELECT m.*, c.gender, l.location_name AS primary_location FROM mart m JOIN dim_customer c USING (customer_id)
LEFT JOIN dim_location l ON l.location_id = m.primary_location_id"""

MONEY = (f"{rnd('sum(transaction_amount_inr)')} AS total_transaction_amount_inr, "
         f"{rnd('avg(transaction_amount_inr)')} AS average_transaction_amount_inr")
MONEY_AND_BALANCE = MONEY + f", {rnd('avg(account_balance_inr)')} AS average_account_balance_inr"

STAGES["monthly"] = f"""
SELECT transaction_month, count(*) AS transaction_count, count(DISTINCT customer_id) AS active_customers,
       {MONEY_AND_BALANCE}, {rnd('(100e0*avg(is_weekend))')} AS weekend_transaction_pct
FROM fact WHERE transaction_month IS NOT NULL GROUP BY transaction_month"""
STAGES["performance"] = f"""
SELECT l.location_id, location_name, count(transaction_id) AS transaction_count,
       count(DISTINCT customer_id) AS unique_customers, {MONEY_AND_BALANCE}
FROM dim_location l LEFT JOIN fact USING (location_id) GROUP BY ALL"""
STAGES["coverage"] = """
SELECT count(*) AS transaction_count, count(DISTINCT customer_id) AS unique_customers,
       count(*) - count(customer_age) AS missing_age_count, count(*) - count(gender) AS missing_gender_count,
       count(*) - count(location_id) AS missing_location_count, count(*) - count(account_balance_inr) AS missing_balance_count,
       count(*) - count(transaction_date) AS missing_date_count, count(*) - count(transaction_time) AS missing_time_count,
       count(*) - count(transaction_amount_inr) AS missing_amount_count
FROM fact"""


def needed_stages(sql: str) -> list[str]:
    """Stages a statement refers to, directly or through other stages, in build order."""
    found: set[str] = set()

    def visit(text: str) -> None:
        for name in STAGES:
            if name not in found and re.search(rf"(?:FROM|JOIN)\s+\(?{name}\b", text):
                found.add(name)
                visit(STAGES[name])

    visit(sql)
    return [name for name in STAGES if name in found]


def full(sql: str) -> str:
    """The statement preceded by the stages it needs."""
    stages = ",\n".join(f"{name} AS MATERIALIZED ({STAGES[name]})" for name in needed_stages(sql))
    if not stages:
        return sql
    return f"WITH {stages}\n{sql}" if not sql.lstrip().startswith("WITH ") else f"WITH {stages},\n{sql.lstrip()[5:]}"


def case_bands(x: str, bounds: list[tuple[str, str]], last: str, missing: str | None = "Unknown") -> str:
    parts = [f"WHEN {x} IS NULL THEN '{missing}'"] if missing else []
    parts += [f"WHEN {x} < {bound} THEN '{label}'" for bound, label in bounds]
    return f"CASE {' '.join(parts)} ELSE '{last}' END"
