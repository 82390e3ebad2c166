from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import bands, dates, numbers, text
from ledgerscope.plans.clean import clean_transactions, reference_date, sorted_for_export
from ledgerscope.schemas import CLEAN_COLUMNS, CLEAN_SCHEMA, RAW_SCHEMA
from tests.conftest import one_column

D = dt.date


def by_id(df):
    return {r["transaction_id"]: r for r in df.collect()}


def test_rows_are_kept_and_sorted(raw):
    clean = clean_transactions(raw)
    assert clean.count() == 4 and clean.columns == CLEAN_COLUMNS
    assert [f.dataType for f in clean.schema] == [f.dataType for f in CLEAN_SCHEMA]
    assert [r["transaction_id"] for r in sorted_for_export(clean).collect()] == ["T4", "T1", "T3", "T2"]


def test_bad_values_become_null(raw):
    rows = by_id(clean_transactions(raw))
    assert rows["T3"]["gender"] is None and rows["T3"]["customer_dob"] is None
    assert rows["T3"]["transaction_time"] is None and rows["T3"]["daypart"] is None
    assert rows["T1"]["customer_location"] == "MUMBAI" == rows["T2"]["customer_location"]
    assert rows["T1"]["transaction_datetime"] == dt.datetime(2016, 8, 2, 14, 32, 7)
    assert rows["T1"]["transaction_weekday"] == "Tuesday" and rows["T1"]["transaction_month"] == "2016-08"
    assert rows["T1"]["customer_age"] == 22.0 and rows["T4"]["customer_age"] == 59.0
    assert rows["T1"]["balance_to_transaction_ratio"] == 40.0


def test_missing_column_raises(raw):
    with pytest.raises(ValueError, match="CustGender"):
        clean_transactions(raw.drop("CustGender"))


def test_time_vector(spark):
    got = one_column(spark, [0, 93015, 235959, 240000, None, 1432071, -1, 126000, 5960],
                     dates.parse_transaction_time, "bigint")
    assert [g["valid"] for g in got] == [True, True, True, False, False, True, False, False, False]
    assert got[1]["text"] == "09:30:15" and got[0]["text"] == "00:00:00" and got[5]["text"] == "14:32:07"
    assert got[3]["hour"] is None and got[6]["text"] is None


def test_date_pivot_and_bad_dates(spark):
    values = ["2/8/16", "02/08/16", "1/1/68", "1/1/69", "31/2/16", "2/8/2016", "x", "", None, " 3/4/05 ", "2016-08-02"]
    assert one_column(spark, values, dates.parse_transaction_date) == [
        D(2016, 8, 2), D(2016, 8, 2), D(2068, 1, 1), D(1969, 1, 1), None, None, None, None, None, D(2005, 4, 3), None]


def test_birth_dates(spark):
    reference = F.lit("2016-12-31").cast("date")
    values = ["10/1/94", "1/1/1800", "1/1/05", "1/1/00", "1/1/0050", "29/2/2096", "31/2/85", "1/1/2020", "1/1/1901",
              "1/1/0150", "1/1/9999", "1/1/123", None, "1994-01-10"]
    assert one_column(spark, values, lambda c: dates.parse_customer_dob(c, reference)) == [
        D(1994, 1, 10), None, D(1905, 1, 1), None, D(1950, 1, 1), D(1996, 2, 29), None, D(1920, 1, 1), D(1901, 1, 1),
        None, None, None, None, None]


def test_leap_day_clamps_when_moved_a_century(spark):
    got = one_column(spark, ["29/2/2000"], lambda c: dates.parse_customer_dob(c, F.lit("1999-12-31").cast("date")))
    assert got == [None]  # 1900 is not after 1900
    got = one_column(spark, ["29/2/2104"], lambda c: dates.parse_customer_dob(c, F.lit("2016-12-31").cast("date")))
    assert got == [D(2004, 2, 29)]


def test_reference_date_default(spark):
    empty = spark.createDataFrame([], RAW_SCHEMA)
    assert reference_date(empty).first()[0] == D(2016, 12, 31)


def test_strip_covers_unicode_space(spark):
    assert one_column(spark, ["\t a ", " ", "", None, "a\x1f"], text.strip_blank) == ["a", None, None, None, "a"]


def test_location_keeps_operation_order(spark):
    values = [" new   delhi ,  india ", "A # B", "#MUMBAI #", "# #", "nation_9,x", None, "o'hare (x)&y/z.", "a\tb"]
    assert one_column(spark, values, text.normalize_location) == [
        "NEW DELHI, INDIA", "A  B", "MUMBAI ", " ", "NATION9, X", None, "O'HARE (X)&Y/Z.", "A B"]


def test_gender(spark):
    assert one_column(spark, [" m", "F", "T", "", None, "male"], text.clean_gender) == ["M", "F", None, None, None, None]


def test_weekend_is_false_without_date(spark):
    assert one_column(spark, ["2016-08-06", "2016-08-08", None],
                      lambda c: dates.is_weekend(c.cast("date"))) == [True, False, False]


def test_dayparts(spark):
    assert one_column(spark, [0, 5, 6, 11, 12, 16, 17, 20, 21, 23, None], dates.daypart, "int") == [
        "night", "night", "morning", "morning", "afternoon", "afternoon", "evening", "evening", "late_evening",
        "late_evening", None]


def test_numbers(spark):
    assert one_column(spark, ["1.5", "x", "NaN", "Infinity", None], numbers.to_number) == [1.5, None, None, None, None]
    assert one_column(spark, [-1.0, 0.0, None], numbers.log1p_floor0, "double") == [0.0, 0.0, None]
    assert one_column(spark, [9.0, -9.0, 0.5, None], lambda c: numbers.clip(c, -1.0, 1.0), "double") == [1.0, -1.0, 0.5, None]
    half = lambda c: numbers.round_half_up(c, 2)
    assert one_column(spark, [1.005, 2.675, -1.005, 1.004, None], half, "double") == [1.01, 2.68, -1.01, 1.0, None]
    assert one_column(spark, [0.0, 0.1, None], numbers.neg_log10, "double")[:2] == pytest.approx([307.65, 1.0], abs=0.01)
    assert one_column(spark, [0.0, 2.0], lambda c: numbers.ratio_if_positive(F.lit(4.0), c), "double") == [None, 2.0]
    assert one_column(spark, [0.0, -2.0, None], lambda c: numbers.ratio_to_magnitude(F.lit(4.0), c), "double") == [0.0, 2.0, 0.0]


def test_age_limits(spark):
    on = F.lit("2016-08-02").cast("date")
    got = one_column(spark, ["1998-08-03", "1998-08-01", "1916-08-01", "1910-01-01", None],
                     lambda c: dates.age_in_years(on, c.cast("date")))
    assert got == [None, 18.0, 100.0, None, None]


def test_bands_and_labels(spark):
    got = one_column(spark, [None, 18.0, 24.9, 25.0, 64.0, 65.0], lambda c: bands.band(c, bands.AGE_BANDS), "double")
    assert got == ["Unknown", "18-24", "18-24", "25-34", "55-64", "65+"]
    assert one_column(spark, [1, 2, 7, 8, 30, 31, 60, 61], lambda c: bands.band(c, bands.SPAN_BANDS), "int") == [
        "1 day", "2-7 days", "2-7 days", "8-30 days", "8-30 days", "31-60 days", "31-60 days", "61+ days"]
    assert one_column(spark, [0.0, 0.3, 0.5, 1.0], bands.weekend_profile, "double") == [
        "No weekend activity", "Mostly weekdays", "Mostly weekends", "Weekend only"]
    assert one_column(spark, [0, 1, 2], bands.segment_name, "int") == ["Limited History", "Repeat Activity", "Segment 2"]


def test_preferred_daypart_ties_and_missing(spark):
    rows = [(1, 0.5, 0.5, 0.0, 0.0, 0.0), (2, 0.0, 0.2, 0.0, 0.4, 0.4), (3, None, 1.0, 0.0, 0.0, 0.0),
            (4, 0.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, night double, morning double, afternoon double, evening double, late_evening double")
    shares = {c: F.col(c) for c in df.columns[1:]}
    got = [r[0] for r in df.orderBy("i").select(bands.preferred_daypart(shares)).collect()]
    assert got == ["Night", "Evening", "Late evening", "Late evening"]


def test_report_names(spark):
    assert one_column(spark, ["01_portfolio_overview"], text.display_name) == ["01 Portfolio Overview"]
    assert one_column(spark, ["n_clusters=3", "x"], text.trailing_number) == [3, None]
    assert one_column(spark, ["Age Band", None], lambda c: text.contains_pattern(c, "AGE")) == [True, False]


def test_csv_scan_keeps_fractions_and_line_breaks(spark, tmp_path):
    from ledgerscope.sources.scans import load_raw_transactions

    header = "TransactionID,CustomerID,CustomerDOB,CustGender,CustLocation,CustAccountBalance,TransactionDate,TransactionTime,TransactionAmount (INR)"
    lines = [header, 'T1,C1,1/1/90,F,"A, B",1.5,2/8/16,143207.0,9', 'T2,C2,1/1/90,M,"two\nlines",2,2/8/16,143207.5,8', "T3,C3,1/1/90,M,X,,2/8/16,93015,7"]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    got = sorted((r["TransactionID"], r["CustLocation"], r["TransactionTime"]) for r in load_raw_transactions(spark, str(tmp_path / "raw.csv")).collect())
    assert got == [("T1", "A, B", 143207), ("T2", "two\nlines", None), ("T3", "X", 93015)]
