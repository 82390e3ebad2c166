from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerscope.plans import catalogue, portfolio, quality, views, warehouse as w
from ledgerscope.plans.clean import clean_transactions
from ledgerscope.plans.features import build_customer_features
from ledgerscope.plans.reports import REPORTS, Report
from ledgerscope.schemas import RAW_COLUMNS
from ledgerscope.session import new_folder, write_and_read
from ledgerscope.sources import scans, sinks


@pytest.fixture
def built(spark, raw):
    folder = new_folder(spark, "wh-test")
    clean = write_and_read(clean_transactions(raw), f"{folder}/clean")
    features = write_and_read(build_customer_features(clean), f"{folder}/features")
    name = "t_" + folder.rsplit("-", 1)[-1]
    return clean, features, w.build_warehouse(clean, features, f"{folder}/wh", name), folder, name


def test_build_views_and_counts(built):
    clean, features, wh, folder, name = built
    counts = {r[0]: r[1] for r in w.table_counts(wh).collect()}
    assert counts == {"dim_location": 2, "dim_customer": 3, "fact_transaction": 4, "customer_feature_mart": 3}
    assert [tuple(r) for r in wh.dim_location.orderBy("location_id").collect()] == [(1, "JHAJJAR"), (2, "MUMBAI")]
    assert views.monthly_kpis(wh).first()["total_transaction_amount_inr"] == 375.0
    assert views.customer_360(wh).count() == 3
    assert w.integrity_report(wh).where("violations > 0").isEmpty()
    assert views.parameterised_query(wh, "SELECT * FROM dim_customer WHERE customer_id = ?", ["C1"]).count() == 1
    with pytest.raises(Exception):
        w.write_warehouse(clean, features, f"{folder}/wh", name, overwrite=False)


def test_gate_raises_on_repeated_and_foreign_keys(built):
    clean, features, wh, folder, name = built
    broken = w.Warehouse(wh.dim_location, wh.dim_customer.where("customer_id <> 'C1'"),
                         wh.fact_transaction.union(wh.fact_transaction), wh.customer_feature_mart)
    found = {r[0]: r[1] for r in w.integrity_report(broken).collect()}
    assert found["orphan_transactions"] == 4 and found["fact_transaction.transaction_id key"] == 4
    assert found["customer_feature_mart.customer_id"] == 1
    with pytest.raises(RuntimeError, match="orphan"):
        w.assert_integrity(broken)


def test_domain_rules(built):
    _, _, wh, _, _ = built
    bad = wh.fact_transaction.withColumn("transaction_hour", F.lit(24))
    found = {r[0]: r[1] for r in w.domain_violations(
        w.Warehouse(wh.dim_location, wh.dim_customer, bad, wh.customer_feature_mart)).collect()}
    assert found["fact_transaction.transaction_hour domain"] == 4 and found["fact_transaction.gender domain"] == 0


def test_location_lookup_trims_leftover_blanks(spark):
    dim = spark.createDataFrame([(1, "MUMBAI")], "location_id int, location_name string")
    rows = spark.createDataFrame([("MUMBAI ",), (" ",), (None,)], "place string")
    ids = lambda trim: [r["id"] for r in w.attach_location_id(rows, "place", "id", dim, trim).orderBy("place").collect()]
    assert ids(True) == [None, None, 1] and ids(False) == [None, None, None]


def test_empty_locations_stay_in_performance(built):
    _, _, wh, _, _ = built
    extra = wh.dim_location.union(wh.spark.createDataFrame([(3, "NOWHERE")], "a int, b string"))
    rows = {r["location_name"]: r for r in views.location_performance(
        w.Warehouse(extra, wh.dim_customer, wh.fact_transaction, wh.customer_feature_mart)).collect()}
    assert rows["NOWHERE"]["transaction_count"] == 0 and rows["NOWHERE"]["total_transaction_amount_inr"] is None
    assert rows["MUMBAI"]["unique_customers"] == 1


def test_catalogue_records_success_and_failure(built):
    _, _, wh, folder, _ = built
    def fails(_):
        raise ValueError("no such table")

    chosen = [REPORTS[0], Report("broken", "Always fails.", fails), REPORTS[2]]
    records = catalogue.run_catalogue(wh, f"{folder}/out", chosen, continue_on_error=True)
    assert [r["status"] for r in records] == ["success", "failed", "success"]
    saved = sinks.read_json_record(wh.spark, f"{folder}/out/query_manifest")
    assert (saved["query_count"], saved["successful_queries"], saved["failed_queries"]) == (3, 2, 1)
    assert saved["queries"][0]["row_count"] == 1 and saved["queries"][0]["column_count"] == 8
    with pytest.raises(ValueError, match="no such table"):
        catalogue.run_catalogue(wh, f"{folder}/out2", chosen)
    with pytest.raises(ValueError, match="repeated"):
        catalogue.run_catalogue(wh, f"{folder}/out3", [REPORTS[0], REPORTS[0]])
    found = catalogue.report_search(catalogue.records_frame(wh.spark, records), "PORTFOLIO").collect()
    assert [r["report_name"] for r in found] == ["01 Portfolio Overview"]


def test_every_report_runs(built):
    _, _, wh, _, _ = built
    assert len(REPORTS) == 32
    for report in REPORTS:
        assert report.build(wh).columns, report.name


def test_quality_report(raw):
    clean = clean_transactions(raw)
    rows = {r["check"]: r for r in quality.build_quality_report(raw, clean).collect()}
    assert len(rows) == 20 and rows["raw_row_count"]["status"] == "PASS" and rows["clean_row_count"]["value"] == 4
    assert rows["invalid_transaction_times"]["value"] == 1 and rows["missing_or_invalid_gender"]["value"] == 1
    assert rows["missing_or_invalid_dob"]["status"] == "WARN" and rows["raw_missing__CustLocation"]["value"] == 1
    with pytest.raises(ValueError, match="TransactionID"):
        quality.validate_raw_schema(raw.drop("TransactionID"))
    doubled = raw.union(raw.limit(1))
    rows = {r["check"]: r for r in quality.build_quality_report(doubled, clean).collect()}
    assert rows["duplicate_transaction_ids"]["value"] == 1 and rows["clean_row_count"]["status"] == "WARN"


def test_csv_round_trip_and_missing_tokens(spark, raw):
    path = new_folder(spark, "csv-test")
    sinks.export_csv(raw.withColumn("Extra", F.lit(1)), path)
    back = scans.load_raw_transactions(spark, path)
    assert back.columns == RAW_COLUMNS and sorted(back.collect()) == sorted(raw.collect())
    assert scans.load_raw_transactions(spark, path, nrows=2).count() == 2
    tokens = new_folder(spark, "csv-test")
    sinks.export_csv(raw.withColumn("CustLocation", F.lit("NULL")).withColumn("CustomerDOB", F.lit("nan")), tokens)
    first = scans.load_raw_transactions(spark, tokens).first()
    assert first["CustLocation"] is None and first["CustomerDOB"] is None
    short = new_folder(spark, "csv-test")
    sinks.export_csv(raw.drop("CustGender"), short)
    with pytest.raises(ValueError, match="CustGender"):
        scans.load_raw_transactions(spark, short)
    with pytest.raises(Exception):
        scans.load_raw_transactions(spark, short + "-none")


def test_json_record_is_sorted(spark):
    path = new_folder(spark, "json-test")
    sinks.write_json_record(spark, {"b": 1, "a": {"z": None}}, path)
    text = spark.read.text(path, wholetext=True).first()[0]
    assert json.loads(text) == {"b": 1, "a": {"z": None}} and text.index('"a"') < text.index('"b"')


def test_portfolio_queries(built):
    _, _, wh, _, _ = built
    kpis = portfolio.portfolio_kpis(wh).first()
    assert kpis["transactions"] == 4 and kpis["transactions_per_customer"] == pytest.approx(4 / 3)
    assert portfolio.coverage_long(wh).count() == 7
    assert portfolio.location_filter(wh, min_customers=1).count() == 2
    assert portfolio.location_filter(wh, min_customers=2).count() == 0
