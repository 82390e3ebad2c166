"""Warehouse, views, reports and portfolio queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerscope.plans import catalogue, portfolio, quality, views, warehouse as wh_ops
from ledgerscope.plans.reports import REPORTS, value_matrix
from ledgerscope.registry.common import on_warehouse, on_workspace, rounded
from ledgerscope.session import cut_lineage, new_folder
from ledgerscope.sources import scans, sinks
from ledgerscope.workspace import Workspace


def _written_catalogue(ws: Workspace) -> tuple[str, list[dict]]:
    """Run the catalogue once per workspace and keep its records."""
    folder = f"{ws.root}/reports"
    return folder, ws.once("catalogue", lambda: catalogue.run_catalogue(ws.warehouse, folder))


def _run_records(ws: Workspace) -> DataFrame:
    _, records = _written_catalogue(ws)
    return catalogue.records_frame(ws.spark, records)


def report_catalogue_runner(ws: Workspace) -> DataFrame:
    return _run_records(ws).select("name", "status", "row_count", "column_count")


def run_manifest(ws: Workspace) -> DataFrame:
    folder, _ = _written_catalogue(ws)
    record = ws.spark.read.json(f"{folder}/query_manifest", multiLine=True)
    each = record.select("query_count", "successful_queries", "failed_queries", F.explode("queries").alias("q"))
    return each.groupBy("query_count", "successful_queries", "failed_queries").agg(
        F.sum("q.row_count").alias("exported_rows"), F.sum("q.column_count").alias("exported_columns"),
        F.max(F.struct("q.row_count", "q.name")).alias("m")).select(
        "query_count", "successful_queries", "failed_queries", "exported_rows", "exported_columns", F.col("m.name").alias("largest_report"))


def query_catalog(ws: Workspace) -> DataFrame:
    folder, _ = _written_catalogue(ws)
    table = ws.spark.read.csv(f"{folder}/query_catalog", header=True, schema=catalogue.RECORD_SCHEMA)
    return table.select("name", "row_count", "column_count", "status")


def exported_report(ws: Workspace) -> DataFrame:
    """A report read back from its export."""
    folder, _ = _written_catalogue(ws)
    return ws.spark.read.csv(f"{folder}/03_customer_transaction_frequency", header=True,
                             schema="transaction_count bigint, customer_count bigint, customer_pct double")


def preparation_summary(ws: Workspace) -> DataFrame:
    # The report is a few rows; they are counted once and read several times.
    report = cut_lineage(quality.build_quality_report(ws.raw, ws.clean))
    return quality.preparation_summary(ws.raw, ws.clean, ws.features, report)


def write_json_record(ws: Workspace) -> DataFrame:
    path = new_folder(ws.spark, "record")
    record = preparation_summary(ws).first().asDict()
    sinks.write_json_record(ws.spark, record, path)
    return ws.spark.read.json(path, multiLine=True).select(list(record))


def write_warehouse(ws: Workspace) -> DataFrame:
    """Write a warehouse partitioned by month, read it back, and count its rows."""
    folder = new_folder(ws.spark, "warehouse")
    name = "wp_" + folder.rsplit("-", 1)[-1]
    fresh = wh_ops.write_warehouse(ws.clean, ws.features, folder, name, overwrite=False,
                                   partition_fact_by="transaction_month")
    return wh_ops.table_counts(fresh)


def integrity_gate(ws: Workspace) -> DataFrame:
    """Raises on any violation, else reports every check."""
    return wh_ops.assert_integrity(ws.warehouse)


def parameterised_query(ws: Workspace) -> DataFrame:
    return rounded(views.parameterised_query(ws.warehouse, """
        SELECT daypart, count(*) AS transaction_count, max(transaction_amount_inr) AS largest_amount
        FROM vw_transaction_enriched
        WHERE transaction_amount_inr >= :low AND transaction_month >= :month
        GROUP BY daypart""", args={"low": 250.0, "month": "1997-01"}))


def load_customer_features(ws: Workspace) -> DataFrame:
    ws.features
    return rounded(scans.load_customer_features(ws.spark, f"{ws.root}/features"))


QUERIES = {
    # sources and sinks
    "load_customer_features": on_workspace(load_customer_features),
    "write_json_record": on_workspace(write_json_record),
    "write_warehouse": on_workspace(write_warehouse),
    "report_catalogue_runner": on_workspace(report_catalogue_runner),
    "run_manifest": on_workspace(run_manifest),
    "query_catalog": on_workspace(query_catalog),
    "exported_report": on_workspace(exported_report),
    "parameterised_query": on_workspace(parameterised_query),
    "preparation_summary": on_workspace(preparation_summary),
    "warehouse_build_summary": on_warehouse(wh_ops.warehouse_build_summary),
    # warehouse
    "dim_location": on_warehouse(lambda wh: wh.dim_location),
    "dim_customer": on_warehouse(lambda wh: rounded(wh.dim_customer)),
    "customer_feature_mart": on_warehouse(lambda wh: rounded(wh.customer_feature_mart)),
    "fact_transaction": on_warehouse(lambda wh: rounded(wh.fact_transaction)),
    "table_counts": on_warehouse(wh_ops.table_counts),
    "orphan_transactions": on_warehouse(wh_ops.orphan_transactions),
    "foreign_key_violations": on_warehouse(wh_ops.foreign_key_violations),
    "key_violations": on_warehouse(wh_ops.key_violations),
    "domain_violations": on_warehouse(wh_ops.domain_violations),
    "integrity_gate": on_workspace(integrity_gate),
    **{name: on_warehouse(lambda wh, build=build: rounded(build(wh))) for name, build in views.VIEWS.items()},
    # reports
    **{f"report_{r.name}": on_warehouse(r.build) for r in REPORTS},
    "report_31_with_median_reference": on_warehouse(lambda wh: value_matrix(wh, reference="median")),
    # portfolio
    "home_kpis": on_warehouse(lambda wh: _kpis(portfolio.home_kpis(wh))),
    "portfolio_kpis": on_warehouse(lambda wh: _kpis(portfolio.portfolio_kpis(wh))),
    "monthly_series": on_warehouse(portfolio.monthly_series),
    "hourly_volume": on_warehouse(lambda wh: rounded(portfolio.hourly_volume(wh))),
    "location_filter": on_warehouse(portfolio.location_filter),
    "coverage_long": on_warehouse(lambda wh: rounded(portfolio.coverage_long(wh))),
}


def _kpis(df: DataFrame) -> DataFrame:
    """Totals carry fewer exact decimals than averages."""
    from ledgerscope.functions.numbers import round_half_up

    return rounded(df).withColumn("total_value", round_half_up(F.col("total_value"), 4))
