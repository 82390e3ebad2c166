"""Run the report catalogue, export each report, and record how it went."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ledgerscope.functions.text import contains_pattern, display_name
from ledgerscope.plans.reports import REPORTS, Report
from ledgerscope.plans.warehouse import Warehouse
from ledgerscope.sources.sinks import export_csv, write_json_record

RECORD_SCHEMA = ("name string, description string, output_file string, row_count bigint, column_count bigint, "
                 "duration_seconds double, status string, error string")


def _run_one(report: Report, wh: Warehouse, out_dir: str) -> dict:
    started = time.perf_counter()
    record = {"name": report.name, "description": report.description, "output_file": f"{out_dir}/{report.name}",
              "row_count": 0, "column_count": 0, "status": "success", "error": None}
    try:
        seen = Observation(report.name)
        result = report.build(wh)
        # Rows are counted while they are written.
        export_csv(result.observe(seen, F.count(F.lit(1)).alias("rows")), record["output_file"])
        record.update(row_count=seen.get["rows"], column_count=len(result.columns))
    except Exception as exc:  # recorded, and raised by the caller when asked
        record.update(status="failed", error=str(exc))
        record["exception"] = exc
    record["duration_seconds"] = round(time.perf_counter() - started, 4)
    return record


def manifest(records: list[dict]) -> dict:
    """Counts, total time and the run records."""
    return {
        "query_count": len(records),
        "successful_queries": sum(r["status"] == "success" for r in records),
        "failed_queries": sum(r["status"] == "failed" for r in records),
        "total_duration_seconds": round(sum(r["duration_seconds"] for r in records), 4),
        "queries": records,
    }


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """One row per catalogue entry."""
    return spark.createDataFrame(records, RECORD_SCHEMA)


def run_catalogue(wh: Warehouse, out_dir: str, reports: list[Report] | None = None,
                  continue_on_error: bool = False) -> list[dict]:
    """Export every report below ``out_dir``, with ``query_manifest`` and ``query_catalog``.

    A failure is recorded; unless ``continue_on_error``, the manifest so far is
    written and the error raised.
    """
    reports = REPORTS if reports is None else reports
    names = [r.name for r in reports]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"Report names are repeated: {repeated}")
    records = []
    for report in reports:
        record = _run_one(report, wh, out_dir)
        error = record.pop("exception", None)
        records.append(record)
        if error is not None and not continue_on_error:
            write_json_record(wh.spark, manifest(records), f"{out_dir}/query_manifest")
            raise error
    write_json_record(wh.spark, manifest(records), f"{out_dir}/query_manifest")
    export_csv(records_frame(wh.spark, records), f"{out_dir}/query_catalog", sort_by=["name"])
    return records


def report_listing(records: DataFrame) -> DataFrame:
    """Display names of the exported reports."""
    return records.where(F.col("status") == "success").select(
        display_name(F.col("name")).alias("report_name"), F.col("name"))


def report_search(records: DataFrame, term: str) -> DataFrame:
    """Reports whose display name matches a term, ignoring case."""
    listed = report_listing(records)
    term = term.strip()
    if term:
        listed = listed.where(contains_pattern(F.col("report_name"), term))
    return listed.orderBy("name")
