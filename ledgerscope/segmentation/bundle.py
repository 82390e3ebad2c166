"""Everything needed to repeat the customer assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.segmentation.final import Centroids, cluster_assignments, projected
from ledgerscope.segmentation.prepare import PARAMS_SCHEMA, ScalingParams, scale
from ledgerscope.sources.sinks import read_json_record, write_json_record


def save_segmentation_bundle(spark: SparkSession, path: str, params: ScalingParams, centroids: Centroids,
                             projection: tuple[list[float], list[list[float]]], metadata: dict) -> None:
    """Scaling parameters, centroids, and the projection's centre and loadings as parquet; metadata as JSON."""
    spark.createDataFrame(params.rows(), PARAMS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaling")
    centers = [(i, list(map(float, c))) for i, c in enumerate(centroids)]
    spark.createDataFrame(centers, "cluster int, center array<double>").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/centroids")
    means, loadings = projection
    lines = [(0, list(map(float, means)))] + [(i, list(map(float, w))) for i, w in enumerate(loadings, start=1)]
    spark.createDataFrame(lines, "line int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/projection")
    write_json_record(spark, {**metadata, "features": params.features}, f"{path}/metadata")


def load_segmentation_bundle(spark: SparkSession, path: str) -> tuple[ScalingParams, Centroids, tuple, dict]:
    metadata = read_json_record(spark, f"{path}/metadata")
    by_feature = {r["feature"]: r for r in spark.read.parquet(f"{path}/scaling").collect()}
    rows = [by_feature[f] for f in metadata["features"]]
    pick = lambda name: {r["feature"]: r[name] for r in rows}
    params = ScalingParams({r["feature"]: (r["lower"], r["upper"]) for r in rows}, pick("median"), pick("center"),
                           pick("scale"))
    centers = spark.read.parquet(f"{path}/centroids").orderBy(F.col("cluster")).collect()
    lines = [list(r["v"]) for r in spark.read.parquet(f"{path}/projection").orderBy("line").collect()]
    return params, [list(r["center"]) for r in centers], (lines[0], lines[1:]), metadata


def assign_with_bundle(features: DataFrame, path: str) -> DataFrame:
    params, centroids, _, _ = load_segmentation_bundle(features.sparkSession, path)
    return cluster_assignments(scale(features, params), centroids)


def project_with_bundle(features: DataFrame, path: str) -> DataFrame:
    """Stored projection of any customers: scaled, centred, and multiplied by the stored loadings."""
    params, _, (means, loadings), _ = load_segmentation_bundle(features.sparkSession, path)
    return projected(scale(features, params), means, loadings)
