"""Display queries over segmentation outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerscope.functions.bands import segment_description, segment_name
from ledgerscope.functions.numbers import neg_log10
from ledgerscope.operators.sampling import sample_rows
from ledgerscope.segmentation.candidates import KMEANS_NAME


def add_segment_labels(df: DataFrame) -> DataFrame:
    return df.withColumns({"segment_name": segment_name(F.col("cluster")),
                           "segment_description": segment_description(F.col("cluster"))})


def profile_long(profile: DataFrame, measures: list[str]) -> DataFrame:
    """Chosen measures by segment in long form."""
    typed = add_segment_labels(profile).select("cluster", "segment_name", *[F.col(m).cast("double").alias(m) for m in measures])
    return typed.unpivot(["cluster", "segment_name"], measures, "feature", "value")


def segment_display_profile(profile: DataFrame) -> DataFrame:
    wanted = ["cluster", "segment_name", "segment_description", "customer_count", "customer_share_pct",
              "transaction_count", "active_days", "average_assignment_confidence"]
    full = add_segment_labels(profile).withColumn("customer_share_pct", F.col("customer_share") * 100)
    return full.select([c for c in wanted if c in full.columns])


def kmeans_selection_curve(comparison: DataFrame, selected_k: int, algorithm: str = KMEANS_NAME) -> DataFrame:
    good = comparison.where((F.col("algorithm") == algorithm) & (F.col("status") == "success"))
    return good.select("cluster_count", "squared_silhouette_score",
                       (F.col("cluster_count") == selected_k).alias("selected")).orderBy("cluster_count")


def comparison_filter(comparison: DataFrame, algorithms: list[str]) -> DataFrame:
    good = comparison.where((F.col("status") == "success") & F.col("squared_silhouette_score").isNotNull())
    return good.where(F.col("algorithm").isin(algorithms)).orderBy(F.desc("squared_silhouette_score"), "algorithm", "parameters")


def significance_view(tests: DataFrame, n: int = 20) -> DataFrame:
    scored = tests.withColumn("negative_log10_p", neg_log10(F.col("p_value")))
    return scored.orderBy(F.desc_nulls_last("negative_log10_p"), "feature").limit(n)


def top_effects(effects: DataFrame, n: int = 12) -> DataFrame:
    return effects.where(F.col("standardized_range") > 0).orderBy(F.desc("standardized_range"), "feature").limit(n)


def top_importance(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def pca_display_sample(projection: DataFrame, n: int = 15_000, seed: int = 42) -> DataFrame:
    return add_segment_labels(sample_rows(projection, "customer_id", n, seed))
