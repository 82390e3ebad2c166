"""Clustering candidates and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerscope.functions.text import trailing_number
from ledgerscope.schemas import require_columns
from ledgerscope.segmentation.coreset import CORESET_ROWS, best_restarts, draw_coreset
from ledgerscope.segmentation.gmm import fit_mixtures, with_components
from ledgerscope.segmentation.metrics import evaluate, evaluate_many
from ledgerscope.segmentation.prepare import ID, assemble
from ledgerscope.segmentation.ward import MICRO_CLUSTERS, ward_labels, with_nearest
from ledgerscope.session import new_folder, write_and_read

CANDIDATE_SCHEMA = (
    "algorithm string, parameters string, sample_size bigint, cluster_count bigint, noise_share double, "
    "squared_silhouette_score double, davies_bouldin_score double, calinski_harabasz_score double, status string, error string")
KMEANS_NAME, WARD_NAME = "KMeans", "WardLinkage"
METRICS = ["squared_silhouette_score", "davies_bouldin_score", "calinski_harabasz_score"]


def _record(algorithm: str, parameters: str, found: dict, sample_size: int) -> dict:
    return {
        "algorithm": algorithm, "parameters": parameters, "sample_size": sample_size,
        "cluster_count": found["cluster_count"], "noise_share": (sample_size - found["rows"]) / sample_size,
        **{m: found[m] for m in METRICS}, "status": "success", "error": None}


def candidate_result(algorithm: str, parameters: str, labelled: DataFrame, columns: list[str],
                     label: str = "label") -> dict:
    """Counts and metrics of one labelling, in which -1 marks noise."""
    return _record(algorithm, parameters, evaluate(labelled, columns, label), labelled.count())


def candidate_results(algorithm: str, labelled: DataFrame, columns: list[str],
                      parameters: dict[str, str]) -> list[dict]:
    """Records of several noise-free labellings (label column -> parameters), evaluated together."""
    found = evaluate_many(labelled, columns, list(parameters))
    return [_record(algorithm, text, found[name], found[name]["rows"]) for name, text in parameters.items()]


def failed_result(algorithm: str, parameters: str, sample_size: int, error: Exception) -> dict:
    return {"algorithm": algorithm, "parameters": parameters, "sample_size": sample_size, "cluster_count": 0,
            "noise_share": 0.0, **dict.fromkeys(METRICS), "status": "failed", "error": str(error)}


def candidates_frame(spark: SparkSession, results: list[dict]) -> DataFrame:
    return spark.createDataFrame(results, CANDIDATE_SCHEMA)


def with_vectors(scaled: DataFrame) -> DataFrame:
    """All rows with their vector, written once and scanned by every fit."""
    features = [c for c in scaled.columns if c != ID]
    return write_and_read(assemble(scaled, features), new_folder(scaled.sparkSession, "vectors"))


def kmeans_candidates(scaled: DataFrame, cluster_range=range(2, 9), seed: int = 42, n_init: int = 10, max_iter: int = 300,
                      coreset_rows: int = CORESET_ROWS, coreset: DataFrame | None = None) -> list[dict]:
    """Fitted on a weighted coreset of all customers (``coreset``, where it was drawn before); every customer is labelled and scored."""
    features = [c for c in scaled.columns if c != ID]
    fits = best_restarts(draw_coreset(scaled, coreset_rows, seed) if coreset is None else coreset, list(cluster_range), n_init, max_iter, seed)
    labelled = with_nearest(scaled, {f"label_{k}": centers for k, (centers, _) in fits.items()})
    labelled = write_and_read(labelled, new_folder(scaled.sparkSession, "kmeans"))
    return candidate_results(KMEANS_NAME, labelled, features, {f"label_{k}": f"n_clusters={k}" for k in fits})


def mixture_candidates(scaled: DataFrame, component_range=range(2, 7), seed: int = 42, n_init: int = 2,
                       max_iter: int = 200, coreset: DataFrame | None = None) -> list[dict]:
    """Diagonal Gaussian mixtures over all rows; a failure is recorded for its component count."""
    features = [c for c in scaled.columns if c != ID]
    rows = scaled.select(ID, *features)
    fitted = fit_mixtures(rows, features, list(component_range), n_init, max_iter, seed, coreset)
    text = {k: f"n_components={k};covariance_type=diag" for k in component_range}
    good = {k: m for k, m in fitted.items() if not isinstance(m, Exception)}
    labelled = write_and_read(with_components(rows, {f"label_{k}": m for k, m in good.items()}), new_folder(scaled.sparkSession, "mixtures"))
    done = candidate_results("GaussianMixture", labelled, features, {f"label_{k}": text[k] for k in good}) if good else []
    return done + [failed_result("GaussianMixture", text[k], rows.count(), e)
                   for k, e in fitted.items() if isinstance(e, Exception)]


def hierarchical_candidates(scaled: DataFrame, cluster_range=range(2, 7), seed: int = 42, micro_clusters: int = MICRO_CLUSTERS) -> list[dict]:
    """Ward linkage over micro-clusters of all customers."""
    features = [c for c in scaled.columns if c != ID]
    labelled = ward_labels(scaled, list(cluster_range), micro_clusters, seed)
    return candidate_results(WARD_NAME, labelled, features, {f"label_{k}": f"n_clusters={k};linkage=ward" for k in cluster_range})


def rank_candidates(results: DataFrame, algorithm: str = KMEANS_NAME) -> DataFrame:
    """Competition rank of each successful candidate on each metric, and their mean.

    A handful of rows, so the ordering windows stay tiny.
    """
    require_columns(results.columns, ["algorithm", "parameters", "status", *METRICS], "Candidate table")
    usable = results.where((F.col("algorithm") == algorithm) & (F.col("status") == "success")).dropna(subset=METRICS)
    best_first = {"squared_silhouette": F.desc, "davies_bouldin": F.asc, "calinski_harabasz": F.desc}
    ranks = {f"{m}_rank": F.rank().over(Window.orderBy(way(f"{m}_score"))).cast("bigint") for m, way in best_first.items()}
    ranked = usable.withColumns(ranks)
    return ranked.withColumn("combined_rank", sum((F.col(c) for c in ranks), F.lit(0)) / 3)


def choose_cluster_count(results: DataFrame, algorithm: str = KMEANS_NAME) -> int:
    """Lowest mean rank; ties go to the higher silhouette."""
    best = rank_candidates(results, algorithm).orderBy("combined_rank", F.desc("squared_silhouette_score"), "parameters").select(
        trailing_number(F.col("parameters")).alias("k")).first()
    if best is None:
        raise ValueError(f"No successful {algorithm} candidates are available")
    return best["k"]
