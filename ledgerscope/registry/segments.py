"""Segmentation and statistics queries.

What is exact for a given labelling runs on two fixed labellings, so that it can
be checked: customers assigned to the mean scaled profile of their gender group,
and the labelled ``embeddings`` table. Fitted models run on the customers.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, functions as F

from ledgerscope.registry.common import on_workspace, rounded
from ledgerscope.schemas import SEGMENTATION_FEATURES as FEATURES
from ledgerscope.segmentation import candidates as cand, display, final, job, metrics, prepare, silhouette
from ledgerscope.segmentation.bundle import assign_with_bundle, project_with_bundle
from ledgerscope.segmentation.coreset import draw_coreset
from ledgerscope.operators.sampling import sample_rows
from ledgerscope.session import new_folder, side_by_side, write_and_read
from ledgerscope.stats import rank_tests
from ledgerscope.workspace import Workspace

DIMENSIONS = 64
POSITIONS = [f"e{i}" for i in range(DIMENSIONS)]


# --- customers under a fixed labelling ---------------------------------------

def _params(ws: Workspace) -> prepare.ScalingParams:
    return ws.once("scaling", lambda: prepare.fit_scaling(ws.features))


def _scaled(ws: Workspace) -> DataFrame:
    return ws.once("scaled", lambda: write_and_read(prepare.scale(ws.features, _params(ws)), f"{ws.root}/scaled"))


def _gender_centroids(ws: Workspace) -> list[list[float]]:
    """Mean scaled profile of the F, M and unknown customers."""
    def build() -> list[list[float]]:
        group = F.when(F.col("gender") == "F", 0).when(F.col("gender") == "M", 1).otherwise(2)
        labelled = _scaled(ws).join(ws.features.select("customer_id", group.alias("group")), "customer_id")
        rows = labelled.groupBy("group").agg(*[F.avg(f).alias(f) for f in FEATURES]).orderBy("group").collect()
        return [[r[f] for f in FEATURES] for r in rows]

    return ws.once("gender_centroids", build)


def _assigned(ws: Workspace) -> DataFrame:
    return ws.once("assigned", lambda: write_and_read(
        final.cluster_assignments(_scaled(ws), _gender_centroids(ws)), f"{ws.root}/assigned"))


def clipping_bounds(ws: Workspace) -> DataFrame:
    bounds = prepare.clipping_bounds(prepare.segmentation_features(ws.features), FEATURES)
    rows = [(f, float(lo), float(hi)) for f, (lo, hi) in bounds.items()]
    return rounded(ws.spark.createDataFrame(rows, "feature string, lower double, upper double"))


def _numeric(ws: Workspace) -> DataFrame:
    return prepare.segmentation_features(ws.features)


def winsorized(ws: Workspace) -> DataFrame:
    return rounded(prepare.winsorize(_numeric(ws), _params(ws).bounds))


def imputed(ws: Workspace) -> DataFrame:
    params = _params(ws)
    return rounded(prepare.impute(prepare.winsorize(_numeric(ws), params.bounds), params.medians))


def scaling_parameters(ws: Workspace) -> DataFrame:
    return rounded(ws.spark.createDataFrame(_params(ws).rows(), prepare.PARAMS_SCHEMA))


def finite_matrix(ws: Workspace) -> DataFrame:
    """Scaled rows after the finite check, with the length of the assembled vector."""
    checked = prepare.assert_finite(_scaled(ws), FEATURES)
    vectors = prepare.assemble(checked, FEATURES)
    from pyspark.ml.functions import vector_to_array

    return vectors.agg(F.count(F.lit(1)).alias("row_count"),
                       F.min(F.size(vector_to_array("vector"))).cast("bigint").alias("width"))


def _profile(ws: Workspace) -> DataFrame:
    return final.cluster_profile(ws.features, _assigned(ws))


def _std_profile(ws: Workspace) -> DataFrame:
    return final.standardized_profile(_scaled(ws), _assigned(ws))


def _tests(ws: Workspace) -> DataFrame:
    merged = ws.features.join(_assigned(ws).select("customer_id", "cluster"), "customer_id")
    return rank_tests.kruskal_wallis(merged, FEATURES)


# --- embeddings under their own labels ---------------------------------------

def _embedded(ws: Workspace) -> DataFrame:
    table = ws.spark.read.parquet(f"{ws.sf_dir}/embeddings.parquet")
    vectors = [F.col("embedding")[i].cast("double").alias(e) for i, e in enumerate(POSITIONS)]
    return table.select(F.col("vec_id").cast("string").alias("vec_id"), "label", *vectors)


def cluster_metrics(ws: Workspace) -> DataFrame:
    return rounded(metrics.evaluate_frame(_embedded(ws), POSITIONS))


def _one_metric(name: str):
    return on_workspace(lambda ws: cluster_metrics(ws).select(name))


def noise_excluded(ws: Workspace) -> DataFrame:
    """Label 0 counts as noise."""
    marked = _embedded(ws).withColumn("label", F.when(F.col("label") == 0, metrics.NOISE).otherwise(F.col("label")))
    record = cand.candidate_result("FixedLabels", "noise=0", marked, POSITIONS)
    return rounded(cand.candidates_frame(ws.spark, [record]).drop("error"))


def single_cluster_guard(ws: Workspace) -> DataFrame:
    """With one cluster, or as many as rows, the metrics are missing; with two they are not."""
    labels = {"one": F.lit(0), "every_row": F.col("vec_id").cast("int"), "two": F.col("label") % 2}
    found = metrics.evaluate_many(_embedded(ws).select("vec_id", *POSITIONS, *[c.alias(n) for n, c in labels.items()]), POSITIONS, list(labels))
    rows = [(n, r["rows"], r["cluster_count"], *[r[m] for m in cand.METRICS]) for n, r in found.items()]
    return rounded(ws.spark.createDataFrame(rows, "labelling string, row_count bigint, cluster_count bigint, " + ", ".join(f"{m} double" for m in cand.METRICS)))


def euclidean(ws: Workspace) -> DataFrame:
    """Every row against the reference sets, which are whole clusters here unless the table is large."""
    found = silhouette.euclidean_silhouette(_embedded(ws), "vec_id", POSITIONS, "label")
    return rounded(ws.spark.createDataFrame([(found["rows"], found["silhouette_score"])], "row_count bigint, silhouette_score double"))


def silhouette_with_references(ws: Workspace) -> DataFrame:
    """Rows scored against about twenty references per cluster, and whether the score of the full sets lies within the bound."""
    near, exact = [silhouette.euclidean_silhouette(_embedded(ws), "vec_id", POSITIONS, "label", reference_rows=n) for n in (20, silhouette.REFERENCE_ROWS)]
    inside = abs(near["silhouette_score"] - exact["silhouette_score"]) <= near["error_bound"]
    return ws.spark.createDataFrame([(near["rows"], near["reference_rows"] < near["rows"], inside)], "row_count bigint, sampled boolean, within_bound boolean")


def _fixed_candidates(ws: Workspace) -> DataFrame:
    """Candidates that merge the ten labels into 2 to 5 groups."""
    def build() -> list[dict]:
        counts = range(2, 6)
        rows = _embedded(ws).select("*", *[(F.col("label") % k).alias(f"label_{k}") for k in counts])
        return cand.candidate_results("FixedLabels", rows, POSITIONS, {f"label_{k}": f"n_clusters={k}" for k in counts})

    return cand.candidates_frame(ws.spark, ws.once("fixed_candidates", build))


def choose_cluster_count(ws: Workspace) -> DataFrame:
    k = cand.choose_cluster_count(_fixed_candidates(ws), "FixedLabels")
    return ws.spark.createDataFrame([(k,)], "selected_cluster_count bigint")


def competition_rank(ws: Workspace) -> DataFrame:
    ranked = cand.rank_candidates(_fixed_candidates(ws), "FixedLabels")
    return rounded(ranked.select("parameters", "squared_silhouette_rank", "davies_bouldin_rank", "calinski_harabasz_rank",
                                 "combined_rank"))


def kmeans_selection_curve(ws: Workspace) -> DataFrame:
    table = _fixed_candidates(ws)
    return rounded(display.kmeans_selection_curve(table, cand.choose_cluster_count(table, "FixedLabels"), "FixedLabels"))


def classification_report(ws: Workspace) -> DataFrame:
    """Nearest class mean against the true label."""
    rows = _embedded(ws)
    means = rows.groupBy("label").agg(*[F.avg(e).alias(e) for e in POSITIONS]).orderBy("label").collect()
    said = final.nearest(rows, POSITIONS, [[m[e] for e in POSITIONS] for m in means])
    return rounded(rank_tests.classification_report(said.select("label", F.col("cluster").alias("prediction"))))


# --- fitted models -----------------------------------------------------------

COMPARED = {"KMeans": lambda ws: cand.kmeans_candidates(_scaled(ws), coreset=_coreset(ws)),
            "GaussianMixture": lambda ws: cand.mixture_candidates(_scaled(ws), coreset=_coreset(ws)),
            cand.WARD_NAME: lambda ws: cand.hierarchical_candidates(_scaled(ws))}


def _coreset(ws: Workspace) -> DataFrame:
    """With the library's defaults, for k-means candidates, mixtures and the final fit."""
    return ws.once("coreset", lambda: draw_coreset(_scaled(ws)))


def _records(ws: Workspace, algorithm: str) -> list[dict]:
    """Candidates of one algorithm with the library's defaults, once per workspace."""
    return ws.once(f"candidates-{algorithm}", lambda: COMPARED[algorithm](ws))


def _run(ws: Workspace) -> job.SegmentationResult:
    """The run with the library's defaults, once per workspace."""
    def build() -> job.SegmentationResult:
        coreset = _coreset(ws)  # stored, with the scaled customers, before the algorithms start together
        compared = [r for found in side_by_side(ws.spark, [partial(_records, ws, a) for a in COMPARED]) for r in found]
        return job.run_segmentation(ws.features, new_folder(ws.spark, "segmentation"), compared=compared,
                                    params=_params(ws), coreset=coreset)

    return ws.once("segmentation", build)


def _facts(ws: Workspace, algorithm: str) -> DataFrame:
    """What holds for the candidates of any correct fit."""
    table = cand.candidates_frame(ws.spark, _records(ws, algorithm))
    present = [F.col(m).isNotNull() & ~F.isnan(m) for m in cand.METRICS]
    return table.select("algorithm", "parameters", "sample_size", "status", (present[0] & present[1] & present[2]).alias("has_metrics"))


def final_kmeans(ws: Workspace) -> DataFrame:
    """Customers, and how many centroids are off the mean of their own customers."""
    run = _run(ws)
    scaled, centroids = run.extra["scaled"], run.extra["centroids"]
    merged = scaled.join(run.tables["customer_segment_assignments"].select("customer_id", "cluster"), "customer_id")
    center = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])[F.col("cluster")]
    means = merged.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in FEATURES])
    gaps = [F.abs(F.col(f) - center[i]) for i, f in enumerate(FEATURES)]
    return means.agg(F.sum("n").alias("customers"), F.count_if(F.greatest(*gaps) > 1e-2).alias("centroids_off"),
                     (F.count(F.lit(1)) == len(centroids)).alias("every_cluster_is_used"))


def pca_projection(ws: Workspace) -> DataFrame:
    """Customers; the scores are centred, uncorrelated, and the first varies most."""
    found = _run(ws).tables["pca_customer_projection"].agg(
        F.count(F.lit(1)).alias("customers"), F.avg("pca_1").alias("m1"), F.avg("pca_2").alias("m2"),
        F.stddev("pca_1").alias("s1"), F.stddev("pca_2").alias("s2"), F.corr("pca_1", "pca_2").alias("r"))
    centred = (F.abs("m1") < F.col("s1") * 1e-6) & (F.abs("m2") < F.col("s1") * 1e-6)
    return found.select("customers", centred.alias("centred"), (F.abs("r") < 1e-6).alias("uncorrelated"),
                        (F.col("s1") >= F.col("s2")).alias("ordered"))


def saved_segmentation_bundle(ws: Workspace) -> DataFrame:
    """Assignments and projections repeated from the stored bundle against the stored ones."""
    run = _run(ws)
    again = assign_with_bundle(ws.features, run.bundle_path).join(project_with_bundle(ws.features, run.bundle_path), "customer_id")
    both = again.alias("a").join(run.tables["customer_segment_assignments"].alias("b"), "customer_id").join(
        run.tables["pca_customer_projection"].alias("c"), "customer_id")
    far = [F.abs(F.col(f"a.pca_{i}") - F.col(f"c.pca_{i}")) > 1e-9 for i in (1, 2)]
    return both.agg(F.count(F.lit(1)).alias("customers"),
                    F.count_if(F.col("a.cluster") != F.col("b.cluster")).alias("other_cluster"),
                    F.count_if(far[0] | far[1]).alias("other_place"))


def segmentation_outputs(ws: Workspace) -> DataFrame:
    """Rows of every written output table; per cluster for the tables that have a row for each."""
    run = _run(ws)
    k = run.summary["selected_cluster_count"]
    per = lambda n: k if n in ("cluster_profile", "cluster_standardized_profile", "cluster_distribution") else 1
    counts = [ws.spark.read.csv(f"{run.out_dir}/csv/{n}", header=True).agg(
        F.lit(n).alias("table_name"), (F.count(F.lit(1)) / per(n)).cast("bigint").alias("row_count")) for n in run.tables]
    return reduce(DataFrame.unionByName, counts)


def segmentation_run(ws: Workspace) -> DataFrame:
    found = job.selected_summary(_run(ws), ws.spark)
    return found.select("customer_count", "feature_count", F.col("selected_cluster_count").between(2, 8).alias("count_in_range"),
                        F.col("surrogate_accuracy").between(0.5, 1.0).alias("segments_are_relearned"))


def segmentation_summary(ws: Workspace) -> DataFrame:
    record = ws.spark.read.json(f"{_run(ws).out_dir}/segmentation_summary", multiLine=True)
    return rounded(record.select("customer_count", "feature_count", "selected_algorithm", "single_transaction_share"))


def surrogate_importance(ws: Workspace) -> DataFrame:
    """Features, their summed importance, the accuracy recomputed from the stored predictions, and customers fitted or scored."""
    fitted = _run(ws).extra["surrogate"]
    hits = fitted.predictions.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    return rounded(_run(ws).tables["cluster_feature_importance"].agg(
        F.count(F.lit(1)).alias("features"), F.sum("importance").alias("importance")).select(
        "*", F.lit(abs(hits - fitted.accuracy) < 1e-9).alias("accuracy_repeats"),
        F.lit(fitted.fitted_rows + fitted.scored_rows).cast("bigint").alias("customers")))


def top_importance(ws: Workspace) -> DataFrame:
    """The features are those of the model, largest importance first."""
    shown = display.top_importance(_run(ws).tables["cluster_feature_importance"])
    return shown.select("feature")


QUERIES = {
    "segmentation_features": on_workspace(lambda ws: rounded(_numeric(ws))),
    "clipping_bounds": on_workspace(clipping_bounds),
    "winsorize": on_workspace(winsorized),
    "median_impute": on_workspace(imputed),
    "scaling_parameters": on_workspace(scaling_parameters),
    "robust_scale": on_workspace(lambda ws: rounded(prepare.scale(ws.features, _params(ws)))),
    "assemble_and_check_finite": on_workspace(finite_matrix),
    "reproducible_sample": on_workspace(lambda ws: rounded(sample_rows(_scaled(ws), "customer_id", 5000))),
    "kmeans_candidates": on_workspace(lambda ws: _facts(ws, "KMeans")),
    "davies_bouldin": _one_metric("davies_bouldin_score"),
    "calinski_harabasz": _one_metric("calinski_harabasz_score"),
    "squared_silhouette": _one_metric("squared_silhouette_score"),
    "silhouette": on_workspace(euclidean),
    "silhouette_with_references": on_workspace(silhouette_with_references),
    "noise_excluded_candidate": on_workspace(noise_excluded),
    "single_cluster_guard": on_workspace(single_cluster_guard),
    "candidate_result": on_workspace(lambda ws: rounded(_fixed_candidates(ws).drop("error"))),
    "competition_rank": on_workspace(competition_rank),
    "choose_cluster_count": on_workspace(choose_cluster_count),
    "gmm_diag_candidates": on_workspace(lambda ws: _facts(ws, "GaussianMixture")),
    "hierarchical_candidates": on_workspace(lambda ws: _facts(ws, cand.WARD_NAME)),
    "final_kmeans": on_workspace(final_kmeans),
    "cluster_assignments": on_workspace(lambda ws: rounded(
        final.cluster_assignments(_scaled(ws), _gender_centroids(ws)))),
    "cluster_profile": on_workspace(lambda ws: rounded(_profile(ws))),
    "standardized_profile": on_workspace(lambda ws: rounded(_std_profile(ws))),
    "pca_projection": on_workspace(pca_projection),
    "saved_segmentation_bundle": on_workspace(saved_segmentation_bundle),
    "segmentation_run": on_workspace(segmentation_run),
    "segmentation_outputs": on_workspace(segmentation_outputs),
    "segmentation_summary": on_workspace(segmentation_summary),
    # statistics
    "cluster_distribution": on_workspace(lambda ws: rounded(rank_tests.cluster_distribution(_assigned(ws)))),
    "kruskal_wallis": on_workspace(lambda ws: rounded(_tests(ws))),
    "effect_range": on_workspace(lambda ws: rounded(rank_tests.effect_range(_std_profile(ws)))),
    "surrogate_importance": on_workspace(surrogate_importance),
    "classification_report": on_workspace(classification_report),
    # display
    "profile_long": on_workspace(lambda ws: rounded(display.profile_long(
        _std_profile(ws), ["transaction_count", "active_days", "log_total_transaction_amount", "log_average_account_balance"]))),
    "segment_display_profile": on_workspace(lambda ws: rounded(display.segment_display_profile(_profile(ws)))),
    "kmeans_selection_curve": on_workspace(kmeans_selection_curve),
    "comparison_filter": on_workspace(lambda ws: rounded(
        display.comparison_filter(_fixed_candidates(ws), ["FixedLabels"]).drop("error"))),
    "test_significance_view": on_workspace(lambda ws: rounded(display.significance_view(_tests(ws)))),
    "top_effects": on_workspace(lambda ws: rounded(display.top_effects(rank_tests.effect_range(_std_profile(ws))))),
    "top_importance": on_workspace(top_importance),
    "pca_display_sample": on_workspace(lambda ws: display.pca_display_sample(_run(ws).tables["pca_customer_projection"], 5000).select("customer_id")),
}
