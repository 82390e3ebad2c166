"""Checking SQL of the segmentation and statistics queries that are exact for a fixed labelling."""

from __future__ import annotations

from oracle.base import SEGMENTATION as SEG, STAGES, b, r6, rnd

each = lambda pattern, sep=", ": sep.join(pattern.format(f=f) for f in SEG)

STAGES["seg"] = "SELECT customer_id, " + each("CAST({f} AS DOUBLE) AS {f}") + " FROM features"
STAGES["bounds"] = "SELECT " + each("quantile_cont({f}, 0.005) AS {f}_lo, quantile_cont({f}, 0.995) AS {f}_hi") + " FROM seg"
STAGES["clipped"] = ("SELECT customer_id, " + each("CASE WHEN {f} IS NOT NULL THEN greatest(least({f}, {f}_hi), {f}_lo) END AS {f}")
                     + " FROM seg CROSS JOIN bounds")
STAGES["middles"] = "SELECT " + each("quantile_cont({f}, 0.5) AS {f}_m") + " FROM clipped"
STAGES["filled"] = "SELECT customer_id, " + each("coalesce({f}, {f}_m) AS {f}") + " FROM clipped CROSS JOIN middles"
STAGES["spreads"] = ("SELECT " + each("quantile_cont({f}, 0.5) AS {f}_c, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS {f}_w")
                     + " FROM filled")
STAGES["scaled"] = ("SELECT customer_id, " + each("({f} - {f}_c) / CASE WHEN {f}_w > 1e-12 THEN {f}_w ELSE 1e0 END AS {f}")
                    + " FROM filled CROSS JOIN spreads")
STAGES["gender_means"] = ("SELECT CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE 2 END AS cluster, " + each("avg(s.{f}) AS {f}")
                          + " FROM scaled s JOIN features USING (customer_id) GROUP BY 1")
STAGES["ranked"] = ("SELECT customer_id, g.cluster, sqrt(" + each("(s.{f}-g.{f})*(s.{f}-g.{f})", "+") + ") AS distance, "
                    "row_number() OVER (PARTITION BY customer_id ORDER BY distance, g.cluster) AS place "
                    "FROM scaled s CROSS JOIN gender_means g")
STAGES["assigned"] = """
SELECT customer_id, a.cluster, a.distance AS distance_to_centroid,
       greatest(least(CASE WHEN z.distance > 0 THEN 1e0 - a.distance / z.distance ELSE 1e0 END, 1e0), 0e0) AS assignment_confidence
FROM ranked a JOIN (SELECT customer_id, distance FROM ranked WHERE place = 2) z USING (customer_id) WHERE place = 1"""
STAGES["profile"] = ("SELECT cluster, count(*) AS customer_count, avg(assignment_confidence) AS average_assignment_confidence, "
                     + each("quantile_cont(CAST({f} AS DOUBLE), 0.5) AS {f}")
                     + ", count(*) / CAST((SELECT count(*) FROM assigned) AS DOUBLE) AS customer_share "
                     "FROM features JOIN assigned USING (customer_id) GROUP BY 1")
STAGES["std_profile"] = ("SELECT cluster, " + each("avg({f}) AS {f}") + " FROM scaled JOIN assigned USING (customer_id) GROUP BY 1")
STAGES["effects"] = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, min({f}) AS minimum_cluster_mean, max({f}) AS maximum_cluster_mean, "
    f"max({f}) - min({f}) AS standardized_range FROM std_profile" for f in SEG)
STAGES["long"] = " UNION ALL ".join(f"SELECT '{f}' AS feature, cluster, {rnd(f, 6)} AS v FROM seg JOIN assigned USING (customer_id) "
                                    f"WHERE {f} IS NOT NULL" for f in SEG)
STAGES["midranks"] = """
SELECT feature, cluster, v, rank() OVER (PARTITION BY feature ORDER BY v)
         + (count(*) OVER (PARTITION BY feature, v) - 1) / 2e0 AS r,
       CAST(count(*) OVER (PARTITION BY feature) AS DOUBLE) AS total FROM long"""
STAGES["ranksums"] = """
SELECT feature, cluster, any_value(total) AS total, count(*) AS n, sum(r) AS s FROM midranks GROUP BY ALL"""
STAGES["ties"] = """
SELECT feature, sum(CAST(t AS DOUBLE) * t * t - t) AS tied FROM (SELECT feature, v, count(*) AS t FROM long GROUP BY ALL) GROUP BY 1"""
STAGES["tests"] = """
SELECT feature, cluster_count, (12e0 / (total * (total + 1)) * squares - 3 * (total + 1))
         / nullif(1 - tied / (total * total * total - total), 0) AS statistic
FROM (SELECT feature, any_value(total) AS total, count(*) AS cluster_count, sum(s * s / n) AS squares FROM ranksums GROUP BY 1)
JOIN ties USING (feature)"""
# Three clusters leave two degrees of freedom, for which the tail is a plain exponential.
STAGES["scored"] = "SELECT feature, cluster_count, 'Kruskal-Wallis' AS test, statistic, exp(-statistic / 2) AS p_value FROM tests"
SCORED = (f"feature, cluster_count, test, {r6('statistic', 'p_value')}, coalesce(p_value < 0.05e0, FALSE) AS significant_at_0_05")

# Embeddings: every merge of the ten labels at once; k = 10 keeps them all, k = 1 joins them.
STAGES["embedded"] = """
SELECT vec_id, k, CAST(label % k AS INTEGER) AS label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x
FROM embeddings CROSS JOIN (VALUES (2), (3), (4), (5), (10)) t(k)
UNION ALL
SELECT vec_id, 0, CAST(label AS INTEGER), list_transform(embedding, lambda v: CAST(v AS DOUBLE)) FROM embeddings WHERE label <> 0"""
STAGES["label_means"] = """
SELECT k, label, list(c ORDER BY i) AS c, any_value(n) AS n FROM (
  SELECT k, label, i, avg(x[i]) AS c, count(*) AS n FROM embedded CROSS JOIN range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL"""
STAGES["centre"] = """
SELECT k, list(c ORDER BY i) AS c FROM (SELECT k, i, avg(x[i]) AS c FROM embedded CROSS JOIN range(1, 65) r(i) GROUP BY ALL) GROUP BY ALL"""
STAGES["gaps"] = """
SELECT k, label, any_value(n) AS n, any_value(c) AS c, avg(list_distance(x, c)) AS spread, sum(list_distance(x, c) ** 2) AS within
FROM embedded JOIN label_means USING (k, label) GROUP BY ALL"""
STAGES["db"] = """
SELECT k, avg(worst) AS davies_bouldin_score FROM (
  SELECT p.k, p.label, max((p.spread + q.spread) / list_distance(p.c, q.c)) AS worst
  FROM gaps p JOIN gaps q ON p.k = q.k AND p.label <> q.label GROUP BY ALL) GROUP BY 1"""
STAGES["ch"] = """
SELECT g.k, sum(n * list_distance(g.c, m.c) ** 2) * (sum(n) - count(*)) / (sum(within) * (count(*) - 1)) AS calinski_harabasz_score,
       count(*) AS cluster_count, CAST(sum(n) AS BIGINT) AS kept
FROM gaps g JOIN centre m ON m.k = g.k GROUP BY 1"""
STAGES["pairs"] = """
SELECT p.vec_id AS one, q.vec_id AS other, list_distance(p.x, q.x) ** 2 AS d
FROM embedded p JOIN embedded q ON p.k = 10 AND q.k = 10 AND p.vec_id <> q.vec_id"""
STAGES["reach"] = """
SELECT p.k, one, p.label AS own, q.label AS other_label, sum(d) AS d
FROM pairs JOIN embedded p ON p.vec_id = one JOIN embedded q ON q.vec_id = other AND q.k = p.k GROUP BY ALL"""
STAGES["sil"] = """
SELECT k, avg(CASE WHEN size = 1 THEN 0e0 ELSE (outside - inside) / greatest(inside, outside) END) AS squared_silhouette_score FROM (
  SELECT r.k, one, any_value(o.n) AS size, max(CASE WHEN own = other_label THEN d / (o.n - 1) END) AS inside,
         min(CASE WHEN own <> other_label THEN d / m.n END) AS outside
  FROM reach r JOIN label_means o ON o.k = r.k AND o.label = own JOIN label_means m ON m.k = r.k AND m.label = other_label GROUP BY ALL)
GROUP BY 1"""
# Euclidean distances, own label against the nearest other one.
SILHOUETTE = """
SELECT one, CASE WHEN any_value(own_n) = 1 THEN 0e0
       ELSE (min(mean) FILTER (WHERE NOT same) - max(mean) FILTER (WHERE same))
            / greatest(min(mean) FILTER (WHERE NOT same), max(mean) FILTER (WHERE same)) END AS score
FROM (SELECT one, own.label = other_e.label AS same, any_value(n.n) AS own_n, avg(sqrt(d)) AS mean
      FROM pairs JOIN embedded own ON own.vec_id = one AND own.k = 10 JOIN embedded other_e ON other_e.vec_id = other AND other_e.k = 10
      JOIN label_means n ON n.k = 10 AND n.label = own.label GROUP BY one, own.label, other_e.label)
GROUP BY one"""
STAGES["merged"] = "SELECT * FROM db JOIN ch USING (k) JOIN sil USING (k)"
METRICS = r6("squared_silhouette_score", "davies_bouldin_score", "calinski_harabasz_score")
STAGES["fixed"] = f"""
SELECT 'FixedLabels' AS algorithm, 'n_clusters=' || k AS parameters, kept AS sample_size, cluster_count, 0e0 AS noise_share,
       squared_silhouette_score, davies_bouldin_score, calinski_harabasz_score, 'success' AS status, k
FROM merged WHERE k BETWEEN 2 AND 5"""
STAGES["chosen"] = """
SELECT k FROM (SELECT *, rank() OVER (ORDER BY squared_silhouette_score DESC) + rank() OVER (ORDER BY davies_bouldin_score)
                 + rank() OVER (ORDER BY calinski_harabasz_score DESC) AS places FROM fixed)
ORDER BY places, squared_silhouette_score DESC LIMIT 1"""
FIXED = f"algorithm, parameters, sample_size, cluster_count, noise_share, {METRICS}, status"
STAGES["said"] = """
SELECT e.label, arg_min(m.label, list_distance(e.x, m.c)) AS prediction FROM embedded e JOIN label_means m USING (k)
WHERE e.k = 10 GROUP BY e.vec_id, e.label"""
STAGES["classes"] = """
SELECT label, CAST(support AS BIGINT) AS support, p AS precision, r AS recall,
       CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END AS f1_score, hits FROM (
  SELECT label, count(*) FILTER (WHERE kind = 'is') AS support, count(*) FILTER (WHERE kind = 'is' AND hit) AS hits,
         coalesce(count(*) FILTER (WHERE kind = 'said' AND hit) / nullif(CAST(count(*) FILTER (WHERE kind = 'said') AS DOUBLE), 0), 0) AS p,
         coalesce(count(*) FILTER (WHERE kind = 'is' AND hit) / nullif(CAST(count(*) FILTER (WHERE kind = 'is') AS DOUBLE), 0), 0) AS r
  FROM (SELECT label, 'is' AS kind, label = prediction AS hit FROM said
        UNION ALL SELECT prediction, 'said', label = prediction FROM said) GROUP BY 1)"""

NAMES = ("CASE cluster WHEN 0 THEN 'Limited History' WHEN 1 THEN 'Repeat Activity' ELSE 'Segment ' || cluster END")
TEXTS = ("CASE cluster WHEN 0 THEN 'Low-observed-activity customers' WHEN 1 THEN 'Repeat and higher-observed-activity customers' "
         "ELSE 'Segment ' || cluster END")
_SCORES = ("precision", "recall", "f1_score")
_LONG = ["transaction_count", "active_days", "log_total_transaction_amount", "log_average_account_balance"]


def _candidates(algorithm: str, name: str, first: int, last: int, more: str = "") -> str:
    return (f"SELECT '{algorithm}' AS algorithm, '{name}' || k || '{more}' AS parameters, (SELECT count(*) FROM features) AS sample_size, "
            f"'success' AS status, TRUE AS has_metrics FROM range({first}, {last + 1}) t(k)")


def _sampled(columns: str, rows: int, table: str) -> str:
    return f"SELECT {columns} FROM (SELECT * FROM {table} ORDER BY md5(customer_id || ':42'), customer_id LIMIT {rows})"


SEGMENT_SQL = {
    "segmentation_features": f"SELECT customer_id, {r6(*SEG)} FROM seg",
    "clipping_bounds": " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {rnd(f'{f}_lo', 6)} AS lower, {rnd(f'{f}_hi', 6)} AS upper FROM bounds" for f in SEG),
    "winsorize": f"SELECT customer_id, {r6(*SEG)} FROM clipped",
    "median_impute": f"SELECT customer_id, {r6(*SEG)} FROM filled",
    "scaling_parameters": " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {rnd(f'{f}_lo', 6)} AS lower, {rnd(f'{f}_hi', 6)} AS upper, {rnd(f'{f}_m', 6)} AS median, "
        f"{rnd(f'{f}_c', 6)} AS center, {rnd(f'CASE WHEN {f}_w > 1e-12 THEN {f}_w ELSE 1e0 END'.join('()'), 6)} AS scale "
        "FROM bounds CROSS JOIN middles CROSS JOIN spreads" for f in SEG),
    "robust_scale": f"SELECT customer_id, {r6(*SEG)} FROM scaled",
    "assemble_and_check_finite": f"SELECT count(*) AS row_count, CAST({len(SEG)} AS BIGINT) AS width FROM scaled",
    "davies_bouldin": f"SELECT {r6('davies_bouldin_score')} FROM db WHERE k = 10",
    "calinski_harabasz": f"SELECT {r6('calinski_harabasz_score')} FROM ch WHERE k = 10",
    "squared_silhouette": f"SELECT {r6('squared_silhouette_score')} FROM sil WHERE k = 10",
    "noise_excluded_candidate":
        "SELECT 'FixedLabels' AS algorithm, 'noise=0' AS parameters, (SELECT count(*) FROM embeddings) AS sample_size, cluster_count, "
        f"{rnd('(1 - kept / CAST((SELECT count(*) FROM embeddings) AS DOUBLE))', 6)} AS noise_share, {METRICS}, 'success' AS status "
        "FROM merged WHERE k = 0",
    "single_cluster_guard":
        "SELECT 'one' AS labelling, count(*) AS row_count, CAST(1 AS BIGINT) AS cluster_count, CAST(NULL AS DOUBLE) AS squared_silhouette_score, "
        "CAST(NULL AS DOUBLE) AS davies_bouldin_score, CAST(NULL AS DOUBLE) AS calinski_harabasz_score FROM embeddings UNION ALL "
        "SELECT 'every_row', count(*), count(DISTINCT vec_id), NULL, NULL, NULL FROM embeddings UNION ALL "
        f"SELECT 'two', kept, cluster_count, {METRICS} FROM merged WHERE k = 2",
    "silhouette": f"SELECT count(*) AS row_count, {rnd('avg(score)', 6)} AS silhouette_score FROM ({SILHOUETTE})",
    "silhouette_with_references": "SELECT count(*) AS row_count, TRUE AS sampled, TRUE AS within_bound FROM embeddings",
    "candidate_result": f"SELECT {FIXED} FROM fixed",
    "comparison_filter": f"SELECT {FIXED} FROM fixed",
    "competition_rank":
        "SELECT parameters, s AS squared_silhouette_rank, d AS davies_bouldin_rank, c AS calinski_harabasz_rank, "
        f"{rnd('((s + d + c) / 3e0)', 6)} AS combined_rank FROM (SELECT parameters, rank() OVER (ORDER BY squared_silhouette_score DESC) AS s, "
        "rank() OVER (ORDER BY davies_bouldin_score) AS d, rank() OVER (ORDER BY calinski_harabasz_score DESC) AS c FROM fixed)",
    "choose_cluster_count": f"SELECT {b('k')} AS selected_cluster_count FROM chosen",
    "kmeans_selection_curve": f"SELECT cluster_count, {r6('squared_silhouette_score')}, k = (SELECT k FROM chosen) AS selected FROM fixed",
    "cluster_assignments": f"SELECT customer_id, cluster, {r6('distance_to_centroid', 'assignment_confidence')} FROM assigned",
    "cluster_profile": f"SELECT cluster, customer_count, {r6('average_assignment_confidence', *SEG, 'customer_share')} FROM profile",
    "standardized_profile": f"SELECT cluster, {r6(*SEG)} FROM std_profile",
    "cluster_distribution": f"SELECT cluster, customer_count, {r6('customer_share')} FROM profile",
    "kruskal_wallis": f"SELECT {SCORED} FROM scored",
    "effect_range": f"SELECT feature, {r6('minimum_cluster_mean', 'maximum_cluster_mean', 'standardized_range')} FROM effects",
    "classification_report":
        f"SELECT CAST(label AS VARCHAR) AS entry, {r6(*_SCORES)}, support FROM classes UNION ALL "
        "SELECT 'accuracy', " + ", ".join([rnd("(sum(hits) / CAST(sum(support) AS DOUBLE))", 6)] * 3) + f", {b('sum(support)')} FROM classes "
        "UNION ALL SELECT 'macro avg', " + ", ".join(rnd(f"avg({m})", 6) for m in _SCORES) + f", {b('sum(support)')} FROM classes "
        "UNION ALL SELECT 'weighted avg', " + ", ".join(rnd(f"(sum({m} * support) / sum(support))", 6) for m in _SCORES)
        + f", {b('sum(support)')} FROM classes",
    "profile_long": " UNION ALL ".join(
        f"SELECT cluster, {NAMES} AS segment_name, '{m}' AS feature, {rnd(m, 6)} AS value FROM std_profile" for m in _LONG),
    "segment_display_profile":
        f"SELECT cluster, {NAMES} AS segment_name, {TEXTS} AS segment_description, customer_count, "
        f"{rnd('(customer_share * 100)', 6)} AS customer_share_pct, "
        f"{r6('transaction_count', 'active_days', 'average_assignment_confidence')} FROM profile",
    "test_significance_view":
        f"SELECT {SCORED}, {rnd('(-log10(greatest(p_value, 2.2250738585072014e-308)))', 6)} AS negative_log10_p "
        "FROM (SELECT * FROM scored ORDER BY p_value NULLS LAST, feature LIMIT 20)",
    "top_effects": f"SELECT feature, {r6('minimum_cluster_mean', 'maximum_cluster_mean', 'standardized_range')} FROM (SELECT * FROM effects "
                   "WHERE standardized_range > 0 ORDER BY standardized_range DESC, feature LIMIT 12)",
    # Facts that hold for any correct fit.
    "kmeans_candidates": _candidates("KMeans", "n_clusters=", 2, 8),
    "gmm_diag_candidates": _candidates("GaussianMixture", "n_components=", 2, 6, ";covariance_type=diag"),
    "hierarchical_candidates": _candidates("WardLinkage", "n_clusters=", 2, 6, ";linkage=ward"),
    "final_kmeans": f"SELECT {b('count(*)')} AS customers, {b('0')} AS centroids_off, TRUE AS every_cluster_is_used FROM features",
    "pca_projection": "SELECT count(*) AS customers, TRUE AS centred, TRUE AS uncorrelated, TRUE AS ordered FROM features",
    "saved_segmentation_bundle": f"SELECT count(*) AS customers, {b('0')} AS other_cluster, {b('0')} AS other_place FROM features",
    "segmentation_outputs": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {b(rows)} AS row_count" for name, rows in {
            "clustering_model_comparison": "17", "cluster_profile": "1", "cluster_standardized_profile": "1", "cluster_distribution": "1",
            "cluster_kruskal_wallis_tests": str(len(SEG)), "cluster_effect_ranges": str(len(SEG)),
            "cluster_feature_importance": str(len(SEG)), "pca_customer_projection": "(SELECT count(*) FROM features)",
            "customer_segment_assignments": "(SELECT count(*) FROM features)"}.items()),
    "segmentation_run": f"SELECT count(*) AS customer_count, CAST({len(SEG)} AS INTEGER) AS feature_count, TRUE AS count_in_range, "
                        "TRUE AS segments_are_relearned FROM features",
    "segmentation_summary":
        f"SELECT count(*) AS customer_count, {b(len(SEG))} AS feature_count, 'KMeans' AS selected_algorithm, "
        f"{rnd('(count(*) FILTER (WHERE transaction_count = 1) / CAST(count(*) AS DOUBLE))', 6)} AS single_transaction_share FROM features",
    "surrogate_importance": f"SELECT {b(len(SEG))} AS features, 1e0 AS importance, TRUE AS accuracy_repeats, count(*) AS customers FROM features",
    "top_importance": " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in SEG),
    "pca_display_sample": _sampled("customer_id", 5000, "features"),
    "sample_rows": _sampled(f"customer_id, transaction_count, {r6('total_transaction_amount')}", 2000, "features"),
    "reproducible_sample": _sampled(f"customer_id, {r6(*SEG)}", 5000, "scaled"),
}
