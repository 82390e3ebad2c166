from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation, functions as F

from ledgerscope.schemas import SEGMENTATION_FEATURES as FEATURES
from ledgerscope.segmentation import candidates as cand, display, final, gmm, metrics, prepare
from ledgerscope.segmentation.job import SegmentationSettings, run_segmentation
from ledgerscope.segmentation.bundle import assign_with_bundle, project_with_bundle
from ledgerscope.session import new_folder
from ledgerscope.stats import rank_tests, surrogate


def feature_frame(rows=180, seed=5):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(rng.normal(size=(rows, len(FEATURES))), columns=FEATURES)
    frame.insert(0, "customer_id", [f"C{i:04d}" for i in range(rows)])
    frame.loc[3, "customer_age"] = None
    frame.loc[5, "log_average_account_balance"] = 1_000_000.0
    frame["transaction_count"] = np.where(np.arange(rows) % 10 == 0, 4.0, 1.0)  # no spread in the middle half
    return frame


@pytest.fixture(scope="module")
def features(spark):
    df = spark.createDataFrame(feature_frame())
    return df.select("customer_id", *[F.when(~F.isnan(f), F.col(f)).alias(f) for f in FEATURES]).cache()


def test_preparation_matches_pandas(features):
    frame = feature_frame()
    numeric = frame[FEATURES]
    low, high = numeric.quantile(0.005), numeric.quantile(0.995)
    clipped = numeric.clip(low, high, axis=1)
    filled = clipped.fillna(clipped.median())
    width = filled.quantile(0.75) - filled.quantile(0.25)
    want = (filled - filled.median()) / width.where(width > 0, 1.0)
    params = prepare.fit_scaling(features)
    got = prepare.assert_finite(prepare.scale(features, params), FEATURES).toPandas().sort_values("customer_id")
    np.testing.assert_allclose(got[FEATURES].to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-9)
    assert params.scales["transaction_count"] == 1.0 and got["transaction_count"].max() == 3.0


def test_preparation_errors(spark, features):
    with pytest.raises(ValueError, match="quantiles"):
        prepare.fit_scaling(features, lower=0.9, upper=0.1)
    with pytest.raises(ValueError, match="active_days"):
        prepare.fit_scaling(features.drop("active_days"))
    with pytest.raises(ValueError, match="without any value"):
        prepare.fit_scaling(features.withColumn("active_days", F.lit(None).cast("double")))
    with pytest.raises(ValueError, match="finite"):
        prepare.assert_finite(features, FEATURES)


def blobs(spark, sizes=(60, 40, 25), noise=0, seed=1):
    rng = np.random.default_rng(seed)
    centers = [(0, 0), (8, 1), (3, 9)]
    points = np.vstack([rng.normal(c, 0.6, size=(n, 2)) for c, n in zip(centers, sizes)])
    label = np.repeat(np.arange(len(sizes)), sizes)
    if noise:
        points = np.vstack([points, rng.uniform(30, 400, size=(noise, 2))])
        label = np.append(label, np.full(noise, -1))
    frame = pd.DataFrame(points, columns=["x", "y"])
    frame.insert(0, "customer_id", [f"p{i:04d}" for i in range(len(frame))])
    frame["label"] = label
    return frame, spark.createDataFrame(frame)


def brute_metrics(frame):
    x, label = frame[["x", "y"]].to_numpy(), frame["label"].to_numpy()
    codes = np.unique(label)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    scores = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a, b = (d[i, own] ** 2).mean(), min((d[i, label == c] ** 2).mean() for c in codes if c != label[i])
        scores.append((b - a) / max(a, b))
    means = np.array([x[label == c].mean(0) for c in codes])
    spread = np.array([np.sqrt(((x[label == c] - m) ** 2).sum(1)).mean() for c, m in zip(codes, means)])
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(len(codes)) if j != i)
                  for i in range(len(codes))])
    sizes = np.array([(label == c).sum() for c in codes])
    between = (sizes * ((means - x.mean(0)) ** 2).sum(1)).sum()
    within = sum(((x[label == c] - m) ** 2).sum() for c, m in zip(codes, means))
    return np.mean(scores), db, between * (len(x) - len(codes)) / (within * (len(codes) - 1))


def test_metrics_match_brute_force(spark):
    frame, df = blobs(spark)
    found = metrics.evaluate(df, ["x", "y"])
    got = [found[m] for m in cand.METRICS]
    assert got == pytest.approx(brute_metrics(frame), rel=1e-9)


def test_metrics_guard_and_noise(spark):
    frame, df = blobs(spark, noise=10)
    record = cand.candidate_result("x", "p", df, ["x", "y"])
    assert record["cluster_count"] == 3 and record["noise_share"] == pytest.approx(10 / 135)
    assert record["squared_silhouette_score"] == pytest.approx(brute_metrics(frame[frame["label"] >= 0])[0], rel=1e-9)
    one = cand.candidate_result("x", "p", df.withColumn("label", F.lit(0)), ["x", "y"])
    assert one["squared_silhouette_score"] is None and one["status"] == "success"
    every = df.limit(5).withColumn("label", F.substring("customer_id", 2, 4).cast("int"))
    assert cand.candidate_result("x", "p", every, ["x", "y"])["davies_bouldin_score"] is None


def test_binary_noise_is_no_scale(spark):
    noisy = [0.3 if i % 2 else 0.1 + 0.2 for i in range(40)]
    frame = feature_frame(40).assign(**{FEATURES[0]: noisy})
    params = prepare.fit_scaling(spark.createDataFrame(frame))
    assert params.scales[FEATURES[0]] == 1.0 and params.scales[FEATURES[1]] != 1.0


def test_kmeans_candidates_find_the_blobs(spark):
    _, df = blobs(spark, (120, 90, 60))
    scaled = df.select("customer_id", "x", "y")
    results = cand.kmeans_candidates(scaled, range(2, 5), n_init=2)
    frame = cand.candidates_frame(spark, results)
    assert cand.choose_cluster_count(frame) == 3
    with pytest.raises(ValueError):
        cand.choose_cluster_count(frame, "none")
    curve = display.kmeans_selection_curve(frame, 3).collect()
    assert [(r["cluster_count"], r["selected"]) for r in curve] == [(2, False), (3, True), (4, False)]


def test_mixture_recovers_blobs(spark):
    frame, df = blobs(spark, (120, 90, 60))
    sample = cand.with_vectors(df.select("customer_id", "x", "y"))
    model = gmm.fit_mixtures(sample, ["x", "y"], [3], n_init=1, max_iter=50)[3]
    assert sorted(np.round(model.weights * 270)) == pytest.approx([60, 90, 120], abs=1)
    labelled = model.label(sample).toPandas().merge(frame[["customer_id", "label"]], on="customer_id", suffixes=("", "_true"))
    assert labelled.groupby("label_true")["label"].nunique().eq(1).all()


def test_assignment_confidence(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 2.0)], "customer_id string, x double")
    rows = {r["customer_id"]: r for r in final.cluster_assignments(df, [[0.0], [2.0]]).collect()}
    assert (rows["a"]["cluster"], rows["a"]["assignment_confidence"]) == (0, 1.0)
    assert (rows["b"]["cluster"], rows["b"]["assignment_confidence"]) == (0, 0.0)  # a tie
    only = final.cluster_assignments(df, [[1.0]]).collect()
    assert {r["assignment_confidence"] for r in only} == {1.0}
    same = final.cluster_assignments(df, [[0.0], [0.0]]).collect()
    assert [r["assignment_confidence"] for r in same if r["customer_id"] == "a"] == [1.0]


def test_pca_matches_eigenvectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ np.diag([3.0, 1.0, 0.2]) + 5
    df = spark.createDataFrame([(f"c{i:03d}", *map(float, r)) for i, r in enumerate(x)], "customer_id string, a double, b double, c double")
    model, means, loadings = final.fit_pca(df)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert list(model.explainedVariance) == pytest.approx((values[::-1] / values.sum())[:2])
    top = vectors[:, ::-1].T[:2]
    top = top * np.sign(top[np.arange(2), np.abs(top).argmax(1)])[:, None]
    np.testing.assert_allclose(loadings, top, atol=1e-9)
    everyone = df.select("customer_id", F.lit(0).alias("cluster"))
    got = final.pca_projection(df, everyone, means, loadings).orderBy("customer_id").toPandas()
    np.testing.assert_allclose(got[["pca_1", "pca_2"]].to_numpy(), (x - x.mean(0)) @ top.T, atol=1e-9)


def test_distribution_and_effects(spark):
    assigned = spark.createDataFrame([("A", 0), ("B", 0), ("C", 1), ("D", 1)], "customer_id string, cluster int")
    shares = [r["customer_share"] for r in rank_tests.cluster_distribution(assigned).collect()]
    assert shares == [0.5, 0.5]
    profile = spark.createDataFrame([(0, -1.0, 0.0), (1, 2.0, 0.5)], "cluster int, feature_a double, feature_b double")
    first = rank_tests.effect_range(profile).first()
    assert (first["feature"], first["standardized_range"]) == ("feature_a", 3.0)


def brute_kruskal(groups):
    values = np.concatenate(groups)
    ranks = pd.Series(values).rank().to_numpy()
    n, at, total = len(values), 0, 0.0
    for g in groups:
        total += ranks[at:at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    ties = pd.Series(values).value_counts().to_numpy(dtype=float)
    return (12 / (n * (n + 1)) * total - 3 * (n + 1)) / (1 - (ties ** 3 - ties).sum() / (n ** 3 - n))


def test_kruskal_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"cluster": rng.integers(0, 4, 900), "a": np.round(rng.normal(size=900), 1),
                          "b": rng.normal(size=900), "flat": 1.0})
    frame["a"] += frame["cluster"] * 0.2
    df, names = spark.createDataFrame(frame), ["a", "b", "flat", "none"]
    for digits in (None, 6):  # raw values, in which 0.1 + 0.2 and 0.3 differ, and values tied at six decimals
        got = {r["feature"]: r for r in rank_tests.kruskal_wallis(df, names, tie_digits=digits).collect()}
        for f in ("a", "b"):
            ranked = [g[f].to_numpy() if digits is None else g[f].round(digits).to_numpy() for _, g in frame.groupby("cluster")]
            assert got[f]["statistic"] == pytest.approx(brute_kruskal(ranked), rel=1e-9)
    assert got["a"]["significant_at_0_05"] and got["flat"]["statistic"] is None and "none" not in got
    small = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 10), (1, 11), (1, 12)], "cluster int, amount int")
    row = rank_tests.kruskal_wallis(small, ["amount"]).first()
    assert row["statistic"] == pytest.approx(3.857142857) and row["p_value"] == pytest.approx(0.0495346, abs=1e-6)
    one = spark.createDataFrame([(0, 1), (0, 2)], "cluster int, amount int")
    assert rank_tests.kruskal_wallis(one, ["amount"]).isEmpty()


@pytest.mark.parametrize("x, freedom", [(3.841459, 1), (5.991465, 2), (7.814728, 3), (16.918978, 9), (15.507313, 8)])
def test_chi2_tail(x, freedom):
    assert rank_tests.chi2_tail(x, freedom) == pytest.approx(0.05, abs=1e-6)


def test_classification_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    rows = {r["entry"]: r for r in rank_tests.classification_report(df).collect()}
    assert rows["accuracy"]["precision"] == pytest.approx(0.6) and rows["2"]["f1_score"] == 0.0
    assert rows["1"]["precision"] == pytest.approx(1 / 3) and rows["1"]["recall"] == 1.0
    assert rows["macro avg"]["recall"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert rows["weighted avg"]["precision"] == pytest.approx((3 * 1 + 1 / 3 + 0) / 5)


def test_surrogate_finds_the_signal(spark):
    spark.range(3).observe(Observation("rows"), F.count(F.lit(1))).collect()  # a session that has observed
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    scaled = spark.createDataFrame([(f"c{i:03d}", *map(float, r)) for i, r in enumerate(x)],
                                   "customer_id string, signal double, n1 double, n2 double")
    assigned = scaled.select("customer_id", (F.col("signal") > 0).cast("int").alias("cluster"))
    found = surrogate.surrogate_importance(scaled, assigned, trees=20, depth=5)
    assert found.importance.first()["feature"] == "signal" and found.accuracy > 0.8
    assert found.scored_rows == 100 and found.fitted_rows == 300


def test_whole_run(spark, features):
    numbers = features.withColumn("transaction_count", F.col("transaction_count").cast("bigint"))
    settings = SegmentationSettings(cluster_range=range(2, 4), kmeans_restarts=1, final_restarts=2, trees=5, depth=3, extended=False)
    result = run_segmentation(numbers, new_folder(spark, "seg-test"), settings)
    assigned = result.tables["customer_segment_assignments"]
    assert assigned.count() == 180 and result.summary["selected_cluster_count"] in (2, 3)
    assert assigned.where(~F.col("assignment_confidence").between(0, 1)).isEmpty()
    profile = result.tables["cluster_profile"].collect()
    assert sum(r["customer_count"] for r in profile) == 180 and sum(r["customer_share"] for r in profile) == pytest.approx(1)
    means = [r[0] for r in numbers.join(assigned, "customer_id").groupBy("cluster").agg(
        F.avg("transaction_count")).orderBy("cluster").select("avg(transaction_count)").collect()]
    assert means == sorted(means)  # clusters are numbered by activity
    assert assign_with_bundle(numbers, result.bundle_path).exceptAll(assigned).isEmpty()
    stored = result.tables["pca_customer_projection"].select("customer_id", "pca_1", "pca_2")
    assert project_with_bundle(numbers, result.bundle_path).exceptAll(stored).isEmpty() and stored.count() == 180


def test_display(spark):
    profile = spark.createDataFrame([(0, 9, 0.9, 1.0, 1.0, 0.7), (1, 1, 0.1, 2.0, 9.0, 0.5)],
                                    "cluster int, customer_count bigint, customer_share double, transaction_count double, "
                                    "active_days double, average_assignment_confidence double")
    rows = display.segment_display_profile(profile).orderBy("cluster").collect()
    assert rows[0]["segment_name"] == "Limited History" and rows[0]["customer_share_pct"] == pytest.approx(90)
    assert display.profile_long(profile, ["active_days", "transaction_count"]).count() == 4
    tests = spark.createDataFrame([("a", 0.0), ("b", 0.01), ("c", None)], "feature string, p_value double")
    top = display.significance_view(tests, 2).collect()
    assert [r["feature"] for r in top] == ["a", "b"] and top[0]["negative_log10_p"] == pytest.approx(307.65, abs=0.01)
