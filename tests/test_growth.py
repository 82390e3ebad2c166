"""Steps whose cost must not outgrow their input."""

from __future__ import annotations

import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import ordering
from ledgerscope.plans.clean import clean_transactions
from ledgerscope.plans import features
from ledgerscope.plans.features import build_customer_features
from ledgerscope.registry.common import rounded
from ledgerscope.schemas import SEGMENTATION_FEATURES as FEATURES
from ledgerscope.segmentation import candidates as cand, coreset as coresets, final, gmm, job, metrics, prepare, ward
from ledgerscope.session import new_folder, side_by_side, spread_rows
from ledgerscope.stats import surrogate
from tests.test_clusters_at_scale import points, table
from tests.test_features import _clean


def test_generated_code_of_cleaning_is_compiled(spark, raw, tmp_path):
    """The JVM interprets methods of more than 8,000 bytes."""
    raw.write.parquet(f"{tmp_path}/raw")
    rows = spark.read.parquet(f"{tmp_path}/raw")
    plan = rounded(clean_transactions(rows, F.lit("2016-12-31").cast("date")))._jdf.queryExecution()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan.explainString(mode))]
    assert sizes and max(sizes) <= 8000


def test_generated_code_of_scaling_is_compiled(spark, tmp_path):
    """Also beside the customer's own features, as the run writes them."""
    numbers = spark.range(50).select(F.concat(F.lit("C"), "id").alias("customer_id"), *[(F.col("id") * (i + 1) % 17).cast("double").alias(f) for i, f in enumerate(FEATURES)])
    numbers.write.parquet(f"{tmp_path}/features")
    rows = spark.read.parquet(f"{tmp_path}/features")
    params = prepare.ScalingParams({f: (0.5, 15.5) for f in FEATURES}, *[dict.fromkeys(FEATURES, v) for v in (8.0, 8.0, 4.0)])
    plan = prepare.scale(rows.withColumn(prepare.OWN, F.struct(*FEATURES)), params)._jdf.queryExecution()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan.explainString(mode))]
    assert sizes and max(sizes) <= 8000


def test_scaling_is_clipping_then_filling_then_scaling(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -3.0, 0.25, 1.0, 99.0]
    rows = spark.createDataFrame([(f"C{i}", v) for i, v in enumerate(values)], "customer_id string, x double")
    params = prepare.ScalingParams({"x": (0.0, 2.0)}, {"x": 0.75}, {"x": 0.5}, {"x": 0.3})
    steps = prepare.impute(prepare.winsorize(prepare.segmentation_features(rows, ["x"]), params.bounds), params.medians)
    wanted = [(r["x"] - 0.5) / 0.3 for r in steps.orderBy("customer_id").collect()]
    assert [r["x"] for r in prepare.scale(rows, params).orderBy("customer_id").collect()] == wanted


def test_run_takes_what_was_made_before(spark, monkeypatch):
    """Scaling parameters and coreset are not made again, and the results are those of a run that makes them."""
    numbers = spark.range(120).select(F.concat(F.lit("C"), "id").alias("customer_id"),
                                      *[(F.col("id") * (i + 3) % 23 + F.when(F.col("id") < 50, 100 * (i + 1)).otherwise(0)).cast("double").alias(f) for i, f in enumerate(FEATURES)])
    numbers = numbers.withColumn("transaction_count", F.col("transaction_count").cast("bigint"))
    settings = job.SegmentationSettings(cluster_range=range(2, 4), kmeans_restarts=1, final_restarts=1, trees=3, depth=3, extended=False)
    first = job.run_segmentation(numbers, new_folder(spark, "whole"), settings)
    params = first.extra["params"]
    coreset = coresets.draw_coreset(first.extra["scaled"])
    records = [r.asDict() for r in first.tables["clustering_model_comparison"].collect()]

    def refuse(*_, **__):
        raise AssertionError("made again")

    for module, name in ((job, "fit_scaling"), (job, "draw_coreset"), (cand, "draw_coreset"), (final, "draw_coreset")):
        monkeypatch.setattr(module, name, refuse)
    again = job.run_segmentation(numbers, new_folder(spark, "shared"), settings, compared=records, params=params, coreset=coreset)
    both = [r.tables["customer_segment_assignments"].orderBy("customer_id").collect() for r in (first, again)]
    assert both[0] == both[1]


def test_ward_looks_for_the_nearest_group_once(spark, monkeypatch):
    monkeypatch.setattr(ward, "_nearest", lambda *_: pytest.fail("a second search"))
    rows = table(spark, points(60)).withColumn("_micro", F.lit(1))
    columns = [c for c in rows.columns if c not in ("customer_id", "_micro")]
    used, sizes, _ = ward.nearest_means(rows, columns, np.zeros((2, len(columns))), "_micro")
    assert used.tolist() == [1] and sizes.sum() == rows.count()


def test_expectation_of_all_mixtures_at_once(spark):
    """One product for all models against each model by itself."""
    x = points(400)
    rows = table(spark, x)
    columns = [c for c in rows.columns if c != "customer_id"]
    x = rows.select(columns).toPandas().to_numpy()
    rng = np.random.default_rng(4)
    models = {n: gmm.Mixture(np.full(k, 1 / k), rng.normal(size=(k, len(columns))), rng.uniform(0.5, 2, size=(k, len(columns))), columns) for n, k in ((0, 2), (3, 4))}
    found = gmm._expectation(rows, columns, models)
    for n, m in models.items():
        share, norm = gmm._responsibilities(x, m.weights, m.means, m.variances)
        assert np.allclose(found[n], np.concatenate([gmm._moments(x, share), [norm.sum(), len(x)]]))


def test_sums_by_label_with_unknown_and_unending_values(spark):
    rows = [(0, 1.0, None), (0, 3.0, 2.0), (1, float("inf"), 4.0), (1, 1.0, 6.0), (None, 5.0, 5.0), (200, 7.0, 7.0)]
    found = metrics.cluster_statistics(spark.createDataFrame(rows, "label int, x double, y double"), ["x", "y"], ["label"])["label"]
    assert [(s["label"], s["n"], *s["centroid"].tolist()) for s in found] == [(0, 2, 2.0, 2.0), (1, 2, float("inf"), 5.0), (200, 1, 7.0, 7.0)]


def test_rows_are_dealt_whatever_the_splits(spark):
    parts = spread_rows(spark.range(1000).coalesce(1), 1000, 100).rdd.glom().map(len).collect()
    assert len(parts) == 10 and max(parts) == 100


def _bank(spark):
    rows = [(f"T{i}", "HOT" if i % 3 == 0 else f"C{i % 40}", None if i % 11 == 0 else float(i * 7 % 101) / 4, float(i * 13 % 57),
             None if i % 13 == 0 else f"L{i * 5 % 7}", i % 24) for i in range(600)]
    return _clean(spark, rows)


def test_features_take_one_shuffle(spark):
    text = build_customer_features(_bank(spark))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(") == 1


def test_features_sort_no_rows_per_measure(spark, monkeypatch):
    """Lists instead of a window, and so a sort of all rows, per measure; a task's rows are bounded."""
    monkeypatch.setattr(features, "ROWS_PER_TASK", 20)
    plan = features.build_customer_features(_bank(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning(customer_id" in plan and ", 30), REPARTITION_BY_NUM" in plan


def test_modes_of_lists(spark):
    lists = spark.createDataFrame([(0, ["b", "b", "a"]), (1, ["b", "a"]), (2, []), (3, ["z"]), (4, ["c", "a", "c", "b", "b"])], "n int, v array<string>")
    got = [r[0] for r in lists.orderBy("n").select(features._mode(F.sort_array("v"))).collect()]
    assert got == ["b", "a", None, "z", "b"]


def test_large_customers_get_the_same_features(spark):
    few, many = [build_customer_features(_bank(spark), n).orderBy("customer_id").toPandas() for n in (1000, 50)]
    assert len(few) == 41 and (few["customer_id"] == "HOT").any()
    for c in few.columns:
        if few[c].dtype == float:
            assert np.allclose(few[c], many[c], rtol=1e-12, equal_nan=True)
        else:
            assert few[c].equals(many[c])


def test_sorted_rows_are_stored_compressed(spark):
    numbered = ordering.with_row_number(spark.range(100).toDF("v"), [F.col("v")], "n")
    assert "FileScan parquet" in numbered._jdf.queryExecution().executedPlan().toString()


def test_mixtures_settle_in_few_passes_over_all_rows(spark, monkeypatch):
    passes, real = [], gmm._expectation
    monkeypatch.setattr(gmm, "_expectation", lambda *a: passes.append(1) or real(*a))
    fitted = gmm.fit_mixtures(cand.with_vectors(table(spark, points(3000))), ["f0", "f1", "f2"], [2, 6], 2, 200, 42)
    assert all(m.converged for m in fitted.values()) and len(passes) <= 4


def test_forest_is_fitted_by_many_tasks(spark, monkeypatch):
    seen, real = [], surrogate.RandomForestClassifier.fit
    monkeypatch.setattr(surrogate.RandomForestClassifier, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or real(self, df))
    rows = table(spark, points(400))
    labels = rows.select("customer_id", (F.col("f0") > 0).cast("int").alias("cluster"))
    found = surrogate.surrogate_importance(rows, labels, trees=3, depth=3)
    assert seen == [surrogate.FIT_TASKS] and found.fitted_rows + found.scored_rows == 400


def test_nearest_centroids_are_those_of_brute_force(spark):
    """In batches, without functions evaluated per row; missing values have no distance, ties go to the smaller number."""
    x = points(300)
    rows = table(spark, x).unionByName(spark.createDataFrame([("none", None, 1.0, 2.0)], table(spark, x[:1]).schema))
    columns = rows.columns[1:]
    centers = [x[0].tolist(), x[1].tolist(), x[1].tolist(), x[2].tolist()]
    found = final.cluster_assignments(rows, centers)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "aggregate(" not in text
    got = {r["customer_id"]: r for r in found.collect()}
    assert got["none"]["cluster"] == 0 and got["none"]["distance_to_centroid"] is None and got["none"]["assignment_confidence"] == 1.0
    for r in rows.where(F.col(columns[0]).isNotNull()).collect():
        d = np.sqrt(((np.array([r[c] for c in columns]) - np.array(centers)) ** 2).sum(axis=1))
        two = np.sort(d)[:2]
        mine = got[r["customer_id"]]
        assert mine["cluster"] == d.argmin() and mine["distance_to_centroid"] == pytest.approx(two[0], abs=1e-12)
        assert mine["assignment_confidence"] == pytest.approx(1 - two[0] / two[1] if two[1] > 0 else 1, abs=1e-9)


def test_the_run_does_not_join_customers(spark, monkeypatch):
    """Clusters, scores and the customer's own features lie in one row; only the fitted rows are taken out by id."""
    rng = np.random.default_rng(1)
    rows = [(f"C{i}", *[float(v) for v in rng.normal(size=len(FEATURES))]) for i in range(120)]
    people = spark.createDataFrame(rows, ", ".join(["customer_id string", *[f"{f} double" for f in FEATURES]]))
    seen, real = [], type(people).join
    monkeypatch.setattr(type(people), "join", lambda self, other, on=None, how=None: seen.append((on, how)) or real(self, other, on, how))
    settings = job.SegmentationSettings(cluster_range=range(2, 3), kmeans_restarts=1, final_restarts=1, trees=3, depth=2, extended=False)
    found = job.run_segmentation(people, new_folder(spark, "joins"), settings)
    assert [s for s in seen if s[0] == "customer_id"] == [("customer_id", "left_anti")]
    assert found.tables["cluster_profile"].agg(F.sum("customer_count")).first()[0] == 120


def test_pieces_of_work_run_side_by_side(spark):
    meet = threading.Barrier(3)
    wait = lambda i: lambda: meet.wait(30) * 0 + spark.range(i).count()
    assert side_by_side(spark, [wait(i) for i in (3, 1, 2)]) == [3, 1, 2] and side_by_side(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 / 0])


def test_the_run_does_not_wait_for_the_forest(spark, monkeypatch):
    """Tables that need no forest are made while it grows, and the run's tables keep their names and order."""
    meet = threading.Barrier(4)
    for name in ("surrogate_of", "kruskal_wallis", "profile_of", "fit_pca"):
        monkeypatch.setattr(job, name, lambda *a, real=getattr(job, name): (meet.wait(60), real(*a))[1])
    rng = np.random.default_rng(1)
    rows = [(f"C{i}", *[float(v) for v in rng.normal(size=len(FEATURES))]) for i in range(120)]
    people = spark.createDataFrame(rows, ", ".join(["customer_id string", *[f"{f} double" for f in FEATURES]]))
    settings = job.SegmentationSettings(cluster_range=range(2, 3), n_clusters=9, kmeans_restarts=1, final_restarts=1, trees=3, depth=2, extended=False)
    found = job.run_segmentation(people, new_folder(spark, "together"), settings)
    assert list(found.tables) == [
        "clustering_model_comparison", "cluster_profile", "cluster_standardized_profile", "cluster_distribution", "cluster_kruskal_wallis_tests",
        "cluster_effect_ranges", "cluster_feature_importance", "pca_customer_projection", "customer_segment_assignments"]
    assert {r["parameters"] for r in found.tables["clustering_model_comparison"].collect()} == {"n_clusters=2", "n_clusters=9"}
    assert spark.read.csv(f"{found.out_dir}/csv/customer_segment_assignments", header=True).count() == 120


@pytest.mark.parametrize("shift", [0.02, 3.0])
def test_settling_reads_few_customers_again(spark, monkeypatch, shift):
    """The centroids are those of full passes; a pass over all is made only after a large move. Unused and equal centroids stay."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(300, 3)) + 5, rng.normal(size=(300, 3)) * 2 - 6])
    rows = table(spark, x)
    for start in ([x[:300].mean(0) + shift, x[300:600].mean(0), x[600:].mean(0) - shift], [x[:300].mean(0) + shift]):
        want = np.array(start)
        for _ in range(50):
            near = ((x[:, None, :] - want) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([x[near == i].mean(axis=0) for i in range(len(want))])
            far, want = np.linalg.norm(moved - want, axis=1).max(), moved
            if far <= 1e-4:
                break
        read, whole, real, write = [], [], final.nearest_means, final.write_and_read
        with monkeypatch.context() as m:
            m.setattr(final, "nearest_means", lambda df, *a: read.append(df.count()) or real(df, *a))
            m.setattr(final, "write_and_read", lambda *a: whole.append(1) or write(*a))
            got = final.settle(rows, [list(map(float, c)) for c in start])
        assert np.allclose(got, want, atol=1e-12)
        assert max(read) < 300 and len(whole) <= len(read) and (shift > 1 or len(whole) == 1)
    far_off = [1e6] * 3
    assert final.settle(rows, [x.mean(0).tolist(), far_off])[1] == far_off
    same = final.settle(rows, [x.mean(0).tolist()] * 2)
    assert np.allclose(same, [x.mean(0)] * 2)
