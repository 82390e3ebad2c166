"""Coresets, Ward linkage over micro-clusters, sampled silhouettes, and candidate metrics recomputed in SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerscope.segmentation import candidates as cand, coreset, final, gmm, ward
from ledgerscope.segmentation.silhouette import euclidean_silhouette
from ledgerscope.session import new_folder, write_and_read


def points(n: int, seed: int = 3, dim: int = 3) -> np.ndarray:
    """Four groups of unequal size and spread, with some rows far out."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 6, size=(4, dim))
    group = rng.choice(4, size=n, p=[0.6, 0.25, 0.1, 0.05])
    x = centers[group] + rng.normal(0, 1, size=(n, dim)) * (1 + group[:, None])
    x[:: max(n // 20, 1)] *= 4
    return x


def table(spark, x: np.ndarray, label: np.ndarray | None = None):
    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(x.shape[1])])
    frame.insert(0, "customer_id", [f"c{i:06d}" for i in range(len(x))])
    if label is not None:
        frame["label"] = label
    return write_and_read(spark.createDataFrame(frame), new_folder(spark, "points"))


def cost(x: np.ndarray, centers: np.ndarray) -> float:
    return float(((x[:, None, :] - centers) ** 2).sum(axis=2).min(axis=1).sum())


@pytest.fixture(scope="module")
def large(spark):
    x = points(12_000)
    return x, table(spark, x)


def test_coreset_keeps_costs(spark, large):
    x, df = large
    drawn = coreset.draw_coreset(df, 2_000).toPandas()
    assert 1_500 < len(drawn) <= 2_200 and drawn["weight"].min() >= 1
    assert drawn["weight"].sum() == pytest.approx(len(x), rel=0.1)
    sample, w = drawn[["f0", "f1", "f2"]].to_numpy(), drawn["weight"].to_numpy()
    rng = np.random.default_rng(0)
    for k in (1, 3, 8):
        centers = x[rng.choice(len(x), k)]
        estimate = float((w * ((sample[:, None, :] - centers) ** 2).sum(axis=2).min(axis=1)).sum())
        assert estimate == pytest.approx(cost(x, centers), rel=0.1)
    again = coreset.draw_coreset(df.repartition(7), 2_000)
    assert again.select("customer_id").exceptAll(spark.createDataFrame(drawn[["customer_id"]])).isEmpty()
    small = coreset.draw_coreset(df.limit(50), 2_000)
    assert small.count() == 50 and small.select("weight").distinct().collect()[0][0] == 1.0


def test_fit_on_a_coreset_costs_no_more_than_one_percent_more(spark, large):
    x, df = large
    fits = coreset.best_restarts(coreset.draw_coreset(df, 2_000), [2, 3, 4, 5], 5, 100, 1)
    for k, (centers, _) in fits.items():
        full = min(coreset.weighted_kmeans(x, np.ones(len(x)), k, 100, 1 + r)[1] for r in range(5))
        assert centers.shape == (k, 3) and cost(x, centers) <= 1.01 * full
    settled = np.array(final.fit_final_kmeans(df, 4, n_init=3, max_iter=50, coreset_rows=1_000))
    near = ((x[:, None, :] - settled) ** 2).sum(axis=2).argmin(axis=1)
    assert max(np.abs(x[near == c].mean(axis=0) - settled[c]).max() for c in range(4)) < 1e-2


def test_restarts_do_not_read_the_customers_again(spark, large):
    """Scans of all customers: four for the coreset, whatever the number of fits, and one for the labels."""
    x, df = large
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    watched = df.mapInPandas(counted, df.schema)
    drawn = coreset.draw_coreset(watched, 2_000)
    assert read.value == 4 * len(x)
    fits = coreset.best_restarts(drawn, [2, 3], 10, 20, 1)
    assert read.value == 4 * len(x)
    ward.with_nearest(watched, {str(k): c for k, (c, _) in fits.items()}).write.format("noop").mode("overwrite").save()
    assert read.value == 5 * len(x)


def brute_ward(x: np.ndarray, k: int) -> list[set[int]]:
    groups = [{i} for i in range(len(x))]
    while len(groups) > k:
        best = None
        for a in range(len(groups)):
            for b in range(a):
                n, m = len(groups[a]), len(groups[b])
                gap = x[list(groups[a])].mean(axis=0) - x[list(groups[b])].mean(axis=0)
                height = n * m / (n + m) * float(gap @ gap)
                if best is None or height < best[0]:
                    best = (height, a, b)
        _, a, b = best
        groups[b] |= groups.pop(a)
    return groups


def test_ward_is_exact_on_small_tables(spark):
    x = np.vstack([points(70, seed=5), points(10, seed=5)])
    x[70:75] = x[0]  # copies of one customer
    labelled = ward.ward_labels(table(spark, x), [1, 2, 3, 4, 6]).toPandas().sort_values("customer_id")
    assert len(labelled) == 80
    for k in (1, 2, 3, 4, 6):
        got = {frozenset(np.flatnonzero(labelled[f"label_{k}"] == c)) for c in labelled[f"label_{k}"].unique()}
        assert got == {frozenset(g) for g in brute_ward(x, k)}


def test_ward_over_micro_clusters(spark, large):
    x, df = large
    labelled = ward.ward_labels(df, [2, 3, 4], micro_clusters=150).toPandas()
    assert len(labelled) == len(x) and [labelled[f"label_{k}"].nunique() for k in (2, 3, 4)] == [2, 3, 4]
    values = labelled[["f0", "f1", "f2"]].to_numpy()
    for k in (2, 3, 4):
        label = labelled[f"label_{k}"].to_numpy()
        within = sum(((values[label == c] - values[label == c].mean(axis=0)) ** 2).sum() for c in range(k))
        best = min(coreset.weighted_kmeans(x, np.ones(len(x)), k, 100, r)[1] for r in range(3))
        assert within <= 1.6 * best


def brute_silhouette(x: np.ndarray, label: np.ndarray) -> float:
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(scores))


def test_silhouette_within_its_bound(spark):
    x = points(900, seed=8)
    label = np.where(np.arange(900) == 5, 9, (x[:, 0] > 0).astype(int) + (x[:, 1] > 2))
    df, columns = table(spark, x, label), ["f0", "f1", "f2"]
    exact = euclidean_silhouette(df, "customer_id", columns, "label")
    assert exact["silhouette_score"] == pytest.approx(brute_silhouette(x, label), rel=1e-9) and exact["error_bound"] == 0
    for size in (25, 100):
        near = euclidean_silhouette(df, "customer_id", columns, "label", reference_rows=size)
        assert near["rows"] == 900 and near["reference_rows"] < 6 * size
        assert abs(near["silhouette_score"] - exact["silhouette_score"]) <= near["error_bound"] < 2
    none = euclidean_silhouette(df.withColumn("label", F.lit(1)), "customer_id", columns, "label")
    assert none["silhouette_score"] is None and euclidean_silhouette(df.limit(0), "customer_id", columns, "label")["rows"] == 0


METRICS_SQL = """
WITH r AS (SELECT row_number() OVER () AS id, {label} AS c, [{columns}] AS x FROM '{path}/*.parquet'),
m AS (SELECT c, count(*) AS n, [{means}] AS x FROM '{path}/*.parquet' GROUP BY {label} AS c),
g AS (SELECT c, any_value(m.n) AS n, any_value(m.x) AS x, avg(list_distance(r.x, m.x)) AS spread, sum(list_distance(r.x, m.x) ** 2) AS w
      FROM r JOIN m USING (c) GROUP BY c),
db AS (SELECT avg(worst) AS v FROM (SELECT p.c, max((p.spread + q.spread) / list_distance(p.x, q.x)) AS worst FROM g p JOIN g q ON p.c <> q.c GROUP BY p.c)),
ch AS (SELECT sum(n * list_distance(x, (SELECT [{means}] FROM '{path}/*.parquet')) ** 2) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1)) AS v FROM g),
pairs AS (SELECT p.id, p.c AS own, q.c AS other, sum(list_distance(p.x, q.x) ** 2) AS d FROM r p JOIN r q ON p.id <> q.id GROUP BY ALL),
s AS (SELECT id, any_value(o.n) AS n, max(CASE WHEN own = other THEN d / (o.n - 1) END) AS a, min(CASE WHEN own <> other THEN d / t.n END) AS b
      FROM pairs JOIN g o ON o.c = own JOIN g t ON t.c = other GROUP BY id)
SELECT (SELECT avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) FROM s), db.v, ch.v FROM db, ch"""


def test_candidate_metrics_are_those_that_sql_finds_in_the_stored_labels(spark):
    x = points(500, seed=11)
    df, columns = table(spark, x), ["f0", "f1", "f2"]
    fits = coreset.best_restarts(coreset.draw_coreset(df), [2, 4], 3, 50, 42)
    labelled = {"kmeans": ward.with_nearest(df, {f"label_{k}": c for k, (c, _) in fits.items()}), "ward": ward.ward_labels(df, [2, 4])}
    mixture = gmm.fit_mixtures(cand.with_vectors(df), columns, [2, 4], 1, 30, 42)
    labelled["mixture"] = mixture[4].label(mixture[2].label(df, "label_2"), "label_4")
    for name, rows in labelled.items():
        path = new_folder(spark, f"labels-{name}")
        stored = write_and_read(rows.select(*columns, "label_2", "label_4"), path)
        for record in cand.candidate_results(name, stored, columns, {"label_2": "label_2", "label_4": "label_4"}):
            sql = METRICS_SQL.format(path=path, label=record["parameters"], columns=", ".join(columns), means=", ".join(f"avg({c})" for c in columns))
            want = duckdb.sql(sql.replace(f"GROUP BY {record['parameters']} AS c", f"GROUP BY {record['parameters']}").replace(
                "SELECT c, count(*) AS n", f"SELECT {record['parameters']} AS c, count(*) AS n")).fetchall()[0]
            assert [record[m] for m in cand.METRICS] == pytest.approx(list(want), rel=1e-6)
