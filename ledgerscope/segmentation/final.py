"""Final k-means over all customers, assignments, profiles and projection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ledgerscope.operators.keys import one_to_one_join
from ledgerscope.operators.quantiles import group_quantiles, wide_quantiles
from ledgerscope.schemas import SEGMENTATION_FEATURES
from ledgerscope.segmentation.coreset import CORESET_ROWS, best_restarts, draw_coreset, matrix
from ledgerscope.segmentation.prepare import ID, assemble
from ledgerscope.segmentation.ward import nearest_means
from ledgerscope.session import new_folder, write_and_read

Centroids = list[list[float]]
# Of the least distance between two centroids; they change what is read again, not the result.
LEAST_SLACK, MOST_SLACK = 0.01, 0.1


def _ranked(batches: Iterator[pa.RecordBatch], columns: list[str], centroids: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]
        known = np.logical_and.reduce([batch[c].is_valid().to_numpy(zero_copy_only=False) for c in columns])
        distance = np.zeros((batch.num_rows, len(centroids)))
        for i, center in enumerate(centroids):
            for values, at in zip(x, center):  # summed in column order
                distance[:, i] += (values - float(at)) ** 2
        distance = np.sqrt(distance)
        order = np.argsort(distance, axis=1, kind="stable")[:, :2]
        two = np.take_along_axis(distance, order, axis=1)
        first, second = [pa.array(two[:, min(i, two.shape[1] - 1)], mask=~known) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order[:, 0].astype(np.int32)), first, second],
                                         names=[*batch.schema.names, "cluster", "_first", "_second"])


def nearest(rows: DataFrame, columns: list[str], centroids: Centroids) -> DataFrame:
    """Rows with ``cluster`` and the distances to the nearest and second centroid; ties go to the smaller number."""
    kind = StructType([*rows.schema.fields, StructField("cluster", IntegerType()), StructField("_first", DoubleType()), StructField("_second", DoubleType())])
    return rows.mapInArrow(partial(_ranked, columns=columns, centroids=centroids), kind)


def _parted(batches: Iterator[pa.RecordBatch], columns: list[str], centers: np.ndarray, slack: float) -> Iterator[pa.RecordBatch]:
    """A row per centre with number and sums of the rows that stay its own while no centre moves further than ``slack``;
    the other rows as they are, with centre -1."""
    names = ["center", "n", *[f"s{i}" for i in range(len(columns))]]
    sums, sizes = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
    for batch in batches:
        x = matrix(batch, columns)
        distance = np.zeros((len(x), len(centers)))
        for i, center in enumerate(centers):
            for j, at in enumerate(center):
                distance[:, i] += (x[:, j] - at) ** 2
        distance = np.sqrt(distance)
        near = distance.argmin(axis=1)
        first = distance[np.arange(len(x)), near]
        distance[np.arange(len(x)), near] = np.inf
        sure = distance.min(axis=1) - first > 2 * slack
        kept, own = x[sure], near[sure]
        for j in range(len(columns)):
            sums[:, j] += np.bincount(own, weights=kept[:, j], minlength=len(centers))
        sizes += np.bincount(own, minlength=len(centers))
        rest = x[~sure]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), -1)), pa.array(np.ones(len(rest), np.int64)), *map(pa.array, rest.T.copy())], names=names)
    used = np.flatnonzero(sizes)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used]), *[pa.array(sums[used, j]) for j in range(len(columns))]], names=names)


def settle(scaled: DataFrame, centroids: Centroids, max_passes: int = 50, tolerance: float = 1e-4) -> Centroids:
    """Centroids moved to the mean of their customers until none moves further than ``tolerance``.

    Customers whose two nearest centroids differ by more than twice a slack keep theirs while no centroid moves further than the slack:
    one pass over all adds them up and stores the others, which alone are read again after each move. Larger moves take another such pass.
    """
    columns = [c for c in scaled.columns if c != ID]
    sums = [f"s{i}" for i in range(len(columns))]
    kind = "center bigint, n bigint, " + ", ".join(f"{c} double" for c in sums)
    centers, start, slack, far = np.array(centroids, dtype=np.float64), None, 0.0, 0.0
    for _ in range(max_passes):
        if start is None or np.linalg.norm(centers - start, axis=1).max() > slack:
            apart = np.linalg.norm(centers[:, None, :] - centers, axis=2)[np.triu_indices(len(centers), 1)].min(initial=1e300)
            start, slack = centers, min(max(LEAST_SLACK * apart, 2 * far), MOST_SLACK * apart)
            parted = write_and_read(scaled.select(columns).mapInArrow(partial(_parted, columns=columns, centers=centers, slack=slack), kind),
                                    new_folder(scaled.sparkSession, "settle"))
            sizes, totals = np.zeros(len(centers)), np.zeros(centers.shape)
            for r in parted.where("center >= 0").groupBy("center").agg(F.sum("n"), *[F.sum(c) for c in sums]).collect():
                sizes[r[0]], totals[r[0]] = r[1], r[2:]
            rest = parted.where("center < 0").select(sums)
        used, more, means = nearest_means(rest, sums, centers)
        n, total = sizes.copy(), totals.copy()
        n[used] += more
        total[used] += means * more[:, None]
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centers)
        far, centers = float(np.linalg.norm(moved - centers, axis=1).max()), moved
        if far <= tolerance:
            break
    return centers.tolist()


def fit_final_kmeans(scaled: DataFrame, n_clusters: int, seed: int = 42, n_init: int = 20, max_iter: int = 500,
                     coreset_rows: int = CORESET_ROWS, coreset: DataFrame | None = None) -> Centroids:
    """The restart of least cost over a weighted coreset (``coreset``, where it was drawn before), then settled on all customers."""
    centers, _ = best_restarts(draw_coreset(scaled, coreset_rows, seed) if coreset is None else coreset, [n_clusters], n_init, max_iter, seed)[n_clusters]
    return settle(scaled, centers.tolist())


def by_transactions(labelled: DataFrame, centroids: Centroids) -> Centroids:
    """Clusters by ascending mean ``transaction_count`` of their rows, the larger cluster first on ties."""
    stats = labelled.groupBy("cluster").agg(F.avg("transaction_count").alias("mean"), F.count(F.lit(1)).alias("n")).collect()
    order = {r["cluster"]: (r["mean"], -r["n"]) for r in stats}
    return [centroids[i] for i in sorted(range(len(centroids)), key=lambda i: order.get(i, (float("inf"), 0)))]


def renumber(scaled: DataFrame, features: DataFrame, centroids: Centroids) -> Centroids:
    """Clusters by ascending mean transaction count, the larger cluster first on ties.

    This makes cluster numbers, and the names tied to them, independent of the seed.
    """
    columns = [c for c in scaled.columns if c != ID]
    labelled = nearest(scaled, columns, centroids).select(ID, "cluster")
    return by_transactions(labelled.join(features.select(ID, "transaction_count"), ID), centroids)


def with_assignments(rows: DataFrame, columns: list[str], centroids: Centroids) -> DataFrame:
    """All rows with their cluster, distance to its centroid, and 1 - nearest/second nearest as confidence."""
    first, second = F.col("_first"), F.col("_second")
    confidence = F.lit(1.0)
    if len(centroids) > 1:
        confidence = F.when(second > 0, 1.0 - first / second).otherwise(1.0)
    return nearest(rows, columns, centroids).select(
        *rows.columns, "cluster", first.alias("distance_to_centroid"),
        F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)).alias("assignment_confidence"))


def cluster_assignments(scaled: DataFrame, centroids: Centroids) -> DataFrame:
    """Cluster, distance to its centroid, and 1 - nearest/second nearest as confidence."""
    columns = [c for c in scaled.columns if c != ID]
    return with_assignments(scaled, columns, centroids).select(ID, "cluster", "distance_to_centroid", "assignment_confidence")


def cluster_profile(features: DataFrame, assignments: DataFrame,
                    profile_features: list[str] = SEGMENTATION_FEATURES) -> DataFrame:
    """Size, share, mean confidence and exact medians per cluster.

    A cluster may hold nearly every customer, so medians come from distributed selection.
    """
    present = [f for f in profile_features if f in features.columns]
    merged = one_to_one_join(features.select(ID, *present),
                             assignments.select(ID, "cluster", "assignment_confidence"), ID)
    return profile_of(merged, present)


def profile_of(merged: DataFrame, present: list[str]) -> DataFrame:
    """The profile of rows that hold their cluster, confidence and features; ids are unique."""
    sizes = merged.groupBy("cluster").agg(F.count(F.lit(1)).alias("customer_count"),
                                          F.avg("assignment_confidence").alias("average_assignment_confidence"))
    medians = wide_quantiles(group_quantiles(merged, ["cluster"], present, [0.5]), ["cluster"],
                             {(f, 0.5): f for f in present})
    total = merged.agg(F.count(F.lit(1))).scalar()
    return (sizes.join(medians, "cluster", "left")
            .withColumn("customer_share", F.col("customer_count") / total).orderBy("cluster"))


def cluster_means(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each column per cluster."""
    return labelled.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns]).orderBy("cluster")


def standardized_profile(scaled: DataFrame, assignments: DataFrame) -> DataFrame:
    """Mean scaled feature per cluster."""
    columns = [c for c in scaled.columns if c != ID]
    return cluster_means(scaled.join(assignments.select(ID, "cluster"), ID), columns)


def fit_pca(scaled: DataFrame, components: int = 2) -> tuple[PCAModel, list[float], list[list[float]]]:
    """Model, feature means, and loadings whose largest entry is positive."""
    columns = [c for c in scaled.columns if c != ID]
    means = list(scaled.agg(*[F.avg(c).alias(c) for c in columns]).first())
    model = PCA(k=components, inputCol="vector", outputCol="scores").fit(assemble(scaled, columns))
    loadings = model.pc.toArray().T
    signs = np.sign(loadings[np.arange(components), np.abs(loadings).argmax(axis=1)])
    return model, means, (loadings * signs[:, None]).tolist()


def scores(columns: list[str], means: list[float], loadings: list[list[float]]) -> list[Column]:
    """Centred scores as expressions."""
    out = []
    for i, loading in enumerate(loadings, start=1):
        score = F.lit(0.0)
        for c, m, w in zip(columns, means, loading):
            score = score + (F.col(c) - F.lit(float(m))) * F.lit(float(w))
        out.append(score.alias(f"pca_{i}"))
    return out


def projected(scaled: DataFrame, means: list[float], loadings: list[list[float]]) -> DataFrame:
    """Centred scores of all rows; expressions only."""
    return scaled.select(ID, *scores([c for c in scaled.columns if c != ID], means, loadings))


def pca_projection(scaled: DataFrame, assignments: DataFrame, means: list[float], loadings: list[list[float]]) -> DataFrame:
    """Cluster and centred scores of every customer."""
    found = projected(scaled, means, loadings)
    return found.join(assignments.select(ID, "cluster"), ID).select(ID, "cluster", *found.columns[1:])
