"""Weighted coresets: a bounded number of customers that stand for all of them in repeated k-means fits.

A customer's sensitivity is the share that it can have in the cost of any centres. It is bounded by its share of the
cost under a rough solution plus its share of its rough cluster, half each. Customers are drawn independently
with a chance in proportion, by a hash of their id, and weigh the inverse of that chance, so the weighted cost
of any centres is the full cost on average. With m rows drawn, for k centres in d dimensions, it is within a share of about
sqrt(k * d * log(k) / m) of it; the default of 50,000 rows and 8 centres in 15 dimensions gives 7 %, and in practice far less.

Scans of all customers: moments, rough draw, rough costs, draw. What follows reads the coreset, whatever the number of fits.
Tables of at most ``coreset_rows`` customers are their own coreset, after the first scan. Restarts run side by side, one
task each, on the coreset, which is sent to every executor (its size is the bound: 6 MB by default).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.segmentation.prepare import ID, assemble
from ledgerscope.session import new_folder, write_and_read

CORESET_ROWS = 50_000
ROUGH_ROWS, ROUGH_CENTERS = 20_000, 16


def _chance(seed: int) -> Column:
    """A number in [0, 1) for each id, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(ID)), 11) * F.lit(2.0 ** -53)


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def _near(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance to it."""
    gap = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
    near = gap.argmin(axis=1)
    return near, gap[np.arange(len(x)), near]


def _costs(batches: Iterator[pa.RecordBatch], columns: list[str], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    sizes, costs = np.zeros(len(centers), np.int64), np.zeros(len(centers))
    for batch in batches:
        near, gap = _near(matrix(batch, columns), centers)
        sizes += np.bincount(near, minlength=len(centers))
        costs += np.bincount(near, weights=gap, minlength=len(centers))
    used = np.flatnonzero(sizes)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used]), pa.array(costs[used])], names=["center", "n", "cost"])


def _draws(batches: Iterator[pa.RecordBatch], columns: list[str], centers: np.ndarray, cost: float, own: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near, gap = _near(matrix(batch, columns), centers)
        share = own[near] if cost <= 0 else (gap / cost + own[near]) / 2
        wanted = np.minimum(share * size, 1.0)
        drawn = np.flatnonzero(batch["_chance"].to_numpy() < wanted)
        kept = batch.drop_columns(["_chance"]).take(pa.array(drawn))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(1.0 / wanted[drawn])], names=[*kept.schema.names, "weight"])


def _drawn(scaled: DataFrame, columns: list[str], centers: np.ndarray, cost: float, own: np.ndarray, size: int, seed: int) -> DataFrame:
    """Customers drawn in proportion to their share, ``size`` of them on average, with their weights.

    The share is half the customer's part of the whole ``cost`` to the nearest centre and half that centre's entry in ``own``.
    Tasks return only what they draw.
    """
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in scaled.schema] + ["weight double"])
    return scaled.withColumn("_chance", _chance(seed)).mapInArrow(
        partial(_draws, columns=columns, centers=centers, cost=cost, own=own, size=size), kind)


def draw_coreset(scaled: DataFrame, coreset_rows: int = CORESET_ROWS, seed: int = 42) -> DataFrame:
    """Id, features, vector and ``weight`` of the coreset, written to the shared folder."""
    columns = [c for c in scaled.columns if c != ID]
    spark = scaled.sparkSession
    moments = scaled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                         *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    n = moments["n"]
    if n <= coreset_rows:
        return write_and_read(assemble(scaled.withColumn("weight", F.lit(1.0)), columns), new_folder(spark, "coreset"))
    mean = np.array([[moments[f"m{i}"] for i in range(len(columns))]], dtype=np.float64)
    spread = n * sum(moments[f"v{i}"] for i in range(len(columns)))
    rough = _drawn(scaled, columns, mean, spread, np.array([1.0 / n]), min(ROUGH_ROWS, coreset_rows), seed)
    rough = write_and_read(rough, new_folder(spark, "coreset-rough"))
    centers = best_restarts(rough, [ROUGH_CENTERS], 1, 20, seed)[ROUGH_CENTERS][0]
    costs = scaled.select(columns).mapInArrow(partial(_costs, columns=columns, centers=centers), "center bigint, n bigint, cost double").groupBy(
        "center").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    own = np.zeros(len(centers))
    for r in costs:
        own[r["center"]] = 1.0 / (len(costs) * r["n"])
    drawn = _drawn(scaled, columns, centers, sum(r["cost"] for r in costs), own, coreset_rows, seed + 1)
    return write_and_read(assemble(drawn, columns), new_folder(spark, "coreset"))


def _spread_start(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres drawn by weight times squared distance to those drawn before."""
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    gap = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        mass = w * gap
        chosen.append(int(rng.choice(len(x), p=mass / mass.sum())) if mass.sum() > 0 else chosen[0])
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen].copy()


def weighted_kmeans(x: np.ndarray, w: np.ndarray, k: int, max_iter: int, seed: int, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """(centres, weighted cost) of one fit. A centre without rows stays where it is."""
    centers = _spread_start(x, w, k, np.random.default_rng([seed, k]))
    square = (x ** 2).sum(axis=1)
    for last in range(max_iter + 1):
        gaps = (centers ** 2).sum(axis=1) - 2 * x @ centers.T
        near = gaps.argmin(axis=1)
        cost = float((w * np.maximum(square + gaps[np.arange(len(x)), near], 0)).sum())
        if last == max_iter:
            break
        member = np.zeros((len(x), k))
        member[np.arange(len(x)), near] = w
        mass = member.sum(axis=0)
        moved = np.where(mass[:, None] > 0, member.T @ x / np.maximum(mass, 1e-300)[:, None], centers)
        shift, centers = np.abs(moved - centers).max(), moved
        if shift <= tolerance:
            break
    return centers, cost


def best_restarts(coreset: DataFrame, cluster_counts: list[int], n_init: int, max_iter: int, seed: int) -> dict[int, tuple[np.ndarray, float]]:
    """Per cluster count, centres and cost of the restart of least weighted cost over a coreset."""
    spark = coreset.sparkSession
    columns = [c for c in coreset.columns if c not in (ID, "vector", "weight")]
    rows = np.array(coreset.select(*columns, "weight").orderBy(ID).collect(), dtype=np.float64)
    if not len(rows):
        raise ValueError("no customers to group")
    data = spark.sparkContext.broadcast((rows[:, :-1], rows[:, -1]))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, w = data.value
        for batch in batches:
            for k, restart in zip(batch["k"].to_pylist(), batch["restart"].to_pylist()):
                centers, cost = weighted_kmeans(x, w, k, max_iter, seed + restart)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([restart]), pa.array([cost]), pa.array([centers.ravel().tolist()])],
                                                 names=["k", "restart", "cost", "centers"])

    jobs = spark.createDataFrame([(k, r) for k in cluster_counts for r in range(n_init)], "k bigint, restart bigint")
    tasks = min(len(cluster_counts) * n_init, 4 * spark.sparkContext.defaultParallelism)
    found = jobs.repartition(tasks).mapInArrow(fit, "k bigint, restart bigint, cost double, centers array<double>").collect()
    data.unpersist()
    best = {k: min((r for r in found if r["k"] == k), key=lambda r: (r["cost"], r["restart"])) for k in cluster_counts}
    return {k: (np.array(r["centers"]).reshape(k, -1), r["cost"]) for k, r in best.items()}
