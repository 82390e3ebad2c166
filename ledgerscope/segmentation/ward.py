"""Ward linkage over micro-clusters.

Every customer joins the nearest of a bounded number of drawn customers. Tasks add up the clustering features of these
groups (number, sum), which merge by addition; Ward's method then runs on the merged features. With as many
centres as customers it is exact Ward linkage. One pass finds and stores each customer's group, one adds up the
features; the clusters follow from the group, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerscope.segmentation.coreset import draw_coreset, matrix
from ledgerscope.segmentation.prepare import ID
from ledgerscope.session import new_folder, write_and_read

MICRO_CLUSTERS = 1_000
_BLOCK, _FEW = 512, 8


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest centre; centres that coincide with a row are found exactly."""
    middle = centers.mean(axis=0)
    c = centers - middle
    norms = (c ** 2).sum(axis=1)
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), _BLOCK):
        part = x[a:a + _BLOCK] - middle
        if len(c) <= _FEW:
            out[a:a + _BLOCK] = ((part[:, None, :] - c) ** 2).sum(axis=2).argmin(axis=1)
            continue
        rough = part @ (-2 * c.T)
        rough += norms
        here = np.arange(len(part))
        first = np.empty((len(part), 5), np.int64)
        for i in range(5):  # the five least, one after the other, which is faster than a partition of the whole row
            first[:, i] = rough.argmin(axis=1)
            rough[here, first[:, i]] = np.inf
        exact = ((part[:, None, :] - c[first]) ** 2).sum(axis=2)
        least = exact.min(axis=1, keepdims=True)
        out[a:a + _BLOCK] = np.where(exact == least, first, len(c)).min(axis=1)
    return out


def _features(batches: Iterator[pa.RecordBatch], columns: list[str], centers: np.ndarray, found: str | None = None) -> Iterator[pa.RecordBatch]:
    sums, sizes = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
    for batch in batches:
        x = matrix(batch, columns)
        near = batch[found].to_numpy() if found else _nearest(x, centers)
        for i in range(len(columns)):
            sums[:, i] += np.bincount(near, weights=x[:, i], minlength=len(centers))
        sizes += np.bincount(near, minlength=len(centers))
    used = np.flatnonzero(sizes)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used]), *[pa.array(sums[used, i]) for i in range(len(columns))]],
                                     names=["micro", "n", *[f"s{i}" for i in range(len(columns))]])


def nearest_means(scaled: DataFrame, columns: list[str], centers: np.ndarray, found: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the centres that have customers, how many, and their means; one pass, a row per task and centre.

    ``found``: a column that holds the number of the nearest centre already.
    """
    sums = ", ".join(f"s{i} double" for i in range(len(columns)))
    rows = scaled.select(*columns, *([found] if found else []))
    parts = rows.mapInArrow(partial(_features, columns=columns, centers=centers, found=found), f"micro bigint, n bigint, {sums}")
    merged = parts.groupBy("micro").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(columns))]).orderBy("micro").collect()
    sizes = np.array([r["n"] for r in merged], np.float64)
    means = np.array([[r[f"s{i}"] for i in range(len(columns))] for r in merged]).reshape(len(merged), len(columns)) / sizes[:, None]
    return np.array([r["micro"] for r in merged], np.int64), sizes, means


def ward_merges(sizes: np.ndarray, means: np.ndarray) -> list[tuple[float, int, int]]:
    """Merges (height, one, other) by rising height. A chain of nearest neighbours ends in a pair that is nearest to each other."""
    n, c = sizes.astype(np.float64), means.astype(np.float64).copy()
    alive, chain, merges = np.ones(len(n), bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        d = np.where(alive, n * n[a] / (n + n[a]) * ((c - c[a]) ** 2).sum(axis=1), np.inf)
        d[a] = np.inf
        b = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
            merges.append((float(d[b]), a, b))
            c[b] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
            n[b] += n[a]
            alive[a] = False
            del chain[-2:]
        else:
            chain.append(b)
    return sorted(merges, key=lambda m: m[0])


def cut(count: int, merges: list[tuple[float, int, int]], k: int) -> np.ndarray:
    """Cluster number of each of ``count`` items once only ``k`` clusters are left, in order of the first item."""
    parent = list(range(count))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in merges[:max(count - k, 0)]:
        parent[root(a)] = root(b)
    roots = [root(i) for i in range(count)]
    order = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def _labels(batches: Iterator[pa.RecordBatch], columns: list[str], centers: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch, columns)
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(_nearest(x, c).astype(np.int32)) for c in centers.values()]],
                                         names=[*batch.schema.names, *centers])


def with_nearest(scaled: DataFrame, centers: dict[str, np.ndarray]) -> DataFrame:
    """All customers with the number of the nearest centre, a column per set of centres, in one pass."""
    columns = [c for c in scaled.columns if c != ID]
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in scaled.schema] + [f"`{n}` int" for n in centers])
    return scaled.mapInArrow(partial(_labels, columns=columns, centers=centers), kind)


def ward_labels(scaled: DataFrame, cluster_counts: list[int], micro_clusters: int = MICRO_CLUSTERS, seed: int = 42) -> DataFrame:
    """All customers with ``label_k`` for each number of clusters; their groups are written to the shared folder."""
    columns = [c for c in scaled.columns if c != ID]
    drawn = draw_coreset(scaled, micro_clusters, seed).select(columns).distinct().collect()  # about micro_clusters rows
    centers = np.array(sorted(list(r) for r in drawn))
    named = write_and_read(with_nearest(scaled, {"_micro": centers}), new_folder(scaled.sparkSession, "ward"))
    used, sizes, means = nearest_means(named, columns, centers, "_micro")
    merges = ward_merges(sizes, means)
    for k in cluster_counts:
        number = np.zeros(len(centers), np.int64)
        number[used] = cut(len(used), merges, k)
        named = named.withColumn(f"label_{k}", F.array(*[F.lit(int(v)) for v in number])[F.col("_micro")])
    return named.drop("_micro")
