"""Internal cluster metrics over rows with an id, a label and numeric columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NOISE = -1
_FEW = 64  # clusters whose rows are told apart by a matrix of members


def _batch(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which of them are there."""
    x = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
    known = np.column_stack([batch[c].is_valid().to_numpy(zero_copy_only=False) for c in columns])
    return x, known


def _labelled(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have a label, the distinct labels, and the place of each such row among these."""
    label = batch[name]
    rows = np.flatnonzero(label.is_valid().to_numpy(zero_copy_only=False))
    values = label.drop_null().to_numpy(zero_copy_only=False)
    if len(values) and values.min() >= 0 and values.max() < _FEW:
        sizes = np.bincount(values)
        return rows, np.flatnonzero(sizes), (np.cumsum(sizes > 0) - 1)[values]
    found, place = np.unique(values, return_inverse=True)
    return rows, found, place


def _of(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return x if len(rows) == len(x) else x[rows]


def _sums(x: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
    """Sum of each column by place."""
    if count <= _FEW and np.isfinite(x).all():
        member = np.zeros((len(x), count))
        member[np.arange(len(x)), place] = 1.0
        return member.T @ x
    return np.stack([np.bincount(place, weights=c, minlength=count).astype(np.float64) for c in x.T], axis=1)


def _label_sums(batches: Iterator[pa.RecordBatch], columns: list[str], labels: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, known = _batch(batch, columns)
        x = np.where(known, x, 0.0)
        for name in labels:
            rows, found, place = _labelled(batch, name)
            sizes = np.bincount(place, minlength=len(found))
            there = _of(known, rows)
            counts = np.repeat(sizes[:, None].astype(np.float64), len(columns), axis=1) if there.all() else _sums(there.astype(np.float64), place, len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(sizes),
                 *map(pa.array, _sums(_of(x, rows), place, len(found)).T.copy()), *map(pa.array, counts.T.copy())],
                names=["_by", "_in", "n", *[f"s{i}" for i in range(len(columns))], *[f"c{i}" for i in range(len(columns))]])


def _label_gaps(batches: Iterator[pa.RecordBatch], columns: list[str], centers: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, known = _batch(batch, columns)
        whole = known.all(axis=1)
        for name, (numbers, means) in centers.items():
            rows, found, place = _labelled(batch, name)
            if not whole.all():
                keep = whole[rows]
                rows, place = rows[keep], place[keep]
            gap = ((_of(x, rows) - means[np.searchsorted(numbers, found)[place]]) ** 2).sum(axis=1)
            add = lambda weights: pa.array(np.bincount(place, weights=weights, minlength=len(found)).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(np.bincount(place, minlength=len(found))),
                 add(np.sqrt(gap)), add(gap)], names=["_by", "_in", "measured", "spread", "within"])


def cluster_statistics(df: DataFrame, columns: list[str], labels: list[str]) -> dict[str, list[dict]]:
    """Per labelling, one small record per cluster: size, centroid, mean distance and summed
    squared distance to it. All labellings share two passes, in which a batch becomes a row per cluster."""
    rows = df.select(*columns, *[F.col(name).cast("int").alias(name) for name in labels])
    d = range(len(columns))
    kind = "_by string, _in int, n bigint, " + ", ".join(f"s{i} double" for i in d) + ", " + ", ".join(f"c{i} double" for i in d)
    sums = rows.mapInArrow(partial(_label_sums, columns=columns, labels=list(labels)), kind).groupBy("_by", "_in").agg(
        F.sum("n").alias("n"), *[(F.sum(f"s{i}") / F.nullif(F.sum(f"c{i}"), F.lit(0.0))).alias(f"m{i}") for i in d])
    size: dict[str, list[tuple]] = {name: [] for name in labels}
    for r in sorted(sums.collect(), key=lambda r: r["_in"]):
        size[r["_by"]].append((r["_in"], r["n"], np.array([np.nan if r[f"m{i}"] is None else r[f"m{i}"] for i in d])))
    centers = {name: (np.array([r[0] for r in found]), np.array([r[2] for r in found])) for name, found in size.items() if found}
    gaps = rows.mapInArrow(partial(_label_gaps, columns=columns, centers=centers),
                           "_by string, _in int, measured bigint, spread double, within double").groupBy("_by", "_in").agg(
        (F.sum("spread") / F.nullif(F.sum("measured"), F.lit(0))).alias("spread"), F.sum("within").alias("within"))
    gap = {(r["_by"], r["_in"]): r for r in gaps.collect()}
    return {name: [{"label": label, "n": n, "spread": gap[name, label]["spread"], "within": gap[name, label]["within"], "centroid": center}
                   for label, n, center in found] for name, found in size.items()}


def davies_bouldin(stats: list[dict]) -> float:
    """Mean over clusters of the worst (spread + spread) / centroid distance."""
    centers = np.array([s["centroid"] for s in stats])
    spread = np.array([s["spread"] for s in stats])
    apart = np.sqrt(((centers[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2))
    if np.allclose(spread, 0) or np.allclose(apart, 0):
        return 0.0
    apart[apart == 0] = np.inf
    return float(np.mean(np.max((spread[:, None] + spread[None, :]) / apart, axis=1)))


def calinski_harabasz(stats: list[dict]) -> float:
    """Between-cluster over within-cluster dispersion, each per degree of freedom."""
    sizes = np.array([s["n"] for s in stats], dtype=float)
    centers = np.array([s["centroid"] for s in stats])
    middle = (centers * sizes[:, None]).sum(axis=0) / sizes.sum()
    between = float((sizes * ((centers - middle) ** 2).sum(axis=1)).sum())
    within = float(sum(s["within"] for s in stats))
    if within == 0:
        return 1.0
    return float(between * (sizes.sum() - len(stats)) / (within * (len(stats) - 1)))


def _silhouette_sums(batches: Iterator[pa.RecordBatch], columns: list[str], clusters: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    totals = dict.fromkeys(clusters, 0.0)
    for batch in batches:
        x = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
        for name, (numbers, sizes, within, centers) in clusters.items():
            place = np.searchsorted(numbers, batch[name].to_numpy(zero_copy_only=False))
            for a in range(0, len(x), 1024):
                own = place[a:a + 1024]
                gap = ((x[a:a + 1024, None, :] - centers) ** 2).sum(axis=2)
                here = np.arange(len(own))
                mean = gap + within / sizes
                inside = (sizes[own] * gap[here, own] + within[own]) / np.maximum(sizes[own] - 1, 1)
                mean[here, own] = np.inf
                outside = mean.min(axis=1)
                larger = np.maximum(inside, outside)
                score = np.divide(outside - inside, larger, out=np.zeros(len(own)), where=larger > 0)
                totals[name] += float(score[sizes[own] > 1].sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array(list(totals.values()), pa.float64())], names=["label", "total"])


def squared_silhouettes(df: DataFrame, columns: list[str], stats: dict[str, list[dict]]) -> dict[str, float]:
    """Mean silhouette on squared Euclidean distances over all rows, for several labellings in one pass.

    The mean squared distance to a cluster follows from the distance to its centroid, its size and its summed
    squared distances, which ``stats`` (of :func:`cluster_statistics`) holds.
    """
    if not stats:
        return {}
    clusters = {name: (np.array([s["label"] for s in found]), np.array([float(s["n"]) for s in found]),
                       np.array([s["within"] for s in found]), np.array([s["centroid"] for s in found])) for name, found in stats.items()}
    rows = df.select(*columns, *[F.col(name).cast("int").alias(name) for name in clusters])
    parts = rows.mapInArrow(partial(_silhouette_sums, columns=columns, clusters=clusters), "label string, total double")
    found = parts.groupBy("label").agg(F.sum("total").alias("total")).collect()
    return {r["label"]: r["total"] / sum(s["n"] for s in stats[r["label"]]) for r in found}


def evaluate_many(df: DataFrame, columns: list[str], labels: list[str]) -> dict[str, dict]:
    """Row count, cluster count and the three metrics per labelling without noise.

    The metrics are missing with fewer than two clusters or no more rows than clusters.
    """
    stats = cluster_statistics(df, columns, labels)
    total = {name: sum(s["n"] for s in stats[name]) for name in labels}
    silhouette = squared_silhouettes(df, columns, {name: stats[name] for name in labels if 2 <= len(stats[name]) < total[name]})
    out = {}
    for name in labels:
        good = name in silhouette
        out[name] = {
            "rows": total[name], "cluster_count": len(stats[name]),
            "squared_silhouette_score": silhouette.get(name),
            "davies_bouldin_score": davies_bouldin(stats[name]) if good else None,
            "calinski_harabasz_score": calinski_harabasz(stats[name]) if good else None,
        }
    return out


def evaluate(df: DataFrame, columns: list[str], label: str = "label") -> dict:
    """The same for one labelling, over its non-noise rows."""
    return evaluate_many(df.where(F.col(label) != NOISE), columns, [label])[label]


def evaluate_frame(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """The three metrics as one row."""
    found = evaluate(df, columns, label)
    names = ["squared_silhouette_score", "davies_bouldin_score", "calinski_harabasz_score"]
    return df.sparkSession.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} double" for n in names))
