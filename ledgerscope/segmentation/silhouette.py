"""The Euclidean silhouette of every row, against a reference set of each cluster.

Exact silhouettes need the distances of all pairs. Here every row is scored, against at most about ``reference_rows`` rows of
each cluster, drawn by a hash of their id. Clusters with no more rows than that are their own reference, and
the result is exact if all are. Otherwise the mean distance to a cluster is a mean over its reference, whose standard error
follows from the reference's own spread; ``error_bound`` is the mean over all rows of what three standard errors of the
two mean distances can move a row's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

REFERENCE_ROWS = 1_000
_BLOCK = 256


def _scores(batches: Iterator[pa.RecordBatch], columns: list[str], references: list[tuple]) -> Iterator[pa.RecordBatch]:
    """``references``: per cluster (number, rows of the cluster, ids, points). Sums of scores and of their possible errors."""
    numbers = [r[0] for r in references]
    places = [{i: k for k, i in enumerate(ids)} for _, _, ids, _ in references]
    total = bound = rows = 0
    for batch in batches:
        x = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
        own = np.searchsorted(numbers, batch["_label"].to_numpy())
        ids = batch["_id"].to_pylist()
        inside = np.array([i in places[o] for i, o in zip(ids, own.tolist())], bool)
        for a in range(0, len(x), _BLOCK):
            part, o, me = x[a:a + _BLOCK], own[a:a + _BLOCK], inside[a:a + _BLOCK]
            mean, error = np.empty((len(part), len(references))), np.zeros((len(part), len(references)))
            for c, (_, size, _, points) in enumerate(references):
                d = np.sqrt(((part[:, None, :] - points) ** 2).sum(axis=2))
                n = len(points) - (me & (o == c))  # a row is no neighbour of itself; its distance is 0
                mean[:, c] = d.sum(axis=1) / np.maximum(n, 1)
                spread = np.maximum((d ** 2).sum(axis=1) / np.maximum(n, 1) - mean[:, c] ** 2, 0)
                error[:, c] = np.sqrt(spread / np.maximum(n - 1, 1) * max(0.0, 1 - len(points) / size))
            here = np.arange(len(part))
            within, within_error = mean[here, o].copy(), error[here, o]
            mean[here, o] = np.inf
            nearest = mean.argmin(axis=1)
            outside = mean[here, nearest]
            larger = np.maximum(within, outside)
            alone = np.array([references[c][1] for c in o]) < 2
            usable = (larger > 0) & ~alone
            total += float(np.divide(outside - within, larger, out=np.zeros(len(part)), where=usable).sum())
            moved = 6 * (within_error + error[here, nearest])
            bound += float(np.minimum(np.divide(moved, larger, out=np.zeros(len(part)), where=usable), 2).sum())
            rows += len(part)
    yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([float(total)]), pa.array([float(bound)])], names=["n", "total", "bound"])


def _chance(id_col: str, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) * F.lit(2.0 ** -53)


def euclidean_silhouette(df: DataFrame, id_col: str, columns: list[str], label: str, reference_rows: int = REFERENCE_ROWS,
                         seed: int = 42) -> dict:
    """{rows, reference_rows, silhouette_score, error_bound}; ids are unique. Without two clusters, or with as many as rows, no score."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(label).cast("bigint").alias("_label"), *columns)
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = sum(sizes.values())
    if not 2 <= len(sizes) < count:
        return {"rows": count, "reference_rows": 0, "silhouette_score": None, "error_bound": None}
    share = F.create_map(*[c for k, n in sizes.items() for c in (F.lit(k), F.lit(min(1.0, reference_rows / n)))])[F.col("_label")]
    drawn: dict[int, list] = {k: [] for k in sizes}
    for r in rows.where(_chance("_id", seed) < share).orderBy("_id").collect():  # about reference_rows per cluster
        drawn[r["_label"]].append(r)
    for k, found in drawn.items():
        if not found:
            found.append(rows.where(F.col("_label") == k).orderBy("_id").first())
    references = [(k, sizes[k], [r["_id"] for r in drawn[k]], np.array([[float(r[c]) for c in columns] for r in drawn[k]])) for k in sorted(sizes)]
    parts = rows.mapInArrow(partial(_scores, columns=columns, references=references), "n bigint, total double, bound double")
    found = parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("bound").alias("bound")).first()
    return {"rows": found["n"], "reference_rows": sum(len(r[2]) for r in references), "silhouette_score": found["total"] / found["n"],
            "error_bound": found["bound"] / found["n"]}
