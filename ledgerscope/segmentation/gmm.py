"""Diagonal Gaussian mixtures by expectation-maximisation.

Tasks turn their rows into sums (weights, weighted values, weighted squares);
Spark adds the sums; the driver holds only the parameters. All component counts
and restarts advance together, so one pass per iteration serves every model. They start from mixtures fitted
to a weighted coreset, and advance over all rows until the likelihood of all rows settles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerscope.segmentation.coreset import draw_coreset, weighted_kmeans
from ledgerscope.segmentation.prepare import ID

REG_COVAR = 1e-6
TOLERANCE = 1e-3


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    columns: list[str]
    bound: float = -np.inf
    converged: bool = False

    def label(self, rows: DataFrame, name: str = "label") -> DataFrame:
        """Most likely component per row, as Column arithmetic."""
        best = None
        for i in range(len(self.weights)):
            constant = float(np.log(self.weights[i]) - 0.5 * np.log(2 * np.pi * self.variances[i]).sum())
            density = F.lit(constant)
            for c, m, v in zip(self.columns, self.means[i], self.variances[i]):
                density = density - (F.col(c) - F.lit(float(m))) * (F.col(c) - F.lit(float(m))) / F.lit(float(2 * v))
            # Largest density first, then the smaller number.
            pair = F.struct(density.alias("d"), F.lit(-i).alias("i"))
            best = pair if best is None else F.greatest(best, pair)
        return rows.withColumn(name, -best["i"])


def _update(sums: np.ndarray, k: int, d: int, columns: list[str]) -> Mixture:
    mass = sums[:k] + 10 * np.finfo(float).eps
    means = sums[k:k + k * d].reshape(k, d) / mass[:, None]
    variances = sums[k + k * d:k + 2 * k * d].reshape(k, d) / mass[:, None] - means ** 2 + REG_COVAR
    return Mixture(mass / mass.sum(), means, np.maximum(variances, REG_COVAR), columns)


def _responsibilities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of each component, log-likelihood) per row."""
    log_p = (np.log(weights) - 0.5 * np.log(2 * np.pi * variances).sum(axis=1)
             - 0.5 * ((x ** 2) @ (1 / variances).T - 2 * x @ (means / variances).T + (means ** 2 / variances).sum(axis=1)))
    top = log_p.max(axis=1, keepdims=True)
    norm = top[:, 0] + np.log(np.exp(log_p - top).sum(axis=1))
    return np.exp(log_p - norm[:, None]), norm


def _moments(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.concatenate([share.sum(axis=0), (share.T @ x).ravel(), (share.T @ x ** 2).ravel()])


def _warm(x: np.ndarray, w: np.ndarray, columns: list[str], k: int, max_iter: int, seed: int) -> Mixture:
    """A mixture fitted to weighted rows from the moments of a k-means labelling."""
    centers, _ = weighted_kmeans(x, w, k, 20, seed)
    near = np.argmin((centers ** 2).sum(axis=1) - 2 * x @ centers.T, axis=1)
    member = np.zeros((len(x), k))
    member[np.arange(len(x)), near] = w
    member = member[:, member.sum(axis=0) > 0]
    k, d = member.shape[1], x.shape[1]
    model = _update(_moments(x, member), k, d, columns)
    for _ in range(max_iter):
        share, norm = _responsibilities(x, model.weights, model.means, model.variances)
        new = _update(_moments(x, share * w[:, None]), k, d, columns)
        new.bound = float((norm * w).sum() / w.sum())
        done, model = abs(new.bound - model.bound) < TOLERANCE, new
        if done:
            break
    return model


def _starts(sample: DataFrame, columns: list[str], jobs: list[tuple[int, int]], max_iter: int, seed: int,
            coreset: DataFrame | None = None) -> dict[int, Mixture | Exception]:
    """Per job, a mixture fitted to a weighted coreset, one task each, from which few passes over all rows are left."""
    spark = sample.sparkSession
    if coreset is None:
        coreset = draw_coreset(sample.select(ID, *columns), seed=seed)
    rows = np.array(coreset.select(*columns, "weight").orderBy(ID).collect(), dtype=np.float64)
    if not len(rows):
        raise ValueError("no customers to group")
    data = spark.sparkContext.broadcast((rows[:, :-1], rows[:, -1]))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, w = data.value
        for batch in batches:
            for number, k, restart in zip(*[batch[c].to_pylist() for c in ("number", "k", "restart")]):
                numbers, error = [None] * 3, None
                try:
                    m = _warm(x, w, columns, k, max_iter, seed + restart)
                    numbers = [m.weights.tolist(), m.means.ravel().tolist(), m.variances.ravel().tolist()]
                except Exception as exc:
                    error = str(exc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), *[pa.array([v], pa.list_(pa.float64())) for v in numbers], pa.array([error], pa.string())],
                    names=["number", "weights", "means", "variances", "error"])

    listed = spark.createDataFrame([(n, k, r) for n, (k, r) in enumerate(jobs)], "number bigint, k bigint, restart bigint")
    found = listed.repartition(min(len(jobs), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(
        fit, "number bigint, weights array<double>, means array<double>, variances array<double>, error string").collect()
    data.unpersist()
    shape = lambda r, name: np.array(r[name]).reshape(len(r["weights"]), len(columns))
    return {r["number"]: RuntimeError(r["error"]) if r["error"] is not None
            else Mixture(np.array(r["weights"]), shape(r, "means"), shape(r, "variances"), columns) for r in found}


def _expectation(sample: DataFrame, columns: list[str], models: dict[int, Mixture]) -> dict[int, np.ndarray]:
    """Summed responsibilities and moments per model; the log-likelihood and row count come last."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast({i: (m.weights, m.means, m.variances) for i, m in models.items()})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, means, variances = [np.concatenate([m[i] for m in shared.value.values()]) for i in range(3)]
        # Log-densities of all components of all models in one product with the values and their squares.
        factors = np.concatenate([means / variances, -0.5 / variances], axis=1).T
        constant = np.log(weights) - 0.5 * (np.log(2 * np.pi * variances) + means ** 2 / variances).sum(axis=1)
        ends = np.cumsum([len(m[0]) for m in shared.value.values()])
        spans = list(zip(ends - [len(m[0]) for m in shared.value.values()], ends))
        mass, moments, bound, rows = np.zeros(len(weights)), np.zeros((len(weights), 2 * len(columns))), np.zeros(len(spans)), 0
        for batch in batches:
            x = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            both = np.concatenate([x, x ** 2], axis=1)
            share = both @ factors
            share += constant
            for i, (a, b) in enumerate(spans):
                top = share[:, a:b].max(axis=1, keepdims=True)
                part = np.exp(share[:, a:b] - top)
                norm = part.sum(axis=1, keepdims=True)
                share[:, a:b] = part / norm
                bound[i] += (top + np.log(norm)).sum()
            mass += share.sum(axis=0)
            moments += share.T @ both
            rows += len(x)
        d = len(columns)
        for i, (number, (a, b)) in enumerate(zip(shared.value, spans)):
            total = np.concatenate([mass[a:b], moments[a:b, :d].ravel(), moments[a:b, d:].ravel(), [bound[i], float(rows)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), number, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                             names=["model", "position", "value"])

    parts = sample.select(columns).mapInArrow(sums, "model int, position int, value double")
    added = parts.groupBy("model", "position").agg(F.sum("value").alias("value")).toPandas()
    shared.unpersist()
    return {int(n): g.sort_values("position")["value"].to_numpy() for n, g in added.groupby("model")}


def _component_labels(batches: Iterator[pa.RecordBatch], models: dict[str, Mixture]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = []
        for m in models.values():
            x = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in m.columns])
            constant = np.log(m.weights) - 0.5 * np.log(2 * np.pi * m.variances).sum(axis=1)
            density = np.stack([c - ((x - mean) ** 2 / (2 * v)).sum(axis=1) for c, mean, v in zip(constant, m.means, m.variances)], axis=1)
            labels.append(pa.array(density.argmax(axis=1).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *labels], names=[*batch.schema.names, *models])


def with_components(rows: DataFrame, models: dict[str, Mixture]) -> DataFrame:
    """All rows with their most likely component, a column per mixture, in one pass; ties go to the smaller number."""
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` int" for n in models])
    return rows.mapInArrow(partial(_component_labels, models=models), kind)


def fit_mixtures(sample: DataFrame, columns: list[str], component_counts: list[int], n_init: int = 2,
                 max_iter: int = 200, seed: int = 42, coreset: DataFrame | None = None) -> dict[int, Mixture | Exception]:
    """Best mixture per component count, or the error that stopped it. ``coreset``: of the same rows and seed, where it was drawn before."""
    jobs = [(k, r) for k in component_counts for r in range(n_init)]
    starts = _starts(sample, columns, jobs, max_iter, seed, coreset)
    models = {n: m for n, m in starts.items() if isinstance(m, Mixture)}
    failed = {jobs[n][0]: e for n, e in starts.items() if n not in models}
    for _ in range(max_iter):
        running = {n: m for n, m in models.items() if not m.converged}
        if not running:
            break
        for number, sums in _expectation(sample, columns, running).items():
            old = models[number]
            k, d = len(old.weights), len(columns)
            new = _update(sums, k, d, columns)
            new.bound = sums[-2] / sums[-1]
            new.converged = abs(new.bound - old.bound) < TOLERANCE
            models[number] = new
    out: dict[int, Mixture | Exception] = {}
    for k in component_counts:
        restarts = [models[n] for n, (count, _) in enumerate(jobs) if count == k and n in models]
        usable = [m for m in restarts if np.isfinite(m.bound)]
        out[k] = max(usable, key=lambda m: m.bound) if usable else failed.get(k, RuntimeError("no finite likelihood"))
    return out
