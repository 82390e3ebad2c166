"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

Every token owns a sparse random vector that its hash determines. A token's word vector is
the sum of the random vectors of its neighbours and its own, over all documents. Tokens are words,
runs of punctuation, and marks for a word's shape and for a word that repeats one just
before; word and punctuation hashes share 2**15 places. A document is the mean of its
tokens' vectors. A network with one hidden layer of tanh units maps it to a log-odds, which a
temperature, fitted on labelled rows that the network has not seen, calibrates.

Word vectors need no labels and are summed in tasks over the whole corpus; their table has a fixed size. The
network takes about ``TRAIN_ROWS`` labelled rows chosen by hash (all, where there are fewer). Only that table and the
pooled vectors of the fitting rows reach the driver. Every text is then scored whole.

Defined results: a null or empty text has the zero vector and the score of one. Without
labelled rows every score is 0.5. Several labels of one id count as their mean, rounded up
at a half; several rows of one id are fitted each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.llm.texts import WORD_BYTES, check_free, mix, packed, plain, scan_words, small_batches, text_chunks, unpacked
from ledgerscope.session import new_folder, write_and_read

TRAIN_ROWS = 6000
DIMENSIONS = 48
NONZEROS = 6
PLACES = 1 << 15
MARKS = 6  # lower, title, upper and other shapes; a word equal to the last one, or to the one before
REACH = 2
HIDDEN = 32
THRESHOLD = 0.7
_SEED = 20240607
PUNCTUATION = np.where((np.arange(256) > 0x20) & (np.arange(256) < 0x7F) & (WORD_BYTES == 0), np.arange(256), 0).astype(np.uint8)
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)


def random_vectors() -> np.ndarray:
    """One sparse vector of +-1 per token place and mark."""
    n = PLACES + MARKS
    out = np.zeros((n, DIMENSIONS), np.float32)
    for k in range(NONZEROS):
        h = mix(np.arange(n, dtype=np.uint64) * np.uint64(NONZEROS) + np.uint64(k + 1))
        out[np.arange(n), (h % np.uint64(DIMENSIONS)).astype(np.int64)] += np.where(h >> np.uint64(63), 1.0, -1.0)
    return out


@dataclass
class Tokens:
    """Token places, document of each and place in the text."""

    ids: np.ndarray
    rows: np.ndarray
    at: np.ndarray


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> Tokens:
    n = len(bounds) - 1
    words = scan_words(data, bounds)
    marks = scan_words(data, bounds, PUNCTUATION)
    row = np.repeat(np.arange(n), np.diff(words.first))
    place = (words.hashes % np.uint64(PLACES)).astype(np.int64)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    n_upper, size = capitals[words.ends] - capitals[words.starts], words.ends - words.starts
    title = (n_upper == 1) & _UPPER[data[words.starts]] if len(size) else np.zeros(0, bool)
    shape = np.where(n_upper == 0, 0, np.where(title, 1, np.where(2 * n_upper >= size, 2, 3)))
    repeats = []
    for back in (1, 2):
        same = np.zeros(len(place), bool)
        same[back:] = (words.hashes[back:] == words.hashes[:-back]) & (row[back:] == row[:-back])
        repeats.append(np.flatnonzero(same))
    punctuation = (mix(marks.hashes + np.uint64(1)) % np.uint64(PLACES)).astype(np.int64)
    ids = [place, PLACES + shape, np.full(len(repeats[0]), PLACES + 4), np.full(len(repeats[1]), PLACES + 5), punctuation]
    rows = [row, row, row[repeats[0]], row[repeats[1]], np.repeat(np.arange(n), np.diff(marks.first))]
    at = [4 * words.starts, 4 * words.starts + 1, 4 * words.starts[repeats[0]] + 2, 4 * words.starts[repeats[1]] + 3, 4 * marks.starts]
    return Tokens(np.concatenate(ids), np.concatenate(rows), np.concatenate(at))


def pooled(data: np.ndarray, bounds: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean token vector per document; zero without tokens."""
    tokens, n = tokens_of(data, bounds), len(bounds) - 1
    out = np.zeros((n, vectors.shape[1]), np.float64)
    order = np.argsort(tokens.rows, kind="stable")
    ids, rows = tokens.ids[order], tokens.rows[order]
    count = np.bincount(rows, minlength=n)
    some = np.flatnonzero(count)
    low = 0
    starts = np.cumsum(count) - count
    while low < len(some):  # a bounded number of gathered vectors at a time
        high = max(low + 1, int(np.searchsorted(starts[some] + count[some], starts[some[low]] + (1 << 16), "right")))
        part = some[low:high]
        a, b = starts[part[0]], starts[part[-1]] + count[part[-1]]
        if b - a <= 1 << 17:
            out[part] = np.add.reduceat(vectors[ids[a:b]], starts[part] - a, axis=0)
        else:  # one long text
            out[part[0]] = np.bincount(ids[a:b], minlength=len(vectors)) @ vectors.astype(np.float64)
        low = high
    return out / np.maximum(count, 1)[:, None]


def _sum_contexts(batches):
    """Per task: for each token place the sum of its neighbours' random vectors."""
    index, total = random_vectors(), np.zeros((PLACES + MARKS, DIMENSIONS), np.float32)
    met = np.zeros(PLACES + MARKS, bool)
    for batch in batches:
        for data, bounds in text_chunks(batch.column(0), 1 << 18):
            tokens = tokens_of(data, bounds)
            order = np.argsort(tokens.at, kind="stable")
            ids, rows = tokens.ids[order], tokens.rows[order]
            context = index[ids]
            for step in range(1, REACH + 1):
                same = (rows[step:] == rows[:-step])[:, None]
                context[step:] += index[ids[:-step]] * same
                context[:-step] += index[ids[step:]] * same
            by = np.argsort(ids, kind="stable")
            if len(by):
                heads = np.flatnonzero(np.diff(ids[by], prepend=-1))
                total[ids[by][heads]] += np.add.reduceat(context[by], heads, axis=0)
                met[ids] = True
    places = np.flatnonzero(met)
    for low in range(0, len(places), 4096):
        part = places[low:low + 4096]
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * DIMENSIONS, pa.int32()), pa.array(total[part].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part), values], names=["place", "v"])


def word_vectors(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors per token place; places that no text holds keep their random vector."""
    parts = texts.select(plain(text_col)).mapInArrow(_sum_contexts, "place bigint, v array<float>")
    summed = parts.groupBy("place").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIMENSIONS)])
    found = summed.toPandas()  # at most PLACES + MARKS rows
    out = random_vectors()
    out[found["place"].to_numpy(int)] = found.drop(columns="place").to_numpy(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray, rounds: int = 120, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Minimise the cross entropy with Adam over shuffled batches."""
    rng = np.random.default_rng(_SEED)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
                  np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)
    z = (x - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(rounds):
        order = rng.permutation(len(z))
        for low in range(0, len(z), batch):
            part = order[low:low + batch]
            hidden = np.tanh(z[part] @ weights[0] + weights[1])
            gap = (1.0 / (1.0 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -500, 500))) - y[part]) / len(part)
            back = np.outer(gap, weights[2]) * (1 - hidden ** 2)
            slopes = [z[part].T @ back + decay * weights[0], back.sum(axis=0), hidden.T @ gap + decay * weights[2], np.array([gap.sum()])]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope ** 2
                weights[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    return net


def fit_temperature(log_odds: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross entropy, from 0.25 to 16 in fine steps."""
    choices = np.exp(np.linspace(np.log(0.25), np.log(16.0), 121))
    loss = [np.mean(np.logaddexp(0, np.where(y > 0.5, -1, 1) * log_odds / t)) for t in choices]
    return float(choices[int(np.argmin(loss))])


@dataclass
class QualityModel:
    vectors: np.ndarray | None
    network: Network | None


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on about ``train_rows`` of the labelled rows; a fifth of them only sets the temperature."""
    small_batches(docs.sparkSession)
    one = labels.where(plain(label_col).isNotNull() & plain(id_col).isNotNull()).groupBy(plain(id_col).alias("_id")).agg(
        F.round(F.avg(plain(label_col))).cast("int").alias("_y"))
    n = one.count()
    place = F.pmod(F.xxhash64(F.lit(23), "_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = one.where(place < train_rows / max(n, 1))  # about train_rows short rows, whatever the size of the table
    split = F.pmod(F.xxhash64(F.lit(29), "_id"), F.lit(5)) == 0
    texts = docs.select(plain(id_col).alias("id"), plain(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("text", "_y", split.alias("_hold"))
    sample = write_and_read(sample, new_folder(docs.sparkSession, "quality-sample"))
    sizes = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return QualityModel(None, None)
    vectors = word_vectors(docs, text_col)
    rows = sample.select(_pool(vectors)(F.col("text")).alias("x"), "_y", "_hold").toPandas()  # fixed-size vectors of the sample
    rows = rows.sort_values("x", key=lambda c: c.map(bytes), kind="stable")
    x = np.stack([np.frombuffer(v) for v in rows["x"]])
    y, hold = rows["_y"].to_numpy(float), rows["_hold"].to_numpy(bool)
    if hold.all() or len(set(y[~hold])) < 2:
        hold = np.zeros(len(y), bool)
    network = fit_network(x[~hold], y[~hold])
    if hold.any():
        network.temperature = fit_temperature(network.log_odds(x[hold]), y[hold])
    return QualityModel(vectors.astype(np.float32), network)


def _pool(vectors: np.ndarray):
    def pool(texts: pa.Array) -> pa.Array:
        return pa.array([v.tobytes() for data, bounds in text_chunks(texts) for v in pooled(data, bounds, vectors)], pa.binary())

    return F.arrow_udf(pool, "binary")


def score_column(model: QualityModel, text: Column) -> Column:
    if model.network is None:
        return F.lit(0.5)

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *[
            model.network.scores(pooled(data, bounds, model.vectors)) for data, bounds in text_chunks(texts)]]))

    return F.arrow_udf(score, "double")(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    check_free(docs, name)
    return docs.withColumn(name, score_column(model, plain(text_col)))


def learnable(id_col: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, modulo 4, is not 2; never a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 != 2, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``; their columns as they were."""
    model = fit_quality(docs, labels.where(learnable(F.col("doc_id"))))
    rows = docs.select(packed(docs))
    return rows.where(score_column(model, F.col("row.text")) >= threshold).select(*unpacked(docs)) if model.network else docs


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels.where(learnable(F.col("doc_id"))))
    scored = score_quality(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
