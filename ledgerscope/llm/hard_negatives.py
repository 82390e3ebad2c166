"""Hard-negative mining by a secondary sort.

Scores. Anchors and rows are cut into blocks, and each cell (anchor block, row block) is scored by one
matrix product per tile of rows. A cell keeps, per anchor, only the rows that can still be among the
results: its best positives in a first round, and in a second, when the positives are known, its
best rows inside each positive's window. So the shuffle carries a few keys per anchor and row block,
never all pairs, and nothing that can reach the result is left out.

Order. Each kept pair is packed into one binary key (anchor, descending score, positives first, id).
Keys are dealt by anchor and sorted within partitions, the DataFrame form of
``repartitionAndSortWithinPartitions``. One streaming pass over the sorted keys opens a window at each
positive and emits the negatives that fall into it; it holds the open windows of one anchor, never its rows.

Scores are exact integers: components become ``floor(scale * x)`` and products are summed as
doubles. Scores of 2**52 or more raise an error, so every sum is exact.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part;
an empty vector scores 0 with everything. Shorter vectors count as padded with zeros. Rows that
share an id count once, the one with the smallest label, then the smallest vector. Ids are integers.
Equal scores are ordered by the smaller id. Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.llm.texts import plain, small_batches
from ledgerscope.session import new_folder, write_and_read

ANCHOR_BLOCK, ROW_BLOCK, LEAST_BLOCK = 8192, 1 << 18, 4096
_TILE_ROWS, _TILE_ANCHORS = 512, 2048  # a place in a tile and an exact score fit one signed word
_BIAS = 1 << 63
_LOWEST = np.int64(-(1 << 62))
_EXACT = 1 << 52
POSITIVE, NEGATIVE = 0, 1


def pack(anchor: int, score: int, kind: int, row: int) -> bytes:
    """Key whose byte order is (anchor, descending score, kind, id)."""
    return b"".join(x.to_bytes(n, "big") for x, n in (
        (anchor + _BIAS, 8), (_BIAS - 1 - score, 8), (kind, 1), (row + _BIAS, 8)))


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, score, kind, id) of a key."""
    return (int.from_bytes(key[:8], "big") - _BIAS, _BIAS - 1 - int.from_bytes(key[8:16], "big"), key[16],
            int.from_bytes(key[17:], "big") - _BIAS)


def _matrix(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, one row per vector, padded to ``width``."""
    lengths = vectors.value_lengths().to_numpy()
    values = np.floor(scale * vectors.flatten().to_numpy().astype(np.float64))
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    bound = np.abs(anchors).sum(axis=1).max() * np.abs(rows).max() if anchors.size and rows.size else 0
    if not bound < _EXACT:
        raise ValueError("scores of 2**52 or more are not exact; use a smaller scale")
    return (anchors @ rows.T).astype(np.int64)


class _Best:
    """Per anchor the best ``keep`` (score, id) seen so far; rows come by ascending id, so earlier ones win ties."""

    def __init__(self, anchors: int, keep: int):
        self.keep = keep
        self.scores = np.full((anchors, keep), _LOWEST)
        self.ids = np.zeros((anchors, keep), np.int64)

    def add(self, at: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero((allowed & (scores > self.scores[at, -1:])).any(axis=1))
        if not len(some):
            return
        rows = some + at.start
        merged = np.concatenate([self.scores[rows], np.where(allowed[some], scores[some], _LOWEST)], axis=1)
        named = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
        width = merged.shape[1]
        # (score, earlier place) in one word; the lowest score only has to stay below all others
        ranked = np.maximum(merged, -_EXACT) * 1024 + (width - 1 - np.arange(width))
        best = np.argpartition(-ranked, self.keep - 1, axis=1)[:, :self.keep]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(ranked, best, 1), axis=1), 1)
        self.scores[rows] = np.take_along_axis(merged, best, 1)
        self.ids[rows] = np.take_along_axis(named, best, 1)


class _Cell:
    """The anchors of one cell, and the best rows found for them while the cell's rows stream by."""

    def __init__(self, table: pa.Table, n_positives: int, n_negatives: int, low: int, high: int, scale: float):
        self.ids, self.labels = table["id"].to_numpy(), table["label"].to_numpy()
        vectors = table["vector"].combine_chunks()
        self.width = int(max(vectors.value_lengths().to_numpy(), default=0))
        self.vectors = _matrix(vectors, self.width, scale)
        self.bounds, self.scale = (low, high), scale
        windows = table["windows"].combine_chunks()
        self.second = windows.null_count < len(windows)  # the positives are known
        if not self.second:
            self.kept = [_Best(len(self.ids), n_positives)]
            return
        lengths = windows.value_lengths().to_numpy()
        self.windows = np.zeros((len(self.ids), n_positives), np.int64)
        self.has = np.arange(n_positives) < lengths[:, None]
        self.windows[self.has] = windows.flatten().to_numpy()
        self.kept = [_Best(len(self.ids), n_negatives) for _ in range(n_positives)]

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: pa.Array) -> None:
        longest = int(max(vectors.value_lengths().to_numpy(), default=0))
        rows = _matrix(vectors, max(self.width, longest), self.scale)[:, :self.width]
        low, high = self.bounds
        for a in range(0, len(ids), _TILE_ROWS):
            b = min(a + _TILE_ROWS, len(ids))
            for c in range(0, len(self.ids), _TILE_ANCHORS):
                at = slice(c, min(c + _TILE_ANCHORS, len(self.ids)))
                scores = _scores(self.vectors[at], rows[a:b])
                same = self.labels[at, None] == labels[None, a:b]
                if not self.second:
                    self.kept[0].add(at, scores, same & (self.ids[at, None] != ids[None, a:b]), ids[a:b])
                    continue
                for k, best in enumerate(self.kept):
                    p = self.windows[at, k:k + 1]
                    inside = ~same & self.has[at, k:k + 1] & (100 * scores >= low * p) & (100 * scores <= high * p)
                    best.add(at, scores, inside, ids[a:b])

    def keys(self) -> Iterator[tuple[int, bytes]]:
        kind = NEGATIVE if self.second else POSITIVE
        for best in self.kept:
            for r, k in np.argwhere(best.scores > _LOWEST).tolist():
                anchor = int(self.ids[r])
                yield anchor, pack(anchor, int(best.scores[r, k]), kind, int(best.ids[r, k]))


def _key_batch(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([k for _, k in pairs], pa.binary())],
                                      names=["anchor", "key"])


def _score_cells(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
    """Input sorted by cell, anchors before rows, ids ascending. Keys of the pairs that can reach the result."""
    current, held, cell = None, [], None

    def close() -> Iterator[pa.RecordBatch]:
        found = list(cell.keys()) if cell else []
        for a in range(0, len(found), 10_000):
            yield _key_batch(found[a:a + 10_000])

    for batch in batches:
        cells = batch["cell"].to_numpy()
        is_row = batch["is_row"].to_numpy(zero_copy_only=False).astype(np.int8)
        edges = np.flatnonzero((np.diff(cells, prepend=cells[:1]) != 0) | (np.diff(is_row, prepend=is_row[:1]) != 0))
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if cells[a] != current:
                yield from close()
                current, held, cell = cells[a], [], None
            if not is_row[a]:
                held.append(part)
            elif held or cell:
                if cell is None:
                    cell, held = _Cell(pa.Table.from_batches(held), **options), []
                cell.add(part["id"].to_numpy(), part["label"].to_numpy(), part["vector"])
    yield from close()


def _secondary_sort(keys: DataFrame) -> DataFrame:
    """Keys dealt by anchor and sorted within each partition."""
    return keys.repartition("anchor").sortWithinPartitions("key")


def _first_positives(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """The first ``keep`` keys of each anchor, from sorted keys."""
    current, n = None, 0
    for batch in batches:
        out = []
        for key in batch["key"].to_pylist():
            anchor, score, _, _ = unpack(key)
            current, n = (current, n + 1) if anchor == current else (anchor, 1)
            if n <= keep:
                out.append((anchor, key, score))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))],
                                         names=["anchor", "key", "score"])


_RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _emit_negatives(batches: Iterator[pa.RecordBatch], keep: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """One pass over sorted keys: a positive opens a window, a negative goes to each open window that it falls into."""
    current, last, windows = None, None, []
    for batch in batches:
        out = []
        for key in batch["key"].to_pylist():
            if key == last:  # a negative that several windows of a cell kept
                continue
            last = key
            anchor, score, kind, row = unpack(key)
            if anchor != current:
                current, windows = anchor, []
            if kind == POSITIVE:
                windows.append([row, score, 0])
                continue
            windows = [w for w in windows if w[2] < keep and 100 * score >= low * w[1]]
            for w in windows:
                if 100 * score <= high * w[1]:
                    w[2] += 1
                    out.append((anchor, w[0], w[2], row, w[1], score))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int32() if n == "rank" else pa.int64())
                                          for i, n in enumerate(_RESULT)], names=list(_RESULT))


def usable_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id."""
    vector = plain(vector_col)
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    chosen = rows.select(plain(id_col).cast("bigint").alias("id"), plain(label_col).cast("bigint").alias("label"),
                         vector.alias("vector")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~broken)
    return chosen.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding", scale: float = 256.0, n_positives: int = 5, n_negatives: int = 3,
                        low: int = 50, high: int = 95, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``id``. An anchor's positives are its ``n_positives`` best other rows of the
    same label; a positive's negatives are the ``n_negatives`` best rows of other labels whose score lies between
    ``low`` and ``high`` percent of the positive's. ``anchor_block`` and ``row_block`` bound the cells only.
    """
    spark = rows.sparkSession
    small_batches(spark)
    items = write_and_read(usable_rows(rows, id_col, label_col, vector_col), new_folder(spark, "negatives-rows"))
    anchors = items.where(is_anchor)
    counts = items.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-counts["anchors"] // anchor_block))
    # As many row blocks as give each task a cell, but none so small that its best rows are most of it.
    down = max(1, -(-counts["rows"] // row_block), min(-(-tasks // across), -(-counts["rows"] // LEAST_BLOCK)))

    def dealt(df: DataFrame, own: int, others: int) -> tuple[Column, Column]:
        return F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))

    def scored(queries: DataFrame) -> DataFrame:
        own, other = dealt(queries, across, down)
        left = queries.select("id", "label", "vector", "windows", own.alias("i"), other.alias("j"), F.lit(False).alias("is_row"))
        own, other = dealt(items, down, across)
        right = items.select("id", "label", "vector", F.lit(None).cast("array<bigint>").alias("windows"),
                             own.alias("j"), other.alias("i"), F.lit(True).alias("is_row"))
        cells = left.unionByName(right).withColumn("cell", F.col("i").cast("bigint") * down + F.col("j")).drop("i", "j")
        placed = cells.repartition(min(across * down, 8 * tasks), "cell").sortWithinPartitions("cell", "is_row", "id")
        work = partial(_score_cells, n_positives=n_positives, n_negatives=n_negatives, low=low, high=high, scale=scale)
        return placed.mapInArrow(work, "anchor bigint, key binary")

    first = scored(anchors.withColumn("windows", F.lit(None).cast("array<bigint>")))
    positives = write_and_read(
        _secondary_sort(first).mapInArrow(partial(_first_positives, keep=n_positives), "anchor bigint, key binary, score bigint"),
        new_folder(spark, "negatives-positives"))
    windows = positives.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("windows"))  # n_positives at most
    second = scored(anchors.join(windows, "id"))
    return _secondary_sort(positives.select("anchor", "key").unionByName(second)).mapInArrow(
        partial(_emit_negatives, keep=n_negatives, low=low, high=high),
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def hard_negatives_digest(embeddings: DataFrame) -> DataFrame:
    """Anchors: every id divisible by 50. Where 7 divides the id, the label first moves on by one, modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", label.alias("label"), "embedding")
    return mine_hard_negatives(rows, F.col("id") % 50 == 0)
