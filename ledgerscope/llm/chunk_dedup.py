"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 32 bytes marks cut points, so chunk borders follow
the content and meet again after an insertion. Chunks are compared by a 128-bit
digest over the whole corpus: the document with the smallest id keeps the first
occurrence, every other occurrence is removed. Repeats inside a document are found
where it is cut, so each document sends a digest at most once and a digest that many
documents hold is counted by partial sums; the join back splits its rows. A tail shorter
than the smallest chunk belongs to the chunk before it, so a common ending alone stays.
Neighbouring chunks that go form a run; a run of fewer than ``least_run`` bytes stays unless it is
the whole text, so that documents which happen to share a short phrase are left alone.

Defined results: a null or empty text has no chunks. Rows that share an id count as
one document. A null id keeps a chunk only if no other id has it. Cuts lie between
characters, so what is left is a text. Other columns may have any names and come back
as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.texts import mix, packed, plain, row_key, small_batches, text_chunks, unpacked

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 32, 5, 256
LEAST_RUN = 64
_REACH = 32
_BLOCK = 1 << 20
_CHUNKS = "start bigint, length int, d1 bigint, d2 bigint, again boolean"
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_marks(data: np.ndarray, mask_bits: int) -> np.ndarray:
    """Places after which the gear hash asks for a cut."""
    found = []
    for low in range(0, len(data), _BLOCK):
        before = min(low, _REACH - 1)
        h = GEAR[data[low - before:low + _BLOCK]]
        for step in (1, 2, 4, 8, 16):
            grown = h.copy()
            grown[step:] += h[:-step] << np.uint32(step)
            h = grown
        found.append(np.flatnonzero(h[before:] >> np.uint32(32 - mask_bits) == 0) + low + 1)
    marks = np.concatenate(found) if found else np.zeros(0, np.int64)
    marks = marks[marks < len(data)]
    return marks[data[marks] & 0xC0 != 0x80]


def chunk_ends(data: np.ndarray, smallest: int = MIN_CHUNK, mask_bits: int = MASK_BITS, largest: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of one text: lengths from ``smallest`` to ``largest`` bytes; a shorter text is one chunk."""
    ends, last = [], 0

    def fill(upto: int) -> int:
        at = last
        while upto - at > largest:
            at += largest
            while data[at] & 0xC0 == 0x80:
                at -= 1
            ends.append(at)
        return at

    for mark in cut_marks(data, mask_bits).tolist():
        last = fill(mark)
        if mark - last >= smallest:
            ends.append(mark)
            last = mark
    fill(len(data))
    if ends and len(data) - ends[-1] < smallest:  # a short tail joins the chunk before it
        ends.pop()
        if len(data) - (ends[-1] if ends else 0) > largest:
            at = len(data) - smallest
            while data[at] & 0xC0 == 0x80:
                at -= 1
            ends.append(at)
    if len(data):
        ends.append(len(data))
    return ends


def _cut(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row0 = 0
        for data, bounds in text_chunks(batch.column(0)):
            rows, starts, lengths, first, second, again = [], [], [], [], [], []
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                seen, start, piece = set(), 0, data[a:b]
                for end in chunk_ends(piece, *sizes):
                    digest = xxhash.xxh3_128_intdigest(piece[start:end])
                    rows.append(row0 + row)
                    starts.append(start)
                    lengths.append(end - start)
                    first.append(digest >> 64)
                    second.append(digest & 0xFFFFFFFFFFFFFFFF)
                    again.append(digest in seen)
                    seen.add(digest)
                    start = end
            row0 += len(bounds) - 1
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(take) for i in range(1, batch.num_columns)], pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()),
                 pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64)),
                 pa.array(again, pa.bool_())],
                names=[*batch.schema.names[1:], "start", "length", "d1", "d2", "again"])


def content_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   sizes: tuple[int, int, int] = (MIN_CHUNK, MASK_BITS, MAX_CHUNK)) -> DataFrame:
    """(id, key, start, length, d1, d2, again) per chunk; ``again``: the document had it before."""
    rows = docs.select(plain(text_col).alias("_text"), plain(id_col).alias("id"), row_key(plain(text_col)).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(partial(_cut, sizes=sizes), f"id {kind}, key bigint, {_CHUNKS}")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    sizes: tuple[int, int, int] = (MIN_CHUNK, MASK_BITS, MAX_CHUNK)) -> DataFrame:
    """(id, key, lost): per document that loses bytes, the (start, length) of its removed chunks."""
    chunks = content_chunks(docs, id_col, text_col, sizes)
    held = chunks.where(~F.col("again")).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper"))
    shared = held.where(F.col("n") > 1).select("d1", "d2", "keeper", F.lit(True).alias("shared"))
    lost = chunks.join(shared, ["d1", "d2"], "left").where(
        F.col("again") | (F.col("shared") & ~F.col("id").eqNullSafe(F.col("keeper"))))
    return lost.groupBy("id", "key").agg(F.collect_set(F.struct("start", "length")).alias("lost"))


def cut_out(texts: pa.Array, starts: pa.Array, ends: pa.Array, least: int = 0) -> tuple[pa.Array, list[int], list[int]]:
    """Texts as bytes without the given ranges, with the bytes and the maximal runs removed. Ranges are lists per row.

    Runs of fewer than ``least`` bytes stay unless they are the whole text.
    """
    left, removed, runs, row0 = [], [], [], 0
    starts, ends = starts.to_pylist(), ends.to_pylist()
    for data, bounds in text_chunks(texts):
        for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            piece, merged = data[a:b], []
            for s, e in sorted(zip(starts[row0 + row] or (), ends[row0 + row] or ())):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            merged = [m for m in merged if m[1] - m[0] >= min(least, len(piece))]
            at, parts = 0, []
            for s, e in merged:
                parts.append(piece[at:s].tobytes())
                at = e
            parts.append(piece[at:].tobytes())
            left.append(b"".join(parts))
            removed.append(sum(e - s for s, e in merged))
            runs.append(len(merged))
        row0 += len(bounds) - 1
    return left, removed, runs


def removal_udf(least: int = 0):
    """Column function (text, starts, ends) -> struct of the bytes left, the bytes removed and the removed runs."""
    def remove(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        left, removed, runs = cut_out(texts, starts, ends, least)
        return pa.StructArray.from_arrays(
            [pa.array(left, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            ["left", "n_removed", "n_spans"])

    return F.arrow_udf(remove, "left binary, n_removed bigint, n_spans bigint")


def _joined(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, int, int], least_run: int) -> DataFrame:
    """(row, left, n_removed, n_spans): all columns of ``docs`` in a struct, and what is left of the text."""
    small_batches(docs.sparkSession)
    lost = repeated_chunks(docs, id_col, text_col, sizes).select(
        F.col("id").alias("other_id"), F.col("key").alias("other_key"), F.transform("lost", lambda s: s["start"]).alias("starts"),
        F.transform("lost", lambda s: s["start"] + s["length"]).alias("ends"))
    keyed = docs.select(packed(docs), plain(id_col).alias("id"), row_key(plain(text_col)).alias("key"))
    found = keyed.join(lost, (F.col("key") == F.col("other_key")) & F.col("id").eqNullSafe(F.col("other_id")), "left")
    return found.select("row", removal_udf(least_run)(F.col("row").getField(text_col), "starts", "ends").alias("cut")).select("row", "cut.left", "cut.n_removed", "cut.n_spans")


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 sizes: tuple[int, int, int] = (MIN_CHUNK, MASK_BITS, MAX_CHUNK), least_run: int = LEAST_RUN) -> DataFrame:
    """The documents without repeated chunks; null texts and all other columns as they were."""
    left = F.when(F.col("row").getField(text_col).isNotNull(), F.decode("left", "UTF-8"))
    return _joined(docs, id_col, text_col, sizes, least_run).select(*unpacked(docs, **{text_col: left}))


def chunk_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per document."""
    found = _joined(docs.select("doc_id", "text"), "doc_id", "text", (MIN_CHUNK, MASK_BITS, MAX_CHUNK), LEAST_RUN)
    return found.select("row.doc_id", F.octet_length(F.coalesce("row.text", F.lit(""))).cast("bigint").alias("n_bytes"),
                        "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"))
