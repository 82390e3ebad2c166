"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of consecutive words of a benchmark item is a pattern; an item with
fewer words is one pattern of its own length. Patterns of one length share a table:
a block is two consecutive words (one for single-word patterns), ``shift`` says how
far the cursor may jump when a block ends at it, and a block with shift 0 selects,
by the hash of a pattern's last block, the bucket of patterns to test. Hashes of
whole windows thin a bucket out; a comparison of the words themselves confirms.

The shift table has sixteen slots for each block of its patterns, so most blocks of a clean
text find an empty one and jump a whole pattern.

Many cursors advance together, one per stretch of a batch of documents. Benchmarks
are the stated query set: patterns come in blocks of at most ``block_bytes``, one
pass over the documents each, so what a task holds does not grow with them. Between passes only
the hits of contaminated texts are kept, under two hashes of the text.

Defined results: a null or empty text has no words and no hits. Rows are judged one
by one, so repeated rows agree. An item with a null id marks words but is not listed. Other
columns may have any names and come back as they were.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerscope.llm.texts import check_free, combine, packed, plain, scan_words, small_batches, text_chunks, unpacked
from ledgerscope.session import cut_lineage, new_folder, write_and_read

WINDOW = 10
BLOCK_BYTES = 8 << 20
STRETCH = 64
_SLOTS_PER_BLOCK, _FEWEST_SLOTS, _MOST_SLOTS = 16, 1 << 12, 1 << 24
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_HITS_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())),
])


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(pattern, n_words, items): distinct windows of folded words with the ids of the items that hold them."""
    def windows(texts: pa.Array) -> pa.Array:
        out = []
        for data, bounds in text_chunks(texts):
            words = scan_words(data, bounds)
            for a, b in zip(words.first[:-1], words.first[1:]):
                size = min(window, b - a)
                out.append([words.bytes_of(i, i + size) for i in range(a, b - size + 1)] if size else [])
        return pa.array(out, pa.list_(pa.binary()))

    found = F.arrow_udf(windows, T.ArrayType(T.BinaryType()))(plain(text_col))
    per_item = benchmark.select(plain(id_col).cast("string").alias("item"), F.explode(F.array_distinct(found)).alias("pattern"))
    return per_item.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Patterns:
    """Wu-Manber tables of one block of patterns, one table per pattern length."""

    def __init__(self, rows: list[tuple[bytes, list[str]]]):
        self.text, self.items = [bytes(p) for p, _ in rows], [list(i) for _, i in rows]
        by_length = defaultdict(list)
        for k, p in enumerate(self.text):
            by_length[p.count(b" ") + 1].append(k)
        self.tables = {size: self._table(size, np.array(ids)) for size, ids in sorted(by_length.items())}

    def _table(self, size: int, ids: np.ndarray) -> dict:
        joined = b" ".join(self.text[k] for k in ids)
        raw = np.frombuffer(joined, np.uint8)
        words = scan_words(raw, np.array([0, len(raw)])).hashes
        step = min(2, size)
        blocks = combine(words, step)
        heads = np.arange(len(ids)) * size
        wanted = _SLOTS_PER_BLOCK * len(np.unique(blocks))
        slots = min(max(1 << (wanted - 1).bit_length(), _FEWEST_SLOTS), _MOST_SLOTS)
        shift = np.full(slots, size - step + 1, np.int32)
        for j in range(size - step + 1):  # the block that ends j words before the last possible place
            slot = (blocks[heads + j] % np.uint64(slots)).astype(np.int64)
            np.minimum.at(shift, slot, size - step - j)
        last, whole = blocks[heads + size - step], combine(words, size)[heads]
        order = np.lexsort((whole, last))
        return {"step": step, "shift": shift, "last": last[order], "whole": whole[order], "id": ids[order]}

    def search(self, words, doc_of: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, words, pattern) of every confirmed occurrence that lies in one document."""
        found = []
        for size, table in self.tables.items():
            n, step = len(words.hashes), table["step"]
            if n < size:
                continue
            blocks = combine(words.hashes, step)
            cursor = np.arange(size - 1, n, STRETCH)
            limit = np.minimum(cursor + STRETCH, n)
            while len(cursor):
                block = blocks[cursor - step + 1]
                jump = table["shift"][(block % np.uint64(len(table["shift"]))).astype(np.int64)]
                tested = jump == 0
                if tested.any():
                    found += self._confirm(words, doc_of, size, table, cursor[tested], block[tested])
                cursor = cursor + np.maximum(jump, 1)
                going = cursor < limit
                cursor, limit = cursor[going], limit[going]
        return found

    def _confirm(self, words, doc_of, size, table, ends, blocks):
        starts = ends - size + 1
        inside = doc_of[starts] == doc_of[ends]
        starts, blocks = starts[inside], blocks[inside]
        low, high = np.searchsorted(table["last"], blocks, "left"), np.searchsorted(table["last"], blocks, "right")
        keep = low < high
        starts, low, high = starts[keep], low[keep], high[keep]
        whole = np.zeros(len(starts), np.uint64)
        if len(starts):
            whole = combine(words.hashes[starts[:, None] + np.arange(size)].ravel(), size)[::size]
        out = []
        while len(starts):  # one test string of each bucket at a time
            for k in np.flatnonzero(table["whole"][low] == whole):
                pattern, a = int(table["id"][low[k]]), int(starts[k])
                if words.bytes_of(a, a + size) == self.text[pattern]:
                    out.append((a, size, pattern))
            low = low + 1
            left = low < high
            starts, whole, low, high = starts[left], whole[left], low[left], high[left]
        return out


def _runs_of(spans) -> list[list[int]]:
    """Maximal runs of the union of (start, end) spans."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def _hit(n_words: int, spans, items) -> dict:
    runs = _runs_of(spans)
    return {"n_words": n_words, "n_hit": sum(b - a for a, b in runs), "hits": [{"start": a, "end": b} for a, b in runs], "items": sorted(items)}


def _marker(patterns: Patterns):
    """Column function: the hits of one block of patterns in a text."""
    def mark(texts: pa.Array) -> pa.Array:
        out = []
        for data, bounds in text_chunks(texts):
            words = scan_words(data, bounds)
            n_rows = len(bounds) - 1
            doc_of = np.repeat(np.arange(n_rows), np.diff(words.first))
            spans, items = defaultdict(set), defaultdict(set)
            for a, size, pattern in patterns.search(words, doc_of):
                row = int(doc_of[a])
                spans[row].add((a - int(words.first[row]), a - int(words.first[row]) + size))
                items[row].update(patterns.items[pattern])
            out += [_hit(int(words.first[row + 1] - words.first[row]), spans.get(row, ()), items.get(row, ())) for row in range(n_rows)]
        return pa.array(out, _HITS_ARROW)

    return F.arrow_udf(mark, HITS)


def _merger():
    """Column function: hits of one block joined with those of the others."""
    def merge(marks: pa.Array, hits: pa.Array, items: pa.Array) -> pa.Array:
        out = []
        for mark, more, names in zip(marks.to_pylist(), hits.to_pylist(), items.to_pylist()):
            if more:
                spans = {(h["start"], h["end"]) for h in [*mark["hits"], *more]}
                mark = _hit(mark["n_words"], spans, {*mark["items"], *names})
            out.append(mark)
        return pa.array(out, _HITS_ARROW)

    return F.arrow_udf(merge, HITS)


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
                       name: str = "_bench") -> DataFrame:
    """``docs`` with a new struct column ``name``: n_words, n_hit, hits (word runs covered by windows), items.

    The patterns of one block are collected and sent to the tasks: at most about ``block_bytes``
    of them, plus one pattern.
    """
    check_free(docs, name)
    spark = docs.sparkSession
    small_batches(spark)
    windows = cut_lineage(item_windows(benchmark, window, item_id, item_text).withColumn(
        "bytes", F.octet_length("pattern") + F.octet_length(F.array_join("items", ",")) + 16))
    total = windows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_bytes))

    def marked(texts: DataFrame, block: int, text: Column) -> DataFrame:
        part = windows.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block) if blocks > 1 else windows
        patterns = Patterns([(r["pattern"], r["items"]) for r in part.select("pattern", "items").orderBy("pattern").collect()])
        return texts.withColumn("marks", _marker(patterns)(text))

    own = F.col("row").getField(text_col)
    rows = marked(docs.select(packed(docs)), 0, own)
    if blocks > 1:
        def key(text: Column) -> list[Column]:
            return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]

        later = None
        for block in range(1, blocks):
            found = marked(docs.select(plain(text_col).alias("text")), block, F.col("text")).where("marks.n_hit > 0").select(*key(F.col("text")), "marks").groupBy("k1", "k2").agg(
                F.first("marks").alias("marks"))  # one row per distinct text that this block hits
            found = write_and_read(found, new_folder(spark, "bench-block"))
            later = found if later is None else later.unionByName(found)
        merged = later.groupBy("k1", "k2").agg(F.flatten(F.collect_list("marks.hits")).alias("hits"), F.flatten(F.collect_list("marks.items")).alias("items"))
        merged = write_and_read(merged, new_folder(spark, "bench-hits"))
        joined = rows.select("row", "marks", *key(own)).join(merged, ["k1", "k2"], "left")
        rows = joined.select("row", _merger()("marks", "hits", "items").alias("marks"))
    return rows.select(*unpacked(docs), F.col("marks").alias(name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a word inside an occurrence of any window; their columns as they were."""
    name = "marks"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    marked = mark_contamination(docs, benchmark, text_col=text_col, name=name, **options)
    return marked.where(F.col(name)["n_hit"] == 0).select(*[plain(c) for c in docs.columns])


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit runs."""
    marked = mark_contamination(docs.select("doc_id", "text"), benchmark, name="marks")
    hit = F.col("marks")
    return marked.select(
        "doc_id", hit["n_words"].alias("n_words"), hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(hit["items"]), ","), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"))
