"""Suffix-array dedup by depth-limited radix passes.

Two suffixes belong together when their first ``depth`` bytes (400) agree, so suffixes are
ordered by most-significant digits only down to that depth, never further; the equal
groups are the repeated windows.

First digit. Each window is filed under the smallest 32-byte gram inside it (the last one
among equals), taken by hash. Equal windows hold the same gram at the same distance, so
windows of different grams never meet. Neighbouring windows with the same gram at the
same place form a run, the unit that is shuffled: one row per 185 bytes or so instead of
one per byte. A gram that occurs once ends its run's sorting. Repeated grams, their runs'
contents and their groups are counted and written before they are joined, so that Spark can
split a gram that a third of all runs hold.

Second digit. The bytes under a whole run are hashed. A run whose bytes and gram place occur
again is repeated as a whole. This settles copies, however many there are.

Last digit. In groups that still hold an unsettled run, that run and one run for each settled
content are sorted by window. Groups of up to ``group_rows`` runs are sorted in one
task; larger ones send a hash per window, which is counted by partial sums.

Shorter passages. A first digit of its own, the smallest 128-byte gram of each 300 bytes, tells which documents
share a passage that is no whole window: any 300 bytes that two documents have in common put the same
gram into both. Each document gets the number of such grams that other rows hold (``n_shared``);
nothing is removed for that alone.

Defined results: texts are UTF-8 bytes, a null text is empty; texts shorter than the depth
lose nothing and repeat nothing. Rows that share id and text are copies of each other. Other columns may have any names and come back as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.llm.chunk_dedup import removal_udf
from ledgerscope.llm.texts import (
    CHUNK_BYTES, check_free, mix, packed, plain, powers, prefix_hash, row_key, small_batches, text_chunks, unpacked)
from ledgerscope.session import new_folder, write_and_read

DEPTH, GRAM = 400, 32
PASSAGE, PASSAGE_GRAM = 300, 128
GROUP_ROWS = 2000
_PLACE_BITS = 22
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
_SALT = np.uint64(0x8CB92BA72F3D8DD7)


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) from prefix sums."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[:have - width], x[width - have:])


def smallest_grams(piece: np.ndarray, reach: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the gram at each place, prefix sums, place of the smallest gram of each ``reach`` bytes)."""
    sums = prefix_hash(piece + np.uint64(1))
    n = len(piece) - gram + 1
    grams = mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][:n])
    ranked = (grams & ~_PLACE) | (_PLACE - np.arange(n).astype(np.uint64))
    return grams, sums, (_PLACE - (sliding_min(ranked, reach - gram + 1) & _PLACE)).astype(np.int64)


def window_runs(data: np.ndarray, depth: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """Runs of windows that share their smallest gram: (gram hash, run hash, first, last, gram place)."""
    out = []
    for low in range(0, len(data) - depth + 1, CHUNK_BYTES):
        grams, sums, place = smallest_grams(data[low:low + CHUNK_BYTES + depth - 1], depth, gram)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        whole = range_hash(sums, first, last + depth)
        run = mix(whole + _SALT * (at - first).astype(np.uint64) + (last - first).astype(np.uint64))
        out.append((grams[at], run, first + low, last + low, at + low))
    return out


def _runs(batches: Iterator[pa.RecordBatch], depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row0 = 0
        for data, bounds in text_chunks(batch.column(0)):
            parts, rows = [], []
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                for part in window_runs(data[a:b], depth, gram) if b - a >= depth else ():
                    parts.append(part)
                    rows.append(np.full(len(part[0]), row0 + row))
            row0 += len(bounds) - 1
            if parts:
                take = pa.array(np.concatenate(rows))
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(take), batch.column(2).take(take)]
                    + [pa.array(c.view(np.int64)) for c in columns], names=["id", "key", "gram", "run", "first", "last", "place"])


def _passage_grams(batches: Iterator[pa.RecordBatch], reach: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(document, gram): the distinct smallest grams of each text."""
    for batch in batches:
        row0 = 0
        for data, bounds in text_chunks(batch.column(0)):
            found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                text, own = data[a:b], [np.zeros(0, np.uint64)]
                for low in range(0, len(text) - reach + 1, CHUNK_BYTES):
                    grams, _, place = smallest_grams(text[low:low + CHUNK_BYTES + reach - 1], reach, gram)
                    own.append(grams[place[np.flatnonzero(np.diff(place, prepend=-1))]])
                found.append(np.unique(np.concatenate(own)))
                rows.append(np.full(len(found[-1]), row0 + row))
            row0 += len(bounds) - 1
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(np.concatenate(rows))),
                                              pa.array(np.concatenate(found).view(np.int64))], names=["document", "gram"])


def _document() -> Column:
    """One hash for an id and a text."""
    return F.xxhash64(F.col("id").isNull(), "id", "key")


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """(id, key, n_shared): per document, how many of its passage grams other rows hold."""
    spark = docs.sparkSession
    rows = docs.select(plain(text_col).alias("text"), plain(id_col).alias("id"), row_key(plain(text_col)).alias("key")).where(
        F.octet_length("text") >= reach)
    grams = rows.select("text", _document().alias("document")).mapInArrow(
        partial(_passage_grams, reach=reach, gram=gram), "document bigint, gram bigint")
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = write_and_read(counted.select("gram"), new_folder(spark, "suffix-passages"))
    found = grams.join(shared, "gram", "left_semi").groupBy("document").agg(F.count_distinct("gram").alias("n_shared"))
    named = rows.select("id", "key", _document().alias("document")).distinct()
    return named.join(write_and_read(found, new_folder(spark, "suffix-counts")), "document").select("id", "key", "n_shared")


def _window_hashes(contexts: list[np.ndarray], first, last, place, gram, depth: int):
    """Per window of each run: hash of (gram, distance to the gram, bytes), the run's index and the window's start."""
    sizes = np.array([len(c) for c in contexts])
    heads = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    sums = prefix_hash(np.concatenate(contexts) + np.uint64(1))
    counts = last - first + 1
    run = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = heads[run] + step
    window = range_hash(sums, start, start + depth)
    distance = (place[run] - first[run] - step).astype(np.uint64)
    return mix(window + _SALT * distance + gram[run]), run, first[run] + step


_PART_BYTES = 1 << 20


def _sort_groups(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Input sorted by gram. Whole groups, some MB at a time: the first and last repeated window of each open run."""
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        first, last, place = (table[c].to_numpy() for c in ("first", "last", "place"))
        gram, is_open = table["gram"].to_numpy().view(np.uint64), table["open"].to_numpy(zero_copy_only=False)
        contexts = [np.frombuffer(c, np.uint8) for c in table["bytes"].to_pylist()]
        window, run, start = _window_hashes(contexts, first, last, place, gram, depth)
        _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = (count[inverse] > 1) & is_open[run]
        if not twice.any():
            return None
        run, start = run[twice], start[twice]
        heads = np.flatnonzero(np.diff(run, prepend=-1))
        tails = np.append(heads[1:], len(run)) - 1
        take = pa.array(run[heads])
        return pa.RecordBatch.from_arrays(
            [table[c].combine_chunks().take(take) for c in ("id", "key")] + [pa.array(start[heads]), pa.array(start[tails])],
            names=["id", "key", "first", "last"])

    def part(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        gram = table["gram"].to_numpy()
        heads = np.flatnonzero(np.diff(gram, prepend=gram[0] - 1 if len(gram) else 0)) if len(gram) else np.zeros(0, int)
        upto = len(gram) if final else (heads[-1] if len(heads) else 0)
        sizes = np.cumsum([len(x) for x in table["bytes"].to_pylist()])
        low = 0
        while low < upto:
            base = sizes[low - 1] if low else 0
            want = int(np.searchsorted(sizes, base + _PART_BYTES, "right"))
            later = heads[(heads > low) & (heads >= want)]
            high = min(upto, int(later[0])) if len(later) else upto
            found = settle(table.slice(low, high - low).combine_chunks())
            if found is not None:
                yield found
            low = high
        held = table.slice(upto).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from part(False)
    if held:
        yield from part(True)


def _send_windows(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            rows = batch.slice(low, 512)
            column = {n: rows.column(i) for i, n in enumerate(rows.schema.names)}
            first, last, place = (column[c].to_numpy() for c in ("first", "last", "place"))
            contexts = [np.frombuffer(c, np.uint8) for c in column["bytes"].to_pylist()]
            gram = column["gram"].to_numpy().view(np.uint64)
            window, run, start = _window_hashes(contexts, first, last, place, gram, depth)
            take = pa.array(run)
            yield pa.RecordBatch.from_arrays(
                [column["gram"].take(take), pa.array(window.view(np.int64)), column["id"].take(take), column["key"].take(take),
                 column["first"].take(take), pa.array(start), column["open"].take(take)],
                names=["gram", "window", "id", "key", "run", "start", "open"])


def _contexts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """The bytes under each wanted run of a document."""
    for batch in batches:
        row0 = 0
        for data, bounds in text_chunks(batch.column(0)):
            n = len(bounds) - 1
            wanted = batch.column(3).slice(row0, n)
            runs, take = wanted.flatten(), np.repeat(np.arange(n), wanted.value_lengths().to_numpy())
            first, last = runs.field("first").to_numpy(), runs.field("last").to_numpy()
            base = bounds[:-1][take]
            pieces = [data[a:b].tobytes() for a, b in zip(base + first, base + last + depth)]
            rows = pa.array(take + row0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(rows), batch.column(2).take(rows), *[runs.field(c) for c in ("gram", "first", "last", "place", "open")],
                 pa.array(pieces, pa.binary())], names=["id", "key", "gram", "first", "last", "place", "open", "bytes"])
            row0 += n


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM,
                    group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, key, starts, ends): per document, byte ranges whose union is covered by repeated windows."""
    if not 0 < gram <= depth or depth >= 1 << (_PLACE_BITS - 1):
        raise ValueError("gram must be positive and at most depth")
    spark = docs.sparkSession
    rows = docs.select(plain(text_col).alias("_text"), plain(id_col).alias("id"), row_key(plain(text_col)).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()

    def written(df: DataFrame, label: str) -> DataFrame:
        return write_and_read(df, new_folder(spark, f"suffix-{label}"))

    runs = rows.where(F.octet_length("_text") >= depth).mapInArrow(
        partial(_runs, depth=depth, gram=gram),
        f"id {kind}, key bigint, gram bigint, run bigint, first bigint, last bigint, place bigint")
    shared = written(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    candidates = written(runs.join(shared, "gram", "left_semi"), "runs")
    contents = written(candidates.groupBy("gram", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "first", "last", "place")).alias("at")), "contents")
    groups = contents.groupBy("gram").agg(
        F.count(F.lit(1)).alias("contents"), F.max(F.col("n") == 1).alias("unsettled")).where("unsettled and contents > 1")
    wanted = written(contents.join(written(groups, "groups"), "gram").select("at.id", "at.key", F.struct(
        "gram", "at.first", "at.last", "at.place", (F.col("n") == 1).alias("open"), "contents").alias("r")), "open")
    per_document = wanted.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_list("r").alias("wanted"))
    texts = rows.join(per_document, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))

    def contexts(large: bool) -> DataFrame:
        chosen = F.filter("wanted", lambda r: (r["contents"] > group_rows) == F.lit(large))
        work = texts.select("_text", "id", "key", chosen.alias("wanted")).where(F.size("wanted") > 0)
        return work.mapInArrow(partial(_contexts, depth=depth), f"id {kind}, key bigint, gram bigint, first bigint, "
                               "last bigint, place bigint, open boolean, bytes binary")

    sorted_groups = contexts(False).repartition("gram").sortWithinPartitions("gram").mapInArrow(
        partial(_sort_groups, depth=depth), f"id {kind}, key bigint, first bigint, last bigint")
    repeated = written(contents.where(F.col("n") > 1).select("gram", "run"), "repeated")
    settled = candidates.join(repeated, ["gram", "run"], "left_semi")
    found = settled.select("id", "key", "first", "last").unionByName(sorted_groups)
    if (wanted.agg(F.max("r.contents")).first()[0] or 0) > group_rows:
        single = contexts(True).mapInArrow(
            partial(_send_windows, depth=depth),
            f"gram bigint, window bigint, id {kind}, key bigint, run bigint, start bigint, open boolean")
        twice = single.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("gram", "window")
        partial_runs = single.where("open").join(twice, ["gram", "window"], "left_semi").groupBy("id", "key", "run").agg(
            F.min("start").alias("first"), F.max("start").alias("last"))
        found = found.unionByName(partial_runs.drop("run"))
    return found.groupBy("id", "key").agg(F.collect_set(F.struct("first", (F.col("last") + depth).alias("end"))).alias("r")).select(
        "id", "key", F.transform("r", lambda r: r["first"]).alias("starts"), F.transform("r", lambda r: r["end"]).alias("ends"))


def _joined(docs: DataFrame, id_col: str, text_col: str, passages: bool = False, **options) -> DataFrame:
    """(row, left, n_removed, n_spans, n_shared): all columns of ``docs`` in a struct, and what was found."""
    spark = docs.sparkSession
    small_batches(spark)
    ranges = repeated_ranges(docs, id_col, text_col, **options).withColumn("n_shared", F.lit(0).cast("bigint"))
    if passages:
        none = F.lit(None).cast("array<bigint>")
        shared = shared_passages(docs, id_col, text_col).select("id", "key", none.alias("starts"), none.alias("ends"), "n_shared")
        ranges = ranges.unionByName(shared)
    ranges = ranges.groupBy("id", "key").agg(  # one row of ranges and one of passages at most
        F.first("starts", True).alias("starts"), F.first("ends", True).alias("ends"), F.sum("n_shared").alias("n_shared"))
    ranges = write_and_read(ranges, new_folder(spark, "suffix-ranges"))
    other = ranges.withColumnsRenamed({"id": "other_id", "key": "other_key"})
    keyed = docs.select(packed(docs), plain(id_col).alias("id"), row_key(plain(text_col)).alias("key"))
    met = keyed.join(other, (F.col("key") == F.col("other_key")) & F.col("id").eqNullSafe(F.col("other_id")), "left")
    cut = met.select("row", removal_udf()(F.col("row").getField(text_col), "starts", "ends").alias("cut"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return cut.select("row", "cut.left", "cut.n_removed", "cut.n_spans", "n_shared")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "left_bytes", **options) -> DataFrame:
    """The documents with a binary column ``name``, which is new: their bytes without any byte under a repeated window."""
    check_free(docs, name)
    return _joined(docs, id_col, text_col, **options).select(*unpacked(docs), F.col("left").alias(name))


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared per document."""
    found = _joined(docs.select("doc_id", "text"), "doc_id", "text", passages=True)
    return found.select("row.doc_id", F.octet_length(F.coalesce("row.text", F.lit(""))).cast("bigint").alias("n_bytes"),
                        "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"), "n_shared")
