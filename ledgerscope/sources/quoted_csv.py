"""Delimited text whose quoted values hold line breaks, read in splits.

Spark's reader for such files gives each whole file to one task, because a split cannot know whether it begins inside
a quoted value. Here two scans do:

1. Per split, how a line reader's state changes: whether the next line begins inside a quoted value, for a split that
   begins outside and for one that begins inside. Only lines with a quote matter. The changes are chained
   over the splits of each file, which gives every split its state: one small row per split (of 128 MB by
   default), the only thing that passes through the driver.
2. Lines are joined to records in scan order, without a shuffle. Records cut by a split's border leave one
   piece per split; only these pieces are grouped, and only if there are any, which costs another scan.

Without any record over several lines the second scan is Spark's own line reader.

A record ends with \\n or \\r\\n. A quote opens a value only at its beginning and closes it only if it is not doubled;
what follows up to the delimiter belongs to the value. A quote never closed reaches to the end of its file. Empty
records are skipped. Every file begins with the same header on one line.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# A field with its delimiter, any number of times, then the rest of a value that began with a quote.
_FIELDS = re.compile(rb'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?,)*+')
_CLOSING = re.compile(rb'(?:[^"]++|"")*+"[^,]*+,?')
_OPTIONS = {"quote": '"', "escape": '"'}


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether the next line begins inside a quoted value, if this one does or does not."""
    at = 0
    if inside:
        closed = _CLOSING.match(line)
        if not closed:
            return True
        at = closed.end()
        if line[at - 1:at] != b",":
            return False
    at = _FIELDS.match(line, at).end()
    return line[at:at + 1] == b'"' and not _CLOSING.match(line, at + 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Array]]:
    """((file, start, end) of the split, lines) for each run of lines of one split."""
    for batch in batches:
        files, starts, ends = (batch.column(i).to_numpy() for i in range(3))
        edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(files)]):
            if a < b:
                yield (int(files[a]), int(starts[a]), int(ends[a])), batch.column(3).slice(a, b - a)


_CHANGES = [("file", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_()),
            ("begins", pa.bool_()), ("spans", pa.bool_())]


def _split_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, from its lines with quotes: the state at its end from either state at its beginning; whether a record
    begins in it that was entered inside a value; whether any value spans lines."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip((*key, *state), _CHANGES)], names=[n for n, _ in _CHANGES])

    for split, lines in _runs(batches):
        if split != key:
            if key:
                yield row()
            key, state = split, (False, True, False, False)
        outside, inside, begins, spans = state
        for line in lines.to_pylist():
            merged, outside = outside == inside, inside_after(line, outside)
            inside = outside if merged else inside_after(line, inside)
            begins, spans = begins or not inside, spans or outside
        state = (outside, inside, begins, spans)
    if key:
        yield row()


class SplitStates:
    """The state at the end of each split that holds quotes; lines without quotes change nothing."""

    def __init__(self, changes: list):
        changes = sorted(changes, key=lambda r: (r["file"], r["start"]))
        self.file, self.start, self.end = (np.array([r[c] for r in changes], np.int64) for c in ("file", "start", "end"))
        self.inside, self.owner = np.zeros(len(changes), bool), np.zeros(len(changes), np.int64)
        last = None
        for i, r in enumerate(changes):
            if r["file"] != last:
                last, now, begun = r["file"], False, 0
            if not now or r["begins"]:
                begun = r["start"]
            now = r["from_inside"] if now else r["from_outside"]
            self.inside[i], self.owner[i] = now, begun

    def at(self, file: int, start: int) -> tuple[bool, int]:
        """Whether a split begins inside a value, and the start of the split in which that record begins."""
        low, high = np.searchsorted(self.file, file, "left"), np.searchsorted(self.file, file, "right")
        i = low + int(np.searchsorted(self.start[low:high], start)) - 1
        if i < low:
            return False, start
        if start < self.end[i]:
            raise RuntimeError("the input was split in another way than in the first scan; read it again")
        return bool(self.inside[i]), int(self.owner[i])


def _is_header(record: bytes, names: list[str]) -> bool:
    """Names that a header repeats or leaves empty were made up by the reader."""
    found = next(csv.reader([record.decode().rstrip("\r")]), [])
    return len(found) == len(names) and all(x == n or not x or found.count(x) > 1 for x, n in zip(found, names))


def _records(batches: Iterator[pa.RecordBatch], states: SplitStates, names: list[str], pieces: bool) -> Iterator[pa.RecordBatch]:
    """(file, owner, at, record): whole records of each split, or with ``pieces`` those cut by a border instead."""
    key, held, inside, owner, first = None, [], False, None, False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                          names=["file", "owner", "at", "record"])

    for split, lines in _runs(batches):
        out = []
        if split != key:
            if held and pieces:
                out.append((key[0], owner, key[1], b"\n".join(held)))
            key, held = split, []
            file, start, _ = split
            inside, owner = states.at(file, start)
            entered, first = inside, start == 0
            owner = owner if inside else start
        for line in lines.to_pylist():
            if b'"' in line:
                inside = inside_after(line, inside)
            if inside or held:
                held.append(line)
            if inside:
                continue
            record, held = b"\n".join(held) if held else line, []
            if entered:
                if pieces:
                    out.append((file, owner, start, record))
                entered, owner = False, start
            elif record in (b"", b"\r"):
                continue
            elif first:
                first = False
                if not _is_header(record, names):
                    raise ValueError(f"a file of the input does not begin with the header {names}")
            elif not pieces:
                out.append((file, None, start, record))
        yield batch_of(out)
    if held and pieces:
        yield batch_of([(key[0], owner, key[1], b"\n".join(held))])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    split = F.col("_metadata.file_block_start")
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), split.alias("start"), (split + F.col("_metadata.file_block_length")).alias("end"), "value")


def _to_python(lines: DataFrame) -> DataFrame:
    return lines.select("file", "start", "end", F.col("value").cast("binary").alias("line"))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the header, as texts.

    The session's number of splits for small inputs is pinned, so that both scans cut files alike; a scan that
    finds them cut in another way fails.
    """
    pinned = "spark.sql.files.minPartitionNum"
    if spark.conf.get(pinned, None) is None:  # else it follows the number of cores at hand
        spark.conf.set(pinned, str(spark.sparkContext.defaultParallelism))
    by_line = spark.read.options(header=True, **_OPTIONS).csv(path)
    names = by_line.columns
    lines = _lines(spark, path)
    schema = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'bigint'}" for n, t in _CHANGES)
    changes = _to_python(lines.where(F.contains("value", F.lit('"')))).mapInArrow(_split_changes, schema).collect()
    if not any(r["spans"] or r["from_outside"] for r in changes):
        return by_line
    states = SplitStates(changes)

    def cut(pieces: bool) -> DataFrame:
        return _to_python(lines).mapInArrow(partial(_records, states=states, names=names, pieces=pieces),
                                            "file bigint, owner bigint, at bigint, record binary")

    records = cut(False).select(F.col("record").cast("string").alias("record"))
    if states.inside.any():
        parts = F.sort_array(F.collect_list(F.struct("at", F.col("record").cast("string").alias("part"))))  # of one record
        whole = cut(True).groupBy("file", "owner").agg(parts.alias("p"))
        records = records.unionByName(whole.select(F.array_join("p.part", "\n").alias("record")))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = records.select(F.from_csv(F.regexp_replace("record", r"\r\z", ""), schema, {**_OPTIONS, "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])
