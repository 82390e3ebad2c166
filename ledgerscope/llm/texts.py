"""Shared helpers: texts inside Arrow batches as byte arrays, word hashes, row keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHUNK_BYTES = 1 << 19
BATCH_ROWS = 2000
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_tables: dict[str, np.ndarray] = {}


def word_table() -> np.ndarray:
    """Byte -> folded byte: digits, letters (A-Z lower-cased) and all bytes of non-ASCII characters; 0 elsewhere."""
    table = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first:last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


WORD_BYTES = word_table()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(2 * CHUNK_BYTES, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of data[j] * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * powers(len(data))[0][:len(data)], dtype=np.uint64, out=out[1:])
    return out


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of rows as (bytes, row bounds), about ``limit`` bytes each; a null row is empty; a longer row comes alone."""
    if pa.types.is_dictionary(texts.type):
        texts = texts.dictionary_decode()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        texts = texts.fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield data[bounds[row]:bounds[upto]], bounds[row:upto + 1] - bounds[row]
        row = upto


@dataclass
class Words:
    """Words of a run of rows. ``first`` has, per row, the index of its first word, and the total at the end."""

    folded: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def bytes_of(self, a: int, b: int) -> bytes:
        """Words a..b-1 joined by single spaces."""
        folded, starts, ends = self.folded, self.starts, self.ends
        return b" ".join(folded[starts[i]:ends[i]].tobytes() for i in range(a, b))


def _cut_long(starts: np.ndarray, ends: np.ndarray, folded: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Split runs of more than ``longest`` bytes between characters."""
    cuts = []
    for a, b in zip(starts[ends - starts > longest].tolist(), ends[ends - starts > longest].tolist()):
        while b - a > longest:
            cut = a + longest
            while cut > a + 1 and folded[cut] & 0xC0 == 0x80:
                cut -= 1
            cuts.append(cut)
            a = cut
    return np.sort(np.append(starts, cuts).astype(np.int64)), np.sort(np.append(ends, cuts).astype(np.int64))


def scan_words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = WORD_BYTES, longest: int | None = None) -> Words:
    """Maximal runs of bytes that ``table`` keeps, never across rows, with a 64-bit hash of each folded run.

    ``longest``: longer runs are cut into parts of at most that many bytes.
    """
    folded = table[data]
    inside = folded != 0
    opens = np.zeros(len(data) + 1, bool)
    opens[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | opens[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | opens[1:])) + 1
    if longest and len(starts) and (ends - starts).max() > longest:
        starts, ends = _cut_long(starts, ends, folded, longest)
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # blocks of whole words bound the memory of the prefix sums
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, "right")))
        low = starts[a]
        sums = prefix_hash(folded[low:ends[b - 1]])
        hashes[a:b] = (sums[ends[a:b] - low] - sums[starts[a:b] - low]) * powers(len(sums))[1][starts[a:b] - low]
        a = b
    return Words(folded, starts, ends, mix(hashes), np.searchsorted(starts, bounds))


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive hashes."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k:k + n]
    return mix(out)


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: send at most ``BATCH_ROWS`` of them to Python at once, as a setting of the session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body's functions use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(text: Column) -> Column:
    """64-bit hash of a text (null as empty): together with the row's id it names the row in joins."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def plain(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that no internal column can clash with them; see :func:`unpacked`."""
    return F.struct(*[plain(c) for c in df.columns]).alias("row")


def unpacked(df: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of ``df`` out of the struct ``row``, as they were, but for those given anew."""
    return [(replaced[c] if c in replaced else F.col("row").getField(c)).alias(c) for c in df.columns]


def check_free(df: DataFrame, *names: str) -> None:
    """Raise where an output column has the name of an input column: nothing of the input is overwritten."""
    clash = sorted(n for n in names if n.lower() in {c.lower() for c in df.columns})
    if clash:
        raise ValueError(f"the input has columns of the output's names: {clash}")
