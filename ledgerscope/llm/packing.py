"""Packing by power-of-two decomposition.

A document's tokens, with the end token, are cut from the front into pieces whose
lengths are powers of two: as many of the longest length as fit, then the binary
digits of the rest. Each piece is a sequence of its own, so no sequence crosses
documents and none needs padding; equal lengths form one bucket, from which batches
of equal shape are drawn. The whole job is one pass without a shuffle.

``sequence_id`` holds the exponent of the length, the task and the number within
that task's bucket, so a bucket is one range of ids and every id names one sequence.

Defined results: a null text counts as empty and gives one piece of one token, the
end token. Repeated rows are packed each on their own. With ``added_tokens`` the file's
added tokens, such as ``<|endoftext|>``, have their own ids where a text holds them, as the
file's own library gives by default; without, they are spelled out like other text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerscope.llm.texts import mix, plain, powers, prefix_hash, small_batches, text_chunks

MAX_LENGTH = 2048
END_TOKEN = 1
KEPT_UNITS = 400_000
_ROWS = 512
# White space, as bytes: the ASCII characters, and bytes that may begin another white space character.
_BLANK = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_DOUBTFUL = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
PIECE_TYPE = ("_pieces array<struct<start:bigint,length:bigint,ids:binary,exponent:int,number:bigint>>, "
              "doc_tokens bigint")
_kept: dict[tuple[str, bool], UnitTokenizer] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_pair_coder(path: str):
    """Coder of a byte-level BPE file: the same merges and ids, about three times as fast per word as the file's own library."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content["added_tokens"]}
    # Byte-level files write bytes that do not print as the characters from 256 on, in order.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_ids(path: str) -> dict[str, int]:
    """Added tokens of a file, with their ids."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    odd = [t["content"] for t in content["added_tokens"]
           if t["single_word"] or t["lstrip"] or t["rstrip"] or (t["normalized"] and content["normalizer"])]
    if odd:
        raise ValueError(f"added tokens that are not found as they stand: {odd}")
    return {t["content"]: t["id"] for t in content["added_tokens"]}


class UnitTokenizer:
    """Byte-level BPE ids of texts.

    The vocabulary's pattern starts a new word at every single space between two characters
    that are not white space, so the ids of a text are those of its units, cut before such
    spaces, in order. Each distinct unit is encoded once; its ids are kept under its hash in
    a sorted table. Texts with characters that might be other white space are encoded whole.
    An added token is a unit, and ends the text before it.
    """

    def __init__(self, path: str, kept_units: int = KEPT_UNITS, added_tokens: bool = False):
        self._coder = byte_pair_coder(path)
        self._added = added_ids(path) if added_tokens else {}
        either = "|".join(re.escape(t) for t in sorted(self._added, key=len, reverse=True))
        self._text_cut, self._byte_cut = re.compile(f"({either})"), re.compile(either.encode())
        self._limit = kept_units
        self._forget()

    def _forget(self) -> None:
        self._hashes, self._starts, self._sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids, self._used = np.zeros(1 << 16, "<u4"), 0

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        found = [[self._added[u]] if u in self._added else self._coder.encode_ordinary(u) for u in units]
        sizes = np.array([len(x) for x in found], np.int64)
        flat = np.array(list(chain.from_iterable(found)), "<u4")
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used:self._used + len(flat)] = flat
        at = np.searchsorted(self._hashes, hashes)
        starts = self._used + np.cumsum(sizes) - sizes
        self._used += len(flat)
        self._hashes, self._starts, self._sizes = (
            np.insert(a, at, b) for a, b in ((self._hashes, hashes), (self._starts, starts), (self._sizes, sizes)))

    def _whole(self, text: str) -> list[int]:
        if not self._added:
            return self._coder.encode_ordinary(text)
        parts = self._text_cut.split(text)
        return [i for u in parts if u for i in ([self._added[u]] if u in self._added else self._coder.encode_ordinary(u))]

    def _added_places(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Start and end of each added token, never across rows."""
        content = data.tobytes() if self._added else b""
        if not self._added or not self._byte_cut.search(content):
            return []
        return [m.span() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) for m in self._byte_cut.finditer(content, a, b)]

    def chunk(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a run of rows."""
        if not len(data):
            return [np.zeros(0, "<u4")] * (len(bounds) - 1)
        if len(self._hashes) > self._limit:
            self._forget()
        blank = _BLANK[data]
        doubtful = np.flatnonzero(_DOUBTFUL[data])
        opens = data == 0x20
        opens[1:] &= ~blank[:-1]
        opens[:-1] &= ~blank[1:]
        opens[bounds[:-1][bounds[:-1] < len(data)]] = True
        for a, b in self._added_places(data, bounds):
            opens[a:b] = False
            opens[a] = True
            opens[b:b + 1] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        sums = prefix_hash(data + np.uint64(1))
        hashes = mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self._hashes, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self._hashes):
            known = self._hashes[np.minimum(at, len(self._hashes) - 1)] == distinct
        new = first[~known]
        if len(new):
            self._learn(distinct[~known], [data[a:b].tobytes().decode() for a, b in zip(starts[new], ends[new])])
            at = np.searchsorted(self._hashes, distinct)
        sizes, places = self._sizes[at][inverse], self._starts[at][inverse]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._ids[np.repeat(places - total[:-1], sizes) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, bounds)]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for row in np.unique(np.searchsorted(bounds, doubtful, "right") - 1).tolist():
            out[row] = np.array(self._whole(data[bounds[row]:bounds[row + 1]].tobytes().decode()), "<u4")
        return out


def piece_lengths(n: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the powers of two of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def _pack(batches: Iterator[pa.RecordBatch], path: str, longest: int, end_token: int, added_tokens: bool) -> Iterator[pa.RecordBatch]:
    if (path, added_tokens) not in _kept:
        _kept[path, added_tokens] = UnitTokenizer(path, added_tokens=added_tokens)
    tokenizer = _kept[path, added_tokens]
    end, task = np.array([end_token], "<u4").tobytes(), TaskContext.get().partitionId()
    numbers = [0] * longest.bit_length()
    for batch in batches:
        column = batch.column(0)
        for low in range(0, len(column), _ROWS):
            ids = [x for data, bounds in text_chunks(column.slice(low, _ROWS)) for x in tokenizer.chunk(data, bounds)]
            ids = [x.tobytes() + end for x in ids]
            pieces = []
            for x in ids:
                row, start = [], 0
                for length in piece_lengths(len(x) // 4, longest):
                    k = length.bit_length() - 1
                    row.append((start, length, x[4 * start:4 * (start + length)], k, (task << 32) | numbers[k]))
                    numbers[k] += 1
                    start += length
                pieces.append(row)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(low, _ROWS) for i in range(1, batch.num_columns)], _piece_array(pieces),
                 pa.array([len(x) // 4 for x in ids], pa.int64())],
                names=[*batch.schema.names[1:], "_pieces", "doc_tokens"])


def _piece_array(rows: list[list[tuple]]) -> pa.Array:
    flat = [p for row in rows for p in row]
    kinds = (("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("exponent", pa.int32()), ("number", pa.int64()))
    values = pa.StructArray.from_arrays([pa.array([p[i] for p in flat], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_length: int = MAX_LENGTH,
                   end_token: int = END_TOKEN, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``max_length`` must be a power of two. Write partitioned by ``length`` to get the buckets.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    small_batches(docs.sparkSession)
    rows = docs.select(plain(text_col).alias("_text"), plain(id_col).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    work = partial(_pack, path=vocabulary or default_vocabulary(), longest=max_length, end_token=end_token,
                   added_tokens=added_tokens)
    packed = rows.mapInArrow(work, f"doc_id {kind}, {PIECE_TYPE}")
    p = F.col("_piece")
    return packed.select("doc_id", "doc_tokens", F.explode("_pieces").alias("_piece")).select(
        "doc_id", p["start"].alias("start"), p["length"].alias("length"), p["ids"].alias("ids"), "doc_tokens",
        F.shiftleft(p["exponent"].cast("bigint"), 58).bitwiseOR(p["number"]).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"))


def packing_digest(docs: DataFrame, vocabulary: str | None = None, added_tokens: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset per piece."""
    pieces = pack_documents(docs, vocabulary, added_tokens=added_tokens)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
