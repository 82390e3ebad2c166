"""Spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Bigrams
are ordered by how rare they are in the vocabulary. A word's prefix is its three rarest bigrams; two
of them that do not overlap are its pivots, chosen by dynamic programming so that they are rarest in
sum. One edit spoils at most one pivot. So of two near words, the one whose prefix ends at the rarer bigram
has a pivot that the other holds in its prefix, at the same place or one beside it.

Pivots are looked up among prefixes by one equality join. Its key holds the bigram, its place in the
other word, both lengths, and one half of the word: one edit leaves the first or the last half of the shorter
word as it was. A place differs only together with the lengths, which leaves five cases. The half
keeps groups small where a bigram is common, so no group of the vocabulary is ever paired as a whole. Candidates are
verified by edit distance.

A prefix is extended to the first five places of its last bigram: one edit adds at most two bigrams, so a
pivot among the first three equal bigrams of its word is among the first five of the other.

The order comes from the counts of 2**16 hashed bigrams, a table of fixed size that tasks receive. All else grows with the
vocabulary and is joined by sorting: Spark sizes a table by its compressed files and takes no note of the rows that an explode
adds, so without the hint it would gather on the driver many times what it may broadcast.

Defined results: null words are left out, words that come in several rows are counted together, words shorter than
``least_chars`` take no part. Extra columns of any name are ignored. Forms only lead to words at least ``ratio`` times as
frequent, so they end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.llm.texts import plain
from ledgerscope.session import new_folder, write_and_read

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM, PIVOTS, SLOTS = 2, 2, 1 << 16
PREFIX = GRAM * (PIVOTS - 1) + 1
_SAME_GRAM = PREFIX + GRAM
# (shift of the place, difference of the lengths) that one edit can cause
_SHIFTS = [(0, 0), (0, 1), (0, -1), (1, 1), (-1, -1)]
_SIGNATURE = "word string, last binary, pivots array<struct<gram:string,at:int>>, prefix array<struct<gram:string,at:int>>"


def slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SLOTS


def cheapest_disjoint(grams: list[tuple[int, int]], want: int = PIVOTS, width: int = GRAM) -> list[int]:
    """Places of ``want`` grams that do not overlap, of least weight in sum, among (place, weight) sorted by place.

    ``cost[j][i]`` is the least weight of j disjoint grams among the first i; a gram is left out, or follows
    the best choice among those that end before it begins.
    """
    cost = [[0] * (len(grams) + 1)] + [[None] * (len(grams) + 1) for _ in range(want)]
    before = [sum(p + width <= place for p, _ in grams) for place, _ in grams]
    for j in range(1, want + 1):
        for i, (_, weight) in enumerate(grams, 1):
            rest = cost[j - 1][before[i - 1]]
            taken = None if rest is None else rest + weight
            left = cost[j][i - 1]
            cost[j][i] = taken if left is None or (taken is not None and taken < left) else left
    places, i, j = [], len(grams), want
    while j:
        if cost[j][i] == cost[j][i - 1]:
            i -= 1
            continue
        places.append(grams[i - 1][0])
        i, j = before[i - 1], j - 1
    return places[::-1]


def signature(word: str, counts: np.ndarray) -> tuple[bytes, list[tuple[str, int]], list[tuple[str, int]]]:
    """(last bigram of the prefix in the global order, pivots, prefix), bigrams as (gram, place)."""
    placed = sorted((int(counts[slot(word[i:i + GRAM])]), word[i:i + GRAM], i) for i in range(len(word) - GRAM + 1))
    count, last, _ = placed[PREFIX - 1]
    pivots = cheapest_disjoint(sorted((at, weight) for weight, _, at in placed[:PREFIX]))
    prefix = [(gram, at) for _, gram, at in placed[:PREFIX] if gram != last]
    prefix += [(last, at) for _, gram, at in placed if gram == last][:_SAME_GRAM]
    return count.to_bytes(8, "big") + last.encode(), [(word[at:at + GRAM], at) for at in pivots], prefix


def _signatures(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    grams = pa.list_(pa.struct([("gram", pa.string()), ("at", pa.int32())]))
    for batch in batches:
        words = batch.column(0).to_pylist()
        last, pivots, prefix = zip(*[signature(w, counts) for w in words]) if words else ((), (), ())

        def listed(items) -> pa.Array:
            return pa.array([[{"gram": g, "at": at} for g, at in x] for x in items], grams)

        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(last, pa.binary()), listed(pivots), listed(prefix)],
                                         names=["word", "last", "pivots", "prefix"])


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of the hashed bigrams comes in the vocabulary: ``SLOTS`` numbers."""
    places = F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1))
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))).alias("gram"))
    out = np.zeros(SLOTS, np.int64)
    for r in grams.groupBy((F.crc32("gram") % SLOTS).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _keys(signatures: DataFrame, grams: str, cases: list[tuple[int, int]], looks_up: bool) -> DataFrame:
    """(key, last, word): the join keys of one side, for each case of (shift, other length) and each half."""
    length = F.char_length("word")
    case = F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), F.lit(d).alias("longer")) for s, d in cases]))
    rows = signatures.select("word", "last", F.explode(grams).alias("g")).select("word", "last", "g", case.alias("c"))
    rows = rows.select("word", "last", "g", "c", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    other = length + F.col("c.longer")
    half = F.floor(F.least(length, other) / 2).cast("int")
    kept = F.when(F.col("side") == 0, F.substring(F.col("word"), F.lit(1), half)).otherwise(
        F.substring(F.col("word"), length - half + 1, half))
    lengths = (length, other) if looks_up else (other, length)
    return rows.select(F.xxhash64(F.col("g.gram"), F.col("g.at") + F.col("c.shift"), *lengths, F.col("side"), kept).alias("key"),
                       "last", "word")


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) for every two near words of the column ``word``, once each way. The words are distinct, of at least four code points."""
    spark = words.sparkSession
    counts = gram_counts(words)
    signatures = write_and_read(words.select("word").mapInArrow(partial(_signatures, counts=counts), _SIGNATURE),
                                new_folder(spark, "spelling-signatures"))
    pivots = _keys(signatures, "pivots", _SHIFTS, True).toDF("key", "last_a", "a")
    prefixes = _keys(signatures, "prefix", [(0, d) for d in (-1, 0, 1)], False).toDF("key", "last_b", "b")
    met = pivots.join(prefixes.hint("merge"), "key").where((F.col("last_a") <= F.col("last_b")) & (F.col("a") != F.col("b")))
    near = met.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return near.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")),
                                         F.struct(F.col("y").alias("a"), F.col("x").alias("b")))).alias("p")).select("p.a", "p.b")


def follow_forms(edges: DataFrame) -> DataFrame:
    """(word, root): each word's form's form and so on to the last, in doubling steps. ``edges`` (word, form) has no cycles."""
    spark = edges.sparkSession
    roots = write_and_read(edges.select("word", F.col("form").alias("root")), new_folder(spark, "spelling-roots"))
    while True:
        step = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = roots.join(step.hint("merge"), F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = write_and_read(moved, new_folder(spark, "spelling-roots"))
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        roots = moved.select("word", "root")


def group_variants(words: DataFrame, word_col: str = "word", count_col: str = "n", ratio: int = 5, least_chars: int = 6) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of a counted vocabulary.

    A word's form is its near word of largest count (ties: the first in code-point order), if that is at least ``ratio``
    times its own; the root is the end of the forms.
    """
    if least_chars < PREFIX + GRAM - 1 or ratio < 2:
        raise ValueError(f"words need at least {PREFIX + GRAM - 1} code points, and forms a ratio of 2 or more")
    spark = words.sparkSession
    vocabulary = words.select(plain(word_col).alias("word"), plain(count_col).cast("bigint").alias("n")).where(
        F.char_length("word") >= least_chars).groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = write_and_read(vocabulary, new_folder(spark, "spelling-words"))
    pairs = write_and_read(near_words(vocabulary), new_folder(spark, "spelling-pairs"))
    other = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    own = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("n_a"))
    counted = pairs.join(other.hint("merge"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("n_b"), "b")).alias("first"))
    chosen = counted.join(own.hint("merge"), "a").select("a", "n_near", F.when(-F.col("first.col1") >= ratio * F.col("n_a"), F.struct(
        F.col("first.b").alias("form"), (-F.col("first.col1")).alias("form_n"))).alias("f"))
    chosen = write_and_read(chosen.select(F.col("a").alias("word"), "n_near", "f.form", "f.form_n"), new_folder(spark, "spelling-forms"))
    roots = follow_forms(chosen.where("form IS NOT NULL").select("word", "form"))
    return vocabulary.join(chosen.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def count_words(words: Column, docs: DataFrame, least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the elements of an array column, of at least ``least_chars`` code points, seen ``least_count`` times or more."""
    found = docs.select(F.explode(words).alias("word")).where(F.char_length("word") >= least_chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def damaged_run(doc_id: Column, run: Column) -> Column:
    """The run without one code point, if 199 divides its check sum; an unusual spelling to be found again."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % 199 == 0, cut).otherwise(run)


def spelling_digest(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root over the runs of letters of all texts."""
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"({LETTERS})"), F.lit(1))
    long_runs = F.filter(F.transform(runs, lambda r: F.translate(r, UPPER, LOWER)), lambda r: F.char_length(r) >= 6)
    exploded = docs.select("doc_id", F.explode(long_runs).alias("run"))
    return group_variants(count_words(F.array(damaged_run(F.col("doc_id"), F.col("run"))), exploded))
