"""Document fingerprints: one-permutation MinHash with optimal densification and packed bits.

The hashes of a text's five-word shingles are sorted once; their top seven bits name one of
128 bins, so the first hash of each bin is its minimum. An empty bin takes the minimum of
the first filled bin on a probe sequence that depends on the bin alone, so texts with the
same filled bins borrow alike. The low-order byte of each bin is stored, 128 bytes in
hexadecimal. Equal bytes are corrected for chance: two unlike bins agree in 1 of 256 cases.

Everything is DataFrame functions; a fingerprint needs no shuffle. To compare each document
with the next by id, texts are dealt once into slots of neighbouring ids, as many as the bytes of
the table ask for.

Defined results: a text without words, null included, has the empty fingerprint; two empty
ones have likeness 1, an empty and another one 0. A text of one to four words is one
shingle. Ids may be of any type that Spark orders. Rows of one id, null ids included, follow
each other by the hash of their text; null ids come last. A single row is its own successor.
Other columns may have any names but those of the output.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerscope.llm.texts import check_free, let, packed, plain, row_key
from ledgerscope.session import new_folder, write_and_read

SHINGLE = 5
BINS, BITS = 128, 8
_BIN_BITS = BINS.bit_length() - 1
_TRIES = 8
SLOT_BYTES = 16 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.transform(F.array_remove(F.split(folded, SEPARATORS, -1), ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column) -> Column:
    """Hash of every five consecutive words; fewer words are one shingle; none are no shingle."""
    def several(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))

    return let(words, lambda w: F.when(F.size(w) >= SHINGLE, several(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(
        F.array().cast("array<bigint>")))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - _BIN_BITS).cast("int") + BINS // 2


def _filled_bins(hashes: Column) -> Column:
    """One place per bin, in order: the smallest hash of the bin, or null."""
    def spread(low: Column) -> Column:
        def with_gap(x: Column, i: Column) -> Column:
            following = F.coalesce(_bin(F.get(low, i + 1)), F.lit(BINS))
            return F.concat(F.array(x), F.array_repeat(F.lit(None).cast("bigint"), following - _bin(x) - 1))

        return F.concat(F.array_repeat(F.lit(None).cast("bigint"), _bin(F.get(low, F.lit(0)))), F.flatten(F.transform(low, with_gap)))

    return let(F.sort_array(hashes), lambda s: let(
        F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))), spread))


def _probes() -> list[int]:
    """Per empty bin the order in which it asks the others: every bin once, by double hashing."""
    out = []
    for b in range(BINS):
        h = (b + 1) * 0x9E3779B97F4A7C15 >> 20
        out += [((h >> _BIN_BITS) + t * (h | 1)) % BINS for t in range(BINS)]
    return out


def _densified(bins: Column) -> Column:
    # One constant, folded from text, instead of a column expression per number.
    order = F.split(F.lit(",".join(map(str, _probes()))), ",").cast("array<int>")

    def borrow(b: Column) -> Column:
        near = [F.get(bins, F.get(order, b * BINS + t)) for t in range(_TRIES)]
        far = F.filter(F.transform(F.slice(order, b * BINS + _TRIES + 1, BINS - _TRIES), lambda j: F.get(bins, j)), lambda v: v.isNotNull())
        return F.coalesce(*near, F.get(far, F.lit(0)))

    return F.transform(bins, lambda x, b: F.coalesce(x, borrow(b)))


def fingerprint(text: Column) -> Column:
    """128 bins of 8 bits as 256 hexadecimal digits; empty for a text without words."""
    def pack(hashes: Column) -> Column:
        bins = let(_filled_bins(hashes), _densified)
        digits = F.array_join(F.transform(bins, lambda x: F.substring(
            F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1)).bitwiseOR(F.lit(1 << BITS))), 2, 2)), "")
        return F.when(F.size(hashes) > 0, digits).otherwise("")

    return let(shingle_hashes(word_hashes(text)), pack)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1, corrected for chance agreement."""
    def unequal(at: Column) -> Column:
        part = lambda f: F.conv(F.substring(f, at, F.lit(16)), 16, -10).cast("bigint")
        x = part(a).bitwiseXOR(part(b))
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    places = F.sequence(F.lit(1), F.lit(2 * BINS), F.lit(16))
    differing = F.aggregate(places, F.lit(0), lambda total, at: total + unequal(at))
    chance = 1.0 / (1 << BITS)
    estimate = (F.lit(1.0) - differing / F.lit(float(BINS)) - chance) / (1.0 - chance)
    some = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(some, F.greatest(F.lit(0.0), estimate)).when(F.length(a) == F.length(b), 1.0).otherwise(0.0)


def _slot(cuts: Column, rows_id: Column, rows_key: Column) -> Column:
    """How many cuts are at or before a row, less one; among every 64th cut first, then among the 64 from there."""
    def reached(c: Column) -> Column:
        same = c["id"].eqNullSafe(rows_id) & (c["key"] <= rows_key)
        return F.coalesce(c["id"] > rows_id, F.lit(False)) | same | (c["id"].isNotNull() & rows_id.isNull())

    coarse = F.size(F.filter(F.filter(cuts, lambda c, i: i % 64 == 0), reached)) - 1
    return coarse * 64 + F.size(F.filter(F.slice(cuts, coarse * 64 + 1, F.lit(64)), reached)) - 1


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", slots: int | None = None,
              prefix: str = "next_", extra: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Add ``columns`` of the next row by falling id; after the last row comes the first.

    ``extra`` (name -> function of the text) adds columns that are computed once per row, before rows are dealt out;
    ``columns`` may name them too.

    Ids and hashes of texts alone are sorted first; the first row of each range cuts the order into slots. Each slot also
    gets the first row of the following one, so no task orders more than a slot and every text is shuffled once.
    A slot holds about ``SLOT_BYTES`` of text, whatever the size of the table.
    """
    spark, extra = docs.sparkSession, extra or {}
    check_free(docs, *extra, *[prefix + c for c in columns])
    names = {"id": plain(id_col), "key": row_key(plain(text_col))}
    narrow = docs.select(*[c.alias(n) for n, c in names.items()], F.coalesce(F.octet_length(plain(text_col)), F.lit(0)).alias("bytes"))
    narrow = write_and_read(narrow, new_folder(spark, "next-order"))
    if not slots:
        size = narrow.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        slots = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLOT_BYTES))
    order = [F.col("id").desc_nulls_last(), F.col("key")]
    ranged = narrow.select("id", "key").repartitionByRange(slots, *order).sortWithinPartitions(*order).select(
        "id", "key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    found = ranged.groupBy("part").agg(F.min(F.struct("place", "id", "key")).alias("first")).orderBy("part").collect()  # one row per slot
    wanted = [*docs.columns, *extra]
    if not found:
        return docs.withColumns({n: F.lit(None).cast("string") for n in [*extra, *[prefix + c for c in columns]]})
    kind = narrow.schema["id"].dataType.simpleString()
    listed = [{"id": r["first"]["id"], "key": r["first"]["key"]} for r in found]
    # One constant, folded from text, instead of a column expression per cut.
    cuts = F.from_json(F.lit(json.dumps(listed, default=str)), f"array<struct<id:{kind},key:bigint>>")
    rows = docs.select(packed(docs), *[c.alias(n) for n, c in names.items()])
    placed = rows.withColumn("slot", _slot(cuts, F.col("id"), F.col("key")))
    guests = F.broadcast(spark.createDataFrame([(c["id"], c["key"], (i - 1) % len(listed)) for i, c in enumerate(listed)],
                                               f"g_id {kind}, g_key bigint, g_slot int"))
    visiting = rows.join(guests, (F.col("key") == F.col("g_key")) & F.col("id").eqNullSafe(F.col("g_id"))).dropDuplicates(
        ["id", "key"]).select("row", "id", "key", F.col("g_slot").alias("slot"))
    text = F.col("row").getField(text_col)

    def computed(df: DataFrame, guest: bool) -> DataFrame:
        return df.select("row", "id", "key", "slot", F.lit(guest).alias("guest"), F.struct(
            F.lit(0).alias("none"), *[f(text).alias(n) for n, f in extra.items()]).alias("extra"))

    both = computed(placed, False).unionByName(computed(visiting, True)).repartition(len(listed), "slot")
    following = Window.partitionBy("slot").orderBy("guest", *order)
    value = {c: F.col("extra" if c in extra else "row").getField(c) for c in wanted}
    ahead = both.select("guest", *[value[c].alias(f"own_{i}") for i, c in enumerate(wanted)],
                        *[F.lead(value[c]).over(following).alias(f"next_{i}") for i, c in enumerate(columns)])
    return ahead.where(~F.col("guest")).select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(wanted)],
                                               *[F.col(f"next_{i}").alias(prefix + c) for i, c in enumerate(columns)])


def edited_text(text: Column, following: Column) -> Column:
    """The last third (rounded down) of the code points replaced by as many from the front of the next text."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with their fingerprints, in a column that is new."""
    check_free(docs, name)
    return docs.withColumn(name, fingerprint(plain(text_col)))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ahead = with_next(docs.select("doc_id", "text"), ["text", "fingerprint"], extra={"fingerprint": fingerprint})
    edited = ahead.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), "fingerprint",
                          "next_fingerprint", edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    final = edited.withColumn("edited_sha256", F.sha2("edited", 256)).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return final.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
