"""Line dedup: which lines each document keeps, as run-length bitmaps.

Hashes of the lines' keys are range-partitioned and sorted by key, then by document (falling) and
position. A window streams over each sorted key: its first row names the keeping document, and a
row whose document differs from the one before is a document's first occurrence. A key is cut into
salts by document, so a line of a third of all documents fills many ranges; each salt leaves one
small row, and these are added up per key. Only hashes, ids and positions are shuffled; the result
per document is a bitmap of kept lines in run-length form.

Defined results: a null or empty text is one empty line. Rows that share id and
text count as one document and get the same bitmap. A null id sorts below all
others. Lines with short keys and keys of few documents always stay. Other columns may have any
names and come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerscope.llm.texts import let, packed, plain, row_key, unpacked
from ledgerscope.session import new_folder, write_and_read

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEEP_TYPE = "array<struct<start:int,length:int>>"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                      min_docs: int = 5) -> DataFrame:
    """(id, key, dropped): per document that loses lines, their sorted positions."""
    text = plain(text_col)
    lines = docs.select(plain(id_col).alias("id"), row_key(text).alias("key"), F.posexplode(split_lines(text))).select(
        "id", "key", "pos", line_key(F.col("col")).alias("line")).where(F.length("line") >= min_chars)
    hashed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "id", "key", "pos")
    hashed = write_and_read(hashed, new_folder(docs.sparkSession, "line-hashes"))  # the texts are split once
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64(F.col("id").isNull(), "id", "key"), F.lit(salts)))
    document = [F.col("id").desc_nulls_last(), "key"]
    placed = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", *document, "pos")
    falling = Window.partitionBy("h1", "h2", "salt").orderBy(*document, "pos")
    before = F.lag(F.struct("id", "key")).over(falling)
    streamed = placed.select("h1", "h2", F.first("id").over(falling).alias("keeper"), before.eqNullSafe(F.struct("id", "key")).alias("again"))
    shared = streamed.groupBy("h1", "h2").agg(F.count_if(~F.col("again")).alias("docs"), F.max("keeper").alias("keeper")).where(
        F.col("docs") >= min_docs)
    # The counts are written before they are joined: a join of two plain shuffles can split a hot line.
    shared = write_and_read(shared, new_folder(docs.sparkSession, "line-counts"))
    lost = hashed.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("id", "key").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """Run-length bitmap: the runs (start, length) of kept lines, from the sorted dropped positions."""
    def runs(at: Column) -> Column:
        ends, starts = F.concat(at, F.array(n_lines)), F.concat(F.array(F.lit(0)), F.transform(at, lambda x: x + 1))
        pairs = F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("int").alias("start"), (b - a).cast("int").alias("length")))
        return F.filter(pairs, lambda r: r["length"] > 0)

    return let(dropped, runs)


def kept_text(text: Column, keep: Column) -> Column:
    """The text that a bitmap leaves, lines joined by line breaks."""
    return let(split_lines(text), lambda lines: F.array_join(
        F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n"))


def _attach(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(row, text, n_lines, n_dropped, keep): all columns of ``docs`` in a struct, and the bitmap."""
    lost = dropped_positions(docs, id_col, text_col, min_chars, min_docs).toDF("other_id", "other_key", "dropped")
    rows = docs.select(packed(docs), plain(id_col).alias("id"), row_key(plain(text_col)).alias("key"),
                       F.size(split_lines(plain(text_col))).alias("n_lines"))
    found = rows.join(lost, (F.col("key") == F.col("other_key")) & F.col("id").eqNullSafe(F.col("other_id")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return found.select("row", F.col("row").getField(text_col).alias("text"), "id", "key", "n_lines", F.size(dropped).alias("n_dropped"), keep_runs(dropped, F.col("n_lines")).alias("keep"))


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                      min_docs: int = 5) -> DataFrame:
    """(id, key, n_lines, n_dropped, keep) per row; ``key`` is :func:`row_key` of the text."""
    return _attach(docs.select(plain(id_col), plain(text_col)), id_col, text_col, min_chars, min_docs).select(
        "id", "key", "n_lines", "n_dropped", "keep")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5) -> DataFrame:
    """The documents with the bitmaps applied to their text, all other columns as they were."""
    left = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept_text(F.col("text"), F.col("keep")))
    return _attach(docs, id_col, text_col, min_chars, min_docs).select(*unpacked(docs, **{text_col: left}))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, keep: the bitmaps of :func:`dropped_positions` applied to each text."""
    marked = _attach(docs.select("doc_id", "text"), "doc_id", "text", 40, 5)
    whole = F.coalesce("text", F.lit(""))
    left = F.when(F.col("n_dropped") == 0, whole).otherwise(kept_text(F.col("text"), F.col("keep")))
    return marked.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("bigint").alias("n_lines"),
                         F.col("n_dropped").cast("bigint").alias("n_dropped"),
                         F.sha2(left, 256).alias("kept_sha256"),
                         F.array_join(F.transform("keep", lambda r: F.concat(r["start"], F.lit("+"), r["length"])), ",").alias("keep_runs"))
