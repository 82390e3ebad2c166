"""WARC archives: write captures, read records, assemble transactions.

Writing. A page becomes a request, a response or revisit, and a metadata record, tied by
``WARC-Concurrent-To``. A payload that several pages share is stored once, in the response of the smallest
page id; the other pages revisit it. Shared digests are counted by partial sums and written before they are
joined, so a payload of a third of all pages is split over tasks. Records are composed by
column functions; Spark's text writer ends each with the two line breaks the format asks for.

Reading. Spark's text reader cuts archives at the version line, so a plain file is read in splits and a
compressed one as a stream; no task holds more than a record at a time. A payload may hold the version line
itself. Its record is then cut short, which the declared length shows; the pieces of files with such
records are put in order by place and joined until the declared length is reached.

Assembly. Request and metadata records find their response by joins on concurrent-to identifiers, named on
either side, or through another record of the same capture. One nested row comes out per response or
revisit, with the request and the metadata record of the smallest identifier and the number of each; bounded
state per capture, whatever the number. :func:`loose_records` returns every record that no row holds.

Defined results: null html is an empty payload. A null url leaves its header out. Line breaks in a url are
percent-encoded. Pages that repeat an id and a payload share their record identifiers: all are responses if
the id is the smallest, else all are revisits; each still gives one row. A null id comes after all others and
is null again when read. Records that end before their declared length have ``complete`` false
and are no part of a capture. Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerscope.llm.texts import let, plain, small_batches
from ledgerscope.session import new_folder, write_and_read

VERSION = "WARC/1.1"
BREAK = "\r\n"
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CENTRES = ("response", "revisit")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: five hex digits are four base32 digits."""
    def digits(hexed: Column) -> Column:
        return F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)])

    return F.translate(let(F.sha1(data), digits), _DIGITS32, BASE32)


def _urn(kind: str, *of: Column) -> Column:
    """Identifier of a record, the same whenever it is computed."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in of]))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(fields: list[tuple[str, Column | str]], *block: Column) -> Column:
    """A record without its last two line breaks, from the parts of its block; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), sum((F.octet_length(b) for b in block[1:]), F.octet_length(block[0]))))
    return F.concat(F.lit(VERSION + BREAK), F.concat_ws(BREAK, *lines), F.lit(BREAK * 2), *block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Three records per page, as archives below ``path``. Payloads under ``least_bytes`` are all responses."""
    rows = pages.select(plain(id_col).alias("id"), plain(url_col).alias("url"), F.coalesce(plain(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("content", F.sha2("html", 256))
    counted = rows.where(F.octet_length("html") >= least_bytes).groupBy("content").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("keeper"))
    shared = write_and_read(counted.where("n > 1").select("content", "keeper"), new_folder(pages.sparkSession, "warc-shared"))
    known = rows.join(shared.withColumn("found", F.lit(True)), "content", "left")
    later = F.col("found").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    named = known.select(
        "id", "html", uri.alias("uri"), later.alias("later"), F.concat(F.lit("sha1:"), base32_sha1(F.col("html"))).alias("digest"),
        _urn("centre", F.col("id"), F.col("content")).alias("centre"), _urn("request", F.col("id"), F.col("content")).alias("request"),
        _urn("metadata", F.col("id"), F.col("content")).alias("metadata"),
        F.when(later, _urn("centre", F.col("keeper"), F.col("content"))).alias("refers_to"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("html"), F.lit(BREAK * 2))
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce("uri", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)),
                     F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(BREAK * 2))
    known_id = F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(BREAK))

    def side(kind: str, content: str) -> list[tuple[str, Column | str]]:
        return [("WARC-Type", kind), ("WARC-Record-ID", F.col(kind)), ("WARC-Date", date), ("WARC-Target-URI", F.col("uri")),
                ("WARC-Concurrent-To", F.col("centre")), ("Content-Type", content)]

    centre = [
        ("WARC-Type", F.when(F.col("later"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("centre")), ("WARC-Date", date),
        ("WARC-Target-URI", F.col("uri")), ("WARC-Payload-Digest", F.col("digest")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Profile", F.when(F.col("later"), REVISIT_PROFILE)), ("Content-Type", "application/http; msgtype=response")]
    records = named.select(F.explode(F.array(
        _record(side("request", "application/http; msgtype=request"), asked),
        _record(centre, http, F.when(F.col("later"), "").otherwise(F.col("html"))),
        _record(side("metadata", "application/warc-fields"), known_id))).alias("value"))
    records.write.option("lineSep", BREAK * 2).option("compression", compression).text(path)


def _declared_end(piece: bytes) -> int | None:
    """Bytes of the whole record that begins with ``piece``, its closing line breaks included; None if it has no length."""
    head, found, _ = piece.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n") if found else ():
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return len(head) + 4 + int(value) + 4
    return None


def _join_pieces(batches: Iterator[pa.RecordBatch], version: str) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by file and place; a record that its declared length carries past a version line is joined again."""
    file, parts, size, end = None, [], 0, None
    mark = (version + BREAK).encode()
    for batch in batches:
        out = []
        for path, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if path != file and parts:  # an archive that breaks off
                out.append(mark.join(parts))
                parts = []
            file = path
            if not parts:
                size, end = -len(mark), _declared_end(piece)
            parts.append(piece)
            size += len(mark) + len(piece)
            if end is None or size >= end:
                out.append(mark.join(parts))
                parts = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["piece"])
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([mark.join(parts)], pa.binary())], names=["piece"])


def _head(piece: Column) -> Column:
    return F.substring_index(piece, BREAK * 2, 1)


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1), F.lit(""))


def _complete(piece: Column) -> Column:
    length = _field(_head(piece), "Content-Length").cast("bigint")
    return F.coalesce(F.octet_length(piece) == F.octet_length(_head(piece)) + 4 + length + 4, F.lit(False))


def _pieces(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(file, place, n, piece): the bytes between two version lines."""
    read = spark.read.option("lineSep", version + BREAK).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"),
                       F.monotonically_increasing_id().alias("n"), F.col("value").alias("piece")).where(F.length("piece") > 0)


def read_warc(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """One row per record of the archives below ``path``, which all have one version line.

    Columns: record_type, record_id, concurrent_to (array), target_uri, date, refers_to, content_type, http_header,
    payload (binary; null for a revisit), payload_bytes, payload_digest (of the full payload: computed, for a
    revisit as declared), declared_digest, complete.
    """
    pieces = _pieces(spark, path, version)
    cut_short = write_and_read(pieces.where(~_complete(F.col("piece"))).select("file").distinct(), new_folder(spark, "warc-cut"))
    if cut_short.first() is not None:
        small_batches(spark)
        joined = pieces.join(cut_short, "file", "left_semi").select("file", "place", "n", F.col("piece").cast("binary").alias("piece"))
        joined = joined.repartition("file").sortWithinPartitions("file", "place", "n").select("file", "piece").mapInArrow(
            lambda batches: _join_pieces(batches, version), "piece binary")
        pieces = pieces.join(cut_short, "file", "left_anti").select("piece").unionByName(joined.select(F.col("piece").cast("string").alias("piece")))
    heads = pieces.select("piece", _head(F.col("piece")).alias("head"), _complete(F.col("piece")).alias("complete"))
    blocks = heads.select(
        *[_field(F.col("head"), name).alias(to) for name, to in (
            ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
            ("WARC-Refers-To", "refers_to"), ("Content-Type", "content_type"), ("WARC-Payload-Digest", "declared_digest"))],
        F.regexp_extract_all("head", F.lit(r"(?im)^WARC-Concurrent-To:[ \t]*([^\r\n]*?)[ \t]*$"), F.lit(1)).alias("concurrent_to"),
        F.when(F.col("complete"), F.substring(F.col("piece").cast("binary"), F.octet_length("head") + 5,
                                              F.octet_length("piece") - F.octet_length("head") - 8)).alias("block"), "complete")
    is_http = F.col("content_type").startswith("application/http")
    parts = blocks.withColumn("http_header", F.when(is_http, _head(F.col("block").cast("string"))))
    payload = F.when(F.col("record_type") == "revisit", None).when(
        is_http, F.substring(F.col("block"), F.octet_length("http_header") + 5, F.octet_length("block"))).otherwise(F.col("block"))
    revisit = F.col("record_type") == "revisit"
    return parts.withColumn("payload", payload).select(
        "record_type", "record_id", "concurrent_to", "target_uri", "date", "refers_to", "content_type", "http_header", "payload",
        F.when(revisit, _field(F.col("http_header"), "Content-Length").cast("bigint")).otherwise(
            F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("declared_digest", "^sha1:", "")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "declared_digest", "complete")


def _owners(records: DataFrame) -> DataFrame:
    """(record_id, centre): the response or revisit that each request or metadata record belongs to."""
    whole = records.where("complete")
    links = whole.select("record_id", "record_type", F.explode("concurrent_to").alias("other"))
    centres = whole.where(F.col("record_type").isin(*CENTRES)).select(F.col("record_id").alias("centre")).distinct()
    of_sides = links.where(~F.col("record_type").isin(*CENTRES)).select("record_id", "other").distinct()
    of_centres = links.where(F.col("record_type").isin(*CENTRES)).select(F.col("other").alias("record_id"), F.col("record_id").alias("centre"))
    direct = of_sides.join(centres, F.col("other") == F.col("centre")).select("record_id", "centre").unionByName(of_centres)
    direct = direct.groupBy("record_id").agg(F.min("centre").alias("centre"))
    through = of_sides.join(direct.select(F.col("record_id").alias("other"), "centre"), "other").select("record_id", "centre")
    # A direct link comes before one through another record.
    ranked = direct.select("record_id", F.struct(F.lit(0).alias("hops"), "centre").alias("c")).unionByName(
        through.select("record_id", F.struct(F.lit(1).alias("hops"), "centre").alias("c")))
    return ranked.groupBy("record_id").agg(F.min("c").alias("c")).select("record_id", "c.centre")


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit: capture_id, target_uri, date, response, request, metadata, n_requests, n_metadata.

    ``response`` holds the record's type, refers_to, http_header, payload_bytes, payload_digest and, where ``records``
    has it, the payload; ``request`` its http_header; ``metadata`` its text.
    """
    owned = records.where("complete").join(_owners(records), "record_id")

    def first(kind: str, *columns: Column) -> Column:
        return F.min(F.when(F.col("record_type") == kind, F.struct("record_id", *columns))).alias(kind)

    def number(kind: str) -> Column:
        return F.count(F.when(F.col("record_type") == kind, 1))

    metadata = F.col("payload_text") if "payload_text" in records.columns else F.col("payload").cast("string")
    sides = owned.groupBy("centre").agg(
        first("request", F.col("http_header")), first("metadata", metadata.alias("text")),
        number("request").alias("n_requests"), number("metadata").alias("n_metadata"))
    response = [c for c in ("record_type", "refers_to", "http_header", "payload_bytes", "payload_digest", "payload") if c in records.columns]
    centres = records.where(F.col("complete") & F.col("record_type").isin(*CENTRES)).select(
        F.col("record_id").alias("capture_id"), "target_uri", "date", F.struct(*response).alias("response"))
    return centres.join(sides, F.col("capture_id") == F.col("centre"), "left").drop("centre").fillna(0, ["n_requests", "n_metadata"])


def loose_records(records: DataFrame) -> DataFrame:
    """The records that no row of :func:`assemble_captures` holds: incomplete, without a capture, or beyond the first of their kind."""
    captures = assemble_captures(records)
    held = captures.select(F.explode(F.array("capture_id", "request.record_id", "metadata.record_id")).alias("record_id")).distinct()
    return records.where(F.col("complete")).join(held, "record_id", "left_anti").unionByName(records.where(~F.col("complete")))


def without_payloads(records: DataFrame) -> DataFrame:
    """The records with the text of metadata alone in place of payloads: small rows, for joins."""
    text = F.when(F.col("record_type") == "metadata", F.col("payload").cast("string"))
    return records.withColumn("payload_text", text).drop("payload")


def warc_digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per page, from archives that are written and read back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_warc(pages, path)
    records = write_and_read(without_payloads(read_warc(spark, path)), new_folder(spark, "warc-records"))
    captures = assemble_captures(records)
    kind = dict(pages.dtypes)["page_id"]
    named = write_and_read(captures.select("capture_id", _field(F.col("metadata.text"), "page-id").cast(kind).alias("page_id"), "response.*"),
                           new_folder(spark, "warc-captures"))
    asked = named.where(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("capture_id")).distinct()
    first = named.where(F.col("record_type") == "response").join(asked, "capture_id", "left_semi").groupBy(
        F.col("capture_id").alias("original")).agg(F.min("page_id").alias("original_page"))
    # Written before it is joined: a join of two plain shuffles can split a payload that very many pages revisit.
    first = write_and_read(first, new_folder(spark, "warc-originals"))
    return named.join(first, F.col("refers_to") == F.col("original"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("original_page").alias("refers_to"))
