from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm.warc import assemble_captures, loose_records, read_warc, warc_digest, write_warc
from ledgerscope.session import new_folder
from tests.llm.fixtures import collected

SCHEMA = "page_id bigint, url string, html string, content string, keeper string, found string, id string, later string"
MARK = "WARC/1.1\r\n"


def pages() -> list[tuple]:
    forged = MARK + "WARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = ["<p>one</p>", "", None, "ünï 中文 \r\n\r\n text", "x" * 300_000, MARK, "a" + MARK + "b\r\n\r\n" + MARK, forged, forged * 3 + "end",
              "\r\n\r\n", "\n", "Content-Length: 9\r\n\r\n", "ends\r\n\r\n" + MARK, "<p>one</p>", "﻿mark"]
    rows = [(10 * i, f"http://h{i}.example/a?b={i}#c", b) for i, b in enumerate(bodies)]
    rows += [(1000 + i, "no scheme", "copied to a third of all pages") for i in range(12)]
    rows += [(5, None, "copied to a third of all pages"), (5, "http://other/", "copied to a third of all pages"), (7, "http://a/\r\nX-Evil: 1\r\n", "own"),
             (None, "http://n/", "own"), (None, "http://n/", "only without an id"), (1003, "no scheme", "copied to a third of all pages"), (10, "", "another")]
    return [(*r, "c", "k", "f", "i", "l") for r in rows]


def digest(body: str | None) -> str:
    return base64.b32encode(hashlib.sha1((body or "").encode()).digest()).decode()


def brute(rows: list[tuple], least: int = 0) -> list[tuple]:
    first: dict[str, int | None] = {}
    for i, _, body, *_ in rows:
        body = body or ""
        known = first.get(body)
        first[body] = i if known is None else known if i is None else min(i, known)
    out = []
    for i, _, body, *_ in rows:
        n = len((body or "").encode())
        keeper = first[body or ""] if n >= least else i
        out.append((i, n, digest(body), "response" if i == keeper else "revisit", None if i == keeper else keeper))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark):
    assert collected(warc_digest(spark.createDataFrame(pages(), SCHEMA))) == brute(pages())
    assert warc_digest(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n in names:
        spark.conf.unset(n)


def test_plain_archives_are_read_in_splits_with_whole_payloads(spark, small_splits):
    path = new_folder(spark, "warc-test")
    write_warc(spark.createDataFrame(pages(), SCHEMA).coalesce(2), path, least_bytes=20, compression="none")
    records = read_warc(spark, path)
    assert spark.read.text(path).rdd.getNumPartitions() > 100
    captures = assemble_captures(records).collect()
    assert len(captures) == len(pages()) and all(c["request"] and c["metadata"] for c in captures)
    bodies = sorted((r[2] or "").encode() for r in pages())
    stored = [bytes(c["response"]["payload"]) for c in captures if c["response"]["record_type"] == "response"]
    assert set(stored) == set(bodies) and all(c["response"]["payload"] is None for c in captures if c["response"]["record_type"] == "revisit")
    kinds = [(c["response"]["payload_digest"], c["response"]["record_type"]) for c in captures]
    assert sorted(kinds) == sorted((r[2], r[3]) for r in brute(pages(), 20))
    declared = records.where("record_type = 'response'").select("declared_digest", "payload_digest").collect()
    assert all(r["declared_digest"] == "sha1:" + r["payload_digest"] for r in declared)
    assert not any("X-Evil" in (r["target_uri"] or "") and "%0D%0A" not in r["target_uri"] for r in records.select("target_uri").collect())


def record(kind: str, name: str, block: bytes, *extra: str, content: str = "application/http") -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *extra, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return MARK.encode() + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_links_in_either_direction_and_through_a_request(spark, tmp_path):
    get, ok = b"GET / HTTP/1.1\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n\xff\x00binary"
    fields = dict(content="application/warc-fields")
    parts = [
        record("warcinfo", "info", b"software: x\r\n", **fields),
        record("request", "q1", get), record("response", "r1", ok, "warc-concurrent-to: <q1>"),
        record("metadata", "m1", b"via: request\r\n", "WARC-Concurrent-To: <q1>", **fields),
        record("response", "r2", ok, "WARC-Concurrent-To: <q2>", "WARC-Concurrent-To: <m2>"), record("request", "q2", get),
        record("metadata", "m2", b"n: 2\r\n", **fields), record("metadata", "m2b", b"n: 3\r\n", "WARC-Concurrent-To: <r2>", **fields),
        record("response", "r3", b"HTTP/1.1 204 No Content\r\n\r\n"), record("request", "lost", get, "WARC-Concurrent-To: <nowhere>"),
        record("response", "broken", ok)[:-12],
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    records = read_warc(spark, str(tmp_path / "a.warc"))
    got = {r["capture_id"]: r for r in assemble_captures(records).collect()}
    assert set(got) == {"<r1>", "<r2>", "<r3>"}
    assert got["<r1>"]["request"]["record_id"] == "<q1>" and got["<r1>"]["metadata"]["text"] == "via: request\r\n"
    assert bytes(got["<r1>"]["response"]["payload"]) == b"\xff\x00binary" and got["<r3>"]["n_requests"] == 0 and got["<r3>"]["request"] is None
    assert got["<r2>"]["metadata"]["record_id"] == "<m2>" and got["<r2>"]["n_metadata"] == 2
    loose = {r["record_id"]: r["complete"] for r in loose_records(records).collect()}
    assert loose == {"<info>": True, "<lost>": True, "<m2b>": True, "<broken>": False}
    assert records.where(F.col("complete")).count() == len(parts) - 1
