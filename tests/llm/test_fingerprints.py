from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ledgerscope.llm.fingerprints import BINS, fingerprint, fingerprint_digest, likeness, with_next
from tests.llm.fixtures import SCHEMA, documents, empty, rows, words
from tests.llm.test_jaccard_join import edited, shingles


def order(r):
    return (r[0] is not None, r[0] or 0)


def test_edited_texts_follow_the_next_document(spark):
    table = [r for r in rows() if r[0] not in (None, 0, 3, 5)]  # ids that occur once
    got = {r["doc_id"]: r for r in fingerprint_digest(spark.createDataFrame(table, SCHEMA)).collect()}
    falling = sorted(table, key=lambda r: -r[0])
    assert len(got) == len(table)
    for r, following in zip(falling, falling[1:] + falling[:1]):
        text, third = r[1] or "", len(r[1] or "") // 3
        want = text[:len(text) - third] + (following[1] or "")[:third]
        assert got[r[0]]["n_chars"] == len(text)
        assert got[r[0]]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_next_row_does_not_depend_on_slots(spark):
    docs = documents(spark)
    found = [sorted(((r["doc_id"], r["text"], r["next_text"]) for r in with_next(docs, ["text"], slots=n).collect()), key=repr) for n in (1, 3, 50)]
    assert found[0] == found[1] == found[2] and len(found[0]) == docs.count()


def test_equal_texts_and_empty_ones(spark):
    docs = documents(spark).select("text", fingerprint(F.col("text")).alias("f")).collect()
    by = {}
    for r in docs:
        by.setdefault(frozenset(shingles(r["text"])), set()).add(r["f"])
    assert all(len(x) == 1 for x in by.values())
    assert by[frozenset()] == {""} and all(len(f) == 2 * BINS for k, x in by.items() if k for f in x)
    assert fingerprint_digest(empty(spark)).count() == 0


def test_likeness_estimates_jaccard(spark):
    import random

    rng = random.Random(4)
    pairs = []
    for n in (60, 300, 1500):
        for edits in (0, 2, 10, 40):
            base = words(rng, n)
            pairs.append((base, edited(rng, base, edits * n // 300)))
    pairs.append((words(rng, 200), words(rng, 200)))
    printed = spark.createDataFrame(pairs, "a string, b string").withColumns({"f": fingerprint(F.col("a")), "g": fingerprint(F.col("b"))})
    got = printed.select("a", "b", likeness(F.col("f"), F.col("g")).alias("s")).collect()
    gaps = []
    for r in got:
        a, b = shingles(r["a"]), shingles(r["b"])
        gaps.append(abs(len(a & b) / len(a | b) - r["s"]))
    assert max(gaps) < 0.2 and sum(gaps) / len(gaps) < 0.05


def test_no_python_on_the_executors(spark):
    plan = fingerprint_digest(documents(spark).where("doc_id is not null"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_fingerprint(text):
    """One-permutation MinHash in plain Python: the smallest hash per bin, borrowed along the bin's probes, lowest byte."""
    import re

    import xxhash

    def of_long(x, seed):
        return xxhash.xxh64_intdigest((x & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), seed)

    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded) if w]
    if not hashed:
        return ""
    if len(hashed) >= 5:
        found = []
        for i in range(len(hashed) - 4):
            h = 42
            for x in hashed[i:i + 5]:
                h = of_long(x, h)
            found.append(h)
    else:
        blank = 42
        for x in hashed:
            blank = of_long(x, blank)
        found = [blank]
    least = {}
    for h in found:
        signed = h - (1 << 64) if h >> 63 else h
        least[(signed >> 57) + 64] = min(least.get((signed >> 57) + 64, signed), signed)
    out = []
    for b in range(128):
        at, t, step = b, 0, (b + 1) * 0x9E3779B97F4A7C15 >> 20
        while at not in least:
            at = ((step >> 7) + t * (step | 1)) % 128
            t += 1
        out.append(f"{least[at] & 0xFF:02X}")
    return "".join(out)


def test_fingerprints_equal_plain_minhash(spark):
    got = documents(spark).select("text", fingerprint(F.col("text")).alias("f")).collect()
    assert len(got) > 30 and all(r["f"] == brute_fingerprint(r["text"]) for r in got)


def test_ids_of_any_type_and_many_rows_of_one_id(spark):
    table = [(None if i % 3 else f"id {i % 20:03d}", f"text {i} " + "w" * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(table, "name string, text string")
    found = [sorted(((r["name"], r["text"], r["next_text"]) for r in with_next(docs, ["text"], id_col="name", slots=n).collect()), key=repr) for n in (1, 7, 90)]
    assert found[0] == found[1] == found[2] and len({x[2] for x in found[0]}) == 200
    named = [x for x in found[0] if x[0] is not None]
    assert sum(dict((t, n) for n, t in table)[x[2]] is None for x in named) == 1  # only the last named row is followed by a null id
