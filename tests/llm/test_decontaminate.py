from __future__ import annotations

import hashlib
import re

import pytest

from ledgerscope.llm.decontaminate import contamination_digest, decontaminate, mark_contamination
from tests.llm.fixtures import SCHEMA, collected, documents, empty, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(table, bench):
    windows = {}
    for item, text in bench:
        w = tokens(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    out = []
    for r in table:
        w, hit, items = tokens(r[1]), set(), set()
        for size in range(1, 11):
            for i in range(len(w) - size + 1):
                if (t := tuple(w[i:i + size])) in windows:
                    hit.update(range(i, i + size))
                    items |= {x for x in windows[t] if x is not None}
        ids = ",".join(sorted(map(str, items)))
        out.append((r[0], len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def benchmark_rows():
    t = {r[0]: r[1] for r in rows() if r[0] is not None}
    long = t[12].split("\n")[1]
    return [(0, " ".join(long.split(" ")[5:40])), (1, long.upper().replace(" ", ", ")), (2, "one"), (3, "xyz xyz"), (4, None), (5, ""), (6, "é ü ñ é"),
            (7, " ".join(t[19].split(" ")[4000:4030])), (None, "words two words"), (10, "two words"), (11, "xyz " * 14), (0, "ab " * 3)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 2000])
def test_digest_equals_brute_force(spark, block_bytes):
    bench = spark.createDataFrame(benchmark_rows(), "item_id bigint, text string")
    docs = documents(spark)
    if block_bytes > 10000:
        assert collected(contamination_digest(docs, bench)) == brute(rows(), benchmark_rows())
    marked = mark_contamination(docs, bench, block_bytes=block_bytes)
    got = sorted(((r["doc_id"], r["_bench"]["n_words"], r["_bench"]["n_hit"], len(r["_bench"]["items"])) for r in marked.collect()), key=repr)
    assert got == sorted((x[:4] for x in brute(rows(), benchmark_rows())), key=repr)


def test_filter_keeps_clean_rows_and_columns(spark):
    bench = spark.createDataFrame(benchmark_rows(), "item_id bigint, text string")
    out = decontaminate(documents(spark), bench)
    assert out.columns == documents(spark).columns
    assert out.count() == sum(not x[-1] for x in brute(rows(), benchmark_rows()))


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination_digest(documents(spark), bench).where("contaminated").count() == 0
    assert contamination_digest(empty(spark), bench).count() == 0
    assert SCHEMA
