from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from ledgerscope.llm.line_dedup import dedup_lines, line_dedup_digest, line_keep_bitmaps
from tests.llm.fixtures import collected, documents, empty, rows


def brute(table):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line))
    holders = defaultdict(set)
    for r in table:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add((r[0], r[1] or ""))
    low = lambda i: (i is not None, i or 0)
    out = []
    for r in table:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or low(r[0]) == max(low(d) for d, _ in holders[key(x)])]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_digest_equals_brute_force(spark):
    got = collected(line_dedup_digest(documents(spark)).drop("keep_runs"))
    assert got == brute(rows())
    assert any(r[2] for r in got)


def test_bitmaps_cover_the_kept_lines(spark):
    for r in line_keep_bitmaps(documents(spark)).collect():
        assert sum(x["length"] for x in r["keep"]) == r["n_lines"] - r["n_dropped"]


def test_other_columns_stay_and_empty_table(spark):
    docs = documents(spark)
    out = dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup_digest(empty(spark)).count() == 0 and dedup_lines(empty(spark)).count() == 0


def test_a_window_streams_over_the_sorted_ranges(spark, monkeypatch):
    """The sort stays in the plan, and the window takes the range partitions as they are."""
    from ledgerscope.llm import line_dedup

    plans, write = [], line_dedup.write_and_read
    monkeypatch.setattr(line_dedup, "write_and_read", lambda df, path: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or write(df, path))
    assert line_dedup_digest(documents(spark)).count() == len(rows())
    streamed = next(p for p in plans if "Window" in p)
    assert "first(id" in streamed and "lag(" in streamed and "Sort [h1" in streamed
    assert "rangepartitioning(h1" in streamed and "salt" not in "".join(x for x in streamed.splitlines() if "hashpartitioning" in x)
    assert not any("Python" in p or "Arrow" in p for p in plans)
