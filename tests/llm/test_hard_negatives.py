from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm.hard_negatives import hard_negatives_digest, mine_hard_negatives, pack, unpack
from tests.llm.fixtures import collected

SCHEMA = "vec_id bigint, label int, embedding array<float>, `id` string, `vector` string, `cell` string, `key` string, `anchor` string"


def table(seed: int, n: int, dim: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 0.75]) for _ in range(dim)]  # many equal scores
        rows.append((i, rng.choice([0, 1, 2, -3]), v, "x", "x", "x", "x", "x"))
    same = [0.5] * dim
    rows += [(n + i, 1 if i % 2 else 2, same, *"abcde") for i in range(n // 2)]  # one vector of a third of all rows
    bad = [(None, 1, same), (3 * n, None, same), (3 * n + 50, 1, None), (3 * n + 1, 1, [1.0, None, 1.0, 1.0]), (150, 1, [1.0, math.nan, 0.0, 0.0]),
           (3 * n + 2, 1, [1.0, math.inf, 0.0, 0.0]), (3 * n + 3, 1, []), (3 * n + 4, 2, [1.0]), (-50, 1, [1.0, 1.0, 1.0, 1.0]), (-50, 0, [9.0] * 5)]
    rows += [(*b, *"vwxyz") for b in bad] + rows[:3]
    return rows


def brute(rows: list[tuple], modulus: int = 50, n_positives: int = 5, n_negatives: int = 3, moved: bool = True) -> list[tuple]:
    items: dict[int, tuple] = {}
    for i, label, vector, *_ in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if moved and i % 7 == 0:
            label = int(math.fmod(label + 1, 10))
        items[i] = min(items[i], (label, vector)) if i in items else (label, vector)
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in items.items()}
    out = []
    for a, (label, v) in q.items():
        if a % modulus:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in q.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:n_positives]:
            fits = [(s, i) for s, i, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, positive, r, i, -p, -s) for r, (s, i) in enumerate(fits[:n_negatives], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_brute_force(spark, seed):
    rows = table(seed, 400)
    want = brute(rows)
    assert len(want) > 60 and any(r[0] == -50 for r in want)
    assert collected(hard_negatives_digest(spark.createDataFrame(rows, SCHEMA))) == want


def test_block_sizes_do_not_change_results(spark):
    rows = table(3, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    for anchor_block, row_block in ((7, 50), (1000, 33)):
        got = mine_hard_negatives(df, F.col("id") % 10 == 0, n_positives=3, n_negatives=2, anchor_block=anchor_block, row_block=row_block)
        assert collected(got) == brute(rows, 10, 3, 2, moved=False)


def test_keys_sort_by_anchor_then_score_then_kind_then_id():
    triples = [(a, s, k, i) for a in (-(1 << 63), -5, 0, 7, (1 << 63) - 1) for s in (-9, 0, 4, 1 << 51) for k in (0, 1) for i in (-2, 0, 3)]
    assert sorted(triples, key=lambda t: pack(*t)) == sorted(triples, key=lambda t: (t[0], -t[1], t[2], t[3]))
    assert [unpack(pack(*t)) for t in triples] == triples


def test_empty_tables_and_scores_that_are_not_exact(spark):
    assert hard_negatives_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    only = [(1, 1, [1.0], *"abcde"), (2, 2, [1.0], *"abcde")]
    assert hard_negatives_digest(spark.createDataFrame(only, SCHEMA)).count() == 0
    huge = [(0, 1, [3e30, 1.0], *"abcde"), (1, 1, [3e30, 1.0], *"abcde")]
    with pytest.raises(Exception, match="exact"):
        hard_negatives_digest(spark.createDataFrame(huge, SCHEMA)).count()
