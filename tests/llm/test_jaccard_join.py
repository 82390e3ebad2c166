from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from ledgerscope.llm.jaccard_join import (common_counts, connected, jaccard_classes, jaccard_digest, keep_one_per_class,
                                          linked, picks, runs_needed)
from tests.llm.fixtures import SCHEMA, documents, empty, rows, words
from tests.llm.test_decontaminate import tokens


def shingles(text):
    w = tokens(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(table, threshold=0.8):
    sets = [shingles(r[1]) for r in table]
    parent, links = list(range(len(table))), [0] * len(table)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(table)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and common >= threshold * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, r in enumerate(table):
        groups.setdefault(top(i), []).append(r[0])
    smallest = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((r[0], smallest[top(i)], links[i]) for i, r in enumerate(table)), key=repr)


def edited(rng, base, n):
    w = base.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


def many(rng):
    base, passage = words(rng, 200), words(rng, 60)
    table = [edited(rng, base, rng.randrange(9)) for _ in range(90)]
    table += [words(rng, 40 + rng.randrange(60)) + " " + passage for _ in range(60)]
    for _ in range(25):
        other = words(rng, 30 + rng.randrange(200))
        table += [other, edited(rng, other, 1 + rng.randrange(3)), other.upper()]
    return [(i, t, None, None, 0, "", "", 0) for i, t in enumerate(table)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_classes_equal_brute_force(spark):
    assert got(jaccard_digest(documents(spark))) == brute(rows())


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 4, "tile_rows": 8, "recall": 0.9999}])
def test_groups_splits_and_tiles(spark, options):
    table = many(random.Random(2))
    found = jaccard_classes(spark.createDataFrame(table, SCHEMA), **options)
    found = got(found.select("id", "class_id", "n_links"))
    want = brute(table)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert sum(x[2] for x in found) >= 0.97 * sum(x[2] for x in want) and all(a[2] <= b[2] for a, b in zip(found, want))


def test_one_row_per_class_stays(spark):
    docs = documents(spark)
    out = keep_one_per_class(docs)
    assert out.columns == docs.columns
    classes = {c: True for d, c, _ in brute(rows()) if c is not None}
    kept = out.collect()
    with_words = [r for r in kept if tokens(r["text"])]
    assert len({(r["doc_id"], r["text"]) for r in with_words}) == len(with_words)
    assert {r["doc_id"] for r in with_words} <= set(classes)
    assert sum(1 for r in kept if not tokens(r["text"])) == sum(1 for r in rows() if not tokens(r[1]))


def test_small_parts(spark):
    assert jaccard_digest(empty(spark)).count() == 0 and keep_one_per_class(empty(spark)).count() == 0
    assert runs_needed(0.97, 1) < runs_needed(0.97, 3) < runs_needed(0.999, 3)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype("<u4") for _ in range(70)]
    want = [[len(set(a) & set(b)) for b in sets] for a in sets]
    assert (common_counts(sets) == np.array(want)).all()
    assert linked(sets, 0.8).tolist() == [[i != j and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]


def test_connected_on_a_long_path(spark):
    rng = random.Random(9)
    names = [bytes(rng.randrange(256) for _ in range(16)) for _ in range(40)]
    edges = spark.createDataFrame([(names[i], names[i + 1]) for i in range(29)] + [(names[i], names[i + 1]) for i in range(30, 39)], "node binary, root binary")
    label = {bytes(r["node"]): bytes(r["label"]) for r in connected(edges).collect()}
    assert len({label[n] for n in names[:30]}) == 1 and len({label[n] for n in names[30:]}) == 1 and len(set(label.values())) == 2


def test_pairs_at_the_threshold_meet_on_the_last_level():
    rng = np.random.default_rng(4)
    runs, met, n = runs_needed(0.97, 3), 0, 1500
    for _ in range(n):
        large = np.sort(rng.integers(0, 1 << 64, 100, dtype=np.uint64))
        last = picks([large, np.sort(rng.permutation(large)[:80])], 3, runs, 0.8)[2]
        a, b = ({path for one in tree for two in one for path in two} for tree in last.to_pylist())
        met += bool(a & b)
    assert met / n >= 0.965  # 0.976 by the recursion; one choice for all paths of a run: 0.90


def test_recall_in_groups_of_several_hundred_near_copies(spark):
    rng = random.Random(12)
    table = []
    for g in range(3):  # most pairs are 0.80 to 0.82 alike, so every bucket stays above the leaf size
        base = words(rng, 366, 10 ** 6)
        for _ in range(330):
            w = base.split(" ")
            for at in rng.sample(range(5, 361), 4):
                w[at] = f"e{rng.randrange(10 ** 9)}"
            table.append((len(table), " ".join(w), None, None, 0, "", "", 0))
    ids = {}
    sets = [np.unique([ids.setdefault(x, len(ids)) for x in shingles(r[1])]).astype("<u4") for r in table]
    want = sum(int(linked(sets[a:a + 330], 0.8).sum()) for a in range(0, len(table), 330))
    got = sum(r["n_links"] for r in jaccard_digest(spark.createDataFrame(table, SCHEMA)).collect())
    assert want > 3 * 330 * 200 and 0.97 * want <= got <= want
