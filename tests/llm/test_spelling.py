from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerscope.llm import spelling
from ledgerscope.llm.spelling import SLOTS, cheapest_disjoint, follow_forms, group_variants, near_words, signature, slot, spelling_digest
from tests.llm.fixtures import SCHEMA, collected, documents, empty, rows


def edits(word: str, letters: str) -> set[str]:
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1:] for i in range(len(word))}
    return out - {word}


def brute_forms(counts: dict[str, int], ratio: int = 5) -> list[tuple]:
    letters = sorted(set("".join(counts)))
    near = {w: sorted(edits(w, letters) & set(counts)) for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, counts[w], len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def vocabulary(seed: int, n: int, letters: str) -> dict[str, int]:
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.randrange(6, 10))) for _ in range(n)}
    for w in list(words)[:n // 2]:
        words.add(rng.choice(sorted(edits(w, letters))))
    words |= {"a" * 6, "a" * 7, "a" * 9, "ab" * 5, "ab" * 4 + "a", "a" * 40, "a" * 41, "a" * 20 + "b" + "a" * 20}
    return {w: rng.choice([5, 6, 30, 31, 200, 1000, 1000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("letters,n", [("ab", 150), ("abcdefgh", 400), ("aàéß÷ç", 300)])
def test_near_words_forms_and_roots(spark, letters, n):
    counts = vocabulary(n, n, letters)
    table = [(w, c, "x") for w, c in counts.items()] + [(None, 7, "x"), ("tiny", 9, "x")]
    df = spark.createDataFrame(table, "`a b` string, `n.n` int, `key` string")
    assert collected(group_variants(df, "a b", "n.n")) == brute_forms(counts)


def test_every_single_edit_meets_through_a_pivot():
    """The pivots of the word whose prefix ends first are in the other's prefix, at a shifted place at most."""
    rng = random.Random(5)
    for letters in ("ab", "abc", "abcdefghij"):
        counts = np.array([rng.randrange(1, 50) for _ in range(SLOTS)])
        for _ in range(300):
            a = "".join(rng.choices(letters, k=rng.randrange(6, 14)))
            b = rng.choice(sorted(e for e in edits(a, letters) if len(e) >= 6))
            x, y = sorted([signature(a, counts), signature(b, counts)], key=lambda s: s[0])
            assert any(g == h and abs(p - q) <= 1 for g, p in x[1] for h, q in y[2]), (a, b)


def test_pivots_are_the_cheapest_disjoint_bigrams():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randrange(3, 8)))
        grams = [(p, rng.randrange(1, 9)) for p in places]
        fits = [c for c in itertools.combinations(grams, 2) if c[1][0] - c[0][0] >= 2]
        got = cheapest_disjoint(grams)
        assert sum(dict(grams)[p] for p in got) == min(sum(w for _, w in c) for c in fits) and got[1] - got[0] >= 2
    grams = [(0, 5), (2, 1), (3, 1), (4, 1), (6, 9)]
    assert cheapest_disjoint(grams, want=3) == [0, 2, 4]


def brute_words(table: list[tuple]) -> dict[str, int]:
    found = Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            found[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_query_against_brute_force(spark):
    rng = random.Random(11)
    stems = ["Example", "colour", "Größenwahn", "naïveté", "separate", "definitely", "wwwwww", "ÀÉÎÕÜß", "long" * 500]
    texts = [" ".join(rng.choice(stems) for _ in range(200)) + "\n" + " ".join(rng.choice(sorted(edits(s.lower(), "aeé"))) for s in stems[:8] for _ in range(3))
             for _ in range(60)]
    table = rows() + [(100 + i, t, None, None, None, "key", "id", 1) for i, t in enumerate(texts)]
    want = brute_forms(brute_words(table))
    assert any(r[3] for r in want) and any(r[0] != r[5] for r in want) and len(want) > 40
    assert collected(spelling_digest(spark.createDataFrame(table, SCHEMA))) == want
    assert spelling_digest(empty(spark)).count() == 0
    assert collected(spelling_digest(documents(spark))) == brute_forms(brute_words(rows()))


def test_long_chains_and_bad_parameters(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("other", "end")], "word string, form string")
    got = {r["word"]: r["root"] for r in follow_forms(chain).collect()}
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "other": "end"}
    assert 0 <= slot("é÷") < SLOTS and near_words(spark.createDataFrame([("abcdef",)], "word string")).count() == 0
    with pytest.raises(ValueError):
        group_variants(chain, "word", "form", least_chars=3)


def test_no_join_broadcasts_the_vocabulary(spark, monkeypatch):
    """Not even a small one: Spark takes the exploded keys for no larger than the compressed file they come from."""
    plans, write = [], spelling.write_and_read

    def plan(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(df, path):
        df.collect()
        plans.append(plan(df))
        return write(df, path)

    monkeypatch.setattr(spelling, "write_and_read", seen)
    counts = vocabulary(3, 100, "abc")
    found = group_variants(spark.createDataFrame(list(counts.items()), "word string, n int"))
    assert collected(found) == brute_forms(counts)
    joined = [p for p in [*plans, plan(found)] if "Join" in p]
    assert len(joined) >= 4 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joined)
