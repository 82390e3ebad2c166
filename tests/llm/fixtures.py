"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` string, `id` string, `start` int"


def words(rng: random.Random, n: int, pool: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def rows(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    shared = words(rng, 90)
    base = words(rng, 300)
    near = base.split(" ")
    near[150] = "edited"
    texts = [
        base, base, " ".join(near), "start " + base, base + " end", None, "", " ", "\n", "one", "two words", "a\n\nb\n",
        words(rng, 40) + "\n" + shared + "\n" + words(rng, 50), words(rng, 60) + " " + shared,
        shared + "\n" + words(rng, 200), "é ü ñ " * 200, "ab" * 900, "xyz " * 400, shared.upper(), words(rng, 6000),
        "Ünïcode — “quotes” 中文字符 " + shared, "password=hunter22secret\ntoken: token=abc token=abcdef1", "\x00\x01 control \x7f",
        "  double  spaces   and\ttabs \r\n", "<|endoftext|> is text",
    ]
    texts += [f"This line is repeated in many documents, number one.\nown {i} {words(rng, 30)}\n  THIS LINE is repeated in many documents, number one. " for i in range(6)]
    table = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", len(t or ""), "k", "i", i) for i, t in enumerate(texts)]
    table += [table[0], table[0], table[5], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
              (3, "another text under a known id " + words(rng, 20), "en", "s1", 1, "k", "i", 0)]
    return table


def documents(spark, seed: int = 7):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
