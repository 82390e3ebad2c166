"""Language identification and quality classifier."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from ledgerscope.llm.language import (Pieces, default_vocabulary, fit_languages, fit_pieces, forward, identify_languages,  # noqa: E402
                                      language_digest, vocabulary_pieces)
from ledgerscope.llm.quality import (fit_network, fit_quality, fit_temperature, keep_good, pooled, quality_digest, random_vectors,  # noqa: E402
                                     score_quality, tokens_of)
from ledgerscope.llm.texts import text_chunks  # noqa: E402
from tests.llm.fixtures import SCHEMA, documents, empty, rows  # noqa: E402

SYLLABLES = {"en": "the ing tion and er ly".split(), "de": "sch ung keit der ein lich".split(), "fr": "eau tion que é ment oi".split()}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_forward_sums_all_segmentations():
    names = [b" a", b" ab", b"b", b"ba", b"a", b" "]
    pieces, p = Pieces.of(names), np.array([[0.2], [0.1], [0.3], [0.15], [0.05], [0.2], [0.0]])
    prob = dict(zip(names, p[:, 0]))

    @lru_cache
    def total(word):
        return 1.0 if not word else sum(prob[x] * total(word[len(x):]) for x in names if word.startswith(x))

    for word in (b" a", b" ab", b" abab", b" bbabab", b" aabbaab"):
        grid = np.frombuffer(word, np.uint8)[None, :]
        assert np.exp(forward(grid, pieces, p)[0, 0]) == pytest.approx(total(word))
    long = b" " + b"ab" * 32
    assert forward(np.frombuffer(long, np.uint8)[None, :], pieces, p)[0, 0] == pytest.approx(np.log(total(long)))


def test_fitting_raises_the_likelihood():
    pieces = Pieces.of([b" a", b" ab", b"b", b"ba", b"a", b" "])
    data, counts = [b"ab", b"aba", b"b"], np.array([5.0, 3.0, 1.0])

    def likelihood(p):
        table = np.append(p, 0.0)[:, None]
        return sum(c * forward(np.frombuffer(b" " + w, np.uint8)[None, :], pieces, table)[0, 0] for w, c in zip(data, counts))

    fits = [likelihood(fit_pieces(data, counts, pieces, rounds)) for rounds in (1, 2, 4)]
    assert fits[0] < fits[1] < fits[2] + 1e-6


def test_vocabulary_covers_every_byte():
    pieces = vocabulary_pieces(default_vocabulary())
    assert {bytes([b]) for b in range(256)} <= set(pieces) and len(set(pieces)) == len(pieces)


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    table = [(i, text(rng, lang), lang, "s", 0, "", "", 0) for i, lang in enumerate(list(SYLLABLES) * 60)]
    table += [(1000, None, "en", "s", 0, "", "", 0), (1001, "123 !!", "en", "s", 0, "", "", 0), (1002, "", None, "s", 0, "", "", 0),
              (1003, "ungkeitschlich" * 3000, None, "s", 0, "", "", 0), (None, text(rng, "fr"), "de", "s", 0, "", "", 0)]
    got = language_digest(spark.createDataFrame(table, SCHEMA)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(table) and all(0 <= r["score"] <= 1 for r in got)
    assert all(by[r[0]]["lang_pred"] == r[2] for r in table[:180])
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by[1003]["lang_pred"] == "de" and by[None]["lang_pred"] == "fr" and by[None]["held_out"] is False


def test_language_of_awkward_and_empty_tables(spark):
    docs = documents(spark)
    model = fit_languages(docs)
    out = identify_languages(docs, model)
    assert out.columns == [*docs.columns, "lang_pred", "score"] and out.count() == docs.count()
    assert language_digest(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(docs, fit_languages(empty(spark))).collect()} == {"und"}


def junk(rng, kind):
    base = text(rng, "en").split(" ")
    return {0: " ".join(w.upper() + "!!" for w in base), 1: " ".join([base[0]] * 40), 2: " ".join(w + "***" for w in base)}[kind]


def test_quality_is_learned_and_held_out_rows_are_scored(spark):
    rng = random.Random(2)
    docs = [(i, text(rng, "en") if i % 3 else junk(rng, i % 4 % 3), None, None, 0, "", "", 0) for i in range(600)]
    docs += [(None, "x", None, None, 0, "", "", 0), (9000, None, None, None, 0, "", "", 0), docs[0]]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    frame = spark.createDataFrame(docs, SCHEMA)
    got = quality_digest(frame, labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.97
    kept = keep_good(frame, labels)
    assert kept.columns == frame.columns and 380 <= kept.count() <= 420


def test_quality_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents(spark)
    assert {r["score"] for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    assert keep_good(docs, none).count() == docs.count()
    assert quality_digest(empty(spark), none).count() == 0


def test_pooling_is_the_mean_of_token_vectors():
    texts = pa.array([r[1] for r in rows()])
    vectors = random_vectors().astype(np.float64)
    for data, bounds in text_chunks(texts):
        tokens, out = tokens_of(data, bounds), pooled(data, bounds, vectors)
        for row in range(len(bounds) - 1):
            own = vectors[tokens.ids[tokens.rows == row]]
            assert np.allclose(out[row], own.mean(axis=0) if len(own) else 0)


def test_network_and_temperature():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] * x[:, 1] + 0.5 * x[:, 2]) > 0).astype(float)
    net = fit_network(x[:600], y[:600])
    assert np.mean((net.scores(x[600:]) > 0.5) == y[600:]) > 0.85
    assert fit_temperature(np.array([9.0, 9.0, -9.0, -9.0]), np.array([1.0, 0.0, 0.0, 1.0])) > 5
