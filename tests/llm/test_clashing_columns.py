"""Columns of the input whose names the operators use inside come back as they were, or raise one stated error."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm.chunk_dedup import dedup_chunks
from ledgerscope.llm.decontaminate import decontaminate, mark_contamination
from ledgerscope.llm.fingerprints import fingerprint, fingerprint_documents, with_next
from ledgerscope.llm.hard_negatives import mine_hard_negatives
from ledgerscope.llm.jaccard_join import keep_one_per_class
from ledgerscope.llm.language import fit_languages, identify_languages
from ledgerscope.llm.line_dedup import dedup_lines
from ledgerscope.llm.packing import pack_documents
from ledgerscope.llm.quality import fit_quality, keep_good, score_quality
from ledgerscope.llm.secrets import scan_secrets
from ledgerscope.llm.suffix_dedup import remove_repeats
from tests.llm.fixtures import rows

NAMES = ("row id key marks starts ends left n_removed n_spans cut slot guest extra language salt keep dropped n_lines n_dropped other_id other_key "
         "from to one again kept_id kept_key label node class_id _row _owner _spans _text spans own_0 next_0 next_1 document some n_shared hits items "
         "k1 k2 r gram run first last place open bytes n keeper h1 h2 pos lost shared d1 d2 start length vector windows cell is_row anchor score_ "
         "_bench_ _sd_row _cd_row _ld_row _jj_row _nx_id _quality_score _language _y _hold _id x part none g_id g_key g_slot a.b").split()


@pytest.fixture(scope="module")
def docs(spark):
    plain = [r for r in rows() if r[0] is not None]
    frame = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in plain], "doc_id bigint, text string, lang string, source string")
    return frame.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id")).alias(n) for n in NAMES])


def same_columns(out, docs, changed=()):
    """Every column but the changed ones holds what the row's id says."""
    assert out.columns[:len(docs.columns)] == docs.columns
    for r in out.collect():
        assert all(r[n] == f"{n} of {r['doc_id']}" for n in NAMES if n not in changed)
    return out.count()


def test_filters_and_removals(spark, docs):
    bench = spark.createDataFrame([(0, "two words")], "item_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    n = docs.count()
    assert same_columns(decontaminate(docs, bench), docs) == n - 1
    assert same_columns(mark_contamination(docs, bench, name="new", block_bytes=30), docs) == n
    assert same_columns(dedup_lines(docs), docs) == n
    assert same_columns(dedup_chunks(docs), docs) == n
    assert same_columns(remove_repeats(docs), docs) == n
    assert same_columns(keep_one_per_class(docs), docs) < n
    assert same_columns(keep_good(docs, labels), docs) <= n
    model = fit_quality(docs, labels)
    assert same_columns(score_quality(docs, model, name="new"), docs) == n
    languages = fit_languages(docs)
    assert same_columns(identify_languages(docs, languages), docs) == n


def test_additions(docs):
    n = docs.count()
    assert same_columns(fingerprint_documents(docs), docs) == n
    assert same_columns(with_next(docs, ["text", "print"], prefix="following_", slots=3, extra={"print": fingerprint}), docs) == n
    found = scan_secrets(docs, keep=tuple(c for c in docs.columns if c != "text"))
    assert found.count() == n and all(r[c] == f"{c} of {r['doc_id']}" for r in found.collect() for c in NAMES)
    pieces = pack_documents(docs, max_length=64)
    assert set(pieces.columns) == {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"}
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("label_"), F.array(F.lit(1.0)).alias("embedding"), *[F.col(f"`{c}`") for c in NAMES])
    assert mine_hard_negatives(vectors, F.col("id") == 0, label_col="label_").count() == 0


@pytest.mark.parametrize("call", [
    lambda d, b: mark_contamination(d, b, name="marks"), lambda d, b: remove_repeats(d, name="LEFT"), lambda d, b: fingerprint_documents(d, name="key"),
    lambda d, b: with_next(d, ["text"], prefix="next_", extra={"slot": fingerprint}), lambda d, b: scan_secrets(d.withColumn("found", F.lit(1)), keep=("doc_id", "found")),
    lambda d, b: identify_languages(d, fit_languages(d.limit(0)), lang_name="label"),
])
def test_an_output_never_overwrites_an_input(spark, docs, call):
    bench = spark.createDataFrame([(0, "two words")], "item_id bigint, text string")
    with pytest.raises(ValueError, match="output's names"):
        call(docs, bench)
