"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ledgerscope.llm import checks
from ledgerscope.llm.chunk_dedup import chunk_dedup_digest
from ledgerscope.llm.decontaminate import contamination_digest
from ledgerscope.llm.fingerprints import fingerprint_digest
from ledgerscope.llm.hard_negatives import hard_negatives_digest
from ledgerscope.llm.jaccard_join import jaccard_digest
from ledgerscope.llm.language import language_digest
from ledgerscope.llm.line_dedup import line_dedup_digest
from ledgerscope.llm.packing import packing_digest
from ledgerscope.llm.quality import quality_digest
from ledgerscope.llm.secrets import secrets_digest
from ledgerscope.llm.spelling import spelling_digest
from ledgerscope.llm.suffix_dedup import suffix_dedup_digest
from ledgerscope.llm.warc import warc_digest


def _on(digest: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return digest(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": _on(contamination_digest, "documents", "benchmark"),
    "op2_language_id": _on(language_digest, "documents"),
    "op3_quality_classifier": _on(quality_digest, "documents", "labels"),
    "op4_jaccard_join": _on(jaccard_digest, "documents"),
    "op5_packing": _on(partial(packing_digest, added_tokens=True), "documents"),
    "op6_secret_scan": _on(secrets_digest, "documents"),
    "op7_suffix_dedup": _on(suffix_dedup_digest, "documents"),
    "op8_fingerprints": _on(fingerprint_digest, "documents"),
    "op9_chunk_dedup": _on(chunk_dedup_digest, "documents"),
    "op10_line_dedup": _on(line_dedup_digest, "documents"),
    "op11_warc": _on(warc_digest, "pages"),
    "op12_hard_negatives": _on(hard_negatives_digest, "embeddings"),
    "op13_spelling_variants": _on(spelling_digest, "documents"),
    "pipeline": corpus_pipeline.run,
}

# The others are tested against brute force, exact round trips and held-out accuracy.
SQL: dict[str, str] = {
    "op1_benchmark_decontamination": checks.DECONTAMINATION,
    "op4_jaccard_join": checks.JACCARD_JOIN,
    "op10_line_dedup": checks.LINE_DEDUP,
    "op11_warc": checks.WARC,
    "op12_hard_negatives": checks.HARD_NEGATIVES,
    "op13_spelling_variants": checks.SPELLING,
}
