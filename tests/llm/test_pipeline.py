from __future__ import annotations

import os

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from ledgerscope.llm.queries import QUERIES  # noqa: E402
from tests.llm.fixtures import SCHEMA, rows  # noqa: E402
from tests.llm.test_decontaminate import benchmark_rows, brute as brute_bench  # noqa: E402
from tests.llm.test_jaccard_join import brute as brute_classes  # noqa: E402
from tests.llm.test_line_dedup import brute as brute_lines  # noqa: E402
from tests.llm.test_packing import encoder  # noqa: E402


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark_rows(), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_each_stage_decides_on_what_the_one_before_kept(spark, sf_dir):
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = os.path.join(sf_dir, "out", name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        at[name] = [tuple(r) for r in docs.collect()]
        assert name == "packing" or docs.columns == names
    table = at["line_dedup"]
    assert len(table) == len(rows()) and len(brute_lines(rows())) == len(table)
    classes = {(d, c) for d, c, _ in brute_classes(table)}
    kept = at["jaccard_join"]
    assert all((r[0], r[0]) in classes for r in kept)
    clean = {x[0] for x in brute_bench(kept, benchmark_rows()) if not x[-1]}
    assert {r[0] for r in at["benchmark_decontamination"]} <= clean
    assert len(at["benchmark_decontamination"]) == sum(not x[-1] for x in brute_bench(kept, benchmark_rows()))
    encode = encoder(added_tokens=True)
    want = sorted(i for r in at["benchmark_decontamination"] for i in encode(r[1]))
    assert sorted(i for p in at["packing"] for i in np.frombuffer(p[3], "<u4").tolist()) == want


def test_run_is_registered(spark, sf_dir):
    assert QUERIES["pipeline"](spark, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "jaccard_join" and len(corpus_pipeline.STAGES) == 5


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id bigint, text string"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
