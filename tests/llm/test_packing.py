from __future__ import annotations

import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from ledgerscope.llm.packing import default_vocabulary, pack_documents, packing_digest, piece_lengths  # noqa: E402
from tests.llm.fixtures import SCHEMA, documents, empty, rows  # noqa: E402


def encoder(added_tokens: bool = False):
    """Ids by the file's own library; added tokens spelled out, or with the ids of their own that it gives by default."""
    tokenizer = Tokenizer.from_file(default_vocabulary())
    tokenizer.encode_special_tokens = not added_tokens
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_round_trip_and_checksums(spark):
    encode, got = encoder(), {}
    pieces = pack_documents(documents(spark), max_length=256).collect()
    for p in pieces:
        got.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    want = {}
    for r in rows():
        want.setdefault((r[0], len(encode(r[1]))), []).append(encode(r[1]))
    assert set(got) == set(want)
    for k, found in got.items():
        copies = want[k]
        assert sorted(x for _, ids in found for x in ids) == sorted(x for ids in copies for x in ids)
        if len(copies) == 1:
            assert [x for _, ids in sorted(found) for x in ids] == copies[0]
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    assert all(p["length"] & (p["length"] - 1) == 0 and p["length"] <= 256 and p["offset"] == 0 for p in pieces)


def test_digest(spark):
    encode = encoder()
    by = {(r[0], len(encode(r[1]))): encode(r[1]) for r in rows() if r[0] not in (None, 3)}
    for p in packing_digest(documents(spark)).collect():
        if p["doc_id"] not in (None, 3):
            ids = by[(p["doc_id"], p["doc_tokens"])][p["start"]:p["start"] + p["length"]]
            assert zlib.crc32(np.array(ids, "<u4").tobytes()) == p["ids_crc32"]


def test_piece_lengths_and_bad_limit(spark):
    assert piece_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]
    assert packing_digest(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        pack_documents(documents(spark), max_length=1000)


def test_query_and_pipeline_give_added_tokens_their_ids(spark, tmp_path):
    import corpus_pipeline
    from ledgerscope.llm.queries import QUERIES

    end = "<|endoftext|>"
    texts = [f"hello {end} world", f"{end}{end}", f"a  {end}  b {end}", f"{end}\n{end} x", f"é\u00a0{end}\u2003z {end}", "half <|endof", "text|> half",
             end, f"<|endoftext{end}|>", f"plain text{end}", "no token"]
    table = [(i, t, None, None, 0, "", "", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(table, SCHEMA).coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert want[0] == [31373, 220, 50256, 995, 1]
    got = {}
    for p in corpus_pipeline.packing(spark, docs, "").orderBy("start").collect():
        got.setdefault(p["doc_id"], []).extend(np.frombuffer(p["ids"], "<u4").tolist())
    assert [got[i] for i in range(len(texts))] == want
    for p in QUERIES["op5_packing"](spark, str(tmp_path)).collect():
        ids = want[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert p["doc_tokens"] == len(want[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
