"""Chunk dedup and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerscope.llm.chunk_dedup import chunk_dedup_digest, chunk_ends, dedup_chunks
from ledgerscope.llm.suffix_dedup import remove_repeats, repeated_ranges, suffix_dedup_digest, window_runs
from tests.llm.fixtures import SCHEMA, collected, documents, empty, rows, words


def merged(ranges):
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def digest(doc_id, data, ranges, least=0):
    ranges, at, left = [r for r in merged(ranges) if r[1] - r[0] >= min(least, len(data))], 0, b""
    for s, e in ranges:
        left, at = left + data[at:s], e
    left += data[at:]
    return (doc_id, len(data), sum(e - s for s, e in ranges), len(ranges), hashlib.sha256(left).hexdigest())


def brute_windows(table, depth):
    count = defaultdict(int)
    texts = [(r[0], (r[1] or "").encode()) for r in table]
    for _, t in texts:
        for i in range(len(t) - depth + 1):
            count[hash(t[i:i + depth])] += 1
    return sorted((digest(d, t, [(i, i + depth) for i in range(len(t) - depth + 1) if count[hash(t[i:i + depth])] > 1]) for d, t in texts), key=repr)


def test_suffix_digest_equals_brute_force(spark):
    got = collected(suffix_dedup_digest(documents(spark)).drop("n_shared"))
    assert got == brute_windows(rows(), 400)
    assert any(r[2] for r in got) and any(0 < r[2] < r[1] for r in got)


@pytest.mark.parametrize("group_rows", [2000, 2])
def test_suffix_dedup_on_many_edits(spark, group_rows):
    rng = random.Random(3)
    base = words(rng, 250, 50)
    passage = words(rng, 30)
    table = []
    for i in range(40):
        w = base.split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        table.append((i, words(rng, rng.randrange(30)) + " " + " ".join(w[rng.randrange(100):]) + passage, None, None, 0, "", "", 0))
    table += [(50, "a" * 1000, None, None, 0, "", "", 0), (51, "b" * 401 + "ab" * 300, None, None, 0, "", "", 0), (52, "c" * 120, None, None, 0, "", "", 0)]
    docs = spark.createDataFrame(table, SCHEMA)
    out = remove_repeats(docs, depth=120, gram=16, group_rows=group_rows)
    got = sorted(((r["doc_id"], len(r["left_bytes"]), hashlib.sha256(r["left_bytes"]).hexdigest()) for r in out.collect()), key=repr)
    assert got == sorted(((d, n - lost, sha) for d, n, lost, _, sha in brute_windows(table, 120)), key=repr)


def test_passages_shorter_than_a_window_are_counted_but_stay(spark):
    rng = random.Random(21)
    passage = words(rng, 60, 10 ** 6)[:330]
    table = [(i, words(rng, 300, 10 ** 6) + (" " + passage + " " if i < 4 else " ") + words(rng, 10 * i, 10 ** 6), None, None, 0, "", "", 0) for i in range(40)]
    table += [(40, passage, None, None, 0, "", "", 0), (41, "own " * 100 + words(rng, 90, 10 ** 6), None, None, 0, "", "", 0), (None, None, None, None, 0, "", "", 0)]
    table += [table[9], (42, words(rng, 70, 10 ** 6), None, None, 0, "", "", 0)]
    got = {r["doc_id"]: r for r in suffix_dedup_digest(spark.createDataFrame(table, SCHEMA)).collect()}
    assert all(got[i]["n_shared"] > 0 and got[i]["n_removed"] == 0 for i in (0, 1, 2, 3, 40))
    assert all(r["n_shared"] == 0 for i, r in got.items() if i not in (0, 1, 2, 3, 9, 40))
    assert got[9]["n_shared"] > 0 and got[9]["n_removed"] == got[9]["n_bytes"] and got[41]["n_removed"] == 0


@pytest.mark.parametrize("n", [399, 400, 401, 900, (1 << 19) + 250, (1 << 19) + 399, (1 << 19) + 400, (1 << 20) + 777])
def test_runs_cover_every_window_once(n):
    data = np.random.default_rng(n).integers(97, 101, n).astype(np.uint8)
    parts = window_runs(data, 400, 32)
    first, last, place = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in (2, 3, 4))
    covered = [w for a, b in zip(first.tolist(), last.tolist()) for w in range(a, b + 1)]
    assert covered == list(range(max(n - 399, 0)))
    assert all(b <= p <= a + 368 for a, b, p in zip(first, last, place))


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(31)
    long = words(rng, 130_000, 10 ** 6)
    passage = words(rng, 100, 10 ** 6)
    table = [(0, long + " " + passage, None, None, 0, "", "", 0), (1, words(rng, 20) + " " + long[300_000:] + passage, None, None, 0, "", "", 0),
             (2, passage + words(rng, 90_000, 10 ** 6) + passage, None, None, 0, "", "", 0)]
    assert min(len(r[1]) for r in table) > 550_000
    assert collected(suffix_dedup_digest(spark.createDataFrame(table, SCHEMA)).drop("n_shared")) == brute_windows(table, 400)


def test_suffix_dedup_of_empty_tables(spark):
    assert suffix_dedup_digest(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        repeated_ranges(documents(spark), gram=500)


def brute_chunks(table):
    texts = [(r[0], (r[1] or "").encode()) for r in table]
    low = lambda i: (i is None, i or 0)  # noqa: E731  a null id keeps a chunk only when alone
    pieces, keeper = [], {}
    for d, t in texts:
        ends = chunk_ends(np.frombuffer(t, np.uint8))
        own = [(a, b, t[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        pieces.append(own)
        for _, _, c in own:
            keeper[c] = min(keeper.get(c, low(d)), low(d))
    out = []
    for (d, t), own in zip(texts, pieces):
        seen, lost = set(), []
        for a, b, c in own:
            if c in seen or keeper[c] != low(d):
                lost.append((a, b))
            seen.add(c)
        out.append(digest(d, t, lost, 64))
    return sorted(out, key=repr)


def test_chunk_digest_equals_brute_force(spark):
    got = collected(chunk_dedup_digest(documents(spark)))
    assert got == brute_chunks(rows())
    assert any(0 < r[2] < r[1] for r in got)


def test_chunks_resist_insertions_and_keep_characters():
    rng = random.Random(5)
    text = words(rng, 500).encode()
    a, b = (np.frombuffer(x, np.uint8) for x in (text, b"inserted at the front " + text))
    cut = lambda x: {x[s:e].tobytes() for s, e in zip([0, *chunk_ends(x)], chunk_ends(x))}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 2
    wide = np.frombuffer(("中文é" * 3000).encode(), np.uint8)
    ends = chunk_ends(wide)
    assert all(wide[s:e].tobytes().decode() for s, e in zip([0, *ends], ends)) and max(np.diff([0, *ends])) <= 256


def test_passage_of_fifty_words_is_cut_from_all_but_one_document(spark):
    rng = random.Random(11)
    passage = words(rng, 55)
    table = [(i, words(rng, 80) + " " + passage + " " + words(rng, 80), None, None, 0, "", "", 0) for i in range(6)]
    got = {r["doc_id"]: r["n_removed"] for r in chunk_dedup_digest(spark.createDataFrame(table, SCHEMA)).collect()}
    assert got[0] == 0 and all(got[i] > 100 for i in range(1, 6))


def test_a_short_phrase_in_common_stays_and_a_short_copy_goes(spark):
    rng = random.Random(12)
    phrase = " as has been said more than once before, "
    table = [(i, words(rng, 60, 10 ** 9) + phrase + words(rng, 60, 10 ** 9), None, None, 0, "", "", 0) for i in range(60)]
    table += [(100 + i, "the same short note", None, None, 0, "", "", 0) for i in range(3)]
    got = {r["doc_id"]: r["n_removed"] for r in chunk_dedup_digest(spark.createDataFrame(table, SCHEMA)).collect()}
    assert all(got[i] == 0 for i in range(60)) and (got[100], got[101], got[102]) == (0, 19, 19)


def test_unrelated_documents_with_equal_last_words_lose_nothing(spark):
    rng = random.Random(13)
    table = [(i, words(rng, 60, 10 ** 9) + " and that is the end.", None, None, 0, "", "", 0) for i in range(200)]
    assert all(r["n_removed"] == 0 for r in chunk_dedup_digest(spark.createDataFrame(table, SCHEMA)).collect())


def test_no_chunk_of_a_longer_text_is_short():
    rng = random.Random(14)
    for text in (words(rng, 300).encode(), ("中文é" * 300).encode(), b"a" * 900):
        for n in range(1, 900):
            data = np.frombuffer(text[:n].decode(errors="ignore").encode(), np.uint8)
            ends = chunk_ends(data)
            lengths = np.diff([0, *ends])
            assert sum(lengths) == len(data) and max(lengths, default=0) <= 256
            assert len(ends) <= 1 or min(lengths) >= 32
            assert all(data[s:e].tobytes().decode() for s, e in zip([0, *ends], ends))


def test_chunk_dedup_keeps_columns_and_nulls(spark):
    docs = documents(spark)
    out = dedup_chunks(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text is null").count() == docs.where("text is null").count()
    assert chunk_dedup_digest(empty(spark)).count() == 0


def brute_ends(data, smallest=32, mask_bits=5, largest=256):
    """Cut points one byte at a time: the gear hash of the last 32 bytes, lengths kept between the limits."""
    from ledgerscope.llm.chunk_dedup import GEAR

    ends, last, h = [], 0, 0

    def fill(upto):
        nonlocal last
        while upto - last > largest:
            at = last + largest
            while data[at] & 0xC0 == 0x80:
                at -= 1
            ends.append(at)
            last = at

    for i, byte in enumerate(data):
        h = (h * 2 + int(GEAR[byte])) & 0xFFFFFFFF
        mark = i + 1
        if h >> (32 - mask_bits) == 0 and mark < len(data) and data[mark] & 0xC0 != 0x80:
            fill(mark)
            if mark - last >= smallest:
                ends.append(mark)
                last = mark
    fill(len(data))
    if ends and len(data) - ends[-1] < smallest:
        ends.pop()
        if len(data) - (ends[-1] if ends else 0) > largest:
            at = len(data) - smallest
            while data[at] & 0xC0 == 0x80:
                at -= 1
            ends.append(at)
    return [*ends, len(data)] if len(data) else ends


def test_cut_points_equal_a_byte_by_byte_scan():
    rng = random.Random(17)
    texts = [words(rng, n).encode() for n in (0, 1, 5, 40, 900)] + [("中文é — " * 900).encode(), b"a" * 3000, bytes(rng.choices(range(97, 123), k=5000))]
    for text in texts:
        assert chunk_ends(np.frombuffer(text, np.uint8)) == brute_ends(text)
