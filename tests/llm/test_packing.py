"""Operator 5."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortwise.llm.bpe import public_path
from cohortwise.llm.packing import WordIds, lookup, op5_packing, packed, plan, sequences

PATH = public_path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = [*"abEFZÀéßŸΣσİıµ 's't're\n\t\r\x1c\x85  　'’,.!?-12٣漢é́ñ😀​", "<|endoftext|>", "'ll", "  ", "<|startoftext|>", "Ab.", "ΑΣ "]


def test_ids_equal_the_library():
    own, library = WordIds(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None, "", "x" * 5000]
    for text, got in zip(texts, own.encode_many(texts)):
        assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(10, 300))
    counts = np.zeros(capacity + 1, np.int64)
    counts[1:] = rng.integers(0, 40, capacity) * (rng.random(capacity) < 0.4)
    bins = plan(counts.copy(), capacity)
    held = np.zeros(capacity + 1, np.int64)
    for b in bins:
        assert sum(b.lengths) <= capacity and b.count > 0
        for x in b.lengths:
            held[x] += b.count
    assert (held == counts).all()
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    assert sum(b.count for b in bins) <= 1.1 * least + 3
    at = lookup(bins)
    assert len(at["key"]) == sum(len(b.lengths) for b in bins)


def test_plan_is_near_the_least_on_prose_lengths():
    rng = np.random.default_rng(9)
    lengths = np.clip(np.exp(rng.normal(6, 0.8, 200_000)), 2, 2048).astype(int)
    counts = np.bincount(lengths, minlength=2049)
    assert sum(b.count for b in plan(counts, 2048)) <= 1.005 * lengths.sum() / 2048


def checked(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_packing(spark, SF).collect()
    by = checked(rows)
    assert len(by) <= 1.03 * sum(r.length for r in rows) / 2048 + 1
    seen = {}
    for r in rows:
        ids = seen.setdefault(r.doc_id, np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4"))
        assert (r.start, r.length) == (2048 * r.piece, min(2048, len(ids) - r.start))
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(map(len, seen.values())) and set(seen) == set(texts)


def test_nulls_repeats_empty_clashes_and_ids(spark, docs):
    rows = [(1, None, 5), (None, "", 5), (2, "word " * 5000, 5), (3, "a b c", 5), (3, "a b c", 5)]
    df = docs(rows, "doc_id bigint, text string, sequence_id bigint")
    out = packed(df, with_ids=True)
    got = out.collect()
    checked(got)
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in got) == [(-1, 0, 1), (1, 0, 1), (2, 0, 2048), (2, 1, 2048), (2, 2, 905), (3, 0, 4), (3, 0, 4)]
    whole = sequences(out).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got)
    assert packed(df.limit(0)).count() == 0


def test_no_side_that_grows_is_broadcast(spark):
    """Neither the places of a length's blocks nor the spans of repeated strings are collected by the driver."""
    from cohortwise.llm.packing import pack
    from cohortwise.llm.suffix_dedup import without_repeats

    pieces = spark.createDataFrame([(i, 5) for i in range(20)], "id int, length int")
    docs = spark.createDataFrame([(i, "the same words in two texts of some length " * 9) for i in range(2)], "doc_id int, text string")
    for out in (pack(pieces, "length", ["id"], 16), without_repeats(docs, "text")):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
