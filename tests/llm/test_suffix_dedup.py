"""Operator 10 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import cohortwise.llm.suffix_dedup as sd
from cohortwise.llm.suffix_arrays import repeated_starts, suffix_array
from cohortwise.llm.suffix_dedup import remove_repeats, runs, without_repeats

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    """(bytes, removed, spans, what is left) of each text."""
    known = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if known[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc", bytes(range(256))])
def test_suffix_array(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(150):
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        flat = [x for t in texts for x in [*(b + 1 for b in t), 0]]
        end = lambda i: flat.index(0, i)
        want = sorted(range(len(flat)), key=lambda i: (flat[i:end(i) + 1], end(i)))
        for in_memory in (4, 1 << 20):  # with queues on disk, and without
            assert suffix_array(np.array(flat, np.int16), 64, in_memory).tolist() == want
        length = rng.choice([1, 2, 3, 8, 11])
        known = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        want = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - length + 1) if known[t[i:i + length]] > 1]
        assert list(zip(*(x.tolist() for x in repeated_starts(texts, length)))) == want
    assert repeated_starts([], 3)[0].tolist() == []


def test_equal_strings_have_equal_anchors(monkeypatch):
    monkeypatch.setattr(sd, "AT_ONCE", 1 << 12)
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 256, 700).astype(np.uint8)
    texts = [np.concatenate([rng.integers(0, 256, n).astype(np.uint8), shared, rng.integers(0, 256, m).astype(np.uint8)]) for n, m in ((0, 9000), (5000, 10), (333, 100), (12000, 0))]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    row, first, count, anchor, _ = runs(np.concatenate(texts), off, 200)
    starts = {(r, s): a for r, f, c, a in zip(row.tolist(), first.tolist(), count.tolist(), anchor.tolist()) for s in range(f, f + c)}
    assert len(starts) == sum(len(t) - 199 for t in texts)  # every string belongs to one run
    for k in range(501):
        assert len({starts[i, b + k] for i, b in enumerate((0, 5000, 333, 12000))}) == 1


def rows_of(texts, length=20):
    return [(n, r, s, hashlib.sha256(left).hexdigest()) for n, r, s, left in brute([(t or "").encode() for t in texts], length)]


@pytest.mark.parametrize("few,shard", [(4_000_000, 1 << 22), (0, 200)])
def test_random_passages(spark, monkeypatch, few, shard):
    """Also with anchors joined by a shuffle, and with strings dealt one by one."""
    monkeypatch.setattr(sd, "FEW_ANCHORS", few)
    monkeypatch.setattr(sd, "SHARD_BYTES", shard)
    monkeypatch.setattr(sd, "GRAM", 6)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(2, 12))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 15))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += texts[:3] + ["ab" * 60, "x" * 333, "x" * 15, "short", "short", "", passages[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, "text", 20, ()).collect()}
    assert [got[i] for i in range(len(texts))] == rows_of(texts)


def test_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(n, r, s, hashlib.sha256(left).hexdigest()) for n, r, s, left in brute([x.text.encode() for x in rows], 200)]
    got = {r.doc_id: tuple(r)[1:] for r in sd.op10_suffix_dedup(spark, SF).collect()}
    assert got == {x.doc_id: w for x, w in zip(rows, want)}


def test_nulls_ties_empty_and_clashes(spark, docs):
    shared = "é" * 15 + "tail of the passage"
    rows = [(1, None, "a"), (None, "", "b"), (2, "before " + shared, "c"), (2, shared + " after", "d"), (3, "tiny", "e"), (3, "tiny", "e")]
    df = docs(rows, "doc_id bigint, text string, kept string").withColumnRenamed("kept", "spans")
    out = remove_repeats(df, "text", 20, ("kept", "removed")).collect()
    assert len(out) == 6
    assert {(r.spans, r.kept) for r in out} == {("a", ""), ("b", ""), ("c", "before "), ("d", " after"), ("e", "tiny")}
    assert all(r.n_removed == sum(x.b - x.a for x in r.removed) for r in out)
    df = df.withColumnRenamed("spans", "kept")
    back = without_repeats(df, "text", 20)
    assert back.columns == df.columns
    assert sorted((r.kept, r.text) for r in back.collect()) == [("a", ""), ("b", ""), ("c", "before "), ("d", " after"), ("e", "tiny"), ("e", "tiny")]
    assert remove_repeats(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        remove_repeats(df, "text", 0)


def test_a_cut_character_goes_whole(spark, docs):
    # the strings end inside a two-byte character that differs in its second byte
    a, b = "x" * 10 + "é", "y" + "x" * 10 + "è"
    out = without_repeats(docs([(1, a), (2, b)]), "text", 11).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["", "y"]


@pytest.mark.parametrize("few", [4_000_000, 0])
def test_a_passage_shared_by_many_is_folded(spark, monkeypatch, few):
    """Each text has its own words before one passage: no shard holds its copies."""
    monkeypatch.setattr(sd, "FEW_ANCHORS", few)
    monkeypatch.setattr(sd, "SHARD_BYTES", 2000)
    monkeypatch.setattr(sd, "GRAM", 6)
    plain = sd.repeated_starts

    def bounded(held, length):
        if sum(map(len, held)) > 6000:
            raise AssertionError("a shard holds three times its bytes")
        return plain(held, length)

    monkeypatch.setattr(sd, "repeated_starts", bounded)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    shared = word(45)
    texts = [word(40) + shared + word(rng.randint(0, 30)) for _ in range(400)] + ["x" * 5000, word(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, "text", 20, ()).collect()}
    assert [got[i] for i in range(len(texts))] == rows_of(texts)


def test_digests_with_equal_first_halves():
    known = np.array([[1, 5], [3, 1], [3, 2], [3, 9]])
    asked = np.array([[3, 9], [3, 4], [1, 5], [0, 5], [7, 7], [3, 2]])
    assert sd._among(known, asked).tolist() == [True, False, True, False, False, True]
    assert not sd._among(known[:0], asked).any()
