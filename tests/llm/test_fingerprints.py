"""Operator 2 against exact likeness, and its order of documents against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import cohortwise.llm.fingerprints as fp
from cohortwise.llm.fingerprints import edited_pairs, fingerprint_batch, fingerprints, likeness

SF = "/root/testdata/sf0.001"


def jaccard(a, b):
    x, y = ({" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def one(text):
    return fingerprint_batch(pa.array([text], pa.string()))[0]


def test_likeness_is_near_the_truth_and_unbiased():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    errors = []
    for n in (8, 40, 300, 3000):
        for _ in range(60):
            a = [rng.choice(words) for _ in range(n)]
            cut = rng.randint(0, n)
            b = a[:cut] + [rng.choice(words) for _ in range(n - cut)]
            errors.append(likeness(one(" ".join(a)), one(" ".join(b))) - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_texts_alone_together_and_long(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one", "one two three four", "one two three four five"]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["w" * 3000, "Z ü 漢 " * 2000]
    together = fingerprint_batch(pa.array(texts, pa.string()))
    assert together == [one(t) for t in texts]
    assert together[:3] == ["", "", ""] and all(len(f) == fp.BINS * fp.BITS // 4 for f in together[3:])
    assert one("A  b\nC d e F") == one("a b c d e f")
    monkeypatch.setattr(fp, "AT_ONCE", 1 << 10)  # in pieces
    fp._powers.cache_clear()
    assert fingerprint_batch(pa.array(texts, pa.string())) == together
    fp._powers.cache_clear()


def test_likeness_of_empty_texts():
    assert likeness("", "") == 1.0 and likeness(None, None) == 1.0 and likeness("", one("a b")) == 0.0
    assert likeness(one("a b"), one("a b")) == 1.0


@pytest.mark.parametrize("ranges", [1, 4096])
def test_documents(spark, monkeypatch, ranges):
    monkeypatch.setattr(fp, "MOST_RANGES", ranges)
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fp.op2_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    for r, following in zip(rows, rows[1:] + rows[:1]):
        third = len(r.text) // 3
        edited = r.text[:len(r.text) - third] + following.text[:third]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        assert (g.fingerprint, g.edited_fingerprint) == (one(r.text), one(edited))
        assert (g.near_edited, g.near_next) == (likeness(one(r.text), one(edited)), likeness(one(r.text), one(following.text)))


def test_nulls_repeats_empty_and_clashes(spark, docs):
    rows = [(3, "c c c c c c", 1), (None, "x y z", 2), (1, None, 3), (1, "a", 4), (2, "b b b", 5), (2, "b b b", 6)]
    df = docs(rows, "doc_id bigint, text string, range int")
    got = edited_pairs(df).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 5), (1, 0), (1, 1), (2, 5), (2, 5), (3, 11)]
    last = next(r for r in got if r.doc_id is None)  # after the last comes the first
    assert last.edited_sha256 == hashlib.sha256(b"x y c").hexdigest()
    assert edited_pairs(df.limit(0)).count() == 0
    alone = edited_pairs(docs([(9, "a b c")])).collect()
    assert [r.edited_sha256 for r in alone] == [hashlib.sha256(b"a b a").hexdigest()] and alone[0].near_next == 1.0
    assert fingerprints(df, "text").filter("fingerprint is null").count() == 0
