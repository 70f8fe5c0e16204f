"""Operator 9 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortwise.llm.bpe import ForcedBoundaryBpe, decode, encode, public_path, round_trip

PATH = public_path("byte_bpe_50k.json")
ODD = [*"abeEF 's't're\n\t\r\x1c\x85  　'’,.!?-12٣漢é́ñß😀​ <|", "<|endoftext|>", "'ll", " 's", "   "]


@pytest.fixture(scope="module")
def both():
    return ForcedBoundaryBpe(PATH), Tokenizer.from_file(PATH)


def test_random_texts(both):
    own, library = both
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    ids = own.encode_many(texts)
    for text, got in zip(texts, ids):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(got) == library.decode(got.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 20000, "漢" * 3000, "xY" * 5000, " " * 5000, "word " * 5000, "!?" * 4000 + "'s", "\n \n" * 999])
def test_long_texts_without_many_cuts(both, text):
    own, library = both
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_boundaries_hold_in_the_vocabulary(both):
    own, _ = both
    for token in random.Random(2).sample(own.bytes_of, 2000):
        if token != b"<|endoftext|>":
            assert all(own.inside[a, b] for a, b in zip(token, token[1:]))


def test_ids_of_invalid_bytes_decode_like_the_library(both):
    own, library = both
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_table(spark, docs):
    df = docs([(1, "Hello there", "x"), (2, None, None), (None, "", "y"), (1, "Hello there", "x")], "doc_id bigint, text string, n_tokens string")
    rows = round_trip(df, "doc_id", "text", PATH).collect()
    assert len(rows) == 4
    by = {(r.doc_id, r.n_tokens) for r in rows}
    assert by == {(1, 2), (2, 0), (None, 0)}
    assert {r.decoded_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"Hello there").hexdigest()}
    assert round_trip(df.limit(0), "doc_id", "text", PATH).count() == 0
    back = decode(encode(df, "text", PATH), "ids", PATH, "again").collect()
    assert all(r.again == (r.text or "") for r in back)
