"""The registered queries and the stages of the pipeline."""

import array
import base64
import functools
import hashlib
import math
import re

from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from cohortwise.llm.bpe import public_path
from cohortwise.llm.common import written
from cohortwise.llm.quality import FOLDS, MARGIN, ORDER, SPREAD, STEP
from cohortwise.llm.registry import LLM_REGISTRY

from tests.llm.test_quality import plain_model
from tests.llm.test_simhash import plain_classes, plain_fingerprint
from tests.llm.test_suffix_dedup import brute

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in LLM_REGISTRY if n != "pipeline")
    assert numbers == list(range(1, 14))
    assert set(LLM_REGISTRY) <= set(__spark_entry__.queries())


def plain_quality(spark, rows, labels):
    """Ids that the classifier keeps: models, bounds, folds and quantiles in plain Python."""
    def plain(t):
        return "".join(c if ord(c) < 4000 else chr(4000 + ord(c) % 96) for c in t)

    def bound(p, t):
        padded = "\n" * (ORDER - 1) + plain(t)
        return -sum(math.log(p(padded[i:i + ORDER])) for i in range(len(t))) / len(t) - SPREAD / math.sqrt(len(t)) if t else None

    def quantile(lows):
        bins = sorted(math.ceil(x / STEP) for x in lows if x is not None)
        return STEP * next(b for b in bins if sum(x <= b for x in bins) >= 0.99 * len(bins)) if bins else None
    good = {i for i in {x.doc_id for x in labels} if all(x.quality == 1 and not x.toxic for x in labels if x.doc_id == i)}
    fold = {r.doc_id: r.fold for r in spark.createDataFrame(rows).selectExpr("doc_id", f"pmod(xxhash64(lang, text), {FOLDS}) AS fold").collect()}
    kept = set()
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang]
        trusted = [r for r in own if r.doc_id in good]
        p = functools.cache(plain_model([plain(r.text) for r in trusted]))
        low = {r.doc_id: bound(p, r.text) for r in own}
        unseen = []
        for f in {fold[r.doc_id] for r in trusted}:
            others = [plain(r.text) for r in trusted if fold[r.doc_id] != f]
            if others:
                q = functools.cache(plain_model(others))
                unseen += [bound(q, r.text) for r in trusted if fold[r.doc_id] == f]
        value = quantile(unseen)
        if value is None:
            value = quantile([low[r.doc_id] for r in trusted])
        kept |= {i for i, x in low.items() if x is None or value is None or round(x, 9) <= value + MARGIN * abs(value) + 1e-12}
    return kept


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    columns, before = docs.columns, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, SF), "stage")
        after = docs.collect()
        if k < 3:
            assert docs.columns == columns and len({r.doc_id for r in after}) == len(after)
        if k == 0:
            assert {r.doc_id for r in after} == plain_quality(spark, before, labels) and set(after) <= set(before)
        elif k == 1:
            classes = plain_classes([(r.doc_id, plain_fingerprint(r.text)) for r in before])
            assert {r.doc_id for r in after} == set(classes) and set(after) <= set(before) and len(after) < len(before)
        elif k == 2:
            left = brute([r.text.encode() for r in before], 200)
            want = {r.doc_id: x[3].decode("utf-8", "ignore") for r, x in zip(before, left)}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
            assert any(r.text != want[r.doc_id] for r in before)
        else:
            library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
            ids = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in before}
            held = {}
            for r in after:
                held[r.doc_id] = held.get(r.doc_id, 0) + r.length
            assert held == ids
        before = after


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 2048 for parts in by.values())


def test_stages_on_nulls_repeats_clashes_and_nothing(spark):
    """Every stage on odd rows: what its docstring says, no crash, all columns handed on."""
    long = " ".join(f"wort{i * 7919}" for i in range(60_000))
    shared = "a passage of words that several documents have in common, long enough to be found as a repeated string of two hundred bytes, " * 2
    rows = [(1, None, "en", "s", None, 1), (2, "", None, None, 0, 2), (None, "no id but a text of its own", "en", "s", 27, 3), (None, None, None, None, None, 4),
            (5, long, "de", "s", len(long), 5), (6, f"one {shared} end", "en", "s", 9, 6), (7, f"another start {shared}", "en", "s", 9, 7),
            (8, "twice the same row", "en", "s", 18, 8), (8, "twice the same row", "en", "s", 18, 8), (9, "é" * 300, "fr", "s", 300, 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, {} bigint"
    for extra in ("key", "fp", "row", "piece"):
        docs = spark.createDataFrame(rows, schema.format(extra))
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            if k and extra in ("fp", "row") and k < 3:
                continue  # one clash for each stage is enough
            out = stage(spark, docs, SF)
            got = out.collect()
            if k < 3:
                assert out.columns == docs.columns, name
            if k == 0:
                assert {r.doc_id for r in got} >= {1, 2} and sum(r.doc_id == 8 for r in got) in (0, 2)
            elif k == 1:  # one of the texts without words, one of the repeated rows
                assert sorted(r.doc_id for r in got if r.doc_id in (1, 2, 8)) == [1, 8]
            elif k == 2:
                assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
                assert not any(shared[:200] in r.text for r in got) and any(r.text == long for r in got)
            else:
                assert {r.doc_id for r in got} == {r[0] for r in rows}
    empty = spark.createDataFrame([], schema.format("key"))
    assert all(stage(spark, empty, SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_quality_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    verdicts = LLM_REGISTRY["op4_quality"][0](spark, SF).collect()
    assert len(verdicts) == len(docs)
    assert {r.doc_id for r in verdicts if r.keep} == plain_quality(spark, docs, spark.read.parquet(f"{SF}/labels.parquet").collect())


def test_bpe_query_against_the_library(spark):
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in LLM_REGISTRY["op9_bpe"][0](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False).encode()
        want = (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back).hexdigest())
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_warc_query_against_plain_python(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    payload = {r.page_id: (r.html or "").encode() for r in pages}
    last = {}
    for i, x in sorted(payload.items()):
        last[x] = i
    want = sorted((i, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if last[x] == i else "revisit", None if last[x] == i else last[x]) for i, x in payload.items())
    got = LLM_REGISTRY["op6_warc"][0](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want
