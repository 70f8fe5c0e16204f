"""Operator 3 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import cohortwise.llm.simhash as sh
from cohortwise.llm.components import components
from cohortwise.llm.simhash import fingerprint, simhash_classes, simhash_dedup

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps):
    """fps: (id, fingerprint); the smallest id of each component of links."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(fps):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [least.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one TWO", "a b c", "É\x0bB\x0cc\x85d e", "x " * 70_000, "Ein Wort. " * 9 + "日本 語"])
def test_fingerprint(text):
    assert fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = [(k, plain_fingerprint(t)) for k, t in texts.items()]
    want = {k: (format(f, "016x"), c) for (k, f), c in zip(fps, plain_classes(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op3_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("shared", [1, 3, 256])
def test_links_of_a_dense_ball(spark, monkeypatch, shared):
    monkeypatch.setattr(sh, "SHARED", shared)
    rng = random.Random(shared)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 250:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    got = {tuple(r) for r in sh._links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 3).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & mask).bit_count() <= 3}


def test_nulls_repeats_clashes_empty(spark, docs):
    rows = [(5, None, 1), (3, " ", 2), (None, "", 3), (7, "some words here and more", 4), (7, "some words here and more", 4), (None, "alone with no id at all today", 5)]
    df = docs(rows, "doc_id bigint, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.fingerprint == "0" * 16) for r in simhash_classes(df, "doc_id", "text").collect())
    assert got == [(-1, -1, False), (-1, 3, True), (3, 3, True), (5, 3, True), (7, 7, False), (7, 7, False)]
    stay = simhash_dedup(df, "doc_id", "text")
    assert stay.columns == df.columns
    assert sorted((r.doc_id or -1, r.fp) for r in stay.collect()) == [(-1, 5), (3, 2), (7, 4)]
    assert simhash_classes(df.limit(0), "doc_id", "text").count() == 0
    assert simhash_dedup(df.limit(0), "doc_id", "text").count() == 0


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(7)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(2001, 2000), (2000, 2001), (3, 3)]
    rng.shuffle(pairs)
    out = {r.node: r.root for r in components(spark.createDataFrame([*pairs, (None, 4)], "x bigint, y bigint"), "x", "y").collect()}
    assert out == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").count() == 0


def test_dedup_keeps_one_of_each_class(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    classes = simhash_classes(df, "doc_id", "text")
    want = {r.component_id for r in classes.select("component_id").distinct().collect()}
    assert {r.doc_id for r in simhash_dedup(df, "doc_id", "text").collect()} == want
    assert simhash_dedup(df.withColumn("x", F.lit(1)), "doc_id", "text").count() == len(want)


def test_no_side_that_grows_is_broadcast(spark, monkeypatch):
    """Tables that are small by their files, as before an explode, are not collected by the driver."""
    import cohortwise.llm.components as co

    plans = []
    kept = sh.written

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, tag)
    monkeypatch.setattr(sh, "written", seen)
    monkeypatch.setattr(co, "written", seen)
    monkeypatch.setattr(co, "FEW_EDGES", 0)
    docs = spark.createDataFrame([(i, f"text {i // 2} of a few words") for i in range(8)], "doc_id bigint, text string")
    for last in (simhash_classes(docs, "doc_id", "text"), simhash_dedup(docs, "doc_id", "text")):
        plans.append(last._jdf.queryExecution().sparkPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)
