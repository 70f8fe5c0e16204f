"""Operator 7 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import cohortwise.llm.topk as topk
from cohortwise.llm.topk import top_k, whole_vectors


def brute(rows, k, is_query):
    out = []
    for qid, q in rows:
        if is_query(qid):
            found = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid)
            out += [(qid, r + 1, i, int(-s)) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,chunk,pivots", [(4096, 1024, 32), (16, 8, 5)])
def test_clusters_ties_and_copies(spark, monkeypatch, block, chunk, pivots):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "PIVOTS", pivots)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 8, (4, 6))
    rows = [(i, [float(x) for x in np.floor(centres[i % 4] + rng.normal(0, 1.5, 6))]) for i in range(300)]
    rows += [(i, [3.0, -2.0, 1.0, 0.0, 0.0, 5.0]) for i in range(300, 460)]  # a third are copies
    rows += [(460, [0.0] * 6), (461, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = sorted(tuple(r) for r in top_k(df, F.col("id") % 20 == 0, 7).collect())
    assert got == brute(rows, 7, lambda i: i % 20 == 0)


def test_large_products_are_exact(spark):
    big = float(3 << 26)
    rows = [(i, [big + i, -big + 2 * i, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = sorted(tuple(r) for r in top_k(df, F.col("id") % 20 == 0, 5).collect())
    exact = [(i, [int(x) for x in v]) for i, v in rows]
    assert got == brute(exact, 5, lambda i: i % 20 == 0)


def test_nulls_short_vectors_repeats_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (0, [0.5, 0.25]), (1, None), (2, [0.1, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, []), (7, [0.99, -0.01])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id bigint, embedding array<double>, rank string")
    v = whole_vectors(df, "vec_id", "embedding")
    assert sorted((r.id, list(r.v)) for r in v.collect()) == [(0, [32, 16]), (5, [64]), (6, []), (7, [63, -1])]
    got = [tuple(r) for r in top_k(v, F.col("id") % 20 == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 2048), (0, 2, 7, 2000), (0, 3, 6, 0)]
    assert top_k(v.limit(0), F.col("id") % 20 == 0, 20).count() == 0
    assert top_k(v, F.col("id") == 99, 20).count() == 0


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0]), (0, [2.0]), (1, [3.0]), (2, [-1.0])]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, "id bigint, v array<double>"), F.col("id") == 0, 2).orderBy("rank").collect()]
    assert [g[2:] for g in got] == [(1, 6), (1, 3)]
