"""Operator 12 against plain loops."""

import hashlib
import math

import numpy as np
import pytest

import cohortwise.llm.codes as codes
from cohortwise.llm.codes import Walk, vector_codes


def plain(rows):
    """Sorted (id, code, error, label_error, sha) of rows (id, vector, label)."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = max(-(-max(len(v) for _, v, _ in kept) // 8), 1)
    cut = [[max(min(math.floor(4096 * x), 1 << 27), -(1 << 27)) for x in v] + [0] * (8 * w - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, cut[k]))[:16]
    parts = [[c[p * w:p * w + w] for c in cut] for p in range(8)]
    books = [[parts[p][k] for k in first] for p in range(8)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            own = [best(x, books[p])[1] for x in parts[p]]
            for e in range(len(books[p])):
                mine = [x for x, o in zip(parts[p], own) if o == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[best(parts[p][k], books[p]) for p in range(8)] for k in range(len(kept))]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, g), e in zip(kept, error):
        total[g] = total.get(g, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), x, total[g], sha) for (i, _, g), f, x in zip(kept, found, error)), key=str)


def run(spark, rows, schema="vec_id bigint, embedding array<float>, label int"):
    return sorted((tuple(r) for r in vector_codes(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_walk_shares_prefixes_across_blocks():
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (500, 5))
    x = x[np.lexsort(x.T[::-1])]
    book = rng.integers(-3, 4, (16, 5))
    want = ((x[:, None, :] - book[None]) ** 2).sum(2)
    walk = Walk(book)
    assert (np.vstack([walk.distances(x[a:a + 7]) for a in range(0, 500, 7)]) == want).all()
    assert (Walk(book).distances(x[rng.permutation(500)]).sum() == want.sum())


def test_clusters_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i * 3 % 401, [float(np.float32(v)) for v in np.round(rng.normal(0, 1, 16), 1)], [None, 1, 2][i % 3]) for i in range(150)]
    rows += [(1000 + i, rows[0][1], 7) for i in range(100)]  # copies
    rows += [(2000, [0.5] * 16, 7), (2000, [0.5] * 16, 7), (None, [0.25] * 16, None)]
    assert run(spark, rows) == plain(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [nan], 1), (4, [inf, 0.0], 1), (5, [0.5, 0.25, -1.0], 1), (6, [], 2), (7, [-0.0001] * 9, None)]
    got = run(spark, rows)
    assert got == plain(rows) and [r[0] for r in got] == [5, 6, 7]


def test_fewer_vectors_than_entries_and_none(spark):
    assert run(spark, [(1, [1.0] * 8, 1), (2, [2.0] * 8, 1)]) == plain([(1, [1.0] * 8, 1), (2, [2.0] * 8, 1)])
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("x", [3e38, -3e38, 30000.5])
def test_large_components(spark, x):
    rows = [(i, [x if i % 5 == 0 else float(i)] * 8, i % 2) for i in range(40)]
    rows = [(i, [float(np.float32(v)) for v in vec], g) for i, vec, g in rows]
    assert run(spark, rows) == plain(rows)


def test_extra_columns_of_clashing_names(spark):
    rows = [(i, [float(i)] * 8, 1, "a", "b") for i in range(20)]
    got = run(spark, rows, "vec_id bigint, embedding array<double>, label int, id string, error string")
    assert got == plain([r[:3] for r in rows])


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in codes.op12_codes(spark, sf).collect()), key=str) == plain(rows)
