"""Operator 13 against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortwise.llm.merkle import leaf_digest, manifest, op13_merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """(top, the siblings of every node up to it) of a list of nodes."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = range(p // 8 * 8, min(p // 8 * 8 + 8, len(nodes)))
            paths[i].append(("".join(nodes[q] for q in run if q < p), "".join(nodes[q] for q in run if q > p)))
            place[i] = p // 8
        nodes = [sha(*nodes[a:a + 8]) for a in range(0, len(nodes), 8)]
    return nodes[0] if nodes else None, paths


def plain(rows):
    """Sorted (id, leaf, subroot, root, proof, folded, verified) of rows (id, grp, leaf, shown)."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [climb([r[2] for r in groups[g]]) for g in names]
    root, upper = climb([t for t, _ in trees])
    out = []
    for g, (top, paths), above in zip(names, trees, upper):
        for r, path in zip(groups[g], paths):
            folded = r[3]
            for left, right in path + above:
                folded = sha(left, folded, right)
            out.append((r[0], r[2], top, root, sha(*[a + b for a, b in path + above]), folded, folded == root))
    return sorted(out, key=str)


def run(spark, rows):
    found = manifest(spark.createDataFrame(rows, "id bigint, grp string, leaf string, shown string"))
    return sorted((tuple(r) for r in found.drop("path").collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, "b": 9}, {"a": 65, None: 1, "": 3, "é": 7, "zz": 64}, {f"g{i:02}": 1 + i % 3 for i in range(20)}])
def test_against_a_plain_tree(spark, sizes):
    rows, i = [], 0
    for g, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7 % 1000, g, sha(str(i)), sha("other" if i % 3 == 0 else str(i))))
            i += 1
    assert run(spark, rows) == plain(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, "a", sha("1"), sha("1")), (None, "a", sha("0"), sha("0")), (4, "a", sha("x"), sha("x")), (4, "a", sha("x"), sha("x")), (4, "a", sha("b"), sha("c"))]
    got = run(spark, rows)
    assert got == plain(rows) and len(got) == 5 and [r[-1] for r in got].count(False) == 1


def test_no_rows(spark):
    assert run(spark, []) == []


def test_leaves_by_column(spark):
    df = spark.createDataFrame([(7, None, "ü", "aB"), (None, "", "x", None)], "a bigint, b string, c string, d string")
    got = [r[0] for r in df.select(leaf_digest([F.col(c) for c in "abcd"])).collect()]
    assert got == [sha(enc(7), "-", enc("ü"), enc("aB")), sha("-", "0:", "1:x", "-")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        leaf = lambda t: sha(*[enc(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, t)])
        tampered = r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        rows.append((r.doc_id, r.lang, leaf(r.text), leaf(r.text.translate(str.maketrans(up, low)) if tampered else r.text)))
    found = op13_merkle(spark, sf)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)
