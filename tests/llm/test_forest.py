"""Operator 11 against all pairs of plain sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import cohortwise.llm.forest as forest
from cohortwise.llm.forest import near_classes, op11_forest, regions, shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def plain(rows, percent=85):
    """Sorted (id, size, component, kept) of rows (id, text), by all pairs of different sets."""
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    known = [s for s in sets if s]
    root = {s: s for s in known}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s
    for k, a in enumerate(known):
        for b in known[:k]:
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for s in known:
        ids = [i for i in sets[s] if i is not None]
        least[find(s)] = min([*ids, *([least[find(s)]] if least.get(find(s)) is not None else [])], default=None)
    out = []
    for i, t in rows:
        s = shingles(t)
        c = least[find(s)] if s else i
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id bigint, text string", percent=85):
    return sorted((tuple(r) for r in near_classes(spark.createDataFrame(rows, schema), "doc_id", "text", percent).collect()), key=str)


def family(rnd, size, words, edits):
    base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for k in rnd.sample(range(words), rnd.randrange(edits + 1)):
            own[k] = f"x{rnd.randrange(10 ** 6)}"
        yield " ".join(own)


def test_families_copies_and_hubs(spark):
    rnd = random.Random(4)
    texts = [*family(rnd, 250, 120, 4), *family(rnd, 60, 300, 12), *family(rnd, 40, 30, 1)]
    texts += [texts[0]] * 150 + [f"{texts[1]}  "] + [texts[2].upper()]
    texts += [" ".join(f"u{rnd.randrange(400)}" for _ in range(80)) for _ in range(60)]
    rnd.shuffle(texts)
    rows = [(i * 5 % 2003, t) for i, t in enumerate(texts)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("region", [2, 8])
def test_small_regions_and_blocks_change_nothing(spark, monkeypatch, region):
    monkeypatch.setattr(forest, "REGION", region)
    monkeypatch.setattr(forest, "AT_ONCE", 4000)
    monkeypatch.setattr(forest, "SIGNED", 7)
    monkeypatch.setattr(forest, "SORTED", 500)
    rnd = random.Random(9)
    rows = list(enumerate([*family(rnd, 40, 60, 2), *family(rnd, 30, 40, 3)]))
    assert run(spark, rows) == plain(rows)


def test_nulls_empty_short_long_and_repeated_rows(spark):
    rnd = random.Random(2)
    long = " ".join(f"w{rnd.randrange(10 ** 5)}" for _ in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (None, "one two"), (None, "a b c d e f"), (7, "é É"), (8, "é é"),
            (9, long), (10, long + " end"), (10, long + " end"), (11, "x" * 3_000_000), (12, "\x1f y"), (None, None)]
    assert run(spark, rows) == plain(rows)


def test_no_rows_and_no_links(spark):
    assert run(spark, []) == []
    rows = [(i, f"only {i} in this text of its own {i}") for i in range(5)]
    assert run(spark, rows) == plain(rows)


def test_extra_columns_of_clashing_names(spark):
    rows = [(i, "a b c d e f g", "x", i, b"y") for i in range(4)]
    assert run(spark, rows, "doc_id bigint, text string, digest string, row bigint, shingles binary") == plain([r[:2] for r in rows])


def test_sets_by_blocks(monkeypatch):
    texts = ["a b c d e f", None, "", "g h", "a b c d e f a b c d e f", "z"]
    whole = [(h.tolist(), e.tolist()) for _, _, h, e in shingle_sets(pa.array(texts))]
    monkeypatch.setattr(forest, "AT_ONCE", 1)
    one = [(i, j, h.tolist()) for i, j, h, _ in shingle_sets(pa.array(texts))]
    assert len(whole) == 1 and whole[0][1] == [2, 2, 2, 3, 9, 10] and len(one) > 3
    assert [x for *_, s in one for x in s] == whole[0][0] and [k for i, j, _ in one for k in range(i, j)] == list(range(6))


def test_regions_deepen_only_where_crowded():
    depth = forest.DEPTH
    crowd = [0] + [4] * forest.REGION + [6] + [4] * 3  # one run at depth 4, too large; at depth 5 a pair is left
    shared = np.array([0, 5, 5, *crowd, 0, *[depth] * (2 * forest.REGION)])
    start, deep = regions(shared)
    assert start[:3].tolist() == [0, 0, 0] and not deep[:3].any()
    assert deep[3:3 + len(crowd)].all() and np.bincount(start).max() <= forest.REGION


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op11_forest(spark, sf).collect()), key=str) == plain(rows)


def test_regions_of_the_same_members_meet_once(spark):
    rows = [(10, 1), (10, 2), (10, 3), (20, 3), (20, 1), (20, 2), (30, 1), (30, 2), (40, 4), (40, 5), (None, 9)]
    near = spark.createDataFrame(rows, "region bigint, sid bigint")
    met = sorted((r.region, r.sid, r.root) for r in forest._mixed_regions(near, None).collect())
    assert met == [(10, 1, 1), (10, 2, 2), (10, 3, 3), (30, 1, 1), (30, 2, 2), (40, 4, 4), (40, 5, 5)]
    roots = spark.createDataFrame([(4, 4), (5, 4), (2, 1), (1, 1)], "node bigint, root bigint")
    met = sorted((r.region, r.sid, r.root) for r in forest._mixed_regions(near, roots).collect())
    assert met == [(10, 1, 1), (10, 2, 1), (10, 3, 3)]  # one class in the others
