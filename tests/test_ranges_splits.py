"""Range counts, k-d leaves and quadtree counts against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import criteria as C
from cohortwise.operators import enrich as D
from cohortwise.operators import kdsplit
from cohortwise.operators.ranges import RADIX, Dimension, box_nodes, chain_counts, point_nodes


def test_nodes_cover_a_range_once(spark):
    levels, last = 3, RADIX ** 3 - 1
    rnd = random.Random(1)
    boxes = [(a, b) for a, b in ((rnd.randrange(last + 1), rnd.randrange(last + 1)) for _ in range(60))] + [(0, last), (None, 5), (7, None), (5, 4), (None, None), (3, 3)]
    points = [None, *rnd.sample(range(last + 1), 80), 0, last]
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(boxes)], "i int, lo long, hi long").withColumn("node", F.explode(box_nodes(F.col("lo"), F.col("hi"), levels)))
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "p int, r long").withColumn("node", F.explode(point_nodes(F.col("r"), levels)))
    got = sorted((r.i, r.p) for r in b.join(p, "node").select("i", "p").collect())
    want = sorted((i, k) for i, (lo, hi) in enumerate(boxes) for k, x in enumerate(points) if x is None or (lo is None or x >= lo) and (hi is None or x <= hi))
    assert got == want
    assert b.groupBy("i").count().agg(F.max("count")).first()[0] <= 2 * RADIX * levels + 1


def _chain(points, boxes):
    out = []
    for k, (a0, a1, b0, c1, kinds) in enumerate(boxes):
        left = list(points)
        steps = [len(left)]
        for rule in (lambda p: p[0] is None or a0 is None or p[0] >= a0, lambda p: p[0] is None or a1 is None or p[0] <= a1,
                     lambda p: p[1] is None or b0 is None or p[1] >= b0, lambda p: True, lambda p: True, lambda p: p[2] is None or c1 is None or p[2] <= c1,
                     lambda p: not kinds or not p[3] or p[3].strip().lower() in {t.strip().lower() for t in kinds}):
            left = [p for p in left if rule(p)]
            steps.append(len(left))
        out += [(k, s, n) for s, n in enumerate(steps)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_chain_counts(spark, seed):
    rnd = random.Random(seed)
    some = lambda f: None if rnd.random() < 0.1 else f()
    points = [(some(lambda: rnd.randrange(40) * 5), some(lambda: rnd.randrange(8) / 2), some(lambda: rnd.randrange(300)), rnd.choice(["House", " condo", "", None, "Loft"])) for _ in range(400)]
    points += [(100, 2.0, 50, "House")] * 200  # a third in one place
    boxes = [(some(lambda: rnd.randrange(210)), some(lambda: rnd.randrange(210)), some(lambda: rnd.randrange(5)), some(lambda: rnd.randrange(320)),
              rnd.choice([None, [], ["house "], ["CONDO", "Loft"], ["tent"]])) for _ in range(40)]
    p = spark.createDataFrame(points, "a long, b double, c long, kind string")
    b = spark.createDataFrame([(k, *x) for k, x in enumerate(boxes)], "id int, a0 long, a1 long, b0 int, c1 int, kinds array<string>")
    got = chain_counts(p, b, "id", [Dimension("a", "a0", "a1"), Dimension("b", "b0", None), Dimension("c", None, "c1")], ("kind", "kinds"))
    assert sorted(tuple(r) for r in got.collect()) == _chain(points, boxes)


def test_chain_counts_of_nothing(spark):
    p = spark.createDataFrame([], "a long")
    b = spark.createDataFrame([(1, 5, None)], "id int, a0 long, a1 long")
    assert sorted(tuple(r) for r in chain_counts(p, b, "id", [Dimension("a", "a0", "a1")]).collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 0)]
    assert chain_counts(p, b.limit(0), "id", [Dimension("a", "a0", "a1")]).count() == 0


def test_tree_leaves():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (3000, 3)), np.tile([[0.5, 0.5, 0.5]], (1500, 1))])
    tree = kdsplit.grown(x, 64)
    leaf = tree.leaf_of(x)
    assert len(np.unique(leaf)) > 30
    distinct = np.bincount(leaf[:3000])
    assert distinct.max() <= 400
    for _ in range(40):
        a, b = np.sort(rng.normal(0, 1, (2, 3)), axis=0)
        inside = ((x >= a) & (x <= b)).all(1)
        assert set(leaf[inside]) <= set(tree.touched(a, b))
    assert kdsplit.grown(x[:0], 8).touched(np.zeros(3), np.ones(3)) == [0]


def test_no_leaf_is_crowded_and_null_bounds_pass(spark, monkeypatch):
    """A third of the listings in one spot at one price: keys stay small, and unset bounds keep their searches."""
    monkeypatch.setattr(kdsplit, "LEAF_ROWS", 64)
    rnd = random.Random(5)
    rows = [(i, rnd.uniform(50, 52), rnd.uniform(-115, -113), rnd.choice([None, *range(100, 1000, 10)])) for i in range(2000)] + [(i, 51.0, -114.0, 500) for i in range(2000, 3000)]
    l = spark.createDataFrame(rows, "listing_id int, lat double, lon double, price long").selectExpr("*", "2.0 as beds", "2.0 as baths", "1000L as sqft", "'' as property_type", "1 as days_on_market")
    s = spark.createDataFrame([(1, 51.0, -114.0, 200, 600, 20), (2, 51.0, -114.0, None, None, None), (3, None, None, 300, None, 10), (4, 51.0, -114.0, None, 400, 45)],
                              "search_id int, anchor_lat double, anchor_lon double, price_min int, price_max int, max_commute_min int")
    s = s.selectExpr("*", "0 as beds_min", "0 as baths_min", "'driving' as commute_mode", "9999 as max_age_days")
    keys, meet = [], kdsplit.meet

    def watched(points, boxes, tree, axes, box_array, id_col):
        p = points.withColumn("leaf", kdsplit.leaf_col(tree, axes))
        keys.append(max(math.ceil(r["count"] / math.ceil(r["count"] / 64)) for r in p.groupBy("leaf").count().collect()))
        return meet(points, boxes, tree, axes, box_array, id_col)
    monkeypatch.setattr(kdsplit, "meet", watched)
    got = sorted((r.search_id, r.listing_id) for r in C.criteria_pass_banded(l, s).collect())
    want = sorted((r.search_id, r.listing_id) for r in C.criteria_report(l, s).where("criteria_reason IS NULL").collect())
    assert got == want and {i for i, _ in got} == {1, 2, 3, 4} and keys[0] <= 64
    counts = {(r.search_id, r.reason): r.n for r in C.reason_counts(l, C.criteria_pass_banded(l, s), s).collect()}
    assert sum(counts.values()) == 4 * len(rows) and counts[2, "passed"] == len(rows)


def test_reports_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "REPORT_BLOCK", 3)
    monkeypatch.setattr(C, "REPORT_PARTS", 4)
    l = spark.range(20).selectExpr("cast(id as int) as listing_id", "51.0 as lat", "-114.0 as lon", "id * 10 as price", "2.0 as beds", "2.0 as baths", "1000L as sqft", "'' as property_type", "1 as days_on_market")
    s = spark.range(7).selectExpr("cast(id as int) as search_id", "51.0 as anchor_lat", "-114.0 as anchor_lon", "cast(id * 20 as int) as price_min", "1000 as price_max",
                                  "0 as beds_min", "0 as baths_min", "10 as max_commute_min", "'driving' as commute_mode", "9 as max_age_days")
    got = C.criteria_report(l, s).collect()
    assert len(got) == 140 and all((r.criteria_reason is None) == (r.listing_id * 10 >= r.search_id * 20) for r in got)
    assert C.criteria_report(l, s.limit(0)).count() == 0


@pytest.mark.parametrize("box", [None, 0.006])
def test_dense_centre(spark, monkeypatch, box):
    """A third of all places within some hundred metres: counts as by brute force, and the tests of a point grow far less than the places."""
    monkeypatch.setattr(D, "LEAF_PLACES", 8)
    rnd = random.Random(6)
    places = [(rnd.choice(D.CATEGORIES), rnd.uniform(51.0, 51.06), rnd.uniform(-114.06, -114.0)) for _ in range(800)]
    places += [(rnd.choice(D.CATEGORIES), 51.02 + rnd.gauss(0, 0.002), -114.03 + rnd.gauss(0, 0.003)) for _ in range(400)]
    places += [("cafes", 51.02, -114.03)] * 30 + [("parks", 51.0, 179.999), ("parks", 51.0, -179.999), ("parks", 89.9, 3.0)]
    spots = [(rnd.uniform(51.0, 51.06), rnd.uniform(-114.06, -114.0)) for _ in range(60)] + [(51.02, -114.03), (51.0, 180.0), (89.9, -177.0), (10.0, 10.0)]
    p = spark.createDataFrame(places, "category string, lat double, lon double")
    q = spark.createDataFrame(spots, "lat double, lon double")

    def km(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(x))
    want = {}
    for a, b in spots:
        n = [0] * len(D.CATEGORIES)
        for kind, c, d in places:
            across = min(abs(b - d), 360 - abs(b - d))
            if km(a, b, c, d) <= 1.0 and (box is None or abs(a - c) <= box and across <= box):
                n[D.CATEGORIES.index(kind)] += 1
        if any(n):
            want[a, b] = n
    got = {(r.lat, r.lon): [r[f"_h_{c}"] for c in D.CATEGORIES] for r in D.poi_counts_at(q, p, box_deg=box).collect()}
    assert {k: v for k, v in got.items() if any(v)} == want
