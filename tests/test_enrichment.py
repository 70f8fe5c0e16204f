"""D-family: radius counts vs brute force, null-vs-zero policy, walk proxy, commute, lookups."""

import math
import random

from pyspark.sql import functions as F

from cohortwise.operators import enrich as D


def hav(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(a))


def test_radius_counts_match_brute_force(spark):
    rnd = random.Random(11)
    for lat0 in (51.0, 70.0, -33.9):
        pts = [(i, lat0 + rnd.uniform(0, 0.05), 10 + rnd.uniform(0, 0.05)) for i in range(150)]
        pois = [(j, rnd.choice(["schools", "cafes", "parks", "groceries"]), lat0 + rnd.uniform(-0.01, 0.06),
                 10 + rnd.uniform(-0.02, 0.07)) for j in range(400)]
        pois += [(1000 + j, "cafes", pts[0][1], pts[0][2]) for j in range(30)]  # a dense spot
        df = spark.createDataFrame(pts, "listing_id int, lat double, lon double")
        pdf = spark.createDataFrame(pois, "poi_id int, category string, lat double, lon double")
        got = {r.listing_id: r for r in D.radius_counts(df, pdf).collect()}
        for i, la, lo in pts:
            for c in ("schools", "cafes", "parks", "groceries"):
                expect = sum(1 for _, cc, pa, po in pois if cc == c and hav(la, lo, pa, po) <= 1.0)
                assert getattr(got[i], f"{c}_n") == expect
            assert got[i].transit_n is None  # category absent from the index -> null, not 0


def test_walk_proxy_null_zero_saturation(spark):
    rows = [(1, None, None, None, None, None), (2, 0, 0, 0, 0, 0), (3, 99, 99, 99, 99, 99), (4, 1, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, schools_n int, cafes_n int, parks_n int, groceries_n int, transit_n int")
    got = {r.id: r.w for r in df.select("id", D.walk_proxy_col().alias("w")).collect()}
    assert got == {1: None, 2: 0.0, 3: 100.0, 4: round(0.15 * (1 / 3) * 100, 1)}


def test_cohort_bbox(spark):
    df = spark.createDataFrame([(1, 51.0, -114.0), (1, 51.1, -114.2), (2, None, None)], "search_id int, lat double, lon double")
    got = {r.search_id: r for r in D.cohort_bbox(df, ["search_id"]).collect()}
    assert set(got) == {1}
    b = got[1]
    assert (round(b.south, 6), round(b.west, 6), round(b.north, 6), round(b.east, 6)) == (50.98, -114.22, 51.12, -113.98)


def test_commute_route_then_estimate(spark):
    df = spark.createDataFrame([(1, 51.05, -114.07, "driving", 51.0447, -114.0719),
                                (2, 51.10, -114.00, "driving", 51.0447, -114.0719),
                                (3, 51.10, -114.00, "transit", 51.0447, -114.0719)],
                               "listing_id int, lat double, lon double, commute_mode string, anchor_lat double, anchor_lon double")
    routes = spark.createDataFrame([(51050, -114070, "driving", 51.0447, -114.0719, 321.0)],
                                   "geo_y long, geo_x long, mode string, anchor_lat double, anchor_lon double, seconds double")
    got = {r.listing_id: (r.commute_min, r.commute_estimated) for r in D.commute(df, routes).collect()}
    assert got[1] == (round(321.0 / 60.0, 1), False) == (5.3, False)
    d = hav(51.10, -114.00, 51.0447, -114.0719)
    assert got[2] == (round(d * 1.3 / 42.0 * 60.0, 1), True)
    assert got[3] == (round(d * 1.3 / (42.0 * 0.55) * 60.0, 1), True)


def test_lookup_misses_and_merge(spark):
    keys = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    table = spark.createDataFrame([(1, "a", 1)], "k int, v string, t int")
    assert sorted(r.k for r in D.lookup_misses(keys, table, ["k"]).collect()) == [2, 3]
    fetched = spark.createDataFrame([(1, "b", 2), (2, "c", 1), (2, "d", 3)], "k int, v string, t int")
    got = {r.k: r.v for r in D.lookup_merge(table, fetched, ["k"], ["t"]).collect()}
    assert got == {1: "b", 2: "d"}


def test_geocode_join_first_resolving_candidate(spark):
    df = spark.createDataFrame([(1, "9 Oak Rd NE", None, None), (2, "x", 1.0, 2.0)],
                               "listing_id int, address string, lat double, lon double")
    geo = spark.createDataFrame([("9 Oak Rd NE, Town", 5.0, 6.0), ("9 Oak Road NE, Town", 7.0, 8.0)],
                                "query string, lat double, lon double")
    from cohortwise.functions.text import geocode_candidates
    got = {r.listing_id: (r.lat, r.lon) for r in D.geocode_join(df, geo, geocode_candidates("address", F.lit("Town"))).collect()}
    assert got == {1: (7.0, 8.0), 2: (1.0, 2.0)}


def test_poi_in_bbox(spark):
    rnd = random.Random(4)
    boxes = [(i, 50 + rnd.uniform(0, 3), -115 + rnd.uniform(0, 3)) for i in range(40)]
    pois = [(j, "cafes", 50 + rnd.uniform(-0.5, 4), -115 + rnd.uniform(-0.5, 4)) for j in range(3000)]
    df = spark.createDataFrame(boxes, "search_id int, s double, w double") \
        .selectExpr("search_id", "s AS south", "w AS west", "s + 0.7 AS north", "w + 1.3 AS east")
    got = {(r.search_id, r.poi_id) for r in
           D.poi_in_bbox(spark.createDataFrame(pois, "poi_id int, category string, lat double, lon double"), df).collect()}
    assert got == {(i, j) for i, s, w in boxes for j, _, y, x in pois if s <= y <= s + 0.7 and w <= x <= w + 1.3}


def test_count_near_radius_and_empty_available_category(spark):
    """~1.1 km per 0.01 degree of latitude: 2 of 3 cafes are within 1 km; parks were fetched
    but have no points, so they count 0; transit was never fetched, so it is null."""
    pois = spark.createDataFrame([(1, "cafes", 51.000, -114.0), (2, "cafes", 51.005, -114.0),
                                  (3, "cafes", 51.050, -114.0)], "poi_id int, category string, lat double, lon double")
    cats = spark.createDataFrame([("cafes", True), ("parks", True), ("transit", False)], "category string, available boolean")
    pt = spark.createDataFrame([(1, 51.0, -114.0)], "listing_id int, lat double, lon double")
    r = D.radius_counts(pt, pois, categories=cats).collect()[0]
    assert (r.cafes_n, r.parks_n, r.transit_n, r.schools_n) == (2, 0, None, None)
    r2 = D.radius_counts(pt, pois).collect()[0]
    assert (r2.cafes_n, r2.parks_n) == (2, None)
    w = D.radius_counts(pt, pois, categories=cats).withColumn("w", D.walk_proxy_col()).collect()[0].w
    assert w == round(0.25 * (2 / 12) * 100, 1)


def test_counts_across_the_180th_meridian(spark):
    pois = spark.createDataFrame([(1, "cafes", 10.0, -179.9999), (2, "cafes", 10.0, 179.9), (3, "parks", 10.001, 180.0)], "poi_id int, category string, lat double, lon double")
    at = spark.createDataFrame([(1, 10.0, 179.9999)], "point_id int, lat double, lon double")
    r = D.radius_counts(at, pois).collect()[0]
    assert (r.cafes_n, r.parks_n) == (1, 1)
    r = D.nearby(at, pois).collect()[0]
    assert (r.cafes_n, r.parks_n) == (1, 1)


def test_a_point_has_its_own_box(spark):
    """Far north a kilometre is more degrees of longitude than the box is wide."""
    pois = spark.createDataFrame([(1, "cafes", 80.0, 20.03), (2, "cafes", 80.0, 20.01)], "poi_id int, category string, lat double, lon double")
    at = spark.createDataFrame([(1, 80.0, 20.0)], "point_id int, lat double, lon double")
    assert D.radius_counts(at, pois).collect()[0].cafes_n == 2 and D.nearby(at, pois).collect()[0].cafes_n == 1


def test_a_null_in_any_key_is_no_miss(spark):
    keys = spark.createDataFrame([(1, 1), (1, 3), (1, None), (None, 3), (2, 2), (2, 2)], "a int, b int")
    table = spark.createDataFrame([(1, 1)], "a int, b int")
    assert sorted(map(tuple, D.lookup_misses(keys, table, ["a", "b"]).collect())) == [(1, 3), (2, 2)]
