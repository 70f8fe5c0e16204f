"""What keeps the stages' plans and tasks small on tables that grow."""

import random

from pyspark.sql import functions as F

from cohortwise.operators import criteria as C
from cohortwise.operators import kdsplit, ranges
from cohortwise.operators.score import attach_percentiles


def test_pass_is_the_same_as_no_reason(spark):
    rnd = random.Random(5)
    maybe = lambda *values: rnd.choice([None, *values])
    kinds = "listing_id int, price long, beds double, baths double, sqft long, days_on_market int, property_type string, lat double, lon double"
    rows = [(i, maybe(1, 5, 9), maybe(1.0, 2.5, 4.0), maybe(1.0, 3.0), maybe(500, 900), maybe(3, 40), maybe("", " House", "condo", "Duplex"),
             maybe(51.0, 51.2, 52.0), maybe(-114.0, -113.5)) for i in range(150)]
    bounds = ("search_id int, price_min int, price_max int, beds_min int, beds_max int, baths_min int, baths_max int, sqft_min int, sqft_max int, "
              "max_age_days int, property_types array<string>, max_commute_min int, commute_mode string, anchor_lat double, anchor_lon double")
    searches = [(i, maybe(2, 1), maybe(6), maybe(2, 1), maybe(3, 4), maybe(1, 2), maybe(2, 3), maybe(600, 400), maybe(800, 999), maybe(30, 50),
                 maybe([], ["house"], ["Condo", None]), maybe(9, 60), rnd.choice(["driving", "transit"]), maybe(51.0), maybe(-114.0)) for i in range(80)]
    pairs = spark.createDataFrame(rows, kinds).crossJoin(C.complete_searches(spark.createDataFrame(searches, bounds)))
    pairs = pairs.withColumn("_dist_raw", C.haversine_km("lat", "lon", "anchor_lat", "anchor_lon"))
    got = pairs.select(C.criteria_pass_col().alias("a"), C.criteria_reason_col().isNull().alias("b")).groupBy("a", "b").count().collect()
    assert {(r.a, r.b) for r in got} == {(True, True), (False, False)}


def test_boxes_are_dealt_by_leaf_not_broadcast(spark):
    points = spark.range(3000).selectExpr("id", "double(id % 60) as x", "double(id % 50) as y")
    axes = [F.col("x"), F.col("y")]
    boxes = spark.range(4).selectExpr("id as box", "double(id * 5) as low", "double(id * 5 + 9) as high")
    met = kdsplit.meet(points, boxes, kdsplit.split(points, axes, "id"), axes, F.expr("array(array(low, low, high, high))"), "id")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [_leaf" in plan
    inside = met.where("x between low and high and y between low and high").select("id", "box").collect()
    assert sorted((r.id, r.box) for r in inside) == sorted((i, b) for i in range(3000) for b in range(4) if 5 * b <= i % 60 <= 5 * b + 9 and 5 * b <= i % 50 <= 5 * b + 9)


def test_long_form_of_the_components_is_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 7, 2.0), (1, 8, None)], "search_id int, listing_id int, c_a double")
    table = spark.createDataFrame([(1, "a", 2.0, 50.0)], "search_id int, comp string, v double, pct double")
    got = attach_percentiles(rows, table, ["search_id"], ["a"])
    assert "SortMergeJoin [search_id" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.listing_id, r.r_a) for r in got.collect()) == [(7, 50.0), (8, None)]


def test_boxes_are_dealt_before_they_are_exploded(spark):
    few = spark.range(400).coalesce(1)
    dealt = ranges._dealt(few)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in sizes) < 100


def test_a_plain_session_gets_what_the_queries_need(spark):
    from cohortwise.session import RUNTIME_CONF
    from cohortwise.sources.tables import tables

    plain = spark.newSession()
    for k in RUNTIME_CONF:
        plain.conf.unset(k)
    tables(plain, "/root/testdata/sf0.001")
    assert {k: plain.conf.get(k) for k in RUNTIME_CONF} == RUNTIME_CONF


def test_boxes_do_not_meet_leaves_whose_points_they_miss(spark):
    points = spark.range(4000).selectExpr("id", "double(id % 40) + if(id < 2000, 0, 1000) as x", "double(id % 50) as y")
    axes = [F.col("x"), F.col("y")]
    boxes = spark.createDataFrame([(1, 100.0, 900.0), (2, 10.0, 12.0), (3, 1039.5, 5000.0), (4, 1039.0, 5000.0)], "box int, low double, high double")
    tree = kdsplit.split(points, axes, "id")
    met = kdsplit.meet(points, boxes, tree, axes, F.expr("array(array(low, 0D, high, 60D))"), "id").select("id", "x", "box").collect()
    assert {r.box for r in met} == {2, 4}
    want = [(i, 2) for i in range(2000) if 10 <= i % 40 <= 12] + [(i, 4) for i in range(2000, 4000) if i % 40 == 39]
    assert sorted((r.id, r.box) for r in met if (10 <= r.x <= 12 if r.box == 2 else r.x >= 1039)) == sorted(want)


def test_ranking_reads_written_scores(spark):
    from cohortwise.plans.pipeline import Pipeline

    p = Pipeline(None)
    p._memo["scored"] = spark.range(9).selectExpr("id % 2 as search_id", "id as listing_id", "id as seq", "id % 4 as score_total")
    ranked = p.ranked()
    assert "Range (" not in ranked._jdf.queryExecution().optimizedPlan().toString()  # nothing is scored again for the rows
    assert [r.listing_id for r in ranked.where("search_id = 0").orderBy("rank").collect()] == [2, 6, 0, 4, 8]


def test_repeated_ids_are_never_broadcast(spark, monkeypatch):
    from cohortwise.operators import quality as Q

    plans, pin = [], Q._pinned
    monkeypatch.setattr(Q, "_pinned", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or pin(d))
    rows = spark.range(60).selectExpr("(id + 1) div 2 AS listing_id", "id AS seq", "concat(id div 2, ' Chain Rd') AS address", "1L AS price")
    got = Q.dedupe_exact(rows)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert sorted(r.seq for r in got.collect()) == list(range(0, 60, 2))


def test_report_formats_a_listing_once(spark):
    listings = spark.createDataFrame([(1, 1234567, 2.5, 1.0, None, 3, None, 51.0, -114.0), (2, 5, 2.0, 1.0, None, 3, None, 51.1, -114.2)],
                                     "listing_id long, price long, beds double, baths double, sqft long, days_on_market int, property_type string, lat double, lon double")
    searches = C.with_defaults(spark.createDataFrame([(i, 10, 99, 60 + i) for i in range(3)], "search_id long, price_min int, price_max int, max_commute_min int"))
    report = C.criteria_report(listings, searches)
    plan = report.select("search_id", "criteria_reason")._jdf.queryExecution().optimizedPlan().toString()
    # what stands above the join and is done for each pair prints no price
    assert "format_number(price" not in plan[:plan.index("Join Inner")]
    assert {(r.listing_id, r.criteria_reason) for r in report.collect()} == {(1, "price $1,234,567 above maximum"), (2, "price $5 below minimum")}


def test_rounding_without_text_is_the_same(spark):
    from cohortwise.functions.fmt import pyround, pyround_of

    rnd = random.Random(8)
    xs = [0.0, -0.0, 0.0005, 0.0015, 2.0005, 1.0625, 0.0625, -0.0004, 5.35, 1e6, 1e12, float("nan"), float("inf"), None, *(rnd.uniform(-2e4, 2e4) for _ in range(3000)),
          *(rnd.randrange(10**7) / 2000 for _ in range(3000))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", pyround(F.col("x"), 3).alias("a"), pyround_of(F.col("x"), 3).alias("b")).collect()
    assert [(r.x, r.a, r.b) for r in got if repr(r.a) != repr(r.b)] == []


def test_scores_are_rounded_by_numbers(spark):
    """Whole columns of rounded values equal the text route, also at ties, nulls and values without an end; the text is left for ties."""
    from cohortwise.functions.fmt import pyround, rounded
    from cohortwise.operators.score import COMPONENTS, score_columns

    xs = [None, 0.0, -0.004, 0.005, 1.005, 2.675, 5.35, 66.665, 99.995, 1e12 + 0.125, float("nan"), float("inf")] + [random.Random(3).uniform(-200, 200) for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = rounded(df, a=(F.col("x") / 3, 2), b=(F.col("x"), 1)).select("*", pyround(F.col("x") / 3, 2).alias("c"), pyround(F.col("x"), 1).alias("d"))
    assert got.columns == ["i", "x", "a", "b", "c", "d"]
    assert got.where("not (a <=> c) or not (b <=> d)").count() == 0
    cohort = spark.range(3).selectExpr("id as listing_id", *[f"double(id) as r_{c}" for c, _ in COMPONENTS], "0.2D as w_value", "0.3D as w_location", "0.1D as w_freshness")
    plan = score_columns(cohort)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rint(") >= 5  # two for each of the scores


def test_survivors_read_once_are_not_written(spark, monkeypatch):
    from cohortwise.plans import catalog, pipeline

    written, store = [], pipeline.stored
    monkeypatch.setattr(pipeline, "stored", lambda d: written.append(d.columns) or store(d))
    got = {}
    for name in ("pass_reject_counts", "cohort_bbox", "match_rate", "route_join", "filter_funnel"):
        written.clear()
        got[name] = catalog.REGISTRY[name][0](spark, "/root/testdata/sf0.001")
        assert ["search_id" in c for c in written] == [False]  # the kept listings alone
    n = sum(r.passed for r in got["pass_reject_counts"].collect())
    assert n == got["route_join"].count() == sum(r.total for r in got["match_rate"].collect()) > 0


def test_survivors_are_written_with_what_the_job_reads(spark, monkeypatch):
    from cohortwise.plans import catalog, pipeline

    written, store = [], pipeline.stored
    monkeypatch.setattr(pipeline, "stored", lambda d: written.append(d.columns) or store(d))
    for name, columns in (("walk_proxy", catalog.POINT_COLS), ("stage_reset", pipeline.CUT_COLS), ("cohort_summary", pipeline.SCORED_COLS)):
        written.clear()
        catalog.REGISTRY[name][0](spark, "/root/testdata/sf0.001")
        assert written[1] == list(columns)


def test_many_boxes_go_down_the_tree_at_once(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(kdsplit, "BOXES_AT_ONCE", 7)
    rng = np.random.default_rng(6)
    tree = kdsplit.grown(rng.normal(0, 1, (4000, 2)), 90)
    low = rng.normal(0, 1, (50, 2))
    high = low + rng.uniform(0, 1, (50, 2))
    box, leaf = tree.all_touched(low, high)
    assert sorted(zip(box.tolist(), leaf.tolist())) == sorted((k, x) for k in range(50) for x in tree.touched(low[k], high[k]))
    rows = [(k, [[*low[k].tolist(), *high[k].tolist()], [*low[-k].tolist(), *high[-k].tolist()]][: k % 3]) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, boxes array<array<double>>").coalesce(1)
    got = {r.k: r.leaves for r in df.select("k", kdsplit.leaves_col(tree, F.col("boxes")).alias("leaves")).collect()}
    want = {k: sorted({x for b in boxes for x in tree.touched(np.array(b[:2]), np.array(b[2:]))}) for k, boxes in rows}
    assert got == want


def test_a_report_deals_a_listing_once(spark, monkeypatch):
    """What is shuffled of the listings does not grow with the blocks of searches."""
    monkeypatch.setattr(C, "REPORT_BLOCK", 1)
    listings = spark.range(30).selectExpr("id as listing_id", "id as price", "2.0 as beds", "1.0 as baths", "900L as sqft", "3 as days_on_market", "'' as property_type", "51.0 as lat", "-114.0 as lon")
    searches = C.with_defaults(spark.createDataFrame([(i, 10, 99, 60) for i in range(5)], "search_id long, price_min int, price_max int, max_commute_min int"))
    report = C.criteria_report(listings, searches)
    plan = report._jdf.queryExecution().sparkPlan().toString()
    side = plan[plan.index("Join [_part"):]
    assert "Generate explode" not in side[:side.index("Range")]
    assert sorted((r.search_id, r.listing_id) for r in report.collect()) == [(i, k) for i in range(5) for k in range(30)]
