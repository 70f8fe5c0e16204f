"""J1-J5 on hand-written snapshots."""

import datetime as dt

from cohortwise.operators.state import RESETS, enrich_update, stage_reset, upsert_into

SNAP = ("listing_id string, source string, price long, beds double, first_seen timestamp, last_seen timestamp, "
        "stage string, reject_reason string, walk_proxy double, score_total double")
SIGHT = "listing_id string, seen_at timestamp, seq long, source string, price long, beds double"


def test_upsert_into_keeps_enrichment_and_first_seen(spark):
    t0, t1, t2 = dt.datetime(2001, 7, 1), dt.datetime(2001, 7, 10), dt.datetime(2001, 7, 20)
    snap = spark.createDataFrame([("A", "portal", 900_000, 3.0, t0, t1, "rejected", "price too high", 55.0, 71.2),
                                  ("B", "portal", 400_000, 2.0, t0, t1, "ranked", None, 40.0, 60.0)], SNAP)
    new = spark.createDataFrame([("A", t2, 1, "email", 700_000, None), ("A", t1, 0, "email", 1, 9.0),
                                 ("C", t2, 2, "email", 500_000, 4.0)], SIGHT)
    got = {r.listing_id: r for r in upsert_into(snap, new, source_cols=("source", "price", "beds")).collect()}
    a = got["A"]
    assert (a.source, a.price, a.beds) == ("email", 700_000, None)      # newest wins, nulls too
    assert (a.first_seen, a.last_seen, a.stage, a.reject_reason) == (t0, t2, "scraped", None)
    assert (a.walk_proxy, a.score_total) == (55.0, 71.2)                # enrichment and scores untouched
    b = got["B"]
    assert (b.stage, b.price, b.last_seen) == ("ranked", 400_000, t1)   # not seen again: unchanged
    c = got["C"]
    assert (c.stage, c.price, c.first_seen, c.walk_proxy) == ("scraped", 500_000, t2, None)


def test_stage_reset_only_legal_moves(spark):
    df = spark.createDataFrame([("A", "ranked"), ("B", "analyzed"), ("C", "rejected")], "listing_id string, stage string")
    got = {r.listing_id: r.stage for r in stage_reset(df, "ranked", "analyzed").collect()}
    assert got == {"A": "analyzed", "B": "analyzed", "C": "rejected"}
    assert ("ranked", "scraped") not in RESETS
    try:
        stage_reset(df, "ranked", "scraped")
        raise AssertionError("illegal move accepted")
    except ValueError:
        pass


def test_enrich_update_only_supplied_columns(spark):
    base = spark.createDataFrame([("A", 1.0, 2.0), ("B", 3.0, 4.0)], "k string, walk double, commute double")
    upd = spark.createDataFrame([("A", None)], "k string, walk double")
    got = {r.k: (r.walk, r.commute) for r in enrich_update(base, upd, "k", ["walk"]).collect()}
    assert got == {"A": (None, 2.0), "B": (3.0, 4.0)}


def test_cohort_count_with_and_without_stale_rows(spark):
    from cohortwise.operators.stats import cohort_count
    snap = spark.createDataFrame([("A", "ranked", 70.0), ("B", "rejected", 55.0), ("C", "scraped", None)],
                                 "listing_id string, stage string, score_total double")
    assert cohort_count(snap).first().cohort_size == 2
    assert cohort_count(snap, ranked_only=True).first().cohort_size == 1
