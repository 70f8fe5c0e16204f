"""K1/K2: the streamed snapshot equals the batch result row for row; versions, replays, no stream state."""

import os

from pyspark.sql import functions as F

from cohortwise.operators.enrich import geocode_join
from cohortwise.plans.pipeline import Pipeline
from cohortwise.sources import messages as M
from cohortwise.sources.tables import tables
from cohortwise.streaming.ingest import latest_snapshot, messages_to_rows, run_ingest, snapshot_upsert

COLS = ["listing_id", "source", "url", "price", "beds", "baths", "sqft", "address", "city", "list_date", "lat", "lon"]


def mail(day, *listings):
    body = "".join(f'<a href="https://portal.example/real-estate/{i}/{i}-ferry-ln-ne-pebble-bay">x</a> ${price:,} 2 bed 1 bath 900 sqft<br>' + "." * 1400 for i, price in listings)
    return f"From: a@b.example\r\nDate: {day:02d} Jul 2001 08:00:00 +0000\r\nContent-Type: text/html\r\n\r\n{body}".encode()


def put(folder, name, data, at):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    os.utime(path, (at, at))


def rows(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


def test_stream_equals_batch(spark, tmpdir_path):
    """Paths and times order the files differently, a later batch brings an earlier path, and suffixes vary in case."""
    inbox, root, ck = (os.path.join(tmpdir_path, x) for x in ("inbox", "snap", "ck"))
    os.makedirs(inbox)
    put(inbox, "b.eml", mail(2, (1, 399_000), (2, 150_000)), 1_000_000_000)
    put(inbox, "a.EML", mail(1, (1, 350_000), (3, 275_000)), 1_000_000_500)   # later in time, earlier by path
    run_ingest(spark, inbox, root, ck)
    put(inbox, "a1.Htm", mail(4, (2, 120_000), (4, 500_000)), 1_000_001_000)
    put(inbox, "c.txt", mail(3, (3, 199_000)), 900_000_000)
    run_ingest(spark, inbox, root, ck)
    batch = M.latest_message_wins(messages_to_rows(M.read_messages(spark, inbox)))
    got = rows(latest_snapshot(spark, root))
    assert got == rows(batch) and {(r[0], r[3]) for r in got} == {("RCA1", 399_000), ("RCA2", 150_000), ("RCA3", 199_000), ("RCA4", 500_000)}
    assert all(r[9] is not None for r in got)                                 # the message's date
    assert not os.path.exists(os.path.join(ck, "state"))                      # no join, no state
    seen = {r.listing_id: (r.first_seen, r.last_seen) for r in latest_snapshot(spark, root).collect()}
    assert seen["RCA1"][0] < seen["RCA1"][1]


def test_versions_and_replay(spark, tmpdir_path):
    inbox, root = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "snap")
    os.makedirs(inbox)
    put(inbox, "a.eml", mail(1, (1, 300_000), (2, 310_000)), 1_000_000_000)
    first = messages_to_rows(M.read_messages(spark, inbox))
    snapshot_upsert(first, 0, root)
    before = sorted(map(tuple, latest_snapshot(spark, root).collect()))

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if "_SUCCESS" not in f}
    old = files()
    snapshot_upsert(first, 0, root)                                           # replayed
    assert sorted(map(tuple, latest_snapshot(spark, root).collect())) == before
    put(inbox, "b.eml", mail(2, (2, 290_000), (3, 100_000)), 1_000_000_100)
    snapshot_upsert(messages_to_rows(M.read_messages(spark, inbox).where(F.col("path").endswith("b.eml"))), 1, root)
    assert {f: t for f, t in files().items() if f in old} == old              # nothing is overwritten
    got = {r.listing_id: r.price for r in latest_snapshot(spark, root).collect()}
    assert got == {"RCA1": 300_000, "RCA2": 290_000, "RCA3": 100_000}
    # a batch that failed before its version was recorded leaves no trace
    spark.range(1).write.parquet(os.path.join(root, "data-999999999-lost"))
    assert latest_snapshot(spark, root).count() == 3


def test_a_message_is_ranked_end_to_end(spark, tmpdir_path):
    """Alert messages -> geocode join -> pipeline."""
    put(tmpdir_path, "a.eml", mail(9, (11, 250_000), (12, 900_000)), 1_000_000_000)
    listings = M.message_source(spark, tmpdir_path, "Pebble Bay")
    found = spark.createDataFrame([("11 Ferry Ln NE, Pebble Bay", 51.1, -114.1), ("12 Ferry Ln NE, Pebble Bay", 51.1, -114.1)], "query string, lat double, lon double")
    located = geocode_join(listings, found, F.array(F.concat_ws(", ", "address", "city")))
    search = spark.createDataFrame([(1, 51.1, -114.1, 100000, 400000, 1, 1, 20, "driving", 2000, 1.0, 1.0, 1.0)],
                                   "search_id int, anchor_lat double, anchor_lon double, price_min int, price_max int, beds_min int, baths_min int, "
                                   "max_commute_min int, commute_mode string, max_age_days int, w_value double, w_location double, w_freshness double")
    (r,) = Pipeline(tables(spark, "/root/testdata/sf0.001"), source=located, searches=search).explained().collect()
    assert (r.listing_id, r.rank, r.price, r.days_on_market) == ("RCA11", 1, 250_000, 23)
    assert r.url == "https://portal.example/real-estate/11/11-ferry-ln-ne-pebble-bay"


def test_a_blank_address_is_not_looked_up(spark):
    df = spark.createDataFrame([("a", " ", None, None), ("b", "1 X", 5.0, None), ("c", "2 Y", 7.0, None)], "listing_id string, address string, lat double, lon double")
    codes = spark.createDataFrame([(" ", 1.0, 1.0), ("1 X", 2.0, 3.0)], "query string, lat double, lon double")
    got = {r.listing_id: (r.lat, r.lon) for r in geocode_join(df, codes, F.array("address")).collect()}
    assert got == {"a": (None, None), "b": (2.0, 3.0), "c": (7.0, None)}
