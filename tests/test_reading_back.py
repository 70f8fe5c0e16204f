"""Sources that fail while they are read, retained payloads, ranked bands and snapshots of a number of buckets."""

import os

import pytest
from pyspark.sql import functions as F

from cohortwise.sources.sinks import BAND, read_raw, read_top, retain_raw, write_ranked_bands
from cohortwise.sources.union import read_sources, source_errors
from cohortwise.streaming.ingest import latest_snapshot, snapshot_upsert


def test_one_spoiled_file_among_three_sources(spark, tmpdir_path):
    good, bad, text = (os.path.join(tmpdir_path, x) for x in ("good", "bad", "text"))
    rows = spark.range(100).selectExpr("id AS listing_id", "id * 10 AS price")
    rows.write.parquet(good)
    rows.write.parquet(bad)
    with open(os.path.join(bad, "part-zz.parquet"), "wb") as f:
        f.write(b"this is no parquet file")
    os.makedirs(text)
    with open(os.path.join(text, "a.json"), "w") as f:
        f.write('{"listing_id": 1, "price": 5}\n{"listing_id": 2, "pri\n{"listing_id": 3, "price": 7}\n')
    schema = "listing_id bigint, price bigint"

    def planned_wrong():
        raise OSError("no such portal")
    rows, status = read_sources({
        "good": lambda: spark.read.schema(schema).parquet(good), "bad": lambda: spark.read.schema(schema).parquet(bad),
        "text": lambda: spark.read.schema(schema + ", _corrupt_record string").json(text), "gone": planned_wrong})
    assert {r.source_name: r["count"] for r in rows.groupBy("source_name").count().collect()} == {"good": 100, "text": 2}
    assert sorted(rows.columns) == ["listing_id", "price", "source_name"]
    told = {r.source: r for r in status.collect()}
    assert told["good"].ok and not told["bad"].ok and "OSError" in told["gone"].error
    assert {r.source_name: (r.listings, r.errors) for r in source_errors(status).collect()} == {"good": (100, 0), "bad": (0, 1), "text": (2, 1), "gone": (0, 1)}


def test_every_source_fails(spark):
    def wrong():
        raise ValueError("x")
    rows, status = read_sources({"a": wrong})
    assert rows is None and not status.first().ok


def test_replay_reads_one_day(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "raw")
    for day, first in (("2001-07-30", 0), ("2001-07-31", 100)):
        retain_raw(spark.range(first, first + 10).select(F.col("id").alias("page"), F.lit("{}").alias("json")), path, day)
    days = spark.createDataFrame([("2001-07-30", "parsed"), ("2001-07-31", "failed")], "d string, state string").select(F.to_date("d").alias("ingest_date"), "state")
    again = read_raw(spark, path, days.where("state = 'failed'"))
    assert sorted(r.page for r in again.collect()) == list(range(100, 110))
    assert "dynamicpruning" in again._jdf.queryExecution().executedPlan().toString()


def test_top_of_banded_ranks(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "ranked")
    ranked = spark.range(3000).selectExpr("cast(id % 5 as int) AS search_id", "cast(id div 5 + 1 as int) AS rank", "id AS listing_id")
    write_ranked_bands(ranked.repartition(7), path)
    for k in (1, 5, BAND, BAND + 1, 10_000):
        top = read_top(spark, path, k)
        assert sorted(map(tuple, top.select("search_id", "rank", "listing_id").collect())) == sorted(map(tuple, ranked.where(f"rank <= {k}").collect()))
    plan = read_top(spark, path, 5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(rank,5)" in plan and "PartitionFilters: [isnotnull(band" in plan
    assert sorted(os.listdir(path))[1:] != []


def test_a_snapshot_keeps_its_buckets(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "snap")
    cols = {"source_cols": ("price",), "order_cols": ("at", "seq"), "seen_col": "at"}
    first = spark.createDataFrame([("a", 1, 1, 5), ("b", 1, 2, 6), ("a", 2, 3, 7)], "listing_id string, at int, seq int, price int")
    snapshot_upsert(first, 0, root, 8, **cols)
    snapshot_upsert(first.where("seq = 1"), 1, root, 8, **cols)  # late and again: nothing changes
    assert sorted((r.listing_id, r.price, r.first_seen, r.last_seen) for r in latest_snapshot(spark, root, ("at", "seq")).collect()) == [("a", 7, 1, 2), ("b", 6, 1, 1)]
    with pytest.raises(ValueError):
        snapshot_upsert(first, 2, root, 16, **cols)
