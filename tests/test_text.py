"""B-family column helpers, case by case."""

import pytest
from pyspark.sql import functions as F

from cohortwise.functions import text as T


def _one(spark, col_fn, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(col_fn(F.col("v")).alias("o")).collect()[0].o


@pytest.mark.parametrize("raw,expected", [
    ("64 Quarry Terrace Northeast", "64 QUARRY TC NE"),           # both words spelled out
    ("64 quarry tc ne", "64 QUARRY TC NE"),
    ("2207 9th Boulevard N.W.", "2207 9TH BV NW"),                # dots within the quadrant
    ("2207 9th Blvd n w", "2207 9TH BV NW"),                      # a split quadrant
    ("Suite 31 408 Willow Trail SE", "408 WILLOW TR SE"),         # a unit and its number go
    ("Apt 7", "APT 7"),                                           # nothing would be left: it stays
    ("\t77  Cedar ,, Hill #NW ", "77 CEDAR HL NW"),
    ("5 Park Lane Way SW", "5 PARK LANE WY SW"),                  # only the last type word is shortened
    ("Grove NE", "GROVE NE"),                                     # a type word in front is a name
    ("19 Lantern", "19 LANTERN"),
    ("", ""),
    (None, ""),
])
def test_address_key(spark, raw, expected):
    assert _one(spark, T.address_key, raw) == expected
    df = T.add_address_key(spark.createDataFrame([(raw,)], "address string"))
    assert df.first().address_key == expected


def test_address_key_idempotent(spark):
    df = spark.createDataFrame([("64 Quarry Terrace Northeast",), ("Ste 4 9 Birch Crescent",)], "a string")
    once = df.select(T.address_key("a").alias("k"))
    twice = once.select(T.address_key("k").alias("k2"), "k").collect()
    assert all(r.k == r.k2 for r in twice)


@pytest.mark.parametrize("raw,expected", [
    ("$1,234,500", 1234500), ("599900.00", 599900), ("Contact agent", None), ("", None), ("1.2.3", None)])
def test_parse_price(spark, raw, expected):
    assert _one(spark, T.parse_price, raw) == expected


@pytest.mark.parametrize("raw,expected", [("3 + 1", 4.0), ("2.5", 2.5), ("n/a", None), ("4", 4.0)])
def test_parse_rooms(spark, raw, expected):
    assert _one(spark, T.parse_rooms, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("1,850 sqft", 1850), ("0.25 acres", 10890), ("120 m2", 1291), ("unknown", None), ("0 sqft", None),
    ("99999999999999999999 acres", None)])
def test_parse_area(spark, raw, expected):
    assert _one(spark, T.parse_area, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("3 days", 3), ("1 month", 30), ("2 weeks", 14), ("12 hours", 0), ("36 hours", 2), ("2 years", 730),
    ("17", 17), ("soon", None), ("99999999999", None), ("99999999999 days", None), ("\t5 days\n", 5)])
def test_parse_age(spark, raw, expected):
    assert _one(spark, T.parse_age, raw) == expected


@pytest.mark.parametrize("raw,expected", [
    ("2001-07-20", 12), ("2001-07-20T08:14:00-06:00", 12), ("2001-07-20T23:59:00Z", 12), ("07/04/2001", 28),
    ("2001-07", None), ("garbage", None), ("2002-01-01", 0), ("20010720", 12)])
def test_days_since(spark, raw, expected):
    assert _one(spark, lambda c: T.days_since(c, "2001-08-01"), raw) == expected


@pytest.mark.parametrize("age,expected", [("3 days", "2001-07-29"), ("2000000000 days", None), ("99999999999", None), (None, None)])
def test_list_date_of_an_age(spark, age, expected):
    got = _one(spark, lambda c: T.list_date([F.lit(None).cast("string")], c, "2001-08-01"), age)
    assert (str(got) if got else None) == expected


def test_rounding_of_infinite_and_tied_values(spark):
    from cohortwise.functions.fmt import pyround
    vals = [5.35, 2.675, 0.5, 1.5, -2.5, 1e15 + 0.3, float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r.o for r in df.orderBy("i").select(pyround(F.col("v"), 1).alias("o")).collect()]
    assert got == [round(v, 1) if v is not None and abs(v) < 1e300 else None for v in vals]


def test_split_address(spark):
    r = _one(spark, T.split_address, "7 Oak Dr NW, Sampletown, Province a1b 2c3|extra")
    assert (r.street, r.city, r.postal_code) == ("7 Oak Dr NW", "Sampletown", "A1B 2C3")
    r = _one(spark, T.split_address, "12 Main St SW|Unit 3")
    assert (r.street, r.city, r.postal_code) == ("12 Main St SW", "", "")


def test_slug_address(spark):
    assert _one(spark, lambda c: T.slug_address(c), "18-ferry-ln-ne-pebble-bay-ab") == "18 Ferry Ln NE Pebble Bay"
    assert _one(spark, lambda c: T.slug_address(c, "Pebble Bay, AB"), "18-ferry-ln-ne-pebble-bay-ab") == "18 Ferry Ln NE"


def test_geocode_candidates(spark):
    out = _one(spark, lambda c: T.geocode_candidates(c, F.lit("Sampletown")), "88 Harvest Grove Gv NE")
    assert out == ["88 Harvest Grove Grove NE, Sampletown", "88 Harvest Grove Gv NE, Sampletown"]
    out = _one(spark, lambda c: T.geocode_candidates(c, F.lit("Sampletown")), "1 Main Street")
    assert out == ["1 Main Street, Sampletown"]


def test_abs_url(spark):
    f = lambda c: T.abs_url(c, "https://portal.example")
    assert _one(spark, f, "/real-estate/1/x") == "https://portal.example/real-estate/1/x"
    assert _one(spark, f, "real-estate/1/x") == "https://portal.example/real-estate/1/x"
    assert _one(spark, f, "http://a/b") == "http://a/b"
    assert _one(spark, f, "  ") == ""


def test_mls_id(spark):
    df = spark.createDataFrame([("see MLS® #a1234567 now", "99"), ("no number", "42")], "w string, l string")
    got = [r.o for r in df.select(T.mls_id(F.col("w"), F.col("l")).alias("o")).collect()]
    assert got == ["A1234567", "RCA42"]


def test_whitespace_class_equals_python_isspace(spark):
    chars = [chr(c) for c in range(0x10000) if not (0xD800 <= c < 0xE000)]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    java = {r.c for r in df.where(F.regexp_like("c", F.lit(f"^[{T.WS}]$"))).collect()}
    assert java == {c for c in chars if c.isspace()}
