"""A-family readers on files written to a scratch folder: messages, portal JSON, parcel CSV, POIs, sinks."""

import json
import os
import re

import pytest

from pyspark.sql import functions as F

from cohortwise.sources import messages as M
from cohortwise.sources.loads import parcel_load, read_parcel_csv
from cohortwise.sources.portal import portal_listings, read_portal_json

LINK = M.detail_link_pattern()

EML = (b"From: alerts@portal.example\r\nDate: Tue, 17 Jul 2001 09:30:00 -0600\r\nSubject: New listings\r\n"
       b"Content-Type: text/html; charset=utf-8\r\n\r\n"
       b'<p><a href=3D"https://www.portal.example/real-estate/111/12-oak-dr-nw-sampletown-ab">Open</a> '
       b"$549,900 3 + 1 bed 2.5 bath 1,850 sqft MLS&reg; A2100001</p>\r\n"
       b'<p><a href="https://portal.example/real-estate/222/9-elm-rd-ne-sampletown-ab">x</a> $1,200,000 4 bedroom</p>'
       b'<p><a href="https://portal.example/real-estate/111/12-oak-dr-nw-sampletown-ab">again</a></p>')
HTML = (b'<html><a href="https://portal.example/real-estate/333/5-main-st-sw-sampletown-ab">go</a>'
        b" $399,000 2 bed 1 bath &amp; more</html>")


def _write(folder, name, data):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_message_decode_windows_fields(spark, tmpdir_path):
    _write(tmpdir_path, "a.eml", EML)
    _write(tmpdir_path, "b.html", HTML)
    _write(tmpdir_path, "c.txt", b"\xff\xfe garbage \x00")
    _write(tmpdir_path, "d.pdf", b"ignored suffix")
    files = M.read_messages(spark, tmpdir_path)
    assert sorted(os.path.basename(r.path) for r in files.select("path").collect()) == ["a.eml", "b.html", "c.txt"]
    text = M.decode(files, ["path", "modificationTime"])
    dates = {os.path.basename(r.path): r.sent_date for r in text.collect()}
    assert str(dates["a.eml"]) == "2001-07-17" and dates["b.html"] is None
    wins = M.link_windows(text, ["path", "modificationTime"], LINK)
    wins = wins.withColumn("slug", F.regexp_extract("window", LINK, 2))
    rows = {r.listing_id: r for r in M.message_listings(wins, ["path", "modificationTime"], "Sampletown").collect()}
    assert set(rows) == {"A2100001", "RCA222", "RCA333"}
    a = rows["A2100001"]
    assert (a.price, a.beds, a.baths, a.sqft, a.address) == (549900, 4.0, 2.5, 1850, "12 Oak Dr NW")
    assert rows["RCA333"].price == 399000 and rows["RCA333"].address == "5 Main St SW"


def test_link_windows_match_python(spark):
    text = ("intro " + " ".join(f"https://portal.example/real-estate/{i % 7}/s-{i} body {i} " * 3 for i in range(40)))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r.link_id, r.window) for r in M.link_windows(df, ["id"], LINK).orderBy("pos").collect()]
    seen, expect = set(), []
    for m in re.finditer(LINK, text):
        if m.group(1) not in seen:
            seen.add(m.group(1))
            expect.append((m.group(1), text[m.start(): m.start() + 1400]))
    assert got == expect


def test_latest_message_wins(spark):
    rows = spark.createDataFrame([("/i/1.eml", 1, 0, "X", 100), ("/i/2.eml", 1, 0, "X", 90), ("/i/1.eml", 1, 1, "Y", 5)],
                                 "path string, modificationTime int, pos int, listing_id string, price int")
    got = {r.listing_id: r.price for r in M.latest_message_wins(rows).collect()}
    assert got == {"X": 90, "Y": 5}


def test_portal_json_files(spark, tmpdir_path):
    p1 = {"Results": [
        {"MlsNumber": "A1", "Property": {"Price": "$650,000", "Type": "House",
                                         "Address": {"AddressText": "12 Oak Dr NW, Sampletown, AB T2P 1A1|x",
                                                     "Latitude": "51.05", "Longitude": "-114.07"}},
         "Building": {"Bedrooms": "3 + 1", "BathroomTotal": "2", "SizeInterior": "1,800 sqft"},
         "TimeOnRealtor": "3 days", "RelativeDetailsURL": "/real-estate/1/a"},
        {"Id": "777", "Price": 700000, "Property": {"Price": "Contact"}, "InsertedDateUTC": "1000000000",
         "Latitude": 51.1, "Longitude": -114.1, "DaysOnMarket": 12},
        {"Property": {"Price": "1"}}]}
    p2 = {"Results": [{"MlsNumber": "A1", "Property": {"Price": "$1"}}]}
    for i, p in enumerate((p1, p2)):
        with open(os.path.join(tmpdir_path, f"page{i}.json"), "w") as f:
            json.dump(p, f)
    pages = read_portal_json(spark, tmpdir_path)
    got = {r.listing_id: r for r in portal_listings(pages, ["_file", "_page"]).collect()}
    assert set(got) == {"A1", "777"}
    a = got["A1"]
    assert (a.price, a.beds, a.baths, a.sqft, a.address, a.city, a.postal_code, a.days_on_market) == \
        (650000, 4.0, 2.0, 1800, "12 Oak Dr NW", "Sampletown", "T2P 1A1", 3)
    assert a.url == "https://portal.example/real-estate/1/a" and a.lat == 51.05
    b = got["777"]
    assert b.price == 700000 and str(b.list_date) == "2001-09-09" and b.days_on_market == 12 and b.lat == 51.1


def test_pages_keep_their_order(spark, tmpdir_path):
    """Pages of one file in order, files by the numbers in their names; a zero age falls through."""
    def page(price, **more):
        return {"Results": [{"MlsNumber": "B7", "Price": price, **more}]}
    for name, doc in (("page10.json", [page("$10")]), ("page2.json", [page("$5", TimeOnRealtor=0, DaysOnMarket=9), page("$9")])):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            json.dump(doc, f)
    (r,) = portal_listings(read_portal_json(spark, tmpdir_path), ["_file", "_page"]).collect()
    assert (r.price, r.days_on_market) == (5, 9)


def test_parcel_csv(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "parcels.csv")
    with open(path, "w") as f:
        f.write("address,assessed_value,roll_year\n")
        f.write("12 Oak Drive NW,0,2024\n")            # non-positive: skipped, does not block the key
        f.write("12 Oak Dr NW,455000.7,2024\n")        # first valid row wins
        f.write("12 OAK DR N.W.,999999,2024\n")
        f.write(",100,2024\n")
        f.write("9 Elm Rd NE,abc,2024\n")
    got = {r.address_key: (r.assessed_value, r.roll_year) for r in
           parcel_load(read_parcel_csv(spark, path), ["_file", "_row"]).collect()}
    assert got == {"12 OAK DR NW": (455000, 2024)}


def test_poi_tagging(spark):
    from cohortwise.sources.pois import tag_pois
    els = spark.createDataFrame([
        ("node", 1, 51.0, -114.0, None, {"amenity": "cafe"}),
        ("way", 2, None, None, {"lat": 51.1, "lon": -114.1}, {"railway": "station", "public_transport": "station"}),
        ("node", 3, 51.0, -114.0, None, {"amenity": "bank"}),
        ("node", 4, 60.0, -114.0, None, {"leisure": "park"})],
        "type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, tags map<string,string>")
    got = sorted((r.poi_id, r.category) for r in tag_pois(els, (50.0, -115.0, 52.0, -113.0)).collect())
    assert got == [(1, "cafes"), (2, "transit")]


def test_sinks_roundtrip(spark, tmpdir_path):
    from cohortwise.sources.sinks import retain_raw, write_ranked
    df = spark.createDataFrame([(1, 5, 1.0), (2, 6, 2.0)], "search_id int, listing_id int, score_total double")
    write_ranked(df, os.path.join(tmpdir_path, "ranked"))
    write_ranked(df.where("search_id = 1").withColumn("score_total", F.lit(9.0)), os.path.join(tmpdir_path, "ranked"))
    back = {r.search_id: r.score_total for r in spark.read.parquet(os.path.join(tmpdir_path, "ranked")).collect()}
    assert back == {1: 9.0, 2: 2.0}
    retain_raw(df, os.path.join(tmpdir_path, "raw"), "2001-08-01")
    assert spark.read.parquet(os.path.join(tmpdir_path, "raw")).count() == 2


def test_failing_source_does_not_sink_the_union(spark):
    from cohortwise.operators.stats import source_counts
    from cohortwise.sources.union import union_sources

    def good():
        return spark.createDataFrame([("a", 1), ("b", 2)], "listing_id string, price int")

    def bad():
        raise OSError("payload folder missing")

    rows, status = union_sources({"good": good, "bad": bad, "dev": good}, development="dev")
    assert rows.count() == 2
    got = {r.source_name: (r.listings, r.errors) for r in source_counts(rows, status).collect()}
    assert got == {"good": (2, 0), "bad": (0, 1)}


def test_bounded_link_windows_stop_at_next_link(spark):
    text = ("x " + " ".join(f"https://portal.example/real-estate/{i}/s-{i} " + "body " * (i * 40) for i in range(1, 12)))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [(r.link_id, r.window) for r in M.link_windows(df, ["id"], LINK, bounded=True).orderBy("pos").collect()]
    starts = [m.start() for m in re.finditer(LINK, text)] + [len(text)]
    expect = [(m.group(1), text[m.start(): min(m.start() + 1400, starts[k + 1])])
              for k, m in enumerate(re.finditer(LINK, text))]
    assert got == expect


def _parse(spark, raw: bytes, area="Example City, Alberta"):
    df = spark.createDataFrame([("m", 0, raw)], "path string, modificationTime int, content binary")
    text = M.decode(df, ["path", "modificationTime"])
    wins = M.link_windows(text, ["path", "modificationTime"], LINK).withColumn(
        "slug", F.regexp_extract("window", LINK, 2))
    return [r for r in M.message_listings(wins, ["path", "modificationTime"], area).orderBy("pos").collect()]


def test_message_cases(spark):
    two = ('<div><a title="t" href="https://portal.example/real-estate/5501/18-ferry-ln-ne-pebble-bay">see it</a> asking $ 312,400 '
           '- 2 + 1 bdrm, 1.5 bthrm, 988 sq. ft</div><hr><div><a href="http://www.portal.example/real-estate/5502/7b-quarry-tc-sw-pebble-bay-alberta">'
           'and this</a> $95,000 with 1 Bedroom; MLS #c7654321</div>')
    a, b = _parse(spark, two.encode(), "Pebble Bay, Alberta")
    assert (a.listing_id, a.price, a.beds, a.baths, a.sqft, a.address) == ("C7654321", 312400, 3.0, 1.5, 988, "18 Ferry Ln NE")  # the window runs on
    assert (b.listing_id, b.price, b.beds, b.baths, b.sqft, b.address) == ("C7654321", 95000, 1.0, None, None, "7b Quarry Tc SW")
    again = _parse(spark, (two + two).encode(), "Pebble Bay, Alberta")
    assert [r.address for r in again] == ["18 Ferry Ln NE", "7b Quarry Tc SW"]
    soft = b'<a href="https://portal.example/real-estate/5503/40-har=\nbour-rd-nw-pebble-bay">x</a> $1,020,000'
    (c,) = _parse(spark, soft, "Pebble Bay, Alberta")
    assert (c.listing_id, c.price, c.address) == ("RCA5503", 1020000, "40 Harbour Rd NW")
    other = b'see https://portal.example/immobilier/5504/3-quai-pebble-bay 2 chambre'
    assert [(r.listing_id, r.beds) for r in _parse(spark, other, "Pebble Bay, Alberta")] == [("RCA5504", 2.0)]
    assert _parse(spark, b"no link in this one") == [] and _parse(spark, b"") == []


@pytest.mark.parametrize("slug,expected", [
    ("18-ferry-ln-ne-pebble-bay-alberta", "18 Ferry Ln NE"),
    ("18-ferry-ln-ne-pebble-bay-ab-canada", "18 Ferry Ln NE"),
    ("2207-9th-bv-nw-pebble-bay", "2207 9th Bv NW"),
    ("6-pebble-court-se-pebble-bay", "6 Pebble Court SE"),       # a place word within the address stays
    ("pebble-bay-canada", ""),
    ("", ""),
])
def test_slug_cases(spark, slug, expected):
    from cohortwise.functions.text import slug_address
    df = spark.createDataFrame([(slug,)], "s string")
    assert df.select(slug_address("s", "Pebble Bay, Alberta").alias("a")).first().a == expected


@pytest.mark.parametrize("address,expected", [
    ("64 Quarry Tc NE", "64 Quarry Terrace NE"), ("64 Quarry Tc", "64 Quarry Terrace"), ("3 Cedar Gd SW", "3 Cedar Gardens SW"),
    ("8 Ferry Lane Pt SE", "8 Ferry Lane Point SE"), ("8 Ferry Zz SE", "8 Ferry Zz SE"), ("Tc NE", "Tc NE"), ("Lantern", "Lantern"),
])
def test_expansion_cases(spark, address, expected):
    from cohortwise.functions.text import expand_street_type
    df = spark.createDataFrame([(address,)], "a string")
    assert df.select(expand_street_type("a").alias("e")).first().e == expected


def test_parts_charsets_and_dates(spark):
    raw = (b"From: x@y.example\r\nDate: Fri, 06 Jul 2001 23:10:00 +0200\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=Q\r\n\r\n"
           b"--Q\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\ncaf=E9 one\r\n"
           b"--Q\r\nContent-Type: text/html; charset=no-such\r\nContent-Transfer-Encoding: base64\r\n\r\nPGI+dHdvPC9iPg==\r\n"
           b"--Q\r\nContent-Type: image/png\r\n\r\nnot text\r\n--Q--\r\n")
    rows = [("a", raw), ("b", b"Date: never\r\nFrom: z\r\n\r\nplain &amp; simple"), ("c", b"no headers <i>here</i>"), ("d", None)]
    got = {r.k: (r.text, r.sent_date) for r in M.decode(spark.createDataFrame(rows, "k string, content binary"), ["k"]).collect()}
    assert "café one" in got["a"][0] and "two" in got["a"][0] and "not text" not in got["a"][0] and str(got["a"][1]) == "2001-07-06"
    assert "plain & simple" in got["b"][0] and got["b"][1] is None
    assert got["c"] == ("no headers here ", None) or got["c"][0].split() == ["no", "headers", "here"]
    assert got["d"] == ("", None)


def test_a_link_repeated_often_has_one_window(spark):
    text = "https://portal.example/real-estate/1/a " * 20_000 + "https://portal.example/real-estate/2/b end"
    got = M.link_windows(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], LINK).collect()
    assert [(r.pos, r.link_id, len(r.window)) for r in sorted(got, key=lambda r: r.pos)] == [(0, "1", 1400), (1, "2", 42)]


def test_message_source_batch(spark, tmpdir_path):
    _write(tmpdir_path, "a.eml", EML)
    _write(tmpdir_path, "b.html", HTML)
    rows = {r.listing_id: r for r in M.message_source(spark, tmpdir_path, "Sampletown, AB").collect()}
    assert set(rows) == {"A2100001", "RCA222", "RCA333"}
    assert str(rows["A2100001"].list_date) == "2001-07-17" and rows["RCA333"].list_date is None
    assert rows["A2100001"].city == "Sampletown" and rows["A2100001"].source == "email"
