"""A1/A2: portal JSON payload pages -> listing rows (alternate paths, first id wins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions import text as TX
from cohortwise.sources.tables import AS_OF

_S = "string"
RESULT_DDL = (
    "MlsNumber string, Id string, RelativeDetailsURL string, RelativeURLEn string, TimeOnRealtor string, "
    "DaysOnMarket string, InsertedDateUTC string, ListingDate string, PostedDateTime string, Price string, "
    "Latitude string, Longitude string, Bedrooms string, BathroomTotal string, "
    "Property struct<Price: string, PriceUnformattedValue: string, Type: string, SizeTotal: string, LotSize: string, "
    "Latitude: string, Longitude: string, Address: struct<AddressText: string, Text: string, Latitude: string, "
    "Longitude: string>>, "
    "Building struct<Bedrooms: string, BathroomTotal: string, Bathrooms: string, SizeInterior: string, "
    "SizeInteriorFinished: string, TotalFinishedArea: string, Type: string>")
PAGE_DDL = f"Results array<struct<{RESULT_DDL}>>"
DEFAULT_BASE = "https://portal.example"


def read_portal_json(spark: SparkSession, path: str) -> DataFrame:
    """Payload files (a page, or an array of pages, per file). Every leaf is read as text:
    a leaf may be a number or a phrase, and parsing decides.

    ``_file`` sorts files by their names with numbers as numbers (page2 before
    page10); ``_page`` is the page's place in its file (a file is read by one task, in order).
    """
    return (spark.read.schema(PAGE_DDL).option("multiLine", True).json(path)
            .withColumn("_file", natural_key(F.input_file_name())).withColumn("_page", F.monotonically_increasing_id()))


def read_portal_lines(spark: SparkSession, path: str) -> DataFrame:
    """Payload files with a page to a line, each with its number in ``page``: Spark cuts them into
    byte ranges, so a large file is read by many tasks. Lines that are no JSON give no results."""
    return spark.read.schema(f"page bigint, {PAGE_DDL}").option("mode", "PERMISSIVE").json(path)


def natural_key(name: Column) -> Column:
    """A text that sorts names with the numbers in them as numbers."""
    parts = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 24, "0")).otherwise(p)), "")


def _first(parser, *cols) -> Column:
    """A2: the first candidate that *parses* wins (not the first non-null raw value)."""
    return F.coalesce(*[parser(c) for c in cols])


def _nonblank(c: Column) -> Column:
    t = TX.strip(c)
    return F.when(t != "", t)


def _truthy(c: Column) -> Column:
    """A leaf that is neither blank nor zero."""
    t = _nonblank(c)
    return F.when(~t.rlike(r"^-?0+(\.0+)?$"), t)


def portal_listings(pages: DataFrame, order_cols: list[str], base: str = DEFAULT_BASE,
                    as_of: str = AS_OF) -> DataFrame:
    """A1: flatten ``Results`` of every page; id = MlsNumber else Id; rows without
    an id dropped; first occurrence per id (by ``order_cols`` then position) wins."""
    r = pages.select(*order_cols, F.posexplode("Results").alias("_pos", "r"))
    res, prop, addr, bld = F.col("r"), F.col("r.Property"), F.col("r.Property.Address"), F.col("r.Building")
    lid = F.coalesce(_nonblank(res["MlsNumber"]), _nonblank(res["Id"]))
    num = lambda c: c.try_cast("double")
    split = TX.split_address(F.coalesce(_nonblank(addr["AddressText"]), _nonblank(addr["Text"]), F.lit("")))
    age_raw = F.coalesce(_truthy(res["TimeOnRealtor"]), _nonblank(res["DaysOnMarket"]))
    rows = r.select(
        *order_cols, "_pos",
        lid.alias("listing_id"),
        TX.abs_url(F.coalesce(_nonblank(res["RelativeDetailsURL"]), _nonblank(res["RelativeURLEn"])), base).alias("url"),
        split["street"].alias("address"), split["city"].alias("city"), split["postal_code"].alias("postal_code"),
        _first(TX.parse_price, prop["Price"], prop["PriceUnformattedValue"], res["Price"]).alias("price"),
        _first(TX.parse_rooms, bld["Bedrooms"], res["Bedrooms"]).alias("beds"),
        _first(TX.parse_rooms, bld["BathroomTotal"], bld["Bathrooms"], res["BathroomTotal"]).alias("baths"),
        _first(TX.parse_area, bld["SizeInterior"], bld["SizeInteriorFinished"], bld["TotalFinishedArea"]).alias("sqft"),
        _first(TX.parse_area, prop["SizeTotal"], prop["LotSize"]).alias("lot_sqft"),
        F.trim(F.coalesce(_nonblank(prop["Type"]), _nonblank(bld["Type"]), F.lit(""))).alias("property_type"),
        TX.list_date([res["InsertedDateUTC"], res["ListingDate"], res["PostedDateTime"]], age_raw, as_of).alias("list_date"),
        TX.parse_age(age_raw).alias("days_on_market"),
        _first(num, addr["Latitude"], prop["Latitude"], res["Latitude"]).alias("lat"),
        _first(num, addr["Longitude"], prop["Longitude"], res["Longitude"]).alias("lon"),
    ).where(F.col("listing_id").isNotNull())
    rest = [c for c in rows.columns if c != "listing_id"]
    first = rows.groupBy("listing_id").agg(
        F.min_by(F.struct(*rest), F.struct(*order_cols, "_pos")).alias("_r"))
    return first.select("listing_id", *[F.col(f"_r.{c}").alias(c) for c in rest]).withColumn("source", F.lit("portal"))


def payload_from_raw(raw: DataFrame, page_size: int = 100) -> DataFrame:
    """Payload pages (JSON text) derived from the ``v_raw`` rows, for the scan query.

    Each row becomes one result; the listed price path is the raw text and
    the unformatted path a numeric fallback; every tenth row is repeated on
    the next page with another price, so first-occurrence-wins is exercised.
    Pages are ``page_size`` results, so each collected group is bounded.
    """
    lid = F.col("listing_id")
    result = F.struct(
        F.when(lid % 13 != 0, F.concat(F.lit("M"), lid.cast("string"))).alias("MlsNumber"),
        lid.cast("string").alias("Id"),
        F.concat(F.lit("/real-estate/"), lid.cast("string"), F.lit("/"), F.col("slug")).alias("RelativeDetailsURL"),
        F.col("age_text").alias("TimeOnRealtor"),
        F.col("date_text").alias("InsertedDateUTC"),
        F.struct(F.col("price_text").alias("Price"), (lid * 1000).cast("string").alias("PriceUnformattedValue"),
                 F.struct(F.col("address_text").alias("AddressText")).alias("Address")).alias("Property"),
        F.struct(F.col("rooms_text").alias("Bedrooms"), F.col("area_text").alias("SizeInterior")).alias("Building"),
    )
    first = raw.select((lid / page_size).cast("bigint").alias("page"), lid.alias("_o"), result.alias("r"))
    again = raw.where(lid % 10 == 0).select(
        ((lid / page_size).cast("bigint") + 1).alias("page"), lid.alias("_o"),
        result.withField("Property.Price", F.lit("$1")).alias("r"))
    both = first.unionByName(again)
    pages = both.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("_o", "r"))).alias("_rs"))
    return pages.select("page", F.to_json(F.struct(F.transform("_rs", lambda x: x["r"]).alias("Results"))).alias("json"))
