"""POI elements (JSON) -> (category, lat, lon) by tag patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must equal the reference's): category -> (tag key, value pattern), in order.
CATEGORY_TAGS = (
    ("schools", "amenity", "^(school|kindergarten)$"),
    ("cafes", "amenity", "^(cafe|restaurant)$"),
    ("parks", "leisure", "^(park|playground)$"),
    ("groceries", "shop", "^(supermarket|convenience)$"),
    ("transit", "public_transport", "^(platform|station)$"),
    ("transit", "railway", "^station$"),
)
ELEMENT_DDL = ("type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, "
               "tags map<string, string>")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """One element per JSON line (an export of node/way records with tags)."""
    return spark.read.schema(ELEMENT_DDL).json(path)


def tag_pois(elements: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Elements -> (poi_id, category, lat, lon): node coordinates else the way's centre;
    one element may land in several categories; optional (south, west, north, east) box.

    The category table is a fixed six-row literal, broadcast to every task;
    the match is a regex on the element's tag value for that key.
    """
    spark = elements.sparkSession
    cats = F.broadcast(spark.createDataFrame(list(CATEGORY_TAGS), "category string, tag_key string, pattern string"))
    e = elements.select(F.col("id").alias("poi_id"), "tags",
                        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"))
    e = e.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if bbox:
        s, w, n, east = bbox
        e = e.where(F.col("lat").between(s, n) & F.col("lon").between(w, east))
    joined = e.join(cats, F.regexp_like(F.try_element_at(F.col("tags"), F.col("tag_key")), F.col("pattern")))
    return joined.select("poi_id", "category", "lat", "lon").distinct()


def elements_from_pois(pois: DataFrame) -> DataFrame:
    """Element records derived from ``v_poi`` for the tagging query: tags chosen from
    each category's pattern, ways carry a centre instead of coordinates, and
    every category also gets untagged decoys that must not match."""
    pid = F.col("poi_id")
    alt = pid % 2 == 0
    key = (F.when(F.col("category") == "schools", "amenity").when(F.col("category") == "cafes", "amenity")
           .when(F.col("category") == "parks", "leisure").when(F.col("category") == "groceries", "shop")
           .when(alt, "public_transport").otherwise("railway"))
    val = (F.when(F.col("category") == "schools", F.when(alt, "school").otherwise("kindergarten"))
           .when(F.col("category") == "cafes", F.when(alt, "cafe").otherwise("restaurant"))
           .when(F.col("category") == "parks", F.when(alt, "park").otherwise("playground"))
           .when(F.col("category") == "groceries", F.when(alt, "supermarket").otherwise("convenience"))
           .otherwise(F.when(alt, "platform").otherwise("station")))
    way = pid % 3 == 0
    real = pois.select(
        F.when(way, "way").otherwise("node").alias("type"), pid.alias("id"),
        F.when(~way, F.col("lat")).alias("lat"), F.when(~way, F.col("lon")).alias("lon"),
        F.when(way, F.struct(F.col("lat").alias("lat"), F.col("lon").alias("lon"))).alias("center"),
        F.create_map(key, val, F.lit("name"), F.concat(F.lit("poi "), pid.cast("string"))).alias("tags"))
    decoy = pois.select(F.lit("node").alias("type"), (-pid).alias("id"), "lat", "lon",
                        F.lit(None).cast("struct<lat: double, lon: double>").alias("center"),
                        F.create_map(F.lit("amenity"), F.lit("school_bus_stop")).alias("tags"))
    return real.unionByName(decoy)
