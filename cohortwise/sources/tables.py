"""Base tables and the listing-shaped views derived from them.

The view texts are plain SQL that Spark and DuckDB both run unchanged, so the
same text feeds our jobs (through ``spark.sql`` with DataFrame arguments) and
the DuckDB oracle (as CTEs).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cohortwise.session import prepared

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# "Today" for every date computation (latest o_orderdate in the tables).
AS_OF = "2001-08-01"

# Listings, places and searches lie in cities: 60,000 order keys, 2,000 part keys and 100 supplier keys
# (what one step of the scale factor has) to a city, so the tables grow by cities and a city keeps its density.
def _city(key: str, per: str) -> str:
    return f"CAST(floor({key} / {per}) AS BIGINT)"


def _south(city: str) -> str:
    return f"(40e0 + ({city} % 100) * 25e-2)"


def _west(city: str) -> str:
    return f"(-120e0 + (CAST(floor({city} / 1e2) AS BIGINT) % 300) * 3e-1)"


_ORDER_CITY, _PART_CITY, _SUPP_CITY = _city("o_orderkey", "6e4"), _city("p_partkey", "2e3"), _city("s_suppkey", "1e2")
_LAT = f"{_south(_ORDER_CITY)} + ((o_orderkey * 7919) % 100003) / 5e5"
_LON = f"{_west(_ORDER_CITY)} + ((o_orderkey * 104729) % 100003) / 5e5"


def _street(custkey: str) -> str:
    return (f"CAST(1 + {custkey} % 100000 AS STRING) || ' ' || CASE {custkey} % 4 WHEN 0 THEN 'Market' WHEN 1 THEN 'Deer Lane' "
            f"WHEN 2 THEN 'Harvest Grove' ELSE '5th' END || ' '")


VIEW_SQL: dict[str, str] = {
    # One search for each supplier; one in fifty weighs nothing, one in seven has reached each earlier stage.
    "v_search": f"""
SELECT s_suppkey AS search_id, {_south(_SUPP_CITY)} + 1e-1 AS anchor_lat, {_west(_SUPP_CITY)} + 1e-1 AS anchor_lon,
  CAST(20000 + (s_suppkey * 7) % 40 * 10000 AS INTEGER) AS price_min, CAST(40000 + (s_suppkey * 7) % 40 * 10000 AS INTEGER) AS price_max,
  CAST(1 + s_suppkey % 4 AS INTEGER) AS beds_min, CAST(1 + s_suppkey % 2 AS INTEGER) AS baths_min,
  CAST(9 + s_suppkey % 12 AS INTEGER) AS max_commute_min, CASE s_suppkey % 3 WHEN 0 THEN 'transit' ELSE 'driving' END AS commute_mode,
  CAST(1200 + (s_suppkey * 13) % 2000 AS INTEGER) AS max_age_days,
  CASE WHEN s_suppkey % 50 = 0 THEN 0e0 ELSE (1 + s_suppkey % 5) / 1e1 END AS w_value,
  CASE WHEN s_suppkey % 50 = 0 THEN 0e0 ELSE (1 + s_suppkey % 3) / 1e1 END AS w_location,
  CASE WHEN s_suppkey % 50 = 0 THEN 0e0 ELSE (s_suppkey % 4) / 1e1 END AS w_freshness,
  CASE s_suppkey % 7 WHEN 0 THEN 'filtered' WHEN 1 THEN 'analyzed' ELSE 'ranked' END AS progress
FROM supplier""",
    "v_listing": f"""
SELECT o_orderkey AS listing_id,
  o_orderpriority AS source,
  {_street('o_custkey')}
    || CASE o_orderkey % 3 WHEN 0 THEN 'Street' WHEN 1 THEN 'St' ELSE 'ST.' END || ' '
    || CASE o_orderkey % 2 WHEN 0 THEN 'Northwest' ELSE 'NW' END AS address,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1e4) * 10000 AS BIGINT) END AS price,
  CAST(1 + o_custkey % 6 AS DOUBLE) AS beds,
  CAST(1 + o_orderkey % 4 AS DOUBLE) AS baths,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 45
       ELSE 600 + (o_orderkey * 37) % 2400 END AS sqft,
  CASE o_orderkey % 4 WHEN 0 THEN 'House' WHEN 1 THEN 'Townhouse' WHEN 2 THEN 'Duplex' ELSE 'Condo' END AS property_type,
  CAST(o_orderdate AS DATE) AS list_date,
  CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE {_LAT} END AS lat,
  {_LON} AS lon
FROM orders""",
    # A fifth of the parcels lie in a street that no listing names.
    "v_parcel": f"""
SELECT upper({_street('c_custkey')}) || CASE WHEN c_custkey % 5 = 0 THEN 'NOWHERE ' ELSE '' END || 'ST NW' AS address_key,
  min(CAST(150000 + (c_custkey * 911) % 200000 AS BIGINT)) AS assessed_value
FROM customer GROUP BY 1""",
    "v_poi": f"""
SELECT p_partkey AS poi_id,
  CASE p_partkey % 5 WHEN 0 THEN 'schools' WHEN 1 THEN 'cafes' WHEN 2 THEN 'parks' WHEN 3 THEN 'groceries' ELSE 'transit' END AS category,
  {_south(_PART_CITY)} + ((p_partkey * 6007) % 4001) / 2e4 AS lat,
  {_west(_PART_CITY)} + ((p_partkey * 15013) % 4001) / 2e4 AS lon
FROM part""",
    "v_sighting": """
SELECT user_id AS listing_id, event_id AS seq, ts AS seen_at,
  event_type AS source, CAST(floor(value * 1000) AS BIGINT) AS price
FROM events""",
    "v_raw": """
SELECT o_orderkey AS listing_id,
  CASE o_orderkey % 11 WHEN 0 THEN 'Contact agent' WHEN 1 THEN '' ELSE '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.00' END AS price_text,
  CASE o_orderkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '2.5' WHEN 2 THEN '3 + 1' ELSE CAST(1 + o_custkey % 6 AS STRING) END AS rooms_text,
  CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN CAST(600 + o_custkey % 900 AS STRING) || ' sqft'
       WHEN 2 THEN CASE WHEN o_orderkey % 17 = 0 THEN '99999999999999999999 acres' ELSE '0.25 acres' END
       ELSE CAST(50 + o_custkey % 200 AS STRING) || ' m2' END AS area_text,
  CASE WHEN o_orderkey % 19 = 0 THEN '99999999999' WHEN o_orderkey % 23 = 0 THEN '99999999999 days' WHEN o_orderkey % 29 = 0 THEN '2000000000 days'
       ELSE CAST(1 + o_custkey % 30 AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN ' hours' WHEN 1 THEN ' days' WHEN 2 THEN ' weeks' ELSE ' months' END END AS age_text,
  CASE o_orderkey % 6 WHEN 0 THEN 'not-a-date' WHEN 1 THEN '2001-07' WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T08:14:00-06:00'
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_text,
  CASE o_orderkey % 3 WHEN 0 THEN '12 Main St SW|Unit 3' WHEN 1 THEN '9 Elm Rd NE, Sampletown'
       ELSE '7 Oak Dr NW, Sampletown, Province A1B 2C3' END AS address_text,
  CAST(1 + o_custkey % 400 AS STRING) || '-deer-lane-rd-' || CASE o_orderkey % 2 WHEN 0 THEN 'nw' ELSE 'se' END || '-sample-town-ab' AS slug
FROM orders""",
    # Of the buckets that hold listings a third have no time, and a seventh lie under a key that matches none.
    "v_route": f"""
SELECT DISTINCT CASE WHEN geo_y % 7 = 0 THEN geo_y + 1000000 ELSE geo_y END AS geo_y, geo_x, 'driving' AS mode, anchor_lat, anchor_lon,
  CASE WHEN (geo_y + geo_x) % 3 <> 0 THEN CAST(300 + (geo_y * 31) % 1500 AS DOUBLE) END AS seconds
FROM (SELECT CAST(floor(({_LAT}) * 1000 + 5e-1) AS BIGINT) AS geo_y, CAST(floor(({_LON}) * 1000 + 5e-1) AS BIGINT) AS geo_x,
        {_south(_ORDER_CITY)} + 1e-1 AS anchor_lat, {_west(_ORDER_CITY)} + 1e-1 AS anchor_lon FROM orders) b""",
}

_FROM = re.compile(r"\bFROM (" + "|".join(BASE_TABLES) + r")\b")


@dataclass
class Tables:
    """Lazily read base tables and views for one data folder."""

    spark: SparkSession
    sf_dir: str
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def base(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._cache[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._cache:
            text = VIEW_SQL[name]
            used = sorted(set(_FROM.findall(text)))
            text = _FROM.sub(lambda m: "FROM {" + m.group(1) + "}", text)
            self._cache[name] = self.spark.sql(text, **{t: self.base(t) for t in used})
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_"):
            return self.view(name)
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(prepared(spark), sf_dir)
