"""A10: deterministic listing generator seeded from parcel rows.

Every draw is the head of ``md5(key:seed:stream)`` mapped to [0, 1): stable under
any repartitioning (unlike ``rand``), so a rerun, or another engine, yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE_LOW, PRICE_HIGH, PRICE_STEP = 0.86, 1.18, 5000


def _digest(key: Column, seed: int, stream: int) -> Column:
    return F.md5(F.concat(key, F.lit(f":{seed}:{stream}")))


def _u(key: Column, seed: int, stream: int) -> Column:
    return F.conv(F.substring(_digest(key, seed, stream), 1, 7), 16, 10).cast("double") / float(1 << 28)


def synth_listings(parcels: DataFrame, seed: int = 7) -> DataFrame:
    """One listing per parcel: price = assessed x U(0.86, 1.18) floored to 5,000, with
    planted defects (missing sqft, missing coordinates, null/zero price,
    implausible sqft, a copied address/price under another id, a bad date)."""
    k = F.col("address_key")
    # Defect slot per parcel: each planted kind hits about 1 in 40 rows.
    idx = F.floor(_u(k, seed, 8) * 40).cast("int")
    price = F.floor(F.col("assessed_value") * (PRICE_LOW + (PRICE_HIGH - PRICE_LOW) * _u(k, seed, 1)) / PRICE_STEP) \
        * PRICE_STEP
    base = parcels.select(
        F.concat(F.lit("SYN"), F.substring(_digest(k, seed, 0), 1, 15)).alias("listing_id"),
        F.lit("synthetic").alias("source"), k.alias("address"),
        F.when(idx == 3, F.lit(None)).when(idx == 4, F.lit(0)).otherwise(price).cast("bigint").alias("price"),
        (2 + F.floor(_u(k, seed, 2) * 4)).alias("beds"), (1 + F.floor(_u(k, seed, 3) * 3)).alias("baths"),
        F.when(idx < 3, F.lit(None)).when(idx == 5, F.lit(45)).when(idx == 6, F.lit(99_000))
         .otherwise(900 + F.floor(_u(k, seed, 4) * 2100)).cast("bigint").alias("sqft"),
        F.when(idx == 7, F.lit("not a date")).otherwise(
            F.date_format(F.date_sub(F.lit("2001-08-01").cast("date"), F.floor(_u(k, seed, 5) * 60).cast("int")),
                          "yyyy-MM-dd")).alias("list_date"),
        F.when(idx == 8, F.lit(None)).otherwise(51.0 + _u(k, seed, 6) * 0.2).alias("lat"),
        (-114.2 + _u(k, seed, 7) * 0.2).alias("lon"))
    copies = base.where(F.col("price").isNotNull() & (F.col("price") > 0)).where(idx == 9) \
        .withColumn("listing_id", F.concat(F.col("listing_id"), F.lit("-COPY")))
    return base.unionByName(copies)
