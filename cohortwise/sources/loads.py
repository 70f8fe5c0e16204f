"""Latest-wins folding, parcel rows, search parameter rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.text import address_key, strip
from cohortwise.operators.criteria import complete_searches, with_defaults

PARCEL_CSV_SCHEMA = "address string, assessed_value string, roll_year string"


def latest_per_id(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """The row with the greatest ``order_cols`` per key (later file / time wins)."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def read_parcel_csv(spark: SparkSession, path: str) -> DataFrame:
    """A8 reader: the three-column export, all text, with its file order kept."""
    return (spark.read.schema(PARCEL_CSV_SCHEMA).option("header", True).csv(path)
            .withColumn("_file", F.input_file_name())
            .withColumn("_row", F.monotonically_increasing_id()))


def parcel_load(raw: DataFrame, order_cols: list[str]) -> DataFrame:
    """Residential parcel rows -> (address_key, assessed_value, roll_year).

    Blank address or key, and non-positive or unparseable values, are skipped;
    among the remaining rows the first (by ``order_cols``) per key wins.
    """
    addr = strip(F.coalesce(F.col("address"), F.lit("")))

    def to_int(c):
        t = strip(F.col(c).cast("string"))
        return t.try_cast("double").try_cast("bigint")

    rows = (raw.withColumn("address_key", address_key(addr))
            .withColumn("_value", to_int("assessed_value"))
            .withColumn("_year", F.coalesce(to_int("roll_year"), F.lit(0)))
            .where((addr != "") & (F.col("address_key") != "") & (F.col("_value") > 0)))
    first = rows.groupBy("address_key").agg(
        F.min_by(F.struct(F.col("_value").alias("assessed_value"), F.col("_year").alias("roll_year")),
                 F.struct(*[F.col(c) for c in order_cols])).alias("_f"))
    return first.select("address_key", "_f.assessed_value", "_f.roll_year")


def search_params(searches: DataFrame) -> DataFrame:
    """One row per search with defaults for what it leaves unset, normalised weights and the distance bound."""
    s = complete_searches(with_defaults(searches)).withColumn("_wt", F.col("w_value") + F.col("w_location") + F.col("w_freshness"))
    for w in ("w_value", "w_location", "w_freshness"):
        s = s.withColumn(w, F.when(F.col("_wt") <= 0, F.lit(1 / 3)).otherwise(F.col(w) / F.col("_wt")))
    return s.drop("_wt")
