"""Raw payload retention and the ranked-output sink (Parquet, partitioned)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROWS_PER_FILE = 1_000_000


def retain_raw(raw: DataFrame, path: str, ingest_date: str) -> None:
    """Keep the source payload beside the parsed rows, partitioned by ingest date."""
    (raw.withColumn("ingest_date", F.lit(ingest_date).cast("date"))
     .write.mode("append").partitionBy("ingest_date").parquet(path))


def write_ranked(ranked: DataFrame, path: str) -> None:
    """One Parquet folder per search (dynamic partition overwrite, so a rerun
    replaces only the searches it ranked).

    Rows meet by search first, so a search has one file, or one for each
    ``ROWS_PER_FILE`` ranks if it is larger."""
    part = F.floor(F.coalesce(F.col("rank"), F.lit(0)) / ROWS_PER_FILE) if "rank" in ranked.columns else F.lit(0)
    (ranked.repartition("search_id", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("search_id").parquet(path))


#: Ranks of a band: a read of the top k opens the bands up to k only.
BAND = 100


def read_raw(spark: SparkSession, path: str, dates: DataFrame) -> DataFrame:
    """A13 replay: the payloads retained on ``dates`` (ingest_date), a day table filtered to the days to parse again.

    Dynamic partition pruning reads the partitions of those days only.
    """
    return spark.read.parquet(path).join(F.broadcast(dates.select("ingest_date").distinct()), "ingest_date")


def write_ranked_bands(ranked: DataFrame, path: str) -> None:
    """A14 for many searches: files of one band of ranks and a range of searches, sorted, instead of a folder for each search.

    A search's first ranks lie in the first band, so a top k reads little, and
    the statistics of a file tell which searches it holds.
    """
    banded = ranked.withColumn("band", F.floor((F.col("rank") - 1) / BAND).cast("int"))
    (banded.repartitionByRange("band", "search_id", "rank").sortWithinPartitions("band", "search_id", "rank")
     .write.mode("overwrite").partitionBy("band").parquet(path))


def read_top(spark: SparkSession, path: str, k: int) -> DataFrame:
    """The first ``k`` ranks of every search: bands beyond are not opened, and the rank is pushed down to the files."""
    return spark.read.parquet(path).where((F.col("band") <= (k - 1) // BAND) & (F.col("rank") <= k)).drop("band")
