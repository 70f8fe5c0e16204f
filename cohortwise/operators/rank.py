"""Rank assignment and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.operators.prefix import row_position


def assign_rank(scored: DataFrame, group_cols: list[str] = ("search_id",), score: str = "score_total",
                tie: str = "seq", partitions: int | None = None, key: str = "listing_id") -> DataFrame:
    """G1: 1..n by score descending, ties in input order; adds ``cohort_size``.

    Positions are found on a narrow, range-partitioned frame (group, score, tie,
    key), so a cohort of any size is sorted by many tasks, and joined back on
    (group, key), which is unique.
    """
    g = list(group_cols)
    narrow = scored.select(*g, F.col(score).alias("_s"), F.col(tie).alias("_t"), F.col(key).alias("_key"))
    out = row_position(narrow, g, [F.col("_s").desc(), F.col("_t").asc()], partitions)
    place = out.select(*g, F.col("_key").alias(key), (F.col("_before") + 1).cast("int").alias("rank"), F.col("_group_total").cast("int").alias("cohort_size"))
    return scored.join(place, [*g, key])


def top_k(ranked: DataFrame, k: int, group_cols: list[str] = ("search_id",), score: str = "score_total",
          tie: str = "seq") -> DataFrame:
    """The k best scored rows per group (limit is the feature here).

    ``row_number <= k`` over a per-group window is planned as a
    WindowGroupLimit, which keeps only k rows per group in each task before
    the shuffle, so the exchange carries at most k rows per group per task.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col(score).desc(), F.col(tie).asc())
    return (ranked.where(F.col(score).isNotNull())
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn"))
