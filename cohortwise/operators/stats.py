"""Summary aggregates (all partial aggregates; results are tiny)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.fmt import pyround

SMALL_COHORT = 10


def cohort_summary(scored: DataFrame, group_cols=("search_id",)) -> DataFrame:
    """cohort size, mean completeness (1 dp), small-cohort flag."""
    return (scored.groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("cohort_size"), F.avg("data_completeness").alias("_avg"))
            .select(*group_cols, "cohort_size", pyround(F.col("_avg"), 1).alias("avg_completeness"),
                    (F.col("cohort_size") < SMALL_COHORT).alias("small_cohort")))


def filter_funnel(validated: DataFrame, duplicates: DataFrame, counts: DataFrame) -> DataFrame:
    """input, invalid, duplicate, off-criteria, passed (per search).

    ``counts`` holds search_id, passed and rejected (``criteria.pass_counts``)."""
    n_input = validated.select(F.count(F.lit(1))).scalar()
    n_invalid = validated.select(F.count_if(F.col("invalid_reason").isNotNull())).scalar()
    n_dup = duplicates.select(F.count(F.lit(1))).scalar()
    return counts.select("search_id", n_input.alias("input"), n_invalid.alias("invalid"), n_dup.alias("duplicate"),
                         F.col("rejected").alias("off_criteria"), "passed")


def stage_counts(stages: DataFrame, validated: DataFrame, searches: DataFrame) -> DataFrame:
    """rows per stage and in total, for every search, from the stage table.

    All rows that a search has no other stage for are rejected (invalid,
    duplicate or off its criteria)."""
    total = validated.select(F.count(F.lit(1))).scalar()
    per = stages.where(F.col("search_id").isNotNull() & (F.col("stage") != "rejected")).groupBy("search_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    live = per.groupBy("search_id").agg(F.sum("n").alias("_live"))
    rest = searches.select("search_id").join(live, "search_id", "left").withColumn("_live", F.coalesce("_live", F.lit(0)))
    out = F.array(F.struct(F.lit("rejected").alias("stage"), (total - F.col("_live")).alias("n")), F.struct(F.lit("total").alias("stage"), total.alias("n")))
    return per.unionByName(rest.select("search_id", F.inline(out)).where("n > 0"))


def poi_totals(pois: DataFrame) -> DataFrame:
    """points per category."""
    return pois.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def source_counts(rows: DataFrame, status: DataFrame) -> DataFrame:
    """listings per source and whether the source failed (from the union's status table)."""
    counts = rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("listings"))
    st = status.select(F.col("source").alias("source_name"), F.when(F.col("ok"), 0).otherwise(1).alias("errors"))
    return (st.join(counts, "source_name", "left")
            .select("source_name", F.coalesce(F.col("listings"), F.lit(0)).cast("bigint").alias("listings"), "errors"))


def parcel_count(parcels: DataFrame, year_col: str | None = None) -> DataFrame:
    """parcels held (and the roll year when present)."""
    aggs = [F.count(F.lit(1)).alias("parcels")]
    if year_col:
        aggs.append(F.max(year_col).alias("roll_year"))
    return parcels.agg(*aggs)


def cohort_count(snapshot: DataFrame, ranked_only: bool = False, group_cols=()) -> DataFrame:
    """F4 over a state snapshot: rows holding a score whatever their stage (as the
    reference counts, so stale rejects still count), or only ranked rows."""
    df = snapshot.where(F.col("stage") == "ranked") if ranked_only else snapshot
    return df.groupBy(*group_cols).agg(F.count("score_total").alias("cohort_size"))
