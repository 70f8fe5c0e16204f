"""The listing state table as immutable snapshots (no MERGE needed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("scraped", "filtered", "analyzed", "ranked", "rejected")
# Legal manual moves (J4): from -> to.
RESETS = (("ranked", "analyzed"), ("analyzed", "filtered"), ("rejected", "scraped"))


def upsert(sightings: DataFrame, key: str = "listing_id", order_cols=("seen_at", "seq"),
           source_cols=("source", "price"), time_col: str = "seen_at") -> DataFrame:
    """Newest source columns win (nulls too); first_seen kept, last_seen advanced;
    stage reset to 'scraped', reason cleared.

    One aggregate: ``max_by`` over the ordering struct is combined map-side, so a
    listing seen millions of times never gathers into one task.
    """
    row = F.struct(*[F.col(c) for c in source_cols])
    agg = sightings.groupBy(key).agg(F.max_by(row, F.struct(*[F.col(c) for c in order_cols])).alias("_new"),
                                     F.min(time_col).alias("first_seen"), F.max(time_col).alias("last_seen"))
    return agg.select(key, *[F.col(f"_new.{c}").alias(c) for c in source_cols], "first_seen", "last_seen",
                      F.lit("scraped").alias("stage"), F.lit(None).cast("string").alias("reject_reason"))


def stage_col(invalid: Column, duplicate: Column, criteria: Column, commute: Column) -> tuple[Column, Column]:
    """Stage and reason from the reasons of each step, in pipeline order."""
    reason = (F.when(invalid.isNotNull(), invalid)
              .when(duplicate, F.lit("duplicate listing"))
              .when(criteria.isNotNull(), criteria)
              .when(commute.isNotNull(), commute))
    return F.when(reason.isNull(), F.lit("ranked")).otherwise(F.lit("rejected")), reason


def stage_filter(df: DataFrame, stage: str) -> DataFrame:
    """J2."""
    return df.where(F.col("stage") == stage)


def stage_reset(df: DataFrame, from_stage: str, to_stage: str) -> DataFrame:
    """Move every row of one stage to another (only the legal moves)."""
    if (from_stage, to_stage) not in RESETS:
        raise ValueError(f"illegal reset {from_stage} -> {to_stage}")
    return df.withColumn("stage", F.when(F.col("stage") == from_stage, F.lit(to_stage)).otherwise(F.col("stage")))


def enrich_update(base: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Only the supplied columns overwrite; rows without an update keep theirs.

    A row present in ``updates`` overwrites each listed column (a supplied
    null overwrites too, as an explicit UPDATE does).
    """
    u = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    out = base.join(u, key, "left")
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)))
    return out.drop("_hit", *[f"_u_{c}" for c in cols])


def stage_table(validated: DataFrame, duplicates: DataFrame, enriched: DataFrame, searches: DataFrame,
                id_col: str = "listing_id", progress_col: str = "progress") -> DataFrame:
    """(search_id, id, stage, reject_reason) for all rows whose state says something.

    A row that is invalid or a duplicate is rejected for every search: one row
    with a null search. Pairs that fail a search's criteria are implied by their
    absence (``stage_counts`` counts them), so the table has as many rows as
    there are matches, not listings x searches. Pairs that pass stand at the
    stage their search has reached (``progress_col``: filtered, analyzed or
    ranked); from 'analyzed' on a pair beyond the commute limit is rejected.
    """
    null_search = F.lit(None).cast(searches.schema["search_id"].dataType)
    invalid = validated.where(F.col("invalid_reason").isNotNull()).select(null_search.alias("search_id"), id_col, F.col("invalid_reason").alias("reject_reason"))
    dup = duplicates.select(null_search.alias("search_id"), id_col, F.lit("duplicate listing").alias("reject_reason"))
    gone = invalid.unionByName(dup).withColumn("stage", F.lit("rejected"))
    reached = searches.select("search_id", F.col(progress_col).alias("_at"))
    cut = (F.col("_at") != "filtered") & F.col("commute_reason").isNotNull()
    pairs = enriched.select("search_id", id_col, "commute_reason").join(reached, "search_id").select(
        "search_id", id_col, F.when(cut, F.col("commute_reason")).alias("reject_reason"), F.when(cut, F.lit("rejected")).otherwise(F.col("_at")).alias("stage"))
    return gone.unionByName(pairs).select("search_id", id_col, "stage", "reject_reason")


def upsert_into(snapshot: DataFrame, incoming: DataFrame, key: str = "listing_id",
                order_cols=("seen_at", "seq"), source_cols=("source", "price"),
                time_col: str = "seen_at") -> DataFrame:
    """J1 against an existing snapshot: for every id seen again, the newest source
    columns replace the old ones (nulls too), ``first_seen`` is kept,
    ``last_seen`` advances, the stage resets to 'scraped' and the reason is
    cleared; every other column (enrichment, scores) is left as it was.
    New ids are added; ids not seen again are unchanged.

    The incoming rows fold to one per id first (``max_by``, map-side), then
    one full outer join on the id rewrites the snapshot.
    """
    fresh = upsert(incoming, key, order_cols, source_cols, time_col).withColumn("_hit", F.lit(True))
    bookkeeping = ("first_seen", "last_seen", "stage", "reject_reason")
    rest = [c for c in snapshot.columns if c not in (key, *source_cols, *bookkeeping)]
    o = snapshot.alias("o")
    n = fresh.alias("n")
    hit = F.coalesce(F.col("n._hit"), F.lit(False))
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return j.select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key),
        *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in source_cols],
        F.least(F.col("o.first_seen"), F.col("n.first_seen")).alias("first_seen"),
        F.greatest(F.col("o.last_seen"), F.col("n.last_seen")).alias("last_seen"),
        F.when(hit, F.lit("scraped")).otherwise(F.col("o.stage")).alias("stage"),
        F.when(hit, F.lit(None).cast("string")).otherwise(F.col("o.reject_reason")).alias("reject_reason"),
        *[F.col(f"o.{c}").alias(c) for c in rest])
