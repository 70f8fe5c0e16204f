"""Mid-rank percentiles within each cohort and the weighted scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.fmt import pyround_of, rounded
from cohortwise.operators.enrich import amenity_total_col
from cohortwise.operators.prefix import weighted_before

# Fixed values (must equal the reference's).
# (component, lower-is-better) in component order.
COMPONENTS = (("price_per_sqft", True), ("assessment_ratio", True), ("commute_min", True),
              ("walk_proxy", False), ("amenities", False), ("days_on_market", True))
VALUE_WEIGHTS = (("price_per_sqft", 0.55), ("assessment_ratio", 0.45))
LOCATION_WEIGHTS = (("commute_min", 0.55), ("walk_proxy", 0.30), ("amenities", 0.15))
FRESHNESS_WEIGHTS = (("days_on_market", 1.0),)


def raw_components(df: DataFrame) -> DataFrame:
    """The six raw inputs (price per sqft and amenity total are derived)."""
    price, sqft = F.col("price").cast("double"), F.col("sqft").cast("double")
    ppsf = F.when(price.isNotNull() & (price != 0) & sqft.isNotNull() & (sqft > 0), price / sqft)
    return (df.withColumn("c_price_per_sqft", ppsf)
            .withColumn("c_assessment_ratio", F.col("assessment_ratio").cast("double"))
            .withColumn("c_commute_min", F.col("commute_min").cast("double"))
            .withColumn("c_walk_proxy", F.col("walk_proxy").cast("double"))
            .withColumn("c_amenities", amenity_total_col())
            .withColumn("c_days_on_market", F.col("days_on_market").cast("double")))


def _long(df: DataFrame, keys: list[str], comps: list[str]) -> DataFrame:
    """A row for each known component of each row."""
    parts = F.array(*[F.struct(F.lit(c).alias("comp"), F.col(f"c_{c}").alias("v")) for c in comps])
    return df.select(*keys, F.inline(parts)).where(F.col("v").isNotNull())


def value_percentiles(df: DataFrame, group_cols: list[str], comps: list[str], partitions: int | None = None) -> DataFrame:
    """E1 table: (group, comp, v) -> mid-rank percentile, 2 dp.

    Ties collapse first (value -> count, combined map-side). Each value's count
    of smaller values then comes from the range-partitioned prefix sum, so
    neither a hot value nor a huge cohort lands on one task.
    """
    return _percentiles(value_counts(df, group_cols, comps), group_cols, partitions)


def value_counts(df: DataFrame, group_cols: list[str], comps: list[str]) -> DataFrame:
    """(group, comp, v, _c): how many rows of a group have a value; ties collapse map-side."""
    return _long(df, group_cols, comps).groupBy(*group_cols, "comp", "v").agg(F.count(F.lit(1)).alias("_c"))


def _percentiles(counts: DataFrame, group_cols: list[str], partitions: int | None = None, kept: tuple[str, ...] = ()) -> DataFrame:
    ranked = weighted_before(counts, [*group_cols, "comp"], "v", "_c", partitions)
    i = F.col("_before")
    j = F.col("_before") + F.col("_c") - 1
    n = F.col("_group_total")
    # nothing divides by n - 1 where n is 1
    pct = F.when(n == 1, F.lit(50.0)).otherwise(((i + j) / 2.0) / (n - 1) * 100.0)
    return rounded(ranked, pct=(pct, 2)).select(*group_cols, "comp", "v", *kept, "pct")


def attach_percentiles(df: DataFrame, table: DataFrame, group_cols: list[str], comps: list[str],
                       key_cols: list[str] | None = None) -> DataFrame:
    """Bring each component's percentile back to its rows.

    One join in long form (a narrow row for each component), then one pivot
    back to a row for each listing: the table is computed once and the cohort is
    shuffled a fixed number of times. ``key_cols`` tell the rows of a group apart.
    """
    keys = [*group_cols, *(key_cols or ["listing_id"])]
    # merged: the long form has many times the rows that its files' size tells, and would be broadcast
    hit = _long(df, keys, comps).hint("merge").join(table, [*group_cols, "comp", "v"])
    wide = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("comp") == c, F.col("pct"))).alias(f"r_{c}") for c in comps])
    return df.join(wide, keys, "left")


def _weighted_present(parts) -> tuple[Column, Column]:
    """Weighted mean over present components and the covered weight share."""
    total, used, all_w = F.lit(0.0), F.lit(0.0), 0.0
    for name, w in parts:
        v = F.col(f"p_{name}")
        total = total + F.when(v.isNotNull(), v * F.lit(w)).otherwise(F.lit(0.0))
        used = used + F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        all_w += w
    score = F.when(used > 0, total / used)
    cov = F.when(used > 0, used / F.lit(all_w)).otherwise(F.lit(0.0))
    return score, cov


def score_columns(df: DataFrame) -> DataFrame:
    """E2, E4-E8 from the ``r_<comp>`` percentiles."""
    out = df.withColumns({f"p_{c}": pyround_of(F.lit(100.0) - F.col(f"r_{c}"), 2) if invert else F.col(f"r_{c}") for c, invert in COMPONENTS})
    v, v_cov = _weighted_present(VALUE_WEIGHTS)
    l, l_cov = _weighted_present(LOCATION_WEIGHTS)
    f, f_cov = _weighted_present(FRESHNESS_WEIGHTS)
    out = out.withColumn("_sv", v).withColumn("_sl", l).withColumn("_sf", f)
    wsum = F.col("w_value") + F.col("w_location") + F.col("w_freshness")
    third = F.lit(1 / 3)
    wv = F.when(wsum <= 0, third).otherwise(F.col("w_value") / wsum)
    wl = F.when(wsum <= 0, third).otherwise(F.col("w_location") / wsum)
    wf = F.when(wsum <= 0, third).otherwise(F.col("w_freshness") / wsum)
    num, den = F.lit(0.0), F.lit(0.0)
    for s, w in ((F.col("_sv"), wv), (F.col("_sl"), wl), (F.col("_sf"), wf)):
        num = num + F.when(s.isNotNull(), s * w).otherwise(F.lit(0.0))
        den = den + F.when(s.isNotNull(), w).otherwise(F.lit(0.0))
    out = out.withColumn("_num", num).withColumn("_den", den)
    total = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.lit(0.0))
    missing = F.filter(F.array(*[F.when(F.col(f"p_{c}").isNull(), F.lit(c)) for c, _ in COMPONENTS]),
                       lambda x: x.isNotNull())
    out = rounded(out, score_value=(F.col("_sv"), 2), score_location=(F.col("_sl"), 2), score_freshness=(F.col("_sf"), 2),
                  score_total=(total, 2), data_completeness=((v_cov + l_cov + f_cov) / 3.0 * 100, 1))
    return out.withColumn("missing", missing).drop("_sv", "_sl", "_sf", "_num", "_den")


def score_cohorts(df: DataFrame, group_cols: list[str] = ("search_id",), partitions: int | None = None) -> DataFrame:
    """E1-E8 for every cohort at once (cohort = rows sharing ``group_cols``)."""
    g = list(group_cols)
    comps = [c for c, _ in COMPONENTS]
    raw = raw_components(df)
    table = value_percentiles(raw, g, comps, partitions)
    return score_columns(attach_percentiles(raw, table, g, comps))


# -- scores kept up to date ---------------------------------------------------

#: Folders of a stored score state; a search's rows and counts lie in one of each.
SCORE_BUCKETS = 64
_COMPS = [c for c, _ in COMPONENTS]


def _bucket(group_col: str) -> Column:
    return F.pmod(F.xxhash64(group_col), F.lit(SCORE_BUCKETS)).cast("int")


def write_score_state(df: DataFrame, path: str, group_col: str = "search_id") -> None:
    """Stores a cohort table with its scores, and each (group, component)'s values with their counts and percentiles."""
    raw = raw_components(df)
    values = _percentiles(value_counts(raw, [group_col], _COMPS), [group_col], kept=("_c",))
    _by_bucket(values, group_col).parquet(f"{path}/values")
    values = df.sparkSession.read.parquet(f"{path}/values").drop("bucket")
    _by_bucket(score_columns(attach_percentiles(raw, values.drop("_c"), [group_col], _COMPS)), group_col).parquet(f"{path}/rows")


def _by_bucket(df: DataFrame, group_col: str):
    return df.withColumn("bucket", _bucket(group_col)).repartition("bucket", group_col).sortWithinPartitions("bucket", group_col).write.mode("overwrite").partitionBy("bucket")


def rescored(spark, path: str, gone: DataFrame, come: DataFrame, group_col: str = "search_id", key_col: str = "listing_id") -> tuple[DataFrame, DataFrame]:
    """E1/E5 after a change: (rows with scores, values with counts and percentiles) of the groups that it touches, and of no others.

    ``gone`` holds the rows that leave a stored cohort, as they were, and
    ``come`` those that enter it; a changed row is in both. The values of both
    are counted with signs and added to the stored counts; prefix sums run again only for a (group,
    component) whose counts differ, and the stored percentiles of the others
    hold. Only the folders of touched groups are read.
    """
    from cohortwise.session import stored

    g = [group_col]
    old, new = raw_components(gone), raw_components(come)
    signed = value_counts(old, g, _COMPS).withColumn("_c", -F.col("_c")).unionByName(value_counts(new, g, _COMPS))
    delta = stored(signed.groupBy(group_col, "comp", "v").agg(F.sum("_c").alias("_c")).where("_c <> 0"))
    touched = stored(gone.select(group_col).unionByName(come.select(group_col)).distinct())
    buckets = [r[0] for r in touched.select(_bucket(group_col)).distinct().collect()]  # SCORE_BUCKETS at most

    def held(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").where(F.col("bucket").isin(buckets)).drop("bucket").join(touched, group_col, "left_semi")
    differ = delta.select(group_col, "comp").distinct()
    values = held("values")
    counts = values.select(group_col, "comp", "v", "_c").join(differ, [group_col, "comp"], "left_semi").unionByName(delta)
    again = _percentiles(counts.groupBy(group_col, "comp", "v").agg(F.sum("_c").alias("_c")).where("_c > 0"), g, kept=("_c",))
    values = stored(values.join(differ, [group_col, "comp"], "left_anti").unionByName(again))
    rows = held("rows").select(come.columns).join(gone.select(group_col, key_col), [group_col, key_col], "left_anti").unionByName(come)
    return score_columns(attach_percentiles(raw_components(rows), values.drop("_c"), g, _COMPS, [key_col])), values
