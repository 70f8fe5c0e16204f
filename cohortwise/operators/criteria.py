"""Per-search criteria with reasons, distance bound, commute cut, field health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.fmt import fixed, general, grouped, pyround_of
from cohortwise.functions.geo import haversine_km

OPTIONAL_SEARCH_COLS = {"beds_max": "int", "baths_max": "int", "sqft_min": "int", "sqft_max": "int",
                        "property_types": "array<string>"}


# What a bound becomes that a search leaves unset.
SEARCH_DEFAULTS = {"price_min": 600_000, "price_max": 800_000, "beds_min": 3, "baths_min": 2, "max_commute_min": 20, "commute_mode": "driving",
                   "max_age_days": 30, "w_value": 0.34, "w_location": 0.33, "w_freshness": 0.33, "anchor_lat": 0.0, "anchor_lon": 0.0}
DEFAULT_TYPES = ("House", "Townhouse", "Duplex")


def with_defaults(searches: DataFrame) -> DataFrame:
    """Unset (null) criteria become the defaults.

    Bounds that are optional (``OPTIONAL_SEARCH_COLS`` but the types) stay null, which passes
    everything. Null types become the default ones, an empty list allows all; without a
    column of types no search restricts them. A column that is absent is left to the default for all.
    """
    for c, v in SEARCH_DEFAULTS.items():
        if c not in searches.columns:
            searches = searches.withColumn(c, F.lit(v))
        else:
            searches = searches.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(searches.schema[c].dataType)))
    if "property_types" in searches.columns:
        searches = searches.withColumn("property_types", F.coalesce("property_types", F.array(*[F.lit(t) for t in DEFAULT_TYPES])))
    return searches


def complete_searches(searches: DataFrame) -> DataFrame:
    """Add absent optional bounds as nulls and the derived distance bound (null, no bound, where the minutes are unset)."""
    for c, t in OPTIONAL_SEARCH_COLS.items():
        if c not in searches.columns:
            searches = searches.withColumn(c, F.lit(None).cast(t))
    speed = F.when(F.col("commute_mode") == "driving", F.lit(80.0)).otherwise(F.lit(40.0))
    return searches.withColumn("geo_bound_km", F.col("max_commute_min") / 60.0 * speed)


#: What the reasons say of a listing alone, as columns of it: formatted once for a listing, not for each search that it meets.
LISTING_TEXTS = {"_price_low": lambda: F.concat(F.lit("price $"), grouped(F.col("price")), F.lit(" below minimum")),
                 "_price_high": lambda: F.concat(F.lit("price $"), grouped(F.col("price")), F.lit(" above maximum")),
                 "_beds_text": lambda: general(F.col("beds")), "_baths_text": lambda: general(F.col("baths"))}


def criteria_reason_col(texts: dict[str, Column] | None = None) -> Column:
    """First failing criterion in the reference's order; null means pass. ``texts``: columns that hold ``LISTING_TEXTS``."""
    text = {name: texts[name] if texts else make() for name, make in LISTING_TEXTS.items()}
    price, beds, baths, sqft, dom, ptype = (F.col(c) for c in ("price", "beds", "baths", "sqft",
                                                                "days_on_market", "property_type"))
    allowed = F.transform(F.col("property_types"), lambda t: F.lower(F.trim(t)))
    dist = F.col("_dist_raw")
    return (F.when(price.isNotNull() & (price < F.col("price_min")), text["_price_low"])
            .when(price.isNotNull() & (price > F.col("price_max")), text["_price_high"])
            .when(beds.isNotNull() & (beds < F.col("beds_min")),
                  F.concat(text["_beds_text"], F.lit(" beds below minimum "), F.col("beds_min").cast("string")))
            .when(beds.isNotNull() & (beds > F.col("beds_max")),
                  F.concat(text["_beds_text"], F.lit(" beds above maximum "), F.col("beds_max").cast("string")))
            .when(baths.isNotNull() & (baths < F.col("baths_min")),
                  F.concat(text["_baths_text"], F.lit(" baths below minimum "), F.col("baths_min").cast("string")))
            .when(baths.isNotNull() & (baths > F.col("baths_max")),
                  F.concat(text["_baths_text"], F.lit(" baths above maximum "), F.col("baths_max").cast("string")))
            .when(sqft.isNotNull() & (sqft < F.col("sqft_min")),
                  F.concat(sqft.cast("string"), F.lit(" sqft below minimum")))
            .when(sqft.isNotNull() & (sqft > F.col("sqft_max")),
                  F.concat(sqft.cast("string"), F.lit(" sqft above maximum")))
            .when(dom.isNotNull() & (dom > F.col("max_age_days")),
                  F.concat(F.lit("listed "), dom.cast("string"), F.lit("d ago, over "),
                           F.col("max_age_days").cast("string"), F.lit("d limit")))
            .when((F.size(F.coalesce(F.col("property_types"), F.array())) > 0) & ptype.isNotNull() & (ptype != "")
                  & ~F.array_contains(allowed, F.lower(F.trim(ptype))),
                  F.concat(F.lit("property type '"), ptype, F.lit("' not in allowed types")))
            .when(dist.isNotNull() & (dist > F.col("geo_bound_km")),
                  F.concat(fixed(dist, 1), F.lit(" km from CBD, beyond "), fixed(F.col("geo_bound_km"), 1),
                           F.lit(" km pre-filter bound"))))


def criteria_pass_col() -> Column:
    """Whether ``criteria_reason_col`` is null, without the texts: nothing is formatted for the rows that fail, and the distance comes last."""
    price, beds, baths, sqft, dom, ptype = (F.col(c) for c in ("price", "beds", "baths", "sqft", "days_on_market", "property_type"))
    allowed = F.transform(F.col("property_types"), lambda t: F.lower(F.trim(t)))
    rules = [price < F.col("price_min"), price > F.col("price_max"), beds < F.col("beds_min"), beds > F.col("beds_max"),
             baths < F.col("baths_min"), baths > F.col("baths_max"), sqft < F.col("sqft_min"), sqft > F.col("sqft_max"), dom > F.col("max_age_days"),
             (F.size(F.coalesce(F.col("property_types"), F.array())) > 0) & (ptype != "") & ~F.array_contains(allowed, F.lower(F.trim(ptype))),
             haversine_km("lat", "lon", "anchor_lat", "anchor_lon") > F.col("geo_bound_km")]
    passes = F.lit(True)
    for fails in rules:  # a null compares as no failure
        passes = passes & ~F.coalesce(fails, F.lit(False))
    return passes


#: Searches of a block, and the parts of the listings that meet all blocks on a key of their own.
REPORT_BLOCK, REPORT_PARTS = 64, 256


def criteria_report(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """C4/C6/C7 with reasons: every listing against every one of ``searches``, with the first failing reason.

    A report for a stated set of searches; what passes for all searches comes
    from ``criteria_pass_banded``, and how many fail at each rule from ``reason_counts``.
    The searches are numbered and packed into blocks of ``REPORT_BLOCK``, each
    part of the listings has a copy of every block, and a listing meets them by an
    equi-join on its part. So a listing is dealt once, whatever the number of searches,
    and neither a product nor a key with all listings arises.
    """
    from cohortwise.operators.prefix import row_position

    s = complete_searches(searches)
    packed = (row_position(s.select("search_id", F.struct(*[c for c in s.columns if c != "search_id"]).alias("_s")).withColumn("_all", F.lit(0)), ["_all"], [F.col("search_id")])
              .groupBy(F.floor(F.col("_before") / REPORT_BLOCK).alias("_block")).agg(F.collect_list(F.struct("search_id", "_s.*")).alias("_block_searches"))
              .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(REPORT_PARTS - 1)))))
    some = listings.withColumns({name: make() for name, make in LISTING_TEXTS.items()}).withColumn("_part", F.pmod(F.xxhash64("listing_id"), F.lit(REPORT_PARTS)).cast("int"))
    joined = some.join(packed, "_part").drop("_block", "_part")
    joined = joined.select(*[c for c in joined.columns if c != "_block_searches"], F.inline("_block_searches"))
    joined = joined.withColumn(
        "_dist_raw", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(),
                            haversine_km("lat", "lon", "anchor_lat", "anchor_lon")))
    return (joined.withColumn("criteria_reason", criteria_reason_col({name: F.col(name) for name in LISTING_TEXTS}))
            .withColumn("distance_km", pyround_of(F.col("_dist_raw"), 3)).drop(*LISTING_TEXTS))


#: The rules in the order that they are tried, each with the step of ``ranges.chain_counts`` that tells who is left.
RULES = (("price below minimum", 1), ("price above maximum", 2), ("beds below minimum", 3), ("beds above maximum", 4), ("baths below minimum", 5),
         ("baths above maximum", 6), ("sqft below minimum", 7), ("sqft above maximum", 8), ("listed too long ago", 10), ("property type not allowed", 11))
BEYOND, PASSED = "beyond the distance bound", "passed"


def reason_counts(listings: DataFrame, passed: DataFrame, searches: DataFrame) -> DataFrame:
    """C4 for every search: (search_id, reason, n), how many listings fail first at each rule, or pass; no rows of n = 0.

    No listing is paired with a search for it: the counts after each rule are
    orthogonal range counts (``ranges.chain_counts``), and ``passed`` (what
    ``criteria_pass_banded`` gives for these listings) tells who is left after the distance.
    """
    from cohortwise.operators.ranges import Dimension, chain_counts

    s = complete_searches(searches)
    dims = [Dimension("price", "price_min", "price_max"), Dimension("beds", "beds_min", "beds_max"), Dimension("baths", "baths_min", "baths_max"),
            Dimension("sqft", "sqft_min", "sqft_max"), Dimension("days_on_market", None, "max_age_days")]
    among = ("property_type", "property_types") if "property_types" in searches.columns else None
    steps = chain_counts(listings, s, "search_id", dims, among)
    per = steps.groupBy("search_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("m"))  # a dozen steps
    met = passed.groupBy("search_id").agg(F.count(F.lit(1)).alias("_passed"))
    per = per.join(met, "search_id", "left").withColumn("_passed", F.coalesce("_passed", F.lit(0)))
    counts, before = [], F.col("m")[0]
    for rule, step in RULES if among else RULES[:-1]:
        left = F.col("m")[step]
        counts.append(F.struct(F.lit(rule).alias("reason"), (before - left).alias("n")))
        before = left
    counts += [F.struct(F.lit(BEYOND).alias("reason"), (before - F.col("_passed")).alias("n")), F.struct(F.lit(PASSED).alias("reason"), F.col("_passed").alias("n"))]
    return per.select("search_id", F.inline(F.array(*counts))).where("n > 0")


def pass_counts(kept: DataFrame, passed: DataFrame, searches: DataFrame) -> DataFrame:
    """C5 for every search: how many kept rows pass, and how many don't."""
    n = kept.select(F.count(F.lit(1))).scalar()
    per = passed.groupBy("search_id").agg(F.count(F.lit(1)).alias("passed"))
    out = searches.select("search_id").join(per, "search_id", "left").withColumn("passed", F.coalesce("passed", F.lit(0)))
    return out.withColumn("rejected", n - F.col("passed"))


def commute_reason_col() -> Column:
    """Minutes above the limit reject; unknown minutes pass."""
    m = F.col("commute_min")
    return F.when(m.isNotNull() & (m > F.col("max_commute_min")),
                  F.concat(fixed(m, 0), F.lit(" min commute exceeds "), F.col("max_commute_min").cast("string"),
                           F.lit(" min limit")))


def field_health(df: DataFrame, group_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Share of rows with price, lat and beds per source; flag below the threshold."""
    n = F.count(F.lit(1))
    out = df.groupBy(group_col).agg(
        n.alias("n"),
        (F.count("price") / n).alias("price_share"),
        (F.count("lat") / n).alias("lat_share"),
        (F.count("beds") / n).alias("beds_share"))
    return out.withColumn("unhealthy", (F.col("price_share") < threshold) | (F.col("lat_share") < threshold)
                          | (F.col("beds_share") < threshold))


def lon_cells(lon: Column, reach: Column, cell_deg: float) -> Column:
    """The distinct columns of cells within ``reach`` degrees of a longitude, across the 180th meridian too."""
    low, high = lon - reach, lon + reach
    cell = lambda x: F.floor((x + 180.0) / cell_deg).cast("bigint")
    span = lambda a, b: F.sequence(cell(a), cell(b))
    ends = (F.lit(-180.0), F.lit(180.0))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(
        span(F.greatest(low, ends[0]), F.least(high, ends[1])),
        F.when(low < -180.0, span(F.greatest(low + 360.0, ends[0]), ends[1])).otherwise(none),
        F.when(high > 180.0, span(ends[0], F.least(high - 360.0, ends[1]))).otherwise(none)))


def lon_cell(lon: Column, cell_deg: float) -> Column:
    return F.floor((lon + 180.0) / cell_deg).cast("bigint")


def _reach_boxes() -> Column:
    """The boxes of (lat, lon, price) that a search can reach, as arrays of lower and upper ends.

    Two boxes more where it reaches across the 180th meridian; listings without
    a price lie at -1, which every search reaches. An unset distance bound reaches everywhere.
    """
    from cohortwise.functions.geo import KM_PER_DEGREE

    reach = F.coalesce(F.col("geo_bound_km") / KM_PER_DEGREE * 1.01, F.lit(360.0))
    lat_hi = F.least(F.abs(F.col("anchor_lat")) + reach, F.lit(89.999999))
    dlon = F.least(reach / F.cos(F.radians(lat_hi)), F.lit(180.0))
    low, high = F.col("anchor_lon") - dlon, F.col("anchor_lon") + dlon
    everywhere = F.lit(-1000.0), F.lit(1000.0)
    none = F.array().cast("array<struct<w: double, e: double>>")
    known = F.col("geo_bound_km").isNotNull() & F.col("anchor_lat").isNotNull() & F.col("anchor_lon").isNotNull()
    lons = F.when(known, F.concat(F.array(F.struct(low.alias("w"), high.alias("e"))),
                                  F.when(low < -180.0, F.array(F.struct((low + 360.0).alias("w"), F.lit(180.0).alias("e")))).otherwise(none),
                                  F.when(high > 180.0, F.array(F.struct(F.lit(-180.0).alias("w"), (high - 360.0).alias("e")))).otherwise(none))
                  ).otherwise(F.array(F.struct(everywhere[0].alias("w"), everywhere[1].alias("e"))))
    south = F.when(known, F.col("anchor_lat") - reach).otherwise(everywhere[0])
    north = F.when(known, F.col("anchor_lat") + reach).otherwise(everywhere[1])
    dear = F.coalesce(F.col("price_max").cast("double"), F.lit(1e300))
    cheap = F.coalesce(F.greatest(F.col("price_min").cast("double"), F.lit(0.0)), F.lit(0.0))
    box = lambda x, a, b: F.array(south, x["w"], a, north, x["e"], b)
    return F.concat(F.transform(lons, lambda x: box(x, cheap, dear)), F.transform(lons, lambda x: box(x, F.lit(-1.0), F.lit(-1.0))))


def criteria_pass_banded(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """C4/C7 pass set for any number of searches, without the listings x searches product.

    Every validated listing has coordinates, and a pass needs the haversine
    distance within the search's bound and the price within its bounds. A k-d
    split of (lat, lon, price) gives join keys of a bounded number of listings,
    in a crowded city too (``kdsplit``); each search meets the leaves that its
    bounds reach, so each pair meets once, and the exact rules run on those
    candidates. A null bound passes everything. Returns passing pairs only
    (``criteria_reason`` is null by construction).
    """
    from cohortwise.operators import kdsplit

    s = complete_searches(searches)
    l = listings.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    price = F.when(F.col("price").isNull(), F.lit(-1.0)).otherwise(F.greatest(F.col("price").cast("double"), F.lit(0.0)))
    axes = [F.col("lat"), F.col("lon"), price]
    joined = kdsplit.meet(l, s, kdsplit.split(l, axes, "listing_id"), axes, _reach_boxes(), "listing_id")
    return (joined.where(criteria_pass_col())
            .withColumn("_dist_raw", haversine_km("lat", "lon", "anchor_lat", "anchor_lon"))
            .withColumn("criteria_reason", F.lit(None).cast("string"))
            .withColumn("distance_km", pyround_of(F.col("_dist_raw"), 3)))
