"""Explanation text, amenity phrase, report projection (all Catalyst string ops)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.fmt import fixed, grouped

# Fixed values (must equal the reference's): labels for missing signals, in component order.
MISSING_LABELS = (
    ("price_per_sqft", "size unavailable, so price per sqft could not be computed"),
    ("assessment_ratio", "no City assessment on file for this address"),
    ("commute_min", "commute time unavailable"),
    ("walk_proxy", "no walkability data"),
    ("amenities", "no amenity data"),
    ("days_on_market", "listing date unknown"),
)
EM_DASH = "—"


def _truthy(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def amenity_phrase_explain() -> Column:
    """Phrase used inside the location clause: schools, cafes, parks only."""
    bits = []
    for label, col in (("school", "schools_n"), ("cafe", "cafes_n"), ("park", "parks_n")):
        n = F.col(col).cast("double")
        bits.append(F.when(_truthy(n), F.concat(fixed(n, 0), F.lit(" " + label),
                                                F.when(n != 1, F.lit("s")).otherwise(F.lit("")))))
    arr = F.filter(F.array(*bits), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, F.concat(F.array_join(arr, ", "), F.lit(" within 1 km")))


def amenity_phrase() -> Column:
    """I2 (walk module): up to three of school/cafe/park/grocer; null vs all-zero differ."""
    bits = []
    for label, col in (("school", "schools_n"), ("cafe", "cafes_n"), ("park", "parks_n"),
                       ("grocer", "groceries_n")):
        n = F.coalesce(F.col(col), F.lit(0))
        bits.append(F.when(n != 0, F.concat(n.cast("string"), F.lit(" " + label),
                                            F.when(n != 1, F.lit("s")).otherwise(F.lit("")))))
    arr = F.filter(F.array(*bits), lambda x: x.isNotNull())
    none = F.coalesce(*[F.col(c) for c in ("schools_n", "cafes_n", "parks_n", "groceries_n", "transit_n")]).isNull()
    return (F.when(none, F.lit("no amenity data"))
            .when(F.size(arr) == 0, F.lit("no amenities within 1 km"))
            .otherwise(F.concat(F.array_join(F.slice(arr, 1, 3), ", "), F.lit(" within 1 km"))))


def _value_clause() -> Column:
    price, sqft = F.col("price").cast("double"), F.col("sqft").cast("double")
    ppsf = F.when(_truthy(price) & _truthy(sqft) & (sqft > 0), price / sqft)
    pct = F.col("p_price_per_sqft")
    b1 = F.when(ppsf.isNotNull() & pct.isNotNull(),
                F.concat(F.lit("$"), grouped(ppsf, 0), F.lit("/sqft, cheaper than "), fixed(pct, 0),
                         F.lit("% of matches")))
    ratio = F.col("assessment_ratio")
    delta = (ratio - 1.0) * 100
    b2 = (F.when(ratio.isNull(), F.lit(None))
          .when(delta <= -1, F.concat(F.lit("listed "), fixed(F.abs(delta), 0), F.lit("% below City assessed value")))
          .when(delta >= 1, F.concat(F.lit("listed "), fixed(delta, 0), F.lit("% above City assessed value")))
          .otherwise(F.lit("listed essentially at City assessed value")))
    bits = F.filter(F.array(b1, b2), lambda x: x.isNotNull())
    head = F.concat(F.lit("Value "), fixed(F.col("score_value"), 0))
    return (F.when(F.col("score_value").isNull(), F.lit(None))
            .when(F.size(bits) == 0, F.concat(head, F.lit(".")))
            .otherwise(F.concat(head, F.lit(f" {EM_DASH} "), F.array_join(bits, ", and "), F.lit("."))))


def _location_clause() -> Column:
    m = F.col("commute_min")
    b1 = F.when(m.isNotNull(), F.concat(fixed(m, 0), F.lit(" min to downtown"),
                                        F.when(F.coalesce(F.col("commute_estimated"), F.lit(False)),
                                               F.lit(" (estimated)")).otherwise(F.lit(""))))
    w = F.col("walk_proxy")
    b3 = F.when(w.isNotNull(), F.concat(F.lit("walk proxy "), fixed(w, 0), F.lit("/100")))
    bits = F.filter(F.array(b1, amenity_phrase_explain(), b3), lambda x: x.isNotNull())
    head = F.concat(F.lit("Location "), fixed(F.col("score_location"), 0))
    return (F.when(F.col("score_location").isNull(), F.lit(None))
            .when(F.size(bits) == 0, F.concat(head, F.lit(".")))
            .otherwise(F.concat(head, F.lit(f" {EM_DASH} "), F.array_join(bits, ", "), F.lit("."))))


def _freshness_clause() -> Column:
    d = F.col("days_on_market").cast("double")
    head = F.concat(F.lit("Freshness "), fixed(F.col("score_freshness"), 0))
    return (F.when(F.col("score_freshness").isNull(), F.lit(None))
            .when(d.isNull(), F.concat(head, F.lit(".")))
            .when(d <= 0, F.concat(head, F.lit(f" {EM_DASH} listed today.")))
            .when(d == 1, F.concat(head, F.lit(f" {EM_DASH} listed yesterday.")))
            .otherwise(F.concat(head, F.lit(f" {EM_DASH} listed "), fixed(d, 0), F.lit(" days ago."))))


def _gaps_clause() -> Column:
    label_map = F.create_map(*[F.lit(x) for kv in MISSING_LABELS for x in kv])
    labels = F.array_distinct(F.transform(F.col("missing"), lambda m: F.coalesce(F.try_element_at(label_map, m), m)))
    return F.when(F.size(F.col("missing")) > 0,
                  F.concat(F.lit("Scored on "), fixed(F.col("data_completeness"), 0),
                           F.lit(f"% of available signals {EM_DASH} "), F.array_join(labels, "; "), F.lit(".")))


def explanation_col() -> Column:
    """Header + value + location + freshness + gaps, empty clauses skipped."""
    header = F.concat(F.lit("Ranked #"), F.col("rank").cast("string"), F.lit(" of "),
                      F.col("cohort_size").cast("string"), F.lit(" matches, scoring "),
                      fixed(F.col("score_total"), 0), F.lit("/100."))
    return F.concat_ws(" ", header, _value_clause(), _location_clause(), _freshness_clause(), _gaps_clause())


def explain(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("explanation", explanation_col())


DASH = EM_DASH


def _num(c: Column, places: int = 0) -> Column:
    return F.when(c.isNull(), F.lit(DASH)).otherwise(grouped(c.cast("double"), places))


def report_rows(ranked: DataFrame) -> DataFrame:
    """Display strings for the ranked table."""
    addr = F.coalesce(F.col("address"), F.lit(""))
    price, sqft = F.col("price"), F.col("sqft")
    ppsf = F.when(_truthy(price) & _truthy(sqft),
                  F.concat(F.lit("$"), grouped(price.cast("double") / sqft.cast("double"), 0)))
    commute = F.when(F.col("commute_min").isNull(), F.lit(DASH)).otherwise(
        F.concat(F.when(F.coalesce(F.col("commute_estimated"), F.lit(False)), F.lit("~")).otherwise(F.lit("")),
                 fixed(F.col("commute_min").cast("double"), 0), F.lit(" min")))
    return ranked.select(
        "search_id", "rank", "listing_id",
        F.when(F.length(addr) <= 30, addr).otherwise(F.concat(F.substring(addr, 1, 29), F.lit("…"))).alias("address_display"),
        F.when(price.isNull(), F.lit(DASH)).otherwise(F.concat(F.lit("$"), grouped(price, 0))).alias("price_display"),
        F.concat(_num(F.col("beds")), F.lit("/"), _num(F.col("baths"))).alias("bed_bath"),
        _num(sqft).alias("sqft_display"),
        F.coalesce(ppsf, F.lit(DASH)).alias("ppsf_display"),
        commute.alias("commute_display"),
        _num(F.col("score_total")).alias("score_display"),
        F.concat_ws("/", _num(F.col("score_value")), _num(F.col("score_location")),
                    _num(F.col("score_freshness"))).alias("vlf_display"),
        F.concat(_num(F.col("data_completeness")), F.lit("%")).alias("data_display"))
