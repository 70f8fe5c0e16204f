"""Registered queries: name -> (Spark job over (spark, sf_dir), DuckDB oracle SQL or None).

Every Spark job reads the driver's tables (through the listing views) and
returns a DataFrame whose columns are aliased exactly like the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.operators import criteria as C
from cohortwise.operators import enrich as D
from cohortwise.operators.explain import amenity_phrase, report_rows
from cohortwise.operators.rank import top_k
from cohortwise.plans import oracle as O
from cohortwise.plans.pipeline import CUT_COLS, SCORED_COLS, Pipeline
from cohortwise.sources.tables import tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
CATS = D.CATEGORIES
PCOLS = [f"p_{c}" for c in ("price_per_sqft", "assessment_ratio", "commute_min", "walk_proxy", "amenities",
                            "days_on_market")]
# What radius counts read of a survivor.
POINT_COLS = ("search_id", "listing_id", "lat", "lon")
RCOLS = [c.replace("p_", "r_", 1) for c in PCOLS]


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _p(spark: SparkSession, sf_dir: str, used: tuple[str, ...] | None = None) -> Pipeline:
    return Pipeline(tables(spark, sf_dir), used=used)


# -- C: validation, dedupe, criteria -----------------------------------------

@register("validate", O.with_chain("SELECT listing_id, invalid_reason FROM val"))
def q_validate(spark, sf_dir):
    return _p(spark, sf_dir).validated().select("listing_id", "invalid_reason")


@register("reconcile_age", O.with_chain("SELECT listing_id, days_on_market FROM valid"))
def q_reconcile_age(spark, sf_dir):
    return _p(spark, sf_dir).valid().select("listing_id", "days_on_market")


@register("address_key", O.with_chain(f"SELECT listing_id, address, address_key FROM {O.address_key_sql('v_listing')}"))
def q_address_key(spark, sf_dir):
    from cohortwise.functions.text import address_key
    return tables(spark, sf_dir).v_listing.select("listing_id", "address", address_key("address").alias("address_key"))


@register("dedupe", O.with_chain("SELECT listing_id, address_key, price FROM kept"))
def q_dedupe(spark, sf_dir):
    return _p(spark, sf_dir).kept().select("listing_id", "address_key", "price")


@register("duplicates", O.with_chain("SELECT listing_id, address_key, price FROM dups"))
def q_duplicates(spark, sf_dir):
    p = _p(spark, sf_dir)
    return D.with_address_key(p.duplicates()).select("listing_id", "address_key", "price")


def _duck_greedy(rounds: int = 12) -> str:
    """The greedy rule in rounds: a row stays if it is the first undecided one of its id and of its key."""
    ctes = ["u0 AS MATERIALIZED (SELECT listing_id, seq, CASE WHEN address_key = '' THEN 'own ' || CAST(seq AS VARCHAR) ELSE address_key END AS k, "
            f"coalesce(price, 0) AS p, address_key, price FROM {O.address_key_sql(_TWICE)})"]
    for r in range(rounds):
        ctes += [f"k{r} AS MATERIALIZED (SELECT * FROM u{r} QUALIFY seq = min(seq) OVER (PARTITION BY listing_id) AND seq = min(seq) OVER (PARTITION BY k, p))",
                 f"u{r + 1} AS MATERIALIZED (SELECT * FROM u{r} u WHERE NOT EXISTS (SELECT 1 FROM k{r} x WHERE x.listing_id = u.listing_id) "
                 f"AND NOT EXISTS (SELECT 1 FROM k{r} x WHERE x.k = u.k AND x.p = u.p))"]
    # rows still undecided would show as rows without an id
    kept = " UNION ALL ".join([*(f"SELECT listing_id, seq, address_key, price FROM k{r}" for r in range(rounds)),
                               f"SELECT NULL, seq, address_key, price FROM u{rounds}"])
    return f"SELECT * FROM (WITH {', '.join(ctes)} {kept})"


_TWICE = ("(SELECT listing_id, listing_id * 2 AS seq, address, price FROM val WHERE invalid_reason IS NULL UNION ALL "
          "SELECT listing_id, listing_id * 2 + 1 AS seq, address, price * 2 AS price FROM val WHERE invalid_reason IS NULL)")


@register("dedupe_repeated_ids", O.with_chain(_duck_greedy()))
def q_dedupe_repeated_ids(spark, sf_dir):
    """C3 on two sources that report the same ids, the second at twice the price."""
    t = tables(spark, sf_dir)
    first = t.v_listing.withColumn("seq", F.col("listing_id") * 2)
    again = t.v_listing.withColumn("seq", F.col("listing_id") * 2 + 1).withColumn("price", F.col("price") * 2)
    return Pipeline(t, source=first.unionByName(again), unique_ids=False).kept().select("listing_id", "seq", "address_key", "price")


@register("dedupe_chain", """SELECT o_orderkey AS listing_id, o_orderkey AS seq FROM (
  SELECT o_orderkey, row_number() OVER (PARTITION BY run ORDER BY o_orderkey) AS place FROM (
    SELECT o_orderkey, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS run FROM orders)) WHERE place % 2 = 1""")
def q_dedupe_chain(spark, sf_dir):
    """C3 on orders that share an id with the key before and an address with the key after, so that each run of keys is one chain."""
    from cohortwise.operators.quality import dedupe_exact

    key = F.col("o_orderkey")
    rows = tables(spark, sf_dir).orders.select(key.alias("seq"), F.floor((key + 1) / 2).alias("link"), F.concat(F.floor(key / 2).cast("string"), F.lit(" Chain Road NW")).alias("address"), F.lit(1).alias("price"))
    return dedupe_exact(rows, id_col="link").select(F.col("seq").alias("listing_id"), "seq")


@register("criteria_reason", O.with_chain("SELECT search_id, listing_id, criteria_reason, distance_km FROM rep"))
def q_criteria_reason(spark, sf_dir):
    """The searches whose id is divisible by 20, against every kept listing."""
    return _p(spark, sf_dir).report(F.col("search_id") % 20 == 0).select("search_id", "listing_id", "criteria_reason", "distance_km")


# Searches with every kind of bound; some leave them unset and get the default, or none where there is none.
_BOUNDED = ("SELECT * EXCLUDE (beds_min), CASE WHEN search_id % 11 = 0 THEN 3 ELSE beds_min END AS beds_min, "
            "CASE WHEN search_id % 3 = 0 THEN CAST(beds_min + 2 AS INTEGER) END AS beds_max, CASE WHEN search_id % 4 = 0 THEN CAST(baths_min + 1 AS INTEGER) END AS baths_max, "
            "CASE WHEN search_id % 5 = 0 THEN CAST(800 + search_id % 7 * 50 AS INTEGER) END AS sqft_min, CASE WHEN search_id % 2 = 0 THEN CAST(1500 + search_id % 9 * 100 AS INTEGER) END AS sqft_max, "
            "CASE search_id % 6 WHEN 0 THEN [' house', 'CONDO'] WHEN 1 THEN ['Townhouse'] WHEN 2 THEN []::VARCHAR[] ELSE ['House', 'Townhouse', 'Duplex'] END AS property_types FROM srch")
_REASON_SQL = """SELECT search_id, reason, count(*) AS n FROM (SELECT s.search_id, CASE
  WHEN k.price < s.price_min THEN 'price below minimum' WHEN k.price > s.price_max THEN 'price above maximum'
  WHEN k.beds < s.beds_min THEN 'beds below minimum' WHEN k.beds > s.beds_max THEN 'beds above maximum'
  WHEN k.baths < s.baths_min THEN 'baths below minimum' WHEN k.baths > s.baths_max THEN 'baths above maximum'
  WHEN k.sqft < s.sqft_min THEN 'sqft below minimum' WHEN k.sqft > s.sqft_max THEN 'sqft above maximum'
  WHEN k.days_on_market > s.max_age_days THEN 'listed too long ago'
  WHEN len(s.property_types) > 0 AND k.property_type <> '' AND NOT list_contains([lower(trim(t)) for t in s.property_types], lower(trim(k.property_type))) THEN 'property type not allowed'
  WHEN """ + O.haversine("k.lat", "k.lon", "s.anchor_lat", "s.anchor_lon") + """ > s.geo_bound_km THEN 'beyond the distance bound' ELSE 'passed' END AS reason
FROM kept k CROSS JOIN bounded s) GROUP BY search_id, reason"""


def _bounded(searches: DataFrame) -> DataFrame:
    """The searches with every kind of bound, some of them null."""
    i = F.col("search_id")
    none = F.array().cast("array<string>")
    kinds = F.when(i % 6 == 0, F.array(F.lit(" house"), F.lit("CONDO"))).when(i % 6 == 1, F.array(F.lit("Townhouse"))).when(i % 6 == 2, none)
    return (searches.withColumn("beds_max", F.when(i % 3 == 0, F.col("beds_min") + 2)).withColumn("baths_max", F.when(i % 4 == 0, F.col("baths_min") + 1))
            .withColumn("sqft_min", F.when(i % 5 == 0, 800 + i % 7 * 50)).withColumn("sqft_max", F.when(i % 2 == 0, 1500 + i % 9 * 100))
            .withColumn("beds_min", F.when(i % 11 != 0, F.col("beds_min"))).withColumn("property_types", kinds))


@register("reason_counts", O.with_chain(f"SELECT * FROM (WITH bounded AS MATERIALIZED ({_BOUNDED}) {_REASON_SQL})"))
def q_reason_counts(spark, sf_dir):
    """How many kept listings fail first at each rule, for every search."""
    t = tables(spark, sf_dir)
    return Pipeline(t, searches=_bounded(t.v_search)).reason_counts()


@register("pass_reject_counts", O.with_chain(
    "SELECT s.search_id, count(p.listing_id) AS passed, (SELECT count(*) FROM kept) - count(p.listing_id) AS rejected "
    "FROM srch s LEFT JOIN passed p ON p.search_id = s.search_id GROUP BY s.search_id"))
def q_pass_reject(spark, sf_dir):
    return _p(spark, sf_dir).pass_counts()


@register("distance_km", O.with_chain("SELECT search_id, listing_id, distance_km FROM passed"))
def q_distance(spark, sf_dir):
    return _p(spark, sf_dir).matches().select("search_id", "listing_id", "distance_km")


@register("commute_cut", O.with_chain("SELECT search_id, listing_id, commute_min, commute_reason FROM enr"))
def q_commute_cut(spark, sf_dir):
    return _p(spark, sf_dir, CUT_COLS).enriched().select("search_id", "listing_id", "commute_min", "commute_reason")


@register("field_health", O.with_chain(
    "SELECT source, count(*) AS n, count(price) / count(*) AS price_share, count(lat) / count(*) AS lat_share, "
    "count(beds) / count(*) AS beds_share, (count(price) / count(*) < 0.5 OR count(lat) / count(*) < 0.5 "
    "OR count(beds) / count(*) < 0.5) AS unhealthy FROM v_listing GROUP BY source"))
def q_field_health(spark, sf_dir):
    return C.field_health(tables(spark, sf_dir).v_listing, "source")


# -- D: joins and geo enrichment ----------------------------------------------

@register("parcel_join", O.with_chain(
    "SELECT search_id, listing_id, address_key, assessed_value, assessment_ratio FROM par"))
def q_parcel_join(spark, sf_dir):
    p = _p(spark, sf_dir)
    return D.parcel_join(p.matches(), p.t.v_parcel).select("search_id", "listing_id", "address_key",
                                                          "assessed_value", "assessment_ratio")


@register("match_rate", O.with_chain(
    f"SELECT search_id, count(assessed_value) AS matched, count(*) AS total, "
    f"{O.rnd('count(assessed_value) / count(*) * 100', 1)} AS rate_pct, "
    f"count(assessed_value) / count(*) * 100 < 60 AS low_rate FROM par GROUP BY search_id"))
def q_match_rate(spark, sf_dir):
    p = _p(spark, sf_dir)
    return D.match_rate(D.parcel_join(p.matches(), p.t.v_parcel), ["search_id"])


@register("cohort_bbox", O.with_chain(
    "SELECT search_id, min(lat) - 0.02e0 AS south, min(lon) - 0.02e0 AS west, max(lat) + 0.02e0 AS north, "
    "max(lon) + 0.02e0 AS east FROM passed GROUP BY search_id"))
def q_cohort_bbox(spark, sf_dir):
    return D.cohort_bbox(_p(spark, sf_dir).matches(), ["search_id"])


@register("poi_in_bbox", O.with_chain(
    "SELECT b.search_id, p.poi_id, p.category FROM (SELECT search_id, min(lat) - 0.02e0 AS south, "
    "min(lon) - 0.02e0 AS west, max(lat) + 0.02e0 AS north, max(lon) + 0.02e0 AS east FROM passed "
    "GROUP BY search_id) b JOIN v_poi p ON p.lat BETWEEN b.south AND b.north AND p.lon BETWEEN b.west AND b.east"))
def q_poi_in_bbox(spark, sf_dir):
    p = _p(spark, sf_dir)
    boxes = D.cohort_bbox(p.matches(), ["search_id"])
    return D.poi_in_bbox(p.t.v_poi, boxes).select("search_id", "poi_id", "category")


@register("radius_counts", O.with_chain(
    "SELECT search_id, listing_id, " + ", ".join(f"{c}_n" for c in CATS) + " FROM rad"))
def q_radius_counts(spark, sf_dir):
    p = _p(spark, sf_dir, POINT_COLS)
    return D.radius_counts(p.passed(), p.t.v_poi).select("search_id", "listing_id", *[f"{c}_n" for c in CATS])


@register("nearby", O.with_chain(
    "SELECT q.point_id, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE p.category = '{c}') AS INTEGER) AS {c}_n" for c in CATS) +
    " FROM (SELECT poi_id AS point_id, lat, lon FROM v_poi) q JOIN v_poi p ON "
    "abs(q.lat - p.lat) <= 0.02e0 AND abs(q.lon - p.lon) <= 0.02e0 AND "
    + O.haversine("q.lat", "q.lon", "p.lat", "p.lon") + " <= 1e0 GROUP BY q.point_id"))
def q_nearby(spark, sf_dir):
    pois = tables(spark, sf_dir).v_poi
    pts = pois.select(F.col("poi_id").alias("point_id"), "lat", "lon")
    return D.nearby(pts, pois).select("point_id", *[f"{c}_n" for c in CATS])


@register("walk_proxy", O.with_chain("SELECT search_id, listing_id, walk_proxy FROM walk"))
def q_walk_proxy(spark, sf_dir):
    p = _p(spark, sf_dir, POINT_COLS)
    return D.with_walk_proxy(D.radius_counts(p.passed(), p.t.v_poi)).select("search_id", "listing_id", "walk_proxy")


@register("route_join", O.with_chain("SELECT search_id, listing_id, route_min FROM rt"))
def q_route_join(spark, sf_dir):
    p = _p(spark, sf_dir)
    return D.route_join(p.matches(), p.t.v_route).select("search_id", "listing_id", "route_min")


@register("route_fallback", O.with_chain("SELECT search_id, listing_id, commute_min, commute_estimated FROM enr0"))
def q_route_fallback(spark, sf_dir):
    p = _p(spark, sf_dir)
    return D.commute(p.matches(), p.t.v_route).select("search_id", "listing_id", "commute_min", "commute_estimated")


# -- E: scoring ---------------------------------------------------------------

@register("midrank_pct", O.with_chain("SELECT search_id, listing_id, " + ", ".join(RCOLS) + " FROM pr"))
def q_midrank(spark, sf_dir):
    return _p(spark, sf_dir, SCORED_COLS).scored().select("search_id", "listing_id", *RCOLS)


_CHANGED = ("SELECT * REPLACE (CASE WHEN search_id % 10 = 0 AND listing_id % 20 = 0 THEN price + 15000 ELSE price END AS price) FROM enr "
            "WHERE commute_reason IS NULL AND NOT (search_id % 10 = 0 AND listing_id % 33 = 0)")


@register("rescored", O.with_chain("SELECT search_id, listing_id, " + ", ".join(RCOLS) + ", score_value, score_location, score_freshness, score_total FROM scored WHERE search_id IN ("
                                   "SELECT search_id FROM enr WHERE commute_reason IS NULL AND search_id % 10 = 0 AND (listing_id % 20 = 0 OR listing_id % 33 = 0))")
          .replace("SELECT * FROM enr WHERE commute_reason IS NULL", _CHANGED))
def q_rescored(spark, sf_dir):
    """A stored score state, a change to some searches' listings, and the scores of those searches after it."""
    from cohortwise.operators.score import rescored, write_score_state
    from cohortwise.session import shared_path

    cohort, path = _p(spark, sf_dir, SCORED_COLS).analyzed(), shared_path(spark, "scores")
    write_score_state(cohort, path)
    some = cohort.where(F.col("search_id") % 10 == 0)
    dearer, left = F.col("listing_id") % 20 == 0, F.col("listing_id") % 33 == 0
    come = some.where(dearer & ~left).withColumn("price", F.col("price") + 15000)
    rows, _ = rescored(spark, path, some.where(dearer | left), come)
    return rows.select("search_id", "listing_id", *RCOLS, "score_value", "score_location", "score_freshness", "score_total")


@register("amenity_total", O.with_chain("SELECT search_id, listing_id, c_amenities AS amenity_total FROM comp"))
def q_amenity_total(spark, sf_dir):
    from cohortwise.operators.enrich import amenity_total_col
    return _p(spark, sf_dir, SCORED_COLS).analyzed().select("search_id", "listing_id", amenity_total_col().alias("amenity_total"))


@register("weighted_present", O.with_chain(
    "SELECT search_id, listing_id, score_value, score_location, score_freshness, data_completeness FROM scored"))
def q_weighted_present(spark, sf_dir):
    return _p(spark, sf_dir, SCORED_COLS).scored().select("search_id", "listing_id", "score_value", "score_location",
                                             "score_freshness", "data_completeness")


@register("missing_signals", O.with_chain(
    "SELECT search_id, listing_id, array_to_string(missing, ',') AS missing_signals FROM scored"))
def q_missing(spark, sf_dir):
    return _p(spark, sf_dir, SCORED_COLS).scored().select("search_id", "listing_id",
                                             F.array_join("missing", ",").alias("missing_signals"))


@register("cohort_scores", O.with_chain(
    "SELECT search_id, listing_id, score_value, score_location, score_freshness, score_total, data_completeness, "
    + ", ".join(PCOLS) + " FROM scored"))
def q_cohort_scores(spark, sf_dir):
    return _p(spark, sf_dir, SCORED_COLS).scored().select("search_id", "listing_id", "score_value", "score_location",
                                             "score_freshness", "score_total", "data_completeness", *PCOLS)


# -- G: rank, top-k -------------------------------------------------------------

@register("rank_assign", O.with_chain("SELECT search_id, listing_id, rank, cohort_size, score_total FROM ranked"))
def q_rank(spark, sf_dir):
    return _p(spark, sf_dir, SCORED_COLS).ranked().select("search_id", "listing_id", "rank", "cohort_size", "score_total")


@register("top_k", O.with_chain(
    "SELECT search_id, listing_id, score_total FROM ranked WHERE rank <= 10"))
def q_top_k(spark, sf_dir):
    return top_k(_p(spark, sf_dir, SCORED_COLS).scored(), 10).select("search_id", "listing_id", "score_total")


# -- I: explanation and report ------------------------------------------------

@register("explanations", O.with_chain(f"SELECT search_id, listing_id, rank, {O.explanation_sql()} AS explanation FROM ranked"))
def q_explanations(spark, sf_dir):
    return _p(spark, sf_dir).explained().select("search_id", "listing_id", "rank", "explanation")


@register("amenity_phrase", O.with_chain(f"SELECT search_id, listing_id, {O.amenity_phrase_sql()} AS amenity_phrase FROM rad"))
def q_amenity_phrase(spark, sf_dir):
    p = _p(spark, sf_dir, POINT_COLS)
    return D.radius_counts(p.passed(), p.t.v_poi).select("search_id", "listing_id",
                                                          amenity_phrase().alias("amenity_phrase"))


@register("report_rows", O.with_chain(f"SELECT {O.report_sql()} FROM ranked"))
def q_report_rows(spark, sf_dir):
    return report_rows(_p(spark, sf_dir).ranked())


# -- F: aggregations ----------------------------------------------------------

@register("cohort_summary", O.with_chain(
    f"SELECT search_id, count(*) AS cohort_size, {O.rnd('avg(data_completeness)', 1)} AS avg_completeness, "
    "count(*) < 10 AS small_cohort FROM scored GROUP BY search_id"))
def q_cohort_summary(spark, sf_dir):
    from cohortwise.operators.stats import cohort_summary
    return cohort_summary(_p(spark, sf_dir, SCORED_COLS).scored())


@register("cohort_size", O.with_chain(
    "SELECT search_id, count(score_total) AS cohort_size, count(score_total) FILTER (WHERE listing_id % 10 <> 0) AS ranked_size "
    "FROM scored GROUP BY search_id HAVING count(*) FILTER (WHERE listing_id % 10 <> 0) > 0"))
def q_cohort_size(spark, sf_dir):
    from cohortwise.operators.stats import cohort_count
    from cohortwise.session import stored
    # a tenth of the scored rows have been rejected since: they keep their score and still count
    stage = F.when(F.col("listing_id") % 10 == 0, F.lit("rejected")).otherwise(F.lit("ranked"))
    # both counts read the snapshot: written once, so that the cohorts are scored once
    snapshot = stored(_p(spark, sf_dir, SCORED_COLS).scored().select("search_id", "listing_id", "score_total", stage.alias("stage")))
    ranked = cohort_count(snapshot, True, ["search_id"]).withColumnRenamed("cohort_size", "ranked_size")
    return cohort_count(snapshot, False, ["search_id"]).join(ranked, "search_id")


@register("filter_funnel", O.with_chain(
    "SELECT s.search_id, (SELECT count(*) FROM lst) AS input, (SELECT count(*) FROM val WHERE invalid_reason IS NOT NULL) AS invalid, "
    "(SELECT count(*) FROM dups) AS duplicate, (SELECT count(*) FROM kept) - count(p.listing_id) AS off_criteria, "
    "count(p.listing_id) AS passed FROM srch s LEFT JOIN passed p ON p.search_id = s.search_id GROUP BY s.search_id"))
def q_filter_funnel(spark, sf_dir):
    from cohortwise.operators.stats import filter_funnel
    p = _p(spark, sf_dir)
    return filter_funnel(p.validated(), p.duplicates(), p.pass_counts())


# -- B: bulk field normalisation (v_raw) -----------------------------------------

from cohortwise.functions import text as TX  # noqa: E402
from cohortwise.functions.fmt import pyround  # noqa: E402
from cohortwise.functions.geo import geo_bucket  # noqa: E402

_RAW_PRICE = "regexp_replace(price_text, '[^0-9.]', '', 'g')"
_AGE_RE = r"'(?i)(\d+)\s*(hour|day|week|month|year)'"
_AGE_MAP = "MAP {'hour': 1e0 / 24e0, 'day': 1e0, 'week': 7e0, 'month': 30.44e0, 'year': 365.25e0}"


def _duck_age(t: str) -> str:
    cnt = f"TRY_CAST(regexp_extract({t}, {_AGE_RE}, 1) AS DOUBLE)"
    unit = f"lower(regexp_extract({t}, {_AGE_RE}, 2))"
    return (f"CASE WHEN regexp_full_match(trim({t}), '-?\\d+(\\.\\d+)?') THEN TRY_CAST(trunc(CAST(trim({t}) AS DOUBLE)) AS INTEGER) "
            f"WHEN regexp_matches({t}, {_AGE_RE}) THEN TRY_CAST({O.fixed(f'{cnt} * {_AGE_MAP}[{unit}]', 0)} AS INTEGER) END")


def _duck_bounded_age(t: str) -> str:
    return f"CASE WHEN abs({_duck_age(t)}) <= {TX.MAX_AGE_DAYS} THEN {_duck_age(t)} END"


_ISO_RE = (r"'\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?'")


def _duck_iso(t: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({t}), {_ISO_RE}) THEN TRY_CAST(substr(trim({t}), 1, 10) AS DATE) "
            f"WHEN regexp_full_match(trim({t}), '\\d{{8}}') THEN CAST(try_strptime(trim({t}), '%Y%m%d') AS DATE) END")


def _duck_parse_date(t: str) -> str:
    head = f"substr(trim({t}), 1, 10)"
    return (f"coalesce({_duck_iso(t)}, CAST(try_strptime({head}, '%Y-%m-%d') AS DATE), "
            f"CAST(try_strptime({head}, '%m/%d/%Y') AS DATE), CAST(try_strptime({head}, '%d/%m/%Y') AS DATE))")


@register("parse_price", O.with_chain(
    f"SELECT listing_id, CASE WHEN {_RAW_PRICE} = '' THEN NULL ELSE "
    f"CAST(trunc(TRY_CAST({_RAW_PRICE} AS DOUBLE)) AS BIGINT) END AS price FROM v_raw"))
def q_parse_price(spark, sf_dir):
    return tables(spark, sf_dir).v_raw.select("listing_id", TX.parse_price("price_text").alias("price"))


@register("parse_rooms", O.with_chain(
    r"SELECT listing_id, CASE WHEN len(regexp_extract_all(rooms_text, '\d+(?:\.\d+)?')) = 0 THEN NULL ELSE "
    r"list_reduce(list_transform(regexp_extract_all(rooms_text, '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE)), "
    r"lambda a, b: a + b) END AS rooms FROM v_raw"))
def q_parse_rooms(spark, sf_dir):
    return tables(spark, sf_dir).v_raw.select("listing_id", TX.parse_rooms("rooms_text").alias("rooms"))


_AREA_NUM = r"TRY_CAST(replace(regexp_extract(area_text, '([\d,]+(?:\.\d+)?)', 1), ',', '') AS DOUBLE)"
_AREA = (f"CASE WHEN lower(area_text) LIKE '%acre%' THEN {_AREA_NUM} * 43560e0 "
         f"WHEN lower(area_text) LIKE '%m2%' OR lower(area_text) LIKE '%sqm%' THEN {_AREA_NUM} * 10.7639e0 ELSE {_AREA_NUM} END")


@register("parse_area", O.with_chain(
    f"SELECT listing_id, CASE WHEN ({_AREA}) > 0 THEN TRY_CAST(trunc({_AREA}) AS BIGINT) END AS sqft FROM v_raw"))
def q_parse_area(spark, sf_dir):
    return tables(spark, sf_dir).v_raw.select("listing_id", TX.parse_area("area_text").alias("sqft"))


@register("parse_age", O.with_chain(f"SELECT listing_id, {_duck_age('age_text')} AS days_on_market FROM v_raw"))
def q_parse_age(spark, sf_dir):
    return tables(spark, sf_dir).v_raw.select("listing_id", TX.parse_age("age_text").alias("days_on_market"))


@register("list_date", O.with_chain(
    "SELECT listing_id, coalesce(CASE WHEN trim(date_text) <> '' THEN coalesce("
    "CASE WHEN regexp_full_match(trim(date_text), '\\d{10,}') THEN CAST(epoch_ms(CAST(substr(trim(date_text), 1, 10) AS BIGINT) * 1000) AS DATE) END, "
    f"{_duck_iso('date_text')}) END, DATE '2001-08-01' - {_duck_bounded_age('age_text')}) AS list_date FROM v_raw"))
def q_list_date(spark, sf_dir):
    from cohortwise.sources.tables import AS_OF
    return tables(spark, sf_dir).v_raw.select(
        "listing_id", TX.list_date([F.col("date_text")], F.col("age_text"), AS_OF).alias("list_date"))


@register("days_since", O.with_chain(
    f"SELECT listing_id, CAST(CASE WHEN date_diff('day', {_duck_parse_date('date_text')}, DATE '2001-08-01') < 0 THEN 0 "
    f"ELSE date_diff('day', {_duck_parse_date('date_text')}, DATE '2001-08-01') END AS INTEGER) AS days_since FROM v_raw"))
def q_days_since(spark, sf_dir):
    from cohortwise.sources.tables import AS_OF
    return tables(spark, sf_dir).v_raw.select("listing_id", TX.days_since(F.col("date_text"), AS_OF).alias("days_since"))


_PARTS = "list_filter(list_transform(string_split(split_part(address_text, '|', 1), ','), lambda p: trim(p)), lambda p: p <> '')"


@register("split_address", O.with_chain(
    f"SELECT listing_id, coalesce(({_PARTS})[1], '') AS street, coalesce(({_PARTS})[2], '') AS city, "
    f"CASE WHEN len({_PARTS}) > 2 THEN regexp_extract(upper(({_PARTS})[-1]), '[A-Z]\\d[A-Z]\\s*\\d[A-Z]\\d', 0) ELSE '' END "
    "AS postal_code FROM v_raw"))
def q_split_address(spark, sf_dir):
    a = TX.split_address("address_text")
    return tables(spark, sf_dir).v_raw.select("listing_id", a["street"].alias("street"), a["city"].alias("city"),
                                              a["postal_code"].alias("postal_code"))


SLUG_AREA = "Sample Town"


def _duck_slug(area: str) -> str:
    import re as _re
    drop = sorted({"canada", *TX.PROVINCE_ABBREV} | {w.lower() for w in _re.split(r"[\s,]+", area) if w})
    parts = "list_filter(string_split(slug, '-'), lambda p: p <> '')"
    last = f"coalesce(list_max(list_transform({parts}, lambda p, i: CASE WHEN lower(p) NOT IN {O._in(drop)} THEN i ELSE 0 END)), 0)"
    quads = O._in([q.upper() for q in TX.QUADRANT_ABBREV])
    return (f"array_to_string(list_transform(({parts})[1:{last}], lambda p: CASE WHEN upper(p) IN {quads} THEN upper(p) "
            f"ELSE upper(p[1]) || lower(p[2:]) END), ' ')")


@register("slug_address", O.with_chain(f"SELECT listing_id, {_duck_slug(SLUG_AREA)} AS address FROM v_raw"))
def q_slug_address(spark, sf_dir):
    return tables(spark, sf_dir).v_raw.select("listing_id", TX.slug_address("slug", SLUG_AREA).alias("address"))


@register("geo_bucket", O.with_chain(
    "SELECT listing_id, CAST(floor(lat * 1000 + 5e-1) AS BIGINT) AS geo_y, CAST(floor(lon * 1000 + 5e-1) AS BIGINT) AS geo_x FROM v_listing"))
def q_geo_bucket(spark, sf_dir):
    return tables(spark, sf_dir).v_listing.select("listing_id", geo_bucket("lat").alias("geo_y"), geo_bucket("lon").alias("geo_x"))


@register("price_ratios", O.with_chain(
    f"SELECT l.listing_id, CASE WHEN l.price > 0 AND l.sqft > 0 THEN {O.rnd('l.price / l.sqft', 4)} END AS price_per_sqft, "
    f"CASE WHEN l.price > 0 AND v.assessed_value > 0 THEN {O.rnd('l.price / v.assessed_value', 4)} END AS assessment_ratio "
    f"FROM {O.address_key_sql('v_listing')} l LEFT JOIN v_parcel v ON v.address_key = l.address_key AND l.address_key <> ''"))
def q_price_ratios(spark, sf_dir):
    t = tables(spark, sf_dir)
    j = D.parcel_join(t.v_listing, t.v_parcel)
    ok = (F.col("price") > 0) & (F.col("sqft") > 0)
    return j.select("listing_id", F.when(ok, pyround(F.col("price") / F.col("sqft"), 4)).alias("price_per_sqft"),
                    F.when(F.col("price") > 0, F.col("assessment_ratio")).alias("assessment_ratio"))


GEO_LOCALITY = "Sample Town"


def _duck_expand(col: str) -> str:
    w = f"string_split(trim(regexp_replace({col}, '\\s+', ' ', 'g')), ' ')"
    tail = f"(CASE WHEN lower(({w})[-1]) IN {O._in(TX.QUADRANT_ABBREV)} THEN len({w}) - 1 ELSE len({w}) END)"
    emap = O._map(TX.expansions())
    tr = (f"list_transform({w}, lambda x, i: CASE WHEN {tail} >= 2 AND i = {tail} AND {emap}[lower(x)] IS NOT NULL "
          f"THEN upper(({emap}[lower(x)])[1]) || ({emap}[lower(x)])[2:] ELSE x END)")
    return f"CASE WHEN {col} IS NULL OR len({w}) < 2 THEN {col} ELSE array_to_string({tr}, ' ') END"


_CANDS = (f"CASE WHEN ({_duck_expand('address')}) || ', {GEO_LOCALITY}' = address || ', {GEO_LOCALITY}' "
          f"THEN [address || ', {GEO_LOCALITY}'] ELSE [({_duck_expand('address')}) || ', {GEO_LOCALITY}', address || ', {GEO_LOCALITY}'] END")


@register("geocode_query", O.with_chain(
    f"SELECT listing_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS pos, unnest(c) AS query FROM "
    f"(SELECT listing_id, {_CANDS} AS c FROM v_listing WHERE lat IS NULL)"))
def q_geocode_query(spark, sf_dir):
    l = tables(spark, sf_dir).v_listing.where(F.col("lat").isNull())
    return l.select("listing_id", F.posexplode(TX.geocode_candidates("address", F.lit(GEO_LOCALITY))).alias("pos", "query"))


def _geocodes(t) -> DataFrame:
    """Geocoder cache derived from located listings: one point per address text."""
    return (t.v_listing.where(F.col("lat").isNotNull())
            .groupBy(F.concat_ws(", ", "address", F.lit(GEO_LOCALITY)).alias("query"))
            .agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")))


@register("geocode_join", O.with_chain(
    f"SELECT listing_id, lat, lon FROM v_listing WHERE lat IS NOT NULL UNION ALL "
    f"SELECT l.listing_id, coalesce(b.lat, l.lat) AS lat, coalesce(b.lon, l.lon) AS lon FROM v_listing l LEFT JOIN ("
    f"SELECT n.listing_id, arg_min(g.lat, n.pos) AS lat, arg_min(g.lon, n.pos) AS lon FROM "
    f"(SELECT listing_id, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS query FROM "
    f"(SELECT listing_id, {_CANDS} AS c FROM v_listing WHERE lat IS NULL)) n JOIN "
    f"(SELECT address || ', {GEO_LOCALITY}' AS query, min(lat) AS lat, min(lon) AS lon FROM v_listing WHERE lat IS NOT NULL GROUP BY 1) g "
    f"ON g.query = n.query GROUP BY n.listing_id) b ON b.listing_id = l.listing_id WHERE l.lat IS NULL"))
def q_geocode_join(spark, sf_dir):
    t = tables(spark, sf_dir)
    out = D.geocode_join(t.v_listing, _geocodes(t), TX.geocode_candidates("address", F.lit(GEO_LOCALITY)))
    return out.select("listing_id", "lat", "lon")


# -- D11/D12, A7, J: lookups and state ----------------------------------------------

@register("lookup_misses", O.with_chain(
    "SELECT DISTINCT CAST(floor(lat * 1000 + 5e-1) AS BIGINT) AS geo_y, CAST(floor(lon * 1000 + 5e-1) AS BIGINT) AS geo_x, "
    "commute_mode AS mode, anchor_lat, anchor_lon FROM passed p WHERE NOT EXISTS (SELECT 1 FROM v_route r WHERE "
    "r.geo_y = CAST(floor(p.lat * 1000 + 5e-1) AS BIGINT) AND r.geo_x = CAST(floor(p.lon * 1000 + 5e-1) AS BIGINT) "
    "AND r.mode = p.commute_mode AND r.anchor_lat = p.anchor_lat AND r.anchor_lon = p.anchor_lon)"))
def q_lookup_misses(spark, sf_dir):
    p = _p(spark, sf_dir)
    keys = p.matches().select(geo_bucket("lat").alias("geo_y"), geo_bucket("lon").alias("geo_x"),
                             F.col("commute_mode").alias("mode"), "anchor_lat", "anchor_lon")
    return D.lookup_misses(keys, p.t.v_route, ["geo_y", "geo_x", "mode", "anchor_lat", "anchor_lon"])


@register("lookup_merge", O.with_chain(
    "SELECT listing_id, arg_max(price, (seen_at, seq)) AS price, arg_max(source, (seen_at, seq)) AS source, "
    "max(seen_at) AS seen_at FROM v_sighting GROUP BY listing_id"))
def q_lookup_merge(spark, sf_dir):
    s = tables(spark, sf_dir).v_sighting
    fetched = s.where(F.col("source") != "view").select("listing_id", "price", "source", "seen_at", "seq")
    table = s.where(F.col("source") == "view").select("listing_id", "price", "source", "seen_at", "seq")
    return D.lookup_merge(table, fetched, ["listing_id"], ["seen_at", "seq"]).select("listing_id", "price", "source",
                                                                                      "seen_at")


@register("latest_per_id", O.with_chain(
    "SELECT listing_id, arg_max(seq, (seen_at, seq)) AS seq, max(seen_at) AS seen_at, "
    "arg_max(source, (seen_at, seq)) AS source, arg_max(price, (seen_at, seq)) AS price FROM v_sighting GROUP BY listing_id"))
def q_latest_per_id(spark, sf_dir):
    from cohortwise.sources.loads import latest_per_id
    return latest_per_id(tables(spark, sf_dir).v_sighting, "listing_id", ["seen_at", "seq"])


@register("upsert", O.with_chain(
    "SELECT listing_id, arg_max(source, (seen_at, seq)) AS source, arg_max(price, (seen_at, seq)) AS price, "
    "min(seen_at) AS first_seen, max(seen_at) AS last_seen, 'scraped' AS stage, CAST(NULL AS VARCHAR) AS reject_reason "
    "FROM v_sighting GROUP BY listing_id"))
def q_upsert(spark, sf_dir):
    from cohortwise.operators.state import upsert
    return upsert(tables(spark, sf_dir).v_sighting)


def _stages(p: Pipeline) -> DataFrame:
    from cohortwise.operators.state import stage_table
    return stage_table(p.validated(), p.duplicates(), p.enriched(), p.t.v_search)


_STAGE_SQL = (
    "SELECT CAST(NULL AS BIGINT) AS search_id, v.listing_id, 'rejected' AS stage, coalesce(v.invalid_reason, 'duplicate listing') AS reject_reason "
    "FROM val v WHERE v.invalid_reason IS NOT NULL OR v.listing_id IN (SELECT listing_id FROM dups) UNION ALL "
    "SELECT search_id, listing_id, CASE WHEN progress <> 'filtered' AND commute_reason IS NOT NULL THEN 'rejected' ELSE progress END, "
    "CASE WHEN progress <> 'filtered' THEN commute_reason END FROM enr")


@register("stage_assign", O.with_chain(_STAGE_SQL))
def q_stage_assign(spark, sf_dir):
    return _stages(_p(spark, sf_dir, CUT_COLS))


@register("stage_filter", O.with_chain(f"SELECT search_id, listing_id FROM ({_STAGE_SQL}) WHERE stage = 'ranked'"))
def q_stage_filter(spark, sf_dir):
    from cohortwise.operators.state import stage_filter
    return stage_filter(_stages(_p(spark, sf_dir, CUT_COLS)), "ranked").select("search_id", "listing_id")


@register("stage_counts", O.with_chain(
    f"SELECT search_id, stage, count(*) AS n FROM ({_STAGE_SQL}) WHERE search_id IS NOT NULL AND stage <> 'rejected' GROUP BY ALL "
    "UNION ALL SELECT search_id, 'total' AS stage, (SELECT count(*) FROM val) AS n FROM srch UNION ALL "
    "SELECT * FROM (SELECT s.search_id, 'rejected' AS stage, (SELECT count(*) FROM val) - count(l.listing_id) AS n "
    f"FROM srch s LEFT JOIN (SELECT * FROM ({_STAGE_SQL}) WHERE stage <> 'rejected') l ON l.search_id = s.search_id GROUP BY s.search_id) WHERE n > 0"))
def q_stage_counts(spark, sf_dir):
    from cohortwise.operators.stats import stage_counts
    p = _p(spark, sf_dir)
    return stage_counts(_stages(p), p.validated(), p.t.v_search)


@register("stage_reset", O.with_chain(
    f"SELECT search_id, count(*) FILTER (WHERE stage = 'ranked') AS moved, "
    f"count(*) FILTER (WHERE stage = 'ranked' OR stage = 'analyzed') AS analyzed_after FROM ({_STAGE_SQL}) WHERE search_id IS NOT NULL GROUP BY search_id"))
def q_stage_reset(spark, sf_dir):
    from cohortwise.operators.state import stage_reset
    st = _stages(_p(spark, sf_dir, CUT_COLS)).where(F.col("search_id").isNotNull())
    after = stage_reset(st.withColumn("_was", F.col("stage")), "ranked", "analyzed")
    return after.groupBy("search_id").agg(
        F.count_if((F.col("_was") == "ranked") & (F.col("stage") == "analyzed")).alias("moved"),
        F.count_if(F.col("stage") == "analyzed").alias("analyzed_after"))


@register("enrich_update", O.with_chain(
    "SELECT k.listing_id, k.search_id, w.walk_proxy AS walk_proxy, w.commute_min AS commute_min, "
    "k.price FROM passed k LEFT JOIN enr w ON w.search_id = k.search_id AND w.listing_id = k.listing_id"))
def q_enrich_update(spark, sf_dir):
    from cohortwise.operators.state import enrich_update
    p = _p(spark, sf_dir)
    base = p.passed().select("search_id", "listing_id", "price").withColumn("walk_proxy", F.lit(None).cast("double")) \
        .withColumn("commute_min", F.lit(None).cast("double"))
    upd = p.enriched().select(F.concat_ws(":", "search_id", "listing_id").alias("_key"), "walk_proxy", "commute_min")
    out = enrich_update(base.withColumn("_key", F.concat_ws(":", "search_id", "listing_id")), upd, "_key",
                        ["walk_proxy", "commute_min"])
    return out.select("listing_id", "search_id", "walk_proxy", "commute_min", "price")


# -- A8, A12, F: loads and aggregates ----------------------------------------------

_PARCEL_RAW_SQL = (
    "SELECT c_custkey, CAST(1 + c_custkey % 100000 AS VARCHAR) || ' ' || CASE c_custkey % 4 WHEN 0 THEN 'Market' "
    "WHEN 1 THEN 'Deer Lane' WHEN 2 THEN 'Harvest Grove' ELSE '5th' END || ' ' || CASE c_custkey % 3 WHEN 0 THEN 'Street' "
    "WHEN 1 THEN 'St.' ELSE 'ST' END || ' NW' AS address, CAST(c_acctbal * 100 AS VARCHAR) AS assessed_value, "
    "CAST(1995 + c_nationkey % 7 AS VARCHAR) AS roll_year FROM customer")


def _parcel_raw(t) -> DataFrame:
    c = t.customer
    street = F.concat(
        (1 + c.c_custkey % 100000).cast("string"), F.lit(" "),
        F.when(c.c_custkey % 4 == 0, "Market").when(c.c_custkey % 4 == 1, "Deer Lane")
         .when(c.c_custkey % 4 == 2, "Harvest Grove").otherwise("5th"), F.lit(" "),
        F.when(c.c_custkey % 3 == 0, "Street").when(c.c_custkey % 3 == 1, "St.").otherwise("ST"), F.lit(" NW"))
    return c.select("c_custkey", street.alias("address"), (c.c_acctbal * 100).cast("string").alias("assessed_value"),
                    (1995 + c.c_nationkey % 7).cast("string").alias("roll_year"))


@register("parcel_load", O.with_chain(
    f"SELECT address_key, arg_min(CAST(trunc(TRY_CAST(trim(assessed_value) AS DOUBLE)) AS BIGINT), c_custkey) AS assessed_value, "
    f"arg_min(coalesce(CAST(trunc(TRY_CAST(trim(roll_year) AS DOUBLE)) AS BIGINT), 0), c_custkey) AS roll_year "
    f"FROM {O.address_key_sql('(' + _PARCEL_RAW_SQL + ')')} WHERE trim(address) <> '' AND address_key <> '' "
    f"AND CAST(trunc(TRY_CAST(trim(assessed_value) AS DOUBLE)) AS BIGINT) > 0 GROUP BY address_key"))
def q_parcel_load(spark, sf_dir):
    from cohortwise.sources.loads import parcel_load
    return parcel_load(_parcel_raw(tables(spark, sf_dir)), ["c_custkey"])


@register("parcel_count", O.with_chain(
    f"SELECT count(*) AS parcels, max(roll_year) AS roll_year FROM (SELECT address_key, arg_min(coalesce(CAST(trunc(TRY_CAST(trim(roll_year) AS DOUBLE)) AS BIGINT), 0), c_custkey) AS roll_year "
    f"FROM {O.address_key_sql('(' + _PARCEL_RAW_SQL + ')')} WHERE trim(address) <> '' AND address_key <> '' "
    f"AND CAST(trunc(TRY_CAST(trim(assessed_value) AS DOUBLE)) AS BIGINT) > 0 GROUP BY address_key)"))
def q_parcel_count(spark, sf_dir):
    from cohortwise.operators.stats import parcel_count
    from cohortwise.sources.loads import parcel_load
    return parcel_count(parcel_load(_parcel_raw(tables(spark, sf_dir)), ["c_custkey"]), "roll_year")


_UNSET = {"price_min": 2, "price_max": 3, "beds_min": 5, "baths_min": 7, "max_commute_min": 4, "commute_mode": 6, "max_age_days": 9, "w_value": 8, "w_location": 8, "w_freshness": 8}
_SET_SQL = ", ".join(f"CASE WHEN search_id % {m} = 1 THEN {repr(C.SEARCH_DEFAULTS[c])} ELSE {c} END AS {c}" for c, m in _UNSET.items())


@register("search_defaults", O.with_chain(
    "SELECT *, max_commute_min / 60e0 * CASE WHEN commute_mode = 'driving' THEN 80e0 ELSE 40e0 END AS geo_bound_km FROM ("
    f"SELECT search_id, {_SET_SQL} FROM v_search)").replace("0.34", "0.34e0").replace("0.33 ", "0.33e0 "))
def q_search_defaults(spark, sf_dir):
    """Searches that leave criteria unset, with the defaults and the distance bound that follows."""
    s = tables(spark, sf_dir).v_search
    for c, m in _UNSET.items():
        s = s.withColumn(c, F.when(F.col("search_id") % m != 1, F.col(c)))
    return C.complete_searches(C.with_defaults(s)).select("search_id", *_UNSET, "geo_bound_km")


@register("search_params", O.with_chain(
    "SELECT search_id, anchor_lat, anchor_lon, price_min, price_max, beds_min, baths_min, max_commute_min, commute_mode, max_age_days, "
    + ", ".join(f"CASE WHEN w_value + w_location + w_freshness <= 0 THEN 1e0 / 3 ELSE {w} / (w_value + w_location + w_freshness) END AS {w}"
                for w in ("w_value", "w_location", "w_freshness")) + ", max_commute_min / 60e0 * CASE WHEN commute_mode = 'driving' "
    "THEN 80e0 ELSE 40e0 END AS geo_bound_km FROM v_search"))
def q_search_params(spark, sf_dir):
    from cohortwise.sources.loads import search_params
    return search_params(tables(spark, sf_dir).v_search).select(
        "search_id", "anchor_lat", "anchor_lon", "price_min", "price_max", "beds_min", "baths_min", "max_commute_min",
        "commute_mode", "max_age_days", "w_value", "w_location", "w_freshness", "geo_bound_km")


@register("poi_totals", O.with_chain("SELECT category, count(*) AS n FROM v_poi GROUP BY category"))
def q_poi_totals(spark, sf_dir):
    from cohortwise.operators.stats import poi_totals
    return poi_totals(tables(spark, sf_dir).v_poi)


# -- A1/A2: portal payload scan ---------------------------------------------------

def _duck_portal() -> str:
    """Flat-view rendering of the portal scan: each field parsed from v_raw directly."""
    price1 = f"CASE WHEN {_RAW_PRICE} = '' THEN NULL ELSE CAST(trunc(TRY_CAST({_RAW_PRICE} AS DOUBLE)) AS BIGINT) END"
    rooms = (r"CASE WHEN len(regexp_extract_all(rooms_text, '\d+(?:\.\d+)?')) = 0 THEN NULL ELSE "
             r"list_reduce(list_transform(regexp_extract_all(rooms_text, '\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE)), "
             r"lambda a, b: a + b) END")
    ld = ("coalesce(CASE WHEN trim(date_text) <> '' THEN coalesce(CASE WHEN regexp_full_match(trim(date_text), '\\d{10,}') "
          "THEN CAST(epoch_ms(CAST(substr(trim(date_text), 1, 10) AS BIGINT) * 1000) AS DATE) END, "
          f"{_duck_iso('date_text')}) END, DATE '2001-08-01' - {_duck_bounded_age('age_text')})")
    return (f"SELECT CASE WHEN listing_id % 13 <> 0 THEN 'M' || CAST(listing_id AS VARCHAR) ELSE CAST(listing_id AS VARCHAR) END AS listing_id, "
            f"'https://portal.example/real-estate/' || CAST(listing_id AS VARCHAR) || '/' || slug AS url, "
            f"coalesce(({_PARTS})[1], '') AS address, coalesce({price1}, listing_id * 1000) AS price, {rooms} AS beds, "
            f"CASE WHEN ({_AREA}) > 0 THEN TRY_CAST(trunc({_AREA}) AS BIGINT) END AS sqft, {ld} AS list_date, "
            f"{_duck_age('age_text')} AS days_on_market FROM v_raw")


@register("scan_portal", O.with_chain(_duck_portal()))
def q_scan_portal(spark, sf_dir):
    from cohortwise.sources.portal import PAGE_DDL, payload_from_raw, portal_listings
    pages = payload_from_raw(tables(spark, sf_dir).v_raw)
    parsed = pages.select("page", F.from_json("json", PAGE_DDL).alias("p")).select("page", "p.Results")
    return portal_listings(parsed, ["page"]).select("listing_id", "url", "address", "price", "beds", "sqft",
                                                    "list_date", "days_on_market")


@register("portal_files", O.with_chain(_duck_portal()))
def q_portal_files(spark, sf_dir):
    """A1 from files: the payload pages written as lines of text, read back in byte ranges and parsed."""
    from cohortwise.session import shared_path
    from cohortwise.sources.portal import payload_from_raw, portal_listings, read_portal_lines

    path = shared_path(spark, "payload")
    pages = payload_from_raw(tables(spark, sf_dir).v_raw)
    pages.select(F.regexp_replace("json", r"^\{", F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.lit(","))).alias("value")).write.text(path)
    rows = portal_listings(read_portal_lines(spark, path), ["page"])
    return rows.select("listing_id", "url", "address", "price", "beds", "sqft", "list_date", "days_on_market")


@register("source_union", O.with_chain(
    "SELECT CAST(listing_id AS VARCHAR) AS listing_id, source, price FROM v_listing UNION ALL "
    f"SELECT listing_id, 'portal' AS source, price FROM ({_duck_portal()})"))
def q_source_union(spark, sf_dir):
    rows, _status = _union(spark, sf_dir)
    return rows.drop("source_name")


def _union(spark, sf_dir):
    from cohortwise.sources.union import union_sources
    t = tables(spark, sf_dir)
    return union_sources({
        "listing_view": lambda: t.v_listing.select(F.col("listing_id").cast("string").alias("listing_id"),
                                                   "source", "price"),
        "portal": lambda: q_scan_portal(spark, sf_dir).select("listing_id", F.lit("portal").alias("source"), "price")})


@register("source_counts", O.with_chain(
    "SELECT 'listing_view' AS source_name, count(*) AS listings, 1 - 1 AS errors FROM v_listing UNION ALL "
    f"SELECT 'portal' AS source_name, count(*) AS listings, 1 - 1 AS errors FROM ({_duck_portal()})"))
def q_source_counts(spark, sf_dir):
    from cohortwise.operators.stats import source_counts
    rows, status = _union(spark, sf_dir)
    return source_counts(rows, status)


@register("source_failures", O.with_chain(
    "SELECT source AS source_name, CASE WHEN source = '5-LOW' THEN 0 ELSE count(*) END AS listings, CASE WHEN source = '5-LOW' THEN 1 ELSE 0 END AS errors "
    "FROM v_listing GROUP BY source UNION ALL SELECT 'payload', count(*) FILTER (WHERE listing_id % 9 <> 0), count(*) FILTER (WHERE listing_id % 9 = 0) FROM v_raw"))
def q_source_failures(spark, sf_dir):
    """Each source's listings in files of its own; one source has a spoiled file, and one writes text of which every ninth record is cut short."""
    from cohortwise.session import shared_path
    from cohortwise.sources.union import CORRUPT, read_sources, source_errors

    t = tables(spark, sf_dir)
    folder = shared_path(spark, "sources")
    listings = t.v_listing.select("listing_id", "source", "price")
    listings.write.partitionBy("source").parquet(folder)
    spoiled = "5-LOW"
    t.region.select(F.col("r_name").alias("value")).coalesce(1).write.mode("append").text(f"{folder}/source={spoiled}")
    record = F.to_json(F.struct("listing_id", "price_text"))
    cut = F.when(F.col("listing_id") % 9 == 0, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line"))
    t.v_raw.select("listing_id", record.alias("line")).select(cut.alias("value")).write.text(f"{folder}-text")
    names = [r.source for r in t.v_listing.select("source").distinct().collect()]  # a row for each source

    def portal(name):
        return lambda: spark.read.schema("listing_id bigint, price bigint").parquet(f"{folder}/source={name}")
    sources = {n: portal(n) for n in names}
    sources["payload"] = lambda: spark.read.schema(f"listing_id bigint, price_text string, {CORRUPT} string").json(f"{folder}-text")
    return source_errors(read_sources(sources)[1])


@register("stream_upsert", REGISTRY["upsert"][1])
def q_stream_upsert(spark, sf_dir):
    """K1/K2: the sightings as files, streamed a few at a time into the snapshot; then some of them once more, which changes nothing."""
    from cohortwise.session import shared_path
    from cohortwise.streaming.ingest import latest_snapshot, run_sightings, snapshot_upsert

    folder, root = shared_path(spark, "sightings"), shared_path(spark, "snapshot")
    sightings = tables(spark, sf_dir).v_sighting.select("listing_id", F.col("seen_at").alias("at"), "seq", "source", "price")
    sightings.withColumn("piece", F.pmod(F.col("seq"), F.lit(4))).repartition(4, "piece").drop("piece").write.parquet(folder)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sightings.schema)
    order, cols = ("at", "seq"), ("source", "price")
    run_sightings(spark, folder, root, f"{folder}-progress", schema, 2, order, cols)
    snapshot_upsert(spark.read.schema(schema).parquet(folder).where(F.pmod(F.col("seq"), F.lit(4)) == 0), 0, root, source_cols=cols, order_cols=order, seen_col="at")
    return latest_snapshot(spark, root, order).select("listing_id", *cols, "first_seen", "last_seen", "stage", "reject_reason")


@register("ranked_readback", O.with_chain("SELECT search_id, listing_id, rank, score_total FROM ranked WHERE rank <= 5"))
def q_ranked_readback(spark, sf_dir):
    """Every search's ranking written in bands, and the first five read back."""
    from cohortwise.session import shared_path
    from cohortwise.sources.sinks import read_top, write_ranked_bands

    path = shared_path(spark, "ranked")
    write_ranked_bands(_p(spark, sf_dir).ranked().select("search_id", "listing_id", "rank", "score_total"), path)
    return read_top(spark, path, 5)


@register("raw_replay", O.with_chain(
    f"SELECT listing_id, price, beds, address FROM ({_duck_portal()}) WHERE (CAST(regexp_extract(listing_id, '[0-9]+') AS BIGINT) // 1000) % 2 = 1"))
def q_raw_replay(spark, sf_dir):
    """Payloads retained on two days, and those of the second parsed again."""
    from cohortwise.session import shared_path
    from cohortwise.sources.portal import PAGE_DDL, payload_from_raw, portal_listings
    from cohortwise.sources.sinks import read_raw, retain_raw

    path = shared_path(spark, "raw")
    raw = tables(spark, sf_dir).v_raw
    days = [("2001-07-30", "parsed"), ("2001-07-31", "failed")]
    for part, (day, _) in enumerate(days):
        retain_raw(payload_from_raw(raw.where(F.floor(F.col("listing_id") / 1000) % 2 == part)), path, day)
    table = spark.createDataFrame(days, "day string, state string").select(F.to_date("day").alias("ingest_date"), "state")
    again = read_raw(spark, path, table.where("state = 'failed'"))
    pages = again.select("page", F.from_json("json", PAGE_DDL).alias("p")).select("page", "p.Results")
    return portal_listings(pages, ["page"]).select("listing_id", "price", "beds", "address")


# -- A4/A6/A9/A10: pages, link windows, POI tags, synthetic rows ---------------------

PAGE_LINK = r"(?<=\s)/([^\s/]+)"
_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
             ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"))


def _duck_page_text() -> str:
    t = "replace(replace(replace(replace(html, '=\r\n', ''), '=\n', ''), '=3D', '='), '&amp;', '&')"
    # Named references with ';', then the legacy ones HTML5 also accepts without
    # it (as html.unescape does); '&amp' last in each group.
    semi = _ENTITIES[1:] + _ENTITIES[:1]
    bare = [(e.rstrip(";"), c) for e, c in semi if e.rstrip(";")[1:] in ("lt", "gt", "quot", "nbsp", "copy", "middot", "amp")]
    for ent, ch in list(semi) + bare:
        t = f"replace({t}, {O._q(ent)}, {O._q(ch)})"
    anchor = r"""'<[aA]\b[^>]*?[hH][rR][eE][fF]\s*=\s*["'']([^"'']+)["''][^>]*>'"""
    t = f"regexp_replace({t}, {anchor}, ' \\1 ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    return f"regexp_replace({t}, '[ \t]+', ' ', 'g')"


def _page_text_df(spark, sf_dir):
    from cohortwise.sources.messages import decode
    pages = tables(spark, sf_dir).pages.select("page_id", F.encode("html", "UTF-8").alias("content"))
    return decode(pages, ["page_id"])


@register("page_text", O.with_chain(f"SELECT page_id, {_duck_page_text()} AS text FROM pages"))
def q_page_text(spark, sf_dir):
    return _page_text_df(spark, sf_dir).select("page_id", "text")


# Where each link starts: the lengths of the text between links add up.
_LINK_STARTS = (
    "SELECT page_id, text, unnest(ids) AS link_id, unnest(starts) AS start FROM (SELECT page_id, text, "
    "list_transform(list_filter(p, lambda x, i: i > 1), lambda x: regexp_extract(x, '^([^\\s/]+)', 1)) AS ids, "
    "list_transform(list_filter(p, lambda x, i: i > 1), lambda x, i: len(array_to_string(p[1:i], '/')) + 1) AS starts FROM "
    "(SELECT page_id, text, string_split(text, '/') AS p FROM (" + "{pages}" + ")))")
_WINDOWS = (
    "SELECT page_id, link_id, start, substr(text, start, 1400) AS win FROM (SELECT *, row_number() OVER (PARTITION BY page_id, link_id ORDER BY start) AS r FROM "
    "(SELECT * FROM (" + _LINK_STARTS + ") WHERE link_id <> '' AND start > 1 AND regexp_full_match(substr(text, start - 1, 1), '\\s'))) WHERE r = 1")


def _duck_windows() -> str:
    return _WINDOWS.replace("{pages}", f"SELECT page_id, {_duck_page_text()} AS text FROM pages")


@register("link_windows", O.with_chain(
    f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS INTEGER) AS pos, link_id, win AS window FROM ({_duck_windows()})"))
def q_link_windows(spark, sf_dir):
    from cohortwise.sources.messages import link_windows
    return link_windows(_page_text_df(spark, sf_dir), ["page_id"], PAGE_LINK)


# A message around each page: its headers, its body, and a few facts of a listing after every link of it.
def _page_messages(t) -> DataFrame:
    pid = F.col("page_id").cast("string")
    day = F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0")
    facts = F.concat(F.lit(" $"), (100 + F.col("page_id") % 900).cast("string"), F.lit(",000 "), (1 + F.col("page_id") % 5).cast("string"), F.lit(" + 1 bed "),
                     (1 + F.col("page_id") % 3).cast("string"), F.lit(".5 bath "), (900 + F.col("page_id") % 2000).cast("string"), F.lit(" sqft "),
                     F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("MLS# a"), F.lpad(pid, 7, "1"))).otherwise(F.lit("")))
    head = F.concat(F.lit("From: a@portal.example\r\nDate: "), day, F.lit(" Jul 2001 09:30:00 +0000\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    link = F.concat(F.lit("<a href='https://portal.example/real-estate/"), pid, F.lit("/12-oak-dr-nw-sampletown-ab'>x</a>"))
    return t.pages.select("page_id", F.encode(F.concat(head, link, facts, F.lit(" "), "html"), "UTF-8").alias("content"))


@register("message_fields", O.with_chain(
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'A' || lpad(CAST(page_id AS VARCHAR), 7, '1') ELSE 'RCA' || CAST(page_id AS VARCHAR) END AS listing_id, "
    "(100 + page_id % 900) * 1000 AS price, CAST(1 + page_id % 5 AS DOUBLE) + 1e0 AS beds, CAST(1 + page_id % 3 AS DOUBLE) + 5e-1 AS baths, "
    "900 + page_id % 2000 AS sqft, '12 Oak Dr NW' AS address, DATE '2001-07-01' + CAST(page_id % 28 AS INTEGER) AS list_date, "
    "'https://portal.example/real-estate/' || CAST(page_id AS VARCHAR) || '/12-oak-dr-nw-sampletown-ab' AS url FROM pages"))
def q_message_fields(spark, sf_dir):
    """A4/A5/B1/B2/B9/B10 on mail messages: one for each page, with its date and the facts after its link."""
    from cohortwise.sources.messages import decode, detail_link_pattern, link_windows, message_listings
    text = decode(_page_messages(tables(spark, sf_dir)), ["page_id"])
    pattern = detail_link_pattern()
    wins = link_windows(text, ["page_id", "sent_date"], pattern)
    wins = wins.withColumn("slug", F.regexp_extract("window", pattern, 2)).withColumn("url", F.regexp_extract("window", pattern, 0))
    rows = message_listings(wins, ["page_id", "sent_date"], "Sampletown, AB")
    return rows.select("page_id", "listing_id", "price", "beds", "baths", "sqft", "address", F.col("sent_date").alias("list_date"), "url")


@register("abs_url", O.with_chain(
    "SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN trim(h[i]) = '' THEN '' WHEN starts_with(trim(h[i]), 'http') THEN trim(h[i]) "
    "WHEN starts_with(trim(h[i]), '/') THEN base || trim(h[i]) ELSE base || '/' || trim(h[i]) END AS url FROM ("
    "SELECT page_id, base, h, unnest(range(1, len(h) + 1)) AS i FROM ("
    "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, "
    "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages))"))
def q_abs_url(spark, sf_dir):
    p = tables(spark, sf_dir).pages
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    ex = p.select("page_id", base.alias("base"),
                  F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "href"))
    return ex.select("page_id", "pos", TX.abs_url("href", F.col("base")).alias("url"))


@register("poi_tag", O.with_chain("SELECT poi_id, category, lat, lon FROM v_poi"))
def q_poi_tag(spark, sf_dir):
    from cohortwise.sources.pois import elements_from_pois, tag_pois
    return tag_pois(elements_from_pois(tables(spark, sf_dir).v_poi))


def _duck_draw(stream: int) -> str:
    return f"(('0x' || substr(md5(address_key || ':7:{stream}'), 1, 7))::BIGINT / 268435456e0)"


_SYNTH_SQL = (
    "SELECT 'SYN' || substr(md5(address_key || ':7:0'), 1, 15) AS listing_id, 'synthetic' AS source, address_key AS address, "
    "CASE WHEN i = 3 THEN NULL WHEN i = 4 THEN 0 ELSE CAST(floor(assessed_value * (0.86e0 + (1.18e0 - 0.86e0) * " + _duck_draw(1) + ") / 5000e0) * 5000 AS BIGINT) END AS price, "
    "CAST(2 + floor(" + _duck_draw(2) + " * 4) AS BIGINT) AS beds, CAST(1 + floor(" + _duck_draw(3) + " * 3) AS BIGINT) AS baths, "
    "CASE WHEN i < 3 THEN NULL WHEN i = 5 THEN 45 WHEN i = 6 THEN 99000 ELSE CAST(900 + floor(" + _duck_draw(4) + " * 2100) AS BIGINT) END AS sqft, "
    "CASE WHEN i = 7 THEN 'not a date' ELSE CAST(DATE '2001-08-01' - CAST(floor(" + _duck_draw(5) + " * 60) AS INTEGER) AS VARCHAR) END AS list_date, "
    "CASE WHEN i = 8 THEN NULL ELSE 51e0 + " + _duck_draw(6) + " * 0.2e0 END AS lat, -114.2e0 + " + _duck_draw(7) + " * 0.2e0 AS lon, i "
    "FROM (SELECT *, CAST(floor(" + _duck_draw(8) + " * 40) AS INTEGER) AS i FROM v_parcel)")


@register("synth_listings", O.with_chain(
    f"SELECT * EXCLUDE (i) FROM ({_SYNTH_SQL}) UNION ALL SELECT * EXCLUDE (i) REPLACE (listing_id || '-COPY' AS listing_id) FROM ({_SYNTH_SQL}) WHERE i = 9 AND price > 0"))
def q_synth(spark, sf_dir):
    from cohortwise.sources.synth import synth_listings
    return synth_listings(tables(spark, sf_dir).v_parcel)
