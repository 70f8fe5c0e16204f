"""Parcel join, cohort box, POI radius counts, walk proxy, travel times, lookups."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.fmt import pyround, rounded
from cohortwise.functions.geo import KM_PER_DEGREE, geo_bucket, haversine_km
from cohortwise.functions.text import is_blank
from cohortwise.operators.criteria import lon_cell, lon_cells
from cohortwise.operators.quality import with_address_key
from cohortwise.session import stored

# Fixed values (must equal the reference's).
CATEGORIES = ("schools", "cafes", "parks", "groceries", "transit")
BBOX_PAD_DEG = 0.02
RADIUS_KM = 1.0
# Walk proxy: category -> (weight, saturation count), in summation order.
WALK_WEIGHTS = (("groceries", 0.25, 3), ("cafes", 0.25, 12), ("transit", 0.20, 8),
                ("parks", 0.15, 5), ("schools", 0.15, 3))
FALLBACK_KMH = 42.0
TRANSIT_SPEED_FACTOR = 0.55
DETOUR_FACTOR = 1.3
LOW_MATCH_RATE_PCT = 60


# -- D1/D2 ------------------------------------------------------------------

def parcel_join(df: DataFrame, parcels: DataFrame) -> DataFrame:
    """Exact left join on the canonical address key; adds value and ratio.

    No broadcast hint: parcel tables grow with the area covered, so AQE picks
    broadcast or sort-merge from the measured size.
    """
    keyed = with_address_key(df)
    p = parcels.select("address_key", "assessed_value").where(F.col("address_key") != "")
    out = keyed.join(p, "address_key", "left")
    ok = (F.col("price").isNotNull() & (F.col("price") != 0) & F.col("assessed_value").isNotNull()
          & (F.col("assessed_value") > 0))
    return rounded(out, assessment_ratio=(F.when(ok, F.col("price") / F.col("assessed_value")), 4))


def match_rate(joined: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Matched, total, percent (1 dp) and a low-rate flag."""
    g = group_cols or []
    agg = joined.groupBy(*g).agg(F.count("assessed_value").alias("matched"), F.count(F.lit(1)).alias("total"))
    rate = F.col("matched") / F.col("total") * 100
    return (agg.withColumn("rate_pct", pyround(rate, 1))
            .withColumn("low_rate", rate < LOW_MATCH_RATE_PCT))


# -- D3/D4 ------------------------------------------------------------------

def cohort_bbox(cohort: DataFrame, group_cols: list[str]) -> DataFrame:
    """D3: padded box around each cohort's points (partial aggregates, one row per group)."""
    return (cohort.groupBy(*group_cols)
            .agg((F.min("lat") - BBOX_PAD_DEG).alias("south"), (F.min("lon") - BBOX_PAD_DEG).alias("west"),
                 (F.max("lat") + BBOX_PAD_DEG).alias("north"), (F.max("lon") + BBOX_PAD_DEG).alias("east"))
            .where(F.col("south").isNotNull() & F.col("west").isNotNull()))


BOX_CELL_DEG = 0.25


def poi_in_bbox(pois: DataFrame, boxes: DataFrame) -> DataFrame:
    """POIs inside each box: boxes exploded over the grid cells they touch, POIs in their own
    cell, so each pair meets once."""
    inside = ((F.col("p.lat") >= F.col("b.south")) & (F.col("p.lat") <= F.col("b.north"))
              & (F.col("p.lon") >= F.col("b.west")) & (F.col("p.lon") <= F.col("b.east")))

    def cell(c):
        return F.floor(F.col(c) / BOX_CELL_DEG).cast("bigint")
    b = (boxes.withColumn("_gy", F.explode(F.sequence(cell("south"), cell("north"))))
         .withColumn("_gx", F.explode(F.sequence(cell("west"), cell("east")))))
    p = pois.withColumn("_gy", cell("lat")).withColumn("_gx", cell("lon"))
    return p.alias("p").join(b.alias("b"), ["_gy", "_gx"]).where(inside).select("b.*", "p.*").drop("_gy", "_gx")


# -- D5/D6/D7 ---------------------------------------------------------------

def _cell_deg(radius_km: float) -> float:
    return radius_km / KM_PER_DEGREE * 1.01


#: Places that a point tests one by one in a cell; a cell with more is told apart by its quarters.
LEAF_PLACES = 64
#: Halvings of a cell of the radius at most: beyond them places lie within some metres.
MOST_LEVELS = 12


def _cell_classes(radius_km: float, box_deg: float | None) -> tuple[Column, Column]:
    """Whether the cell (_south, _west, _size) lies wholly within a point's disc (and box), and wholly outside.

    By the distances of its corners and of its nearest place, with room for
    the curvature of so small a cell; near the poles neither is claimed.
    """
    north, east = F.col("_south") + F.col("_size"), F.col("_west") + F.col("_size")
    plain = F.greatest(F.abs(F.col("_south")), F.abs(north)) < 85.0
    corners = [(F.col("_south"), F.col("_west")), (F.col("_south"), east), (north, F.col("_west")), (north, east)]
    farthest = F.greatest(*[haversine_km(F.col("lat"), F.col("lon"), a, b) for a, b in corners])
    # the point's longitude as near the cell's as it comes across the 180th meridian
    middle = F.col("_west") + F.col("_size") / 2
    lon = F.when(F.col("lon") - middle > 180.0, F.col("lon") - 360.0).when(F.col("lon") - middle < -180.0, F.col("lon") + 360.0).otherwise(F.col("lon"))
    nearest_lat = F.least(F.greatest(F.col("lat"), F.col("_south")), north)
    nearest_lon = F.least(F.greatest(lon, F.col("_west")), east)
    nearest = haversine_km(F.col("lat"), lon, nearest_lat, nearest_lon)
    inside = plain & (farthest <= radius_km * 0.999)
    if box_deg is not None:
        inside = inside & (F.greatest(F.abs(F.col("lat") - F.col("_south")), F.abs(F.col("lat") - north)) < box_deg) & (F.greatest(F.abs(lon - F.col("_west")), F.abs(lon - east)) < box_deg)
    return inside, plain & (nearest > radius_km * 1.001)


def poi_counts_at(points: DataFrame, pois: DataFrame, radius_km: float = RADIUS_KM, box_deg: float | None = None) -> DataFrame:
    """D5 core: for each distinct (lat, lon), the POIs of each category within ``radius_km``
    (and, with ``box_deg``, inside the point's own box of that half width).

    A grid-cell equi-join, not a theta join: each POI sits in one cell of
    ``radius`` degrees; each point is exploded over the cells its disc can
    touch (3 rows of latitude, and as many columns as its latitude needs,
    across the 180th meridian too). Both sides are pre-aggregated first --
    points to distinct coordinates, POIs to a coordinate with a count for each
    category -- so repeated places do not multiply the pairs.

    A cell with over ``LEAF_PLACES`` places is a quadtree node that holds its
    counts: a point whose disc holds the cell adds them, one whose disc misses
    it is done with it, and only points on whose edge it lies go on to its
    quarters, until few places are left to test. So a point in a dense centre
    tests places along its circle, not all of them. Returns (lat, lon,
    ``_h_<category>``) for points with at least one hit.
    """
    cell = _cell_deg(radius_km)
    names = [f"_w_{c}" for c in CATEGORIES]
    counts = [F.sum(F.when(F.col("category") == c, 1).otherwise(0)).cast("int").alias(f"_w_{c}") for c in CATEGORIES]
    pw = (pois.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
          .groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(*counts)
          .withColumn("_cy", F.floor(F.col("plat") / cell)).withColumn("_cx", lon_cell(F.col("plon"), cell)))
    q = points.select("lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct()
    reach_lat = F.least(F.abs(F.col("lat")) + F.lit(cell), F.lit(89.999999))
    dlon = F.least(F.lit(radius_km / KM_PER_DEGREE * 1.01) / F.cos(F.radians(reach_lat)), F.lit(180.0))
    cy = F.floor(F.col("lat") / cell)
    q = (q.withColumn("_cy", F.explode(F.sequence(cy - 1, cy + 1)))
          .withColumn("_cx", F.explode(lon_cells(F.col("lon"), dlon, cell))))
    # a distance is no shorter than its part along the meridian: a third of the pairs need no sines
    near = (F.abs(F.col("lat") - F.col("plat")) <= cell) & (haversine_km("lat", "lon", "plat", "plon") <= radius_km)
    if box_deg is not None:
        across = F.abs(F.col("lon") - F.col("plon"))
        near = near & (F.abs(F.col("lat") - F.col("plat")) <= box_deg) & (F.least(across, 360.0 - across) <= box_deg)
    inside, outside = _cell_classes(radius_km, box_deg)
    hits = []
    for level in range(MOST_LEVELS + 1):
        nodes = pw.groupBy("_cy", "_cx").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(w).alias(w) for w in names])
        dense = nodes.where(F.col("_n") > LEAF_PLACES).drop("_n")
        if level == MOST_LEVELS or dense.isEmpty():
            hits.append(q.join(pw, ["_cy", "_cx"]).where(near).select("lat", "lon", *names))
            break
        keys = dense.select("_cy", "_cx")
        hits.append(q.join(pw.join(keys, ["_cy", "_cx"], "left_anti"), ["_cy", "_cx"]).where(near).select("lat", "lon", *names))
        size = cell / 2 ** level
        met = (q.join(dense, ["_cy", "_cx"]).withColumn("_size", F.lit(size)).withColumn("_south", F.col("_cy") * size).withColumn("_west", F.col("_cx") * size - 180.0)
               .withColumn("_in", inside).where(~outside).select("lat", "lon", "_cy", "_cx", "_in", *names))
        met = stored(met)
        hits.append(met.where("_in").select("lat", "lon", *names))
        half = F.array(F.lit(0), F.lit(1))
        q = (met.where("not _in").select("lat", "lon", "_cy", "_cx").withColumn("_y", F.explode(half)).withColumn("_x", F.explode(half))
             .select("lat", "lon", (F.col("_cy") * 2 + F.col("_y")).alias("_cy"), (F.col("_cx") * 2 + F.col("_x")).alias("_cx")))
        pw = pw.join(keys, ["_cy", "_cx"], "left_semi").withColumn("_cy", F.floor(F.col("plat") / (size / 2))).withColumn("_cx", lon_cell(F.col("plon"), size / 2))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    return every.groupBy("lat", "lon").agg(*[F.sum(f"_w_{c}").cast("int").alias(f"_h_{c}") for c in CATEGORIES])


def radius_counts(df: DataFrame, pois: DataFrame, radius_km: float = RADIUS_KM,
                  categories: DataFrame | None = None, box_deg: float | None = None) -> DataFrame:
    """Add ``<category>_n`` columns: 0 when the category is available but nothing is near,
    null when it is unavailable (or the row has no coordinates).

    Availability comes from ``categories(category, available)`` when given (a
    category fetched successfully may hold no points), else from the POI
    table itself (a category with any point is available)."""
    wide = poi_counts_at(df, pois, radius_km, box_deg)
    # One scalar subquery: the set of available categories (at most the five known names).
    source = categories.where(F.col("available")) if categories is not None else pois
    present = source.where(F.col("category").isin(*CATEGORIES)).select(F.collect_set("category")).scalar()
    avail = {c: F.array_contains(present, c) for c in CATEGORIES}
    out = df.join(wide, ["lat", "lon"], "left")
    has_point = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    for c in CATEGORIES:
        out = out.withColumn(f"{c}_n", F.when(has_point & avail[c],
                                              F.coalesce(F.col(f"_h_{c}"), F.lit(0))).cast("int"))
    return out.drop(*[f"_h_{c}" for c in CATEGORIES])


def _walk_raw() -> Column:
    """Sum of weight x min(1, n/saturation), x100, 1 dp when rounded; null only when no counts at all."""
    total = F.lit(0.0)
    for c, w, sat in WALK_WEIGHTS:
        n = F.coalesce(F.col(f"{c}_n"), F.lit(0))
        total = total + F.lit(w) * F.least(F.lit(1.0), n / F.lit(float(sat)))
    none = F.coalesce(*[F.col(f"{c}_n") for c in CATEGORIES]).isNull()
    return F.when(~none, total * 100.0)


def walk_proxy_col() -> Column:
    """D7 as one expression."""
    return pyround(_walk_raw(), 1)


def with_walk_proxy(df: DataFrame) -> DataFrame:
    """D7 as a column of rows that have their counts."""
    return rounded(df, walk_proxy=(_walk_raw(), 1))


def amenity_total_col() -> Column:
    """Sum of known counts; null only when all five are null."""
    s = F.lit(0.0)
    for c in CATEGORIES:
        s = s + F.coalesce(F.col(f"{c}_n"), F.lit(0)).cast("double")
    return F.when(F.coalesce(*[F.col(f"{c}_n") for c in CATEGORIES]).isNotNull(), s)


# -- D8/D9 ------------------------------------------------------------------

def route_join(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Known travel minutes by (bucket, mode, anchor); driving only; 1 dp from seconds.

    An equi-join on all five key columns (the anchor is part of the key, so a
    moved anchor never serves stale times).
    """
    r = routes.select(F.col("geo_y").alias("_gy"), F.col("geo_x").alias("_gx"), F.col("mode").alias("commute_mode"),
                      F.col("anchor_lat"), F.col("anchor_lon"), F.col("seconds").alias("_route_s"))
    keyed = (df.withColumn("_gy", F.when(F.col("commute_mode") == "driving", geo_bucket("lat")))
             .withColumn("_gx", geo_bucket("lon")))
    out = keyed.join(r, ["_gy", "_gx", "commute_mode", "anchor_lat", "anchor_lon"], "left")
    return rounded(out, route_min=(F.col("_route_s") / 60.0, 1)).drop("_gy", "_gx", "_route_s")


def _estimate_raw() -> Column:
    """Straight-line km x detour / speed (transit slower), 1 dp when rounded."""
    kmh = F.when(F.col("commute_mode") == "transit", F.lit(FALLBACK_KMH * TRANSIT_SPEED_FACTOR)) \
        .otherwise(F.lit(FALLBACK_KMH))
    d = haversine_km("lat", "lon", "anchor_lat", "anchor_lon")
    return d * DETOUR_FACTOR / kmh * 60.0


def estimate_minutes_col() -> Column:
    """D9 as one expression."""
    return pyround(_estimate_raw(), 1)


def commute(df: DataFrame, routes: DataFrame) -> DataFrame:
    """D8 + D9: route minutes where known, else the flagged estimate."""
    out = route_join(df, routes)
    has_pt = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    out = rounded(out, _estimate=(_estimate_raw(), 1))
    return (out.withColumn("commute_min", F.when(has_pt, F.coalesce(F.col("route_min"), F.col("_estimate"))))
            .withColumn("commute_estimated", has_pt & F.col("route_min").isNull())
            .drop("route_min", "_estimate"))


# -- D10/D11/D12 ------------------------------------------------------------

def geocode_join(df: DataFrame, geocodes: DataFrame, candidates: Column) -> DataFrame:
    """Rows without coordinates take the first candidate query that resolves.

    Both coordinates come from the geocoder, so a row that had one is not left
    with a mixed point; what does not resolve stays as it is. Rows whose
    address is null or blank are not looked up.
    """
    need = df.where(F.col("lat").isNull() | F.col("lon").isNull())
    have = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    ex = need.where(~is_blank(F.coalesce("address", F.lit("")))).select("listing_id", F.posexplode(candidates).alias("_pos", "query"))
    g = geocodes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("query", F.col("lat").alias("_glat"), F.col("lon").alias("_glon"))
    best = (ex.join(g, "query").groupBy("listing_id")
            .agg(F.min_by(F.struct("_glat", "_glon"), F.col("_pos")).alias("_g")))
    fixed = (need.join(best, "listing_id", "left")
             .withColumn("lat", F.coalesce(F.col("_g._glat"), F.col("lat")))
             .withColumn("lon", F.coalesce(F.col("_g._glon"), F.col("lon"))).drop("_g"))
    return have.unionByName(fixed)


def lookup_misses(keys: DataFrame, table: DataFrame, key_cols: list[str]) -> DataFrame:
    """Distinct keys, with no null in any column, that are not yet in a lookup table (the external fetcher's work list)."""
    return keys.select(*key_cols).dropna().distinct() \
       .join(table.select(*key_cols), key_cols, "left_anti")


def lookup_merge(table: DataFrame, fetched: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Fold fetched rows into a lookup table; the newest row per key wins.

    ``max_by`` is a partial aggregate, so a key fetched many times is combined
    map-side instead of being gathered into one task.
    """
    both = table.unionByName(fetched, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key_cols]
    newest = both.groupBy(*key_cols).agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("_row"))
    return newest.select(*key_cols, *[F.col(f"_row.{c}").alias(c) for c in rest])


def nearby(points: DataFrame, pois: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """Radius counts for ad-hoc points, each with its own padded box."""
    return radius_counts(points.select("point_id", "lat", "lon"), pois, radius_km, box_deg=BBOX_PAD_DEG)
