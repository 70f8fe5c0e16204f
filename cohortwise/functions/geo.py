"""Great-circle distance and coordinate buckets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): mean Earth radius in km.
EARTH_RADIUS_KM = 6371.0088
# Degrees of latitude per km on that sphere (one degree = 2*pi*R/360 km).
KM_PER_DEGREE = 2 * 3.141592653589793 * EARTH_RADIUS_KM / 360.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km, same operation order as the reference."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dphi = p2 - p1
    dlambda = F.radians(_c(lon2) - _c(lon1))
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlambda / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def geo_bucket(coord) -> Column:
    """Coordinate rounded to 3 decimals (~110 m) as an integer bucket."""
    return F.floor(_c(coord) * 1000 + F.lit(0.5)).cast("bigint")
