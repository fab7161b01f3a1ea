"""Great-circle distances in kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Distance between two points in degrees; NULL if any coordinate is NULL."""
    phi1, lam1, phi2, lam2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    chord = F.pow(F.sin((phi2 - phi1) / 2), F.lit(2.0)) + F.cos(phi1) * F.cos(phi2) * F.pow(
        F.sin((lam2 - lam1) / 2), F.lit(2.0)
    )
    # least() would skip a NULL, so the rounding guard is written as a condition.
    bounded = F.when(chord > 1.0, F.lit(1.0)).otherwise(chord)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(bounded))


def nearest_km(lat, lon, points) -> Column:
    """Distance to the nearest of a configured list of (name, lat, lon) points."""
    each = [haversine_km(lat, lon, p_lat, p_lon) for _, p_lat, p_lon in points]
    return each[0] if len(each) == 1 else F.least(*each)


def nearest_point(lat, lon, points) -> Column:
    """Nearest point as struct(km, name); NULL if the position is unknown."""
    each = [
        F.struct(haversine_km(lat, lon, p_lat, p_lon).alias("km"), F.lit(name).alias("name"))
        for name, p_lat, p_lon in points
    ]
    best = each[0] if len(each) == 1 else F.least(*each)
    return F.when(_col(lat).isNotNull() & _col(lon).isNotNull(), best)
