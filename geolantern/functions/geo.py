"""Distances, radius predicates and coordinate encodings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    BANDS,
    COORD_DECIMALS,
    EARTH_RADIUS_M,
    METRES_PER_DEGREE,
    WGS84_A,
    WGS84_B,
    WGS84_F,
)
from .vectors import l2_normalize

VINCENTY_ROUNDS = 6


def metres_to_degrees(metres):
    """Planar radius in degrees; None, NULL and 0 mean no radius."""
    if isinstance(metres, Column):
        return F.when(metres != 0, metres / F.lit(METRES_PER_DEGREE))
    return float(metres) / METRES_PER_DEGREE if metres else None


def round_coord(coord) -> Column:
    """Coordinate as it appears in a query: eight decimals."""
    return F.round(coord, COORD_DECIMALS)


def planar_distance(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance in degrees; no wrap at the antimeridian."""
    dx, dy = F.col(lon1) - F.col(lon2), F.col(lat1) - F.col(lat2)
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres on the mean sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    half_dlat = F.sin((b - a) / 2)
    half_dlon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_dlat * half_dlat + F.cos(a) * F.cos(b) * half_dlon * half_dlon
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geodesic_numpy(lat1, lon1, lat2, lon2):
    """WGS84 spheroidal distance of NumPy arrays in metres (Vincenty's inverse formula).

    Near-antipodal pairs do not converge and are out of scope.
    """
    import numpy as np

    f = WGS84_F
    u1 = np.arctan((1 - f) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - f) * np.tan(np.radians(lat2)))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    diff = np.radians(lon2) - np.radians(lon1)
    lam = diff
    for _ in range(VINCENTY_ROUNDS):
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cs = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(ss, cs)
        sa = np.divide(c1 * c2 * sl, ss, out=np.zeros_like(ss), where=ss != 0)
        ca = 1 - sa * sa
        cm = np.where(ca == 0, 0.0, cs - 2 * s1 * s2 / np.where(ca == 0, 1.0, ca))
        k = f / 16 * ca * (4 + f * (4 - 3 * ca))
        lam = diff + (1 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
    us = ca * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    ka = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
    kb = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
    shift = kb * ss * (
        cm + kb / 4 * (cs * (2 * cm * cm - 1) - kb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))
    )
    return WGS84_B * ka * (sigma - shift)


def geo_distance(lat1, lon1, lat2, lon2) -> Column:
    """WGS84 spheroidal distance in metres, evaluated on Arrow batches.

    The iteration has no compact Column form: unrolled it is a plan of some forty
    projections that the optimizer cannot push filters through, and four times slower.
    """
    @F.pandas_udf(T.DoubleType())
    def distance(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        return pd.Series(geodesic_numpy(*[np.asarray(x, dtype="float64") for x in (a, b, c, d)]))

    # Marked so that a filter on the result does not compute it a second time.
    return distance.asNondeterministic()(lat1, lon1, lat2, lon2)


def with_geodesic(df: DataFrame, lat1, lon1, lat2, lon2, out: str = "distance") -> DataFrame:
    return df.withColumn(out, geo_distance(lat1, lon1, lat2, lon2))


def within_degrees(lat, lon, qlat, qlon, degrees) -> Column:
    """Planar radius predicate, inclusive. The box bounds let scans skip row groups."""
    deg = degrees if isinstance(degrees, Column) else F.lit(float(degrees))
    lat, lon, qlat, qlon = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (lat, lon, qlat, qlon))
    dx, dy = lon - qlon, lat - qlat
    return (
        lat.between(qlat - deg, qlat + deg)
        & lon.between(qlon - deg, qlon + deg)
        & (F.sqrt(dx * dx + dy * dy) <= deg)
    )


def bbox_stats(pois: DataFrame) -> DataFrame:
    """One row: extent, centre latitude, latitude range and scaled longitude range."""
    box = pois.agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lon").alias("west"), F.max("lon").alias("east"),
    )
    mid = (F.col("south") + F.col("north")) / 2
    return box.select(
        "south", "north", "west", "east", mid.alias("mean_lat"),
        (F.col("north") - F.col("south")).alias("lat_range"),
        ((F.col("east") - F.col("west")) * F.cos(F.radians(mid))).alias("lon_range"),
    )


def border_features(lat, lon, box: Column) -> Column:
    """[north, south, east, west] position relative to the borders of ``box``.

    The longitude offset is scaled by the latitude of the point, its range by the
    centre latitude. An extent of zero gives an offset of zero.
    """
    lat, lon = F.col(lat), F.col(lon)

    def share(offset, extent):
        return F.when(extent == 0, 0.0).otherwise(offset / extent)

    coslat = F.cos(F.radians(lat))
    return F.array(
        1 - share(lat - box["south"], box["lat_range"]),
        1 - share(box["north"] - lat, box["lat_range"]),
        1 - share(coslat * (lon - box["west"]), box["lon_range"]),
        1 - share(coslat * (box["east"] - lon), box["lon_range"]),
    )


def spatial_encode(points: DataFrame, pois: DataFrame, out: str = "spatial") -> DataFrame:
    """Add the unit border encoding of each point within the extent of ``pois``.

    The extent enters as a scalar subquery: one aggregate, no join.
    """
    box = bbox_stats(pois).select(F.struct("*").alias("box")).scalar()
    with_box = points.withColumn("_box", box)
    raw = with_box.withColumn(out, border_features("lat", "lon", F.col("_box"))).drop("_box")
    return raw.withColumn(out, l2_normalize(out))


def sinusoidal_features(lat, lon, bands=BANDS) -> Column:
    """[sin lon, cos lon, sin lat, cos lat] over all bands, angles in radians."""
    rlon, rlat = F.radians(lon), F.radians(lat)
    parts = [fn(angle * F.lit(band)) for angle in (rlon, rlat) for fn in (F.sin, F.cos) for band in bands]
    return F.array(*parts)
