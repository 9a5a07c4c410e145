"""Distances and areas on the sphere and the spheroid, as column expressions (Vincenty: an Arrow function)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Radius of the sphere in metres; axes of the WGS84 spheroid.
EARTH_M = 6_371_000.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance; null where a coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2))
    return F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h))) * (2 * radius)  # least() would skip a null


def chord_to_arc_m(chord: Column, radius: float = EARTH_M) -> Column:
    """The arc over a chord of the unit sphere."""
    half = chord / 2
    return F.asin(F.when(half > 1, 1.0).otherwise(half)) * (2 * radius)


def degree_window(lat: Column, metres: Column | float, radius: float = EARTH_M) -> tuple[Column, Column]:
    """Half height and half width, in degrees, of the box around a cap; 360 wide where the cap holds a pole."""
    angle = (F.lit(metres) if isinstance(metres, (int, float)) else metres) / F.lit(radius)
    dlat = F.degrees(angle)
    ratio = F.sin(angle) / F.cos(F.radians(lat))
    return dlat, F.when((F.abs(lat) + dlat >= 90) | (ratio >= 1), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))


def valid_point(lat: Column, lon: Column) -> Column:
    """True for a place on Earth; false for null, NaN and impossible coordinates."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


@F.pandas_udf(T.DoubleType())
def geodesic_m(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Geodesic distance on WGS84 by Vincenty's inverse formula (1975).

    Null where a coordinate is missing; NaN for nearly antipodal points where the iteration doesn't settle.
    """
    for columns in batches:
        lat1, lon1, lat2, lon2 = (np.radians(c.to_numpy(dtype=float, na_value=np.nan)) for c in columns)
        yield pd.Series(_vincenty(lat1, lon1, lat2, lon2)).where(~np.isnan(lat1 + lon1 + lat2 + lon2), None)


def _vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(lat1)), np.arctan((1 - WGS84_F) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    span = lon2 - lon1
    lam, settled = span.copy(), np.zeros(len(span), bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, c1 * c2 * sl / sin_s)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a == 0, 0, cos_s - 2 * s1 * s2 / cos2_a)
            c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            following = span + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1)))
            settled = np.abs(following - lam) < 1e-12
            lam = following
            if settled.all():
                break
        u = cos2_a * (WGS84_A**2 - b**2) / b**2
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        delta = big_b * sin_s * (cos_m + big_b / 4 * (cos_s * (2 * cos_m**2 - 1) - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)))
        return np.where(settled, b * big_a * (sigma - delta), np.nan)


def ring_area_m2(ring: Column, radius: float = EARTH_M) -> Column:
    """Area of a ring of (x longitude, y latitude) on the sphere by the spherical excess of its edges."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, F.lit(2), n), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, after, lambda a, b: F.radians(b["x"] - a["x"]) * (2 + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"]))))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) * (radius**2 / 2)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule with half-open edges; the ring may or may not repeat its first point. Null or empty: false."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(n, F.lit(1))), F.slice(ring, 1, 1))
    crossed = F.filter(F.zip_with(ring, after, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])), lambda hit: hit)
    return F.coalesce((n > 2) & (F.pmod(F.size(crossed), F.lit(2)) == 1), F.lit(False))


METRES_PER_DEGREE = math.pi * EARTH_M / 180
