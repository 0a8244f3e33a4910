"""Map projections as column expressions (polar stereographic, azimuthal equal-area) and geodesic length."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from . import fixed
from .scalar import col, lon180


def _eccentricity(a: float, b: float) -> float:
    return math.sqrt(1 - (b / a) ** 2)


def _t(phi, e, lib):
    s = lib.sin(phi)
    return lib.tan(math.pi / 4 - phi / 2) / lib.pow((1 - e * s) / (1 + e * s), e / 2)


def stereographic_forward(lon, lat, a=fixed.GRID_SEMI_MAJOR_M, b=fixed.GRID_SEMI_MINOR_M, lon0=fixed.GRID_LON_0, true_lat=fixed.GRID_TRUE_SCALE_LAT) -> tuple[Column, Column]:
    """SCA-03: north polar stereographic on an ellipsoid, metres."""
    e, ts = _eccentricity(a, b), math.radians(true_lat)
    mc = math.cos(ts) / math.sqrt(1 - (e * math.sin(ts)) ** 2)
    scale = a * mc / _t(ts, e, math)
    rho = F.lit(scale) * _t(F.radians(col(lat)), e, F)
    d = F.radians(col(lon) - lon0)
    return rho * F.sin(d), -rho * F.cos(d)


def stereographic_inverse(x, y, a=fixed.GRID_SEMI_MAJOR_M, b=fixed.GRID_SEMI_MINOR_M, lon0=fixed.GRID_LON_0, true_lat=fixed.GRID_TRUE_SCALE_LAT) -> tuple[Column, Column]:
    """SCA-03: (lon, lat) of north polar stereographic metres, by the conformal-latitude series."""
    e, ts = _eccentricity(a, b), math.radians(true_lat)
    mc = math.cos(ts) / math.sqrt(1 - (e * math.sin(ts)) ** 2)
    t = F.hypot(col(x), col(y)) * F.lit(_t(ts, e, math) / (a * mc))
    chi = math.pi / 2 - 2 * F.atan(t)
    e2, e4, e6, e8 = (e ** k for k in (2, 4, 6, 8))
    terms = [
        (2, e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360),
        (4, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520),
        (6, 7 * e6 / 120 + 81 * e8 / 1120),
        (8, 4279 * e8 / 161280),
    ]
    phi = chi
    for k, c in terms:
        phi = phi + F.lit(c) * F.sin(chi * k)
    return lon180(F.degrees(F.atan2(col(x), -col(y))) + lon0), F.degrees(phi)


def stereographic_inverse_sphere(x, y, radius_m: float, lon0=fixed.GRID_LON_0, true_lat=fixed.GRID_TRUE_SCALE_LAT) -> tuple[Column, Column]:
    """SCA-03: the spherical approximation used for coordinate checks."""
    s = math.sin(math.radians(true_lat))
    t = F.hypot(col(x), col(y)) * F.lit(math.sqrt((1 + s) / (1 - s)) / (2 * radius_m))
    return lon180(F.degrees(F.atan2(col(x), -col(y))) + lon0), F.degrees(math.pi / 2 - 2 * F.atan(t))


def equal_area_forward(lon, lat, a=fixed.WGS84_SEMI_MAJOR_M, f=fixed.WGS84_FLATTENING) -> tuple[Column, Column]:
    """TOP-05: north polar azimuthal equal-area on an ellipsoid, metres, central meridian 0."""
    e = math.sqrt(f * (2 - f))

    def q(s, lib):
        return (1 - e * e) * (s / (1 - e * e * s * s) - (1 / (2 * e)) * lib.log((1 - e * s) / (1 + e * s)))

    qp = q(1.0, math)
    rho = F.lit(a) * F.sqrt(F.greatest(F.lit(qp) - q(F.sin(F.radians(col(lat))), F), F.lit(0.0)))
    d = F.radians(col(lon))
    return rho * F.sin(d), -rho * F.cos(d)


def geodesic_metres(lon1, lat1, lon2, lat2, a=fixed.WGS84_SEMI_MAJOR_M, f=fixed.WGS84_FLATTENING) -> np.ndarray:
    """Inverse geodesic length on an ellipsoid, vectorised over arrays."""
    b = a * (1 - f)
    p1, p2 = np.radians(np.asarray(lat1, float)), np.radians(np.asarray(lat2, float))
    u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
    L = np.radians((np.asarray(lon2, float) - np.asarray(lon1, float) + 540) % 360 - 180)
    lam = L.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(np.cos(u2) * sl, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * cl)
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss > 0, np.cos(u1) * np.cos(u2) * sl / np.where(ss > 0, ss, 1), 0.0)
            ca2 = 1 - sa * sa
            c2m = np.where(ca2 > 1e-15, cs - 2 * np.sin(u1) * np.sin(u2) / np.where(ca2 > 1e-15, ca2, 1), 0.0)
            c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
            new = L + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
            done = np.nanmax(np.abs(new - lam), initial=0.0) < 1e-13
            lam = new
            if done:
                break
        k2 = ca2 * (a * a - b * b) / (b * b)
        big = 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2)))
        small = k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2)))
        ds = small * ss * (c2m + small / 4 * (cs * (2 * c2m**2 - 1) - small / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    return b * big * (sigma - ds)


@F.pandas_udf(DoubleType())
def geodesic_km(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """AGG-24: ellipsoidal distance for the few rows that need it (one per component)."""
    return pd.Series(geodesic_metres(lon1, lat1, lon2, lat2) / 1000.0)
