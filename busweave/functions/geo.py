"""Distances, bearings, projections and grid cells as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Mean earth radius in metres, WGS84 ellipsoid, UTM scale.
EARTH_RADIUS_M = 6371000.0
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, single: bool = False) -> Column:
    """Great-circle metres; ``single`` rounds to 32-bit floats as the stored match distances are."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        half_lon
    ) * F.sin(half_lon)
    metres = 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))
    return metres.cast("float") if single else metres


def haversine_km_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The kilometre form times 1000, kept in double precision."""
    return haversine_m(lat1, lon1, lat2, lon2) / 1000.0 * 1000.0


@F.pandas_udf(T.DoubleType())
def geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Ellipsoidal metres by Vincenty's inverse formula, a fixed number of rounds per batch."""
    b = WGS84_A * (1 - WGS84_F)
    u1 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1.to_numpy(float))))
    u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2.to_numpy(float))))
    span = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam = span.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(12):
            cross = np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam)
            sin_sigma = np.hypot(np.cos(u2) * np.sin(lam), cross)
            cos_sigma = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_sigma, cos_sigma)
            sin_alpha = np.where(sin_sigma == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_sigma)
            cos2_alpha = 1 - sin_alpha**2
            mid = np.where(cos2_alpha == 0, 0.0, cos_sigma - 2 * np.sin(u1) * np.sin(u2) / cos2_alpha)
            c = WGS84_F / 16 * cos2_alpha * (4 + WGS84_F * (4 - 3 * cos2_alpha))
            lam = span + (1 - c) * WGS84_F * sin_alpha * (
                sigma + c * sin_sigma * (mid + c * cos_sigma * (2 * mid**2 - 1))
            )
        u_sq = cos2_alpha * (WGS84_A**2 - b**2) / b**2
        big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
        big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
        shift = (
            big_b
            * sin_sigma
            * (
                mid
                + big_b
                / 4
                * (
                    cos_sigma * (2 * mid**2 - 1)
                    - big_b / 6 * mid * (4 * sin_sigma**2 - 3) * (4 * mid**2 - 3)
                )
            )
        )
    metres = np.where(sin_sigma == 0, 0.0, b * big_a * (sigma - shift))
    return pd.Series(metres)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Forward azimuth in [0, 360)."""
    turn = F.radians(lon2 - lon1)
    y = F.sin(turn) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def utm_to_latlon(x: Column, y: Column, zone: int = 25, south: bool = True) -> tuple[Column, Column]:
    """Inverse transverse Mercator (Krueger series); zero or missing input gives null."""
    n = WGS84_F / (2 - WGS84_F)
    rect = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    )
    xi = (y - (10_000_000.0 if south else 0.0)) / (UTM_K0 * rect)
    eta = (x - 500_000.0) / (UTM_K0 * rect)
    xi_p, eta_p = xi, eta
    for j, coefficient in enumerate(beta, start=1):
        xi_p = xi_p - coefficient * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_p = eta_p - coefficient * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    lat = chi
    for j, coefficient in enumerate(delta, start=1):
        lat = lat + coefficient * F.sin(2 * j * chi)
    lon = F.lit(float(zone * 6 - 183)) + F.degrees(F.atan2(F.sinh(eta_p), F.cos(xi_p)))
    known = (x != 0) & (y != 0)
    return F.when(known, F.degrees(lat)), F.when(known, lon)


def cell_index(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def cell_key(lat: Column, lon: Column, lat_digits: int = 4, lon_digits: int = 5) -> Column:
    """Cell of about a tenth of a degree: the first characters of both numbers as text."""
    return F.concat_ws(":", F.substring(lat.cast("string"), 1, lat_digits), F.substring(lon.cast("string"), 1, lon_digits))


def is_round_trip(start_end_m: Column, greatest_gap_m: Column) -> Column:
    return start_end_m <= greatest_gap_m


def shape_threshold_m(total_m: Column, points: Column, share: float = 0.09) -> Column:
    """Distance under which a ping counts as being at an end of the shape."""
    return F.floor(total_m / (points * share)).cast("int")


def off_shape(distance_m: Column, threshold_m: Column) -> Column:
    return distance_m > threshold_m


def shape_distance_m(distance: Column, unit_km: bool) -> Column:
    """Shape distances of one city come in kilometres."""
    return distance * 1000.0 if unit_km else distance


def length_coverage(distance_m: Column, trips: Column) -> Column:
    return distance_m * trips
