"""Geodesy as column expressions: WGS84 longitudes and latitudes in degrees, lengths in metres."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS = 6371008.8
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
METRES_PER_DEGREE = 111320.0


def c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    a, b = F.radians(c(lat1)), F.radians(c(lat2))
    dlat, dlon = F.sin((b - a) / 2), F.sin(F.radians(c(lon2) - c(lon1)) / 2)
    h = dlat * dlat + F.cos(a) * F.cos(b) * dlon * dlon
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon2) - c(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def heading_delta(before, after) -> Column:
    """The turn between two headings, within (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - (c(after) - c(before)), F.lit(360.0))


def half_box(lat, distance: float) -> tuple[Column, Column]:
    """Half sides, in degrees of longitude and latitude, of the box whose corners lie `distance` away at 135 and 315 degrees.

    The ellipsoid's radii of curvature at the point stand in for the geodesic; at 100 m the corners differ from it by less than 1e-9 degrees.
    """
    e2, phi = WGS84_F * (2 - WGS84_F), F.radians(c(lat))
    w = 1 - e2 * F.sin(phi) * F.sin(phi)
    side = math.degrees(distance / math.sqrt(2))
    return F.lit(side) * F.sqrt(w) / (F.lit(WGS84_A) * F.cos(phi)), F.lit(side) * w * F.sqrt(w) / F.lit(WGS84_A * (1 - e2))


def along(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    """Planar fraction, 0 to 1, of a point's projection on a line; null for a line of no length."""
    dx, dy = c(lon2) - c(lon1), c(lat2) - c(lat1)
    square = dx * dx + dy * dy
    return F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c(lon) - c(lon1)) * dx + (c(lat) - c(lat1)) * dy) / square)))


def _shares(f: Column, d: Column) -> tuple[Column, Column]:
    """Weights of both ends of an arc of d radians for the point at a fraction of it."""
    return F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)


def _vector(p: Column, q: Column, lon1, lat1, lon2, lat2) -> tuple[Column, Column, Column]:
    a, b, x, y = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lon1)), F.radians(c(lon2))
    return p * F.cos(a) * F.cos(x) + q * F.cos(b) * F.cos(y), p * F.cos(a) * F.sin(x) + q * F.cos(b) * F.sin(y), p * F.sin(a) + q * F.sin(b)


def _or_end(f: Column, d: Column, first, last, between: Column) -> Column:
    return F.when((d == 0) | (f == 0), c(first)).when(f == 1, c(last)).otherwise(F.degrees(between))


def interpolated(lon1, lat1, lon2, lat2, fraction) -> tuple[Column, Column]:
    """The point at a fraction of the great circle between two points.  For whole tables, with_interpolated() works out each step once."""
    d, f = haversine(lon1, lat1, lon2, lat2) / F.lit(EARTH_RADIUS), c(fraction)
    x, y, z = _vector(*_shares(f, d), lon1, lat1, lon2, lat2)
    return _or_end(f, d, lon1, lon2, F.atan2(y, x)), _or_end(f, d, lat1, lat2, F.atan2(z, F.sqrt(x * x + y * y)))


def with_interpolated(df: DataFrame, lon: str, lat: str, line: tuple[str, str, str, str], fraction: str) -> DataFrame:
    """df with interpolated() as columns lon and lat, in named steps: as one expression the branches would repeat them all."""
    f, d = F.col(fraction), F.col("_d")
    df = df.withColumn("_d", haversine(*line) / F.lit(EARTH_RADIUS))
    df = df.withColumns(dict(zip(("_p", "_q"), _shares(f, d), strict=True)))
    df = df.withColumns(dict(zip(("_x", "_y", "_z"), _vector(F.col("_p"), F.col("_q"), *line), strict=True)))
    x, y = F.col("_x"), F.col("_y")
    df = df.withColumns({lon: _or_end(f, d, line[0], line[2], F.atan2(y, x)), lat: _or_end(f, d, line[1], line[3], F.atan2(F.col("_z"), F.sqrt(x * x + y * y)))})
    return df.drop("_d", "_p", "_q", "_x", "_y", "_z")


def deviance(straight, route) -> Column:
    return F.when(c(route) <= 0, F.lit(1.0)).otherwise(c(straight) / c(route))


def padding(metres: float, mid_lat) -> tuple[Column, Column]:
    """A padding in degrees of longitude and latitude."""
    return F.lit(metres / METRES_PER_DEGREE) / F.greatest(F.cos(F.radians(c(mid_lat))), F.lit(1e-6)), F.lit(metres / METRES_PER_DEGREE)


def wkt_linestring(points: Column) -> Column:
    """array<struct<lon, lat>> to text."""
    return F.concat(F.lit("LINESTRING("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ","), F.lit(")"))


def from_wkt(text: Column) -> Column:
    body = F.regexp_extract(text, r"(?i)linestring\s*\(([^)]*)\)", 1)
    return F.transform(F.split(body, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("lon"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat")))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between places on the WGS84 ellipsoid, by Vincenty's inverse formula in Arrow batches; null for places nearly opposite, where it has no limit."""
    def run(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        a, f = 6378137.0, 1 / 298.257223563
        b, away = (1 - f) * a, np.radians((x2 - x1).to_numpy(float))
        u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(y.to_numpy(float)))) for y in (y1, y2))
        lam, done = away.copy(), np.zeros(len(away), bool)
        with np.errstate(all="ignore"):
            for _ in range(200):
                s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
                c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
                sigma = np.arctan2(s, c)
                alpha = np.where(s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / s)
                cos2 = 1 - alpha**2
                mid = np.where(cos2 < 1e-15, 0.0, c - 2 * np.sin(u1) * np.sin(u2) / cos2)
                k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
                new = away + (1 - k) * f * alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
                done = np.abs(new - lam) < 1e-12
                lam = new
                if done[~np.isnan(new)].all():
                    break
            u = cos2 * (a**2 - b**2) / b**2
            p = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
            q = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
            d = q * s * (mid + q / 4 * (c * (2 * mid**2 - 1) - q / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
            return pd.Series(np.where(done, b * p * (sigma - d), np.nan)).replace({np.nan: None}).astype("Float64")

    return F.pandas_udf(run, "double")(c(lon1).cast("double"), c(lat1).cast("double"), c(lon2).cast("double"), c(lat2).cast("double"))
