"""Map projections in closed form (Snyder): WGS 84 to UTM and to polar stereographic, and back."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
K0 = 0.9996
_POLAR = {3413: (1, 70.0, -45.0), 3031: (-1, 71.0, 0.0)}


def _meridian(phi: Column) -> Column:
    e4, e6 = E2**2, E2**3
    return A * ((1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi) + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi))


def _utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    ep2 = E2 / (1 - E2)
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    t, c, a = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    x = K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120) + 500000.0
    y = K0 * (_meridian(phi) + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720))
    return x, y + (10000000.0 if south else 0.0)


def _from_utm(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    ep2, e1 = E2 / (1 - E2), (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = (y - (10000000.0 if south else 0.0)) / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    c, t = ep2 * F.pow(F.cos(p), 2), F.pow(F.tan(p), 2)
    w = 1 - E2 * F.pow(F.sin(p), 2)
    n, r = A / F.sqrt(w), A * (1 - E2) / F.pow(w, 1.5)
    d = (x - 500000.0) / (n * K0)
    lat = p - (n * F.tan(p) / r) * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p)
    return F.degrees(lon) + (6 * zone - 183), F.degrees(lat)


def _t(phi) -> Column:
    es = E * F.sin(phi)
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), E / 2)


def _scale(lat_ts: float) -> float:
    phi = math.radians(lat_ts)
    es = E * math.sin(phi)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (E / 2)
    return A * math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2) / t


def _polar(lon: Column, lat: Column, code: int) -> tuple[Column, Column]:
    sign, ts, lon0 = _POLAR[code]
    rho, lam = _scale(ts) * _t(F.radians(lat * sign)), F.radians(lon - lon0)
    return rho * F.sin(lam), -sign * rho * F.cos(lam)


def _from_polar(x: Column, y: Column, code: int) -> tuple[Column, Column]:
    sign, ts, lon0 = _POLAR[code]
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) / _scale(ts))
    e4, e6 = E2**2, E2**3
    phi = chi + (E2 / 2 + 5 * e4 / 24 + e6 / 12) * F.sin(2 * chi) + (7 * e4 / 48 + 29 * e6 / 240) * F.sin(4 * chi) + (7 * e6 / 120) * F.sin(6 * chi)
    return F.degrees(F.atan2(x, -sign * y)) + lon0, F.degrees(phi) * sign


def transform(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates in another system; geographic ones are (lon, lat). Codes: 4326, 326zz, 327zz, 3413, 3031."""
    if source == target:
        return x, y
    if source != 4326:
        if source in _POLAR:
            x, y = _from_polar(x, y, source)
        elif source // 100 in (326, 327):
            x, y = _from_utm(x, y, source % 100, source // 100 == 327)
        else:
            raise ValueError(f"EPSG {source}")
    if target == 4326:
        return x, y
    if target in _POLAR:
        return _polar(x, y, target)
    if target // 100 in (326, 327):
        return _utm(x, y, target % 100, target // 100 == 327)
    raise ValueError(f"EPSG {target}")


def transform_window(spark, window: tuple[float, float, float, float], source: int, target: int):
    """(ulx, uly, lrx, lry) of the box around the four transformed corners, as a one-row DataFrame."""
    ulx, uly, lrx, lry = window
    corners = spark.createDataFrame([(a, b) for a in (ulx, lrx) for b in (uly, lry)], "x double, y double")
    x, y = transform(F.col("x"), F.col("y"), source, target)
    return corners.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("ulx"), F.max("y").alias("uly"), F.max("x").alias("lrx"), F.min("y").alias("lry"))


def wkt_epsg(wkt: Column) -> Column:
    """The code of the outermost AUTHORITY or ID at the end of a WKT string."""
    return F.regexp_extract(wkt, r'(?:AUTHORITY\["EPSG",\s*"?|ID\["EPSG",\s*)(\d+)"?\]\s*\]\s*$', 1).cast("int")
