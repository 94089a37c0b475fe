"""Map projections and earth-centred coordinates as closed-form Columns (WGS84).

Codes: EPSG:4326 (longitude, latitude, height), EPSG:3857, EPSG:4978, and UTM
zones EPSG:326zz (north) and EPSG:327zz (south). Others are an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
RAD = math.pi / 180
K0 = 0.9996
#: Third flattening and the rectifying radius.
N = FLAT / (2 - FLAT)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Krueger series of the transverse Mercator projection to n^3.
ALPHA = (N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3, 13 / 48 * N**2 - 3 / 5 * N**3, 61 / 240 * N**3)
BETA = (N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3, 1 / 48 * N**2 + 1 / 15 * N**3, 17 / 480 * N**3)
DELTA = (2 * N - 2 / 3 * N**2 - 2 * N**3, 7 / 3 * N**2 - 8 / 5 * N**3, 56 / 15 * N**3)

Triple = tuple[Column, Column, Column]


def to_web_mercator(lon: Column, lat: Column, h: Column) -> Triple:
    return lon * (RAD * A), F.log(F.tan(F.lit(math.pi / 4) + lat * (RAD / 2))) * A, h


def from_web_mercator(x: Column, y: Column, h: Column) -> Triple:
    return x / (RAD * A), (2 * F.atan(F.exp(y / A)) - math.pi / 2) / RAD, h


def to_ecef(lon: Column, lat: Column, h: Column) -> Triple:
    s, c = F.sin(lat * RAD), F.cos(lat * RAD)
    n = A / F.sqrt(1 - E2 * s * s)
    return (n + h) * c * F.cos(lon * RAD), (n + h) * c * F.sin(lon * RAD), (n * (1 - E2) + h) * s


def from_ecef(x: Column, y: Column, z: Column) -> Triple:
    """Bowring's latitude, refined twice; below a micrometre near the surface."""
    p = F.sqrt(x * x + y * y)
    b = A * (1 - FLAT)
    u = F.atan2(z * A, p * b)
    for _ in range(2):
        lat = F.atan2(z + (E2 / (1 - E2)) * b * F.sin(u) ** 3, p - E2 * A * F.cos(u) ** 3)
        u = F.atan((1 - FLAT) * F.tan(lat))
    n = A / F.sqrt(1 - E2 * F.sin(lat) ** 2)
    h = p * F.cos(lat) + z * F.sin(lat) - A * A / n
    return F.atan2(y, x) / RAD, lat / RAD, h


def to_utm(lon: Column, lat: Column, h: Column, zone: int, south: bool) -> Triple:
    lam, phi = (lon - (zone * 6 - 183)) * RAD, lat * RAD
    k = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(phi)) - k * F.atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e, n = eta, xi
    for j, a in enumerate(ALPHA, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + K0 * RECTIFYING * e, (10000000.0 if south else 0.0) + K0 * RECTIFYING * n, h


def from_utm(x: Column, y: Column, h: Column, zone: int, south: bool) -> Triple:
    xi, eta = (y - (10000000.0 if south else 0.0)) / (K0 * RECTIFYING), (x - 500000) / (K0 * RECTIFYING)
    p, q = xi, eta
    for j, b in enumerate(BETA, 1):
        p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(p) / F.cosh(q))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.atan2(F.sinh(q), F.cos(p)) / RAD + (zone * 6 - 183), lat / RAD, h


def _code(code: str | int) -> int:
    text = str(code).upper().removeprefix("EPSG:")
    if not text.isdigit():
        raise ValueError(f"unknown coordinate system {code}")
    return int(text)


def transform(x: Column, y: Column, z: Column, source: str | int, target: str | int) -> Triple:
    """Coordinates of one system in another."""
    a, b = _code(source), _code(target)
    if a == b:
        return x, y, z
    to_degrees = {4326: lambda *p: p, 3857: from_web_mercator, 4978: from_ecef}
    from_degrees = {4326: lambda *p: p, 3857: to_web_mercator, 4978: to_ecef}
    for base, south in ((32600, False), (32700, True)):
        for code, table, f in ((a, to_degrees, from_utm), (b, from_degrees, to_utm)):
            if 1 <= code - base <= 60:
                table[code] = lambda p, q, r, f=f, zone=code - base, south=south: f(p, q, r, zone, south)
    if a not in to_degrees or b not in from_degrees:
        raise ValueError(f"unknown coordinate system {a if a not in to_degrees else b}")
    return from_degrees[b](*to_degrees[a](x, y, z))


def reproject(points: DataFrame, source: str | int, target: str | int) -> DataFrame:
    return points.withColumns(dict(zip("xyz", transform(F.col("x"), F.col("y"), F.col("z"), source, target))))
