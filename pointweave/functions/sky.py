"""CIE standard sky luminance and view directions of sky images, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the CIE standard general sky by type 0..14: gradation a, b;
#: indicatrix c, d, e; turbidity Tv; zenith luminance A, A1, A2, B, C, D, E; Dv/Ev.
TYPES = (
    (4.0, -0.7, 0.0, -1.0, 0.0, 45.0, 0.0, 0.0, 0.0, 54.63, 1.0, 0.0, 0.0, 0.1),
    (4.0, -0.7, 2.0, -1.5, 0.15, 20.0, 0.0, 0.0, 0.0, 12.35, 3.68, 0.59, 50.47, 0.18),
    (1.1, -0.8, 0.0, -1.0, 0.0, 45.0, 0.0, 0.0, 0.0, 48.3, 1.0, 0.0, 0.0, 0.15),
    (1.1, -0.8, 2.0, -1.5, 0.15, 20.0, 0.0, 0.0, 0.0, 12.23, 3.57, 0.57, 44.27, 0.22),
    (0.0, -1.0, 0.0, -1.0, 0.0, 45.0, 0.0, 0.0, 0.0, 42.59, 1.0, 0.0, 0.0, 0.20),
    (0.0, -1.0, 2.0, -1.5, 0.15, 20.0, 0.0, 0.0, 0.0, 11.84, 3.53, 0.55, 38.78, 0.38),
    (0.0, -1.0, 5.0, -2.5, 0.3, 12.0, 13.27, 0.957, 1.790, 21.72, 4.52, 0.63, 34.56, 0.42),
    (0.0, -1.0, 10.0, -3.0, 0.45, 10.0, 10.33, 0.83, 2.03, 29.35, 4.94, 0.7, 30.41, 0.41),
    (-1.0, -0.55, 2.0, -1.5, 0.15, 12.0, 8.7, 0.6, 1.5, 10.34, 3.45, 0.5, 27.47, 0.40),
    (-1.0, -0.55, 5.0, -2.5, 0.3, 10.0, 8.28, 0.567, 2.610, 18.41, 4.27, 0.63, 24.04, 0.36),
    (-1.0, -0.55, 10.0, -3.0, 0.45, 4.0, 5.01, 1.44, -0.75, 24.41, 4.6, 0.72, 20.76, 0.23),
    (-1.0, -0.32, 10.0, -3.0, 0.45, 2.5, 3.3, 1.036, 0.710, 23.0, 4.43, 0.74, 18.52, 0.1),
    (-1.0, -0.32, 16.0, -3.0, 0.3, 4.5, 4.76, 1.244, -0.84, 27.45, 4.61, 0.76, 16.59, 0.28),
    (-1.0, -0.15, 16.0, -3.0, 0.3, 5.0, 4.86, 0.881, 0.453, 25.54, 4.4, 0.79, 14.56, 0.28),
    (-1.0, -0.15, 24.0, -2.8, 0.15, 4.0, 3.62, 0.418, 1.95, 28.08, 4.13, 0.79, 13.0, 0.3),
)
CLAMP = math.radians(10)


def sun_visible(sky_type: int) -> bool:
    return sky_type >= 6


def gradation(a: float, b: float, zenith: Column) -> Column:
    return 1 + a * F.exp(F.lit(b) / (F.abs(F.cos(zenith)) + 0.000001))


def indicatrix(c: float, d: float, e: float, chi: Column) -> Column:
    """Of the angle to the sun; its exponent takes that angle in degrees, as the reference does."""
    return 1 + c * (F.exp(d * F.degrees(chi)) - math.exp(d * math.pi / 2)) + e * F.cos(chi) * F.cos(chi)


def zenith_luminance(sky_type: int, sun_theta: Column, diffuse: float | None = None, total: float | None = None) -> Column:
    """In kcd/m2, from the type's tables or from measured illuminances (lx)."""
    _, _, _, _, _, tv, a, a1, a2, b, c, d, e, dv = TYPES[sky_type]
    gamma = F.lit(math.pi / 2) - F.greatest(F.lit(CLAMP), F.least(F.lit(math.pi - CLAMP), sun_theta))
    s, k = F.sin(gamma), F.cos(gamma)
    shape = F.pow(F.abs(s), F.lit(c)) / (F.pow(k, F.lit(d)) + 1e-6)
    if diffuse is not None and total is not None:
        ev = F.greatest(F.lit(0.00001), 133800 * s)
        m = 1 / (s + 0.50572 * F.pow(F.degrees(gamma) + 6.07995, F.lit(-1.6364)))
        turbid = -F.log(F.greatest(F.lit(1e-12), (total - diffuse) / ev)) * (9.9 + 0.043 * m) / m
        dull = (diffuse / ev) * (b * shape + e * s)
        clear = (a1 * turbid + a2) * s + 0.7 * (turbid + 1) * shape + 0.04 * turbid
        out = dull if sky_type <= 5 else F.when(turbid > 12, dull).otherwise(clear)
    else:
        out = dv * (b * shape + e * s) if sky_type <= 5 or tv > 12 else a * s + 0.7 * (tv + 1) * shape + 0.04 * tv
    return F.greatest(F.lit(0.0), out)


def luminance(sky_type: int, sun_theta: Column, zenith: Column, chi: Column, **measured: float) -> Column:
    """In cd/m2 in a direction at angle ``zenith`` from the zenith and ``chi`` from the sun."""
    a, b, c, d, e = TYPES[sky_type][:5]
    sun = F.greatest(F.lit(CLAMP), F.least(F.lit(math.pi - CLAMP), sun_theta))
    scale = gradation(a, b, zenith) * indicatrix(c, d, e, chi) / (gradation(a, b, F.lit(0.0)) * indicatrix(c, d, e, sun))
    return zenith_luminance(sky_type, sun_theta, **measured) * scale * 1000


def angle_between(theta_a: Column, phi_a: Column, theta_b: Column, phi_b: Column) -> Column:
    c = F.cos(theta_a) * F.cos(theta_b) + F.sin(theta_a) * F.sin(theta_b) * F.cos(phi_a - phi_b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def image_directions(spark: SparkSession, kind: str, width: int, height: int) -> DataFrame:
    """(face, px, py, theta, phi) for the pixels of a cylinder, dome or cube map."""
    px = spark.range(width).select(F.col("id").alias("px"))
    pixels = px.select("px", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("py"))
    u, v = (F.col("px") + 0.5) / width, (F.col("py") + 0.5) / height
    if kind == "cylinder":
        return pixels.select(F.lit(0).alias("face"), "px", "py", (v * math.pi).alias("theta"), (u * 2 * math.pi).alias("phi"))
    if kind == "dome":
        x, y = 2 * u - 1, 2 * v - 1
        r = F.sqrt(x * x + y * y)
        return pixels.where(r <= 1).select(F.lit(0).alias("face"), "px", "py", (r * math.pi / 2).alias("theta"), F.atan2(y, x).alias("phi"))
    if kind == "cube":
        x, y, one = 2 * u - 1, 1 - 2 * v, F.lit(1.0)
        faces = [(one, -x, y), (-one, x, y), (x, one, y), (-x, -one, y), (x, -y, one), (x, y, -one)]
        rows = F.explode(F.array(*(F.struct(F.lit(i).alias("face"), a.alias("x"), b.alias("y"), c.alias("z")) for i, (a, b, c) in enumerate(faces)))).alias("d")
        d = pixels.select("px", "py", rows)
        length = F.sqrt(F.col("d.x") ** 2 + F.col("d.y") ** 2 + F.col("d.z") ** 2)
        return d.select("d.face", "px", "py", F.acos(F.col("d.z") / length).alias("theta"), F.atan2("d.y", "d.x").alias("phi"))
    raise ValueError(f"unknown image {kind}")
