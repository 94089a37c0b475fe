"""Sun, moon and planets as closed-form Columns of a Julian day.

Angles are radians unless a name says degrees; longitudes count east.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

J2000 = 2451545.0
CENTURY = 36525.0
AU = 149597870700.0
RAD = math.pi / 180

#: Orbits by planet: a (AU), e, i, omega, Omega, M0 (degrees at 2000),
#: n (degrees a day), a(1 - e^2), Pi (degrees), diameter (m), obliquity (degrees).
PLANETS = ("mercury", "venus", "earth", "mars", "jupiter", "saturn", "uranus", "neptune", "pluto")
ORBITS = {
    "mercury": (0.38710, 0.20563, 7.005, 29.125, 48.331, 174.7948, 4.092317, 0.37073, 77.456, 4878000.0, 0.0351),
    "venus": (0.72333, 0.00677, 3.395, 54.884, 76.680, 50.4161, 1.602136, 0.72330, 131.564, 12104000.0, 2.6376),
    "earth": (1.00000, 0.01671, 0.000, 288.064, 174.873, 357.5291, 0.985608, 0.99972, 102.937, 12756000.0, 23.4393),
    "mars": (1.52368, 0.09340, 1.850, 286.502, 49.558, 19.3730, 0.524039, 1.51039, 336.060, 6794000.0, 25.1918),
    "jupiter": (5.20260, 0.04849, 1.303, 273.867, 100.464, 20.0202, 0.083056, 5.19037, 14.331, 142984000.0, 3.1189),
    "saturn": (9.55491, 0.05551, 2.489, 339.391, 113.666, 317.0207, 0.033371, 9.52547, 93.057, 120536000.0, 26.7285),
    "uranus": (19.21845, 0.04630, 0.773, 98.999, 74.006, 141.0498, 0.011698, 19.17725, 173.005, 51118000.0, 82.2298),
    "neptune": (30.11039, 0.00899, 1.770, 276.340, 131.784, 256.2250, 0.005965, 30.10796, 48.124, 49532000.0, 27.8477),
    "pluto": (39.543, 0.2490, 17.140, 113.768, 110.307, 14.8820, 0.003964, 37.09129, 224.075, 2370000.0, 119.6075),
}
#: Degrees of the sine series of true minus mean anomaly.
CENTRE = {
    "mercury": (23.4400, 2.9818, 0.5255, 0.1058, 0.0241, 0.0055),
    "venus": (0.7758, 0.0033),
    "earth": (1.9148, 0.0200, 0.0003),
    "mars": (10.6912, 0.6228, 0.0503, 0.0046, 0.0005),
    "jupiter": (5.5549, 0.1683, 0.0071, 0.0003),
    "saturn": (6.3585, 0.2204, 0.0106, 0.0006),
    "uranus": (5.3042, 0.1534, 0.0062, 0.0003),
    "neptune": (1.0302, 0.0058),
    "pluto": (28.3150, 4.3408, 0.9214, 0.2235, 0.0627, 0.0174),
}
#: Ecliptic longitude of the perihelion (degrees).
PERIHELION = {"mercury": 230.3265, "venus": 73.7576, "earth": 102.9373, "mars": 71.0041, "jupiter": 237.1015, "saturn": 99.4587, "uranus": 5.4634, "neptune": 182.2100, "pluto": 184.5484}
#: Solar time (days): a transit's offset, its two series, a solar day.
SOLAR_TIME = {
    "mercury": (45.3497, 11.4556, 0.0000, 175.9386),
    "venus": (52.1268, -0.2516, 0.0099, -116.7505),
    "earth": (0.0009, 0.0053, -0.0068, 1.0000000),
    "mars": (0.9047, 0.0305, -0.0082, 1.027491),
    "jupiter": (0.3345, 0.0064, 0.0000, 0.4135778),
    "saturn": (0.0766, 0.0078, -0.0040, 0.4440276),
    "uranus": (0.1260, -0.0106, 0.0850, -0.7183165),
    "neptune": (0.3841, 0.0019, -0.0066, 0.6712575),
    "pluto": (4.5635, -0.5024, 0.3429, 6.387672),
}
#: Series of the sun's hour angle at the horizon (degrees).
HORIZON = {
    "mercury": (0.035, 0.0, 0.0),
    "venus": (2.636, 0.001, 0.0),
    "earth": (22.137, 0.599, 0.016),
    "mars": (23.576, 0.733, 0.024),
    "jupiter": (3.116, 0.002, 0.0),
    "saturn": (24.800, 0.864, 0.032),
    "uranus": (28.680, -0.843, 8.722),
    "neptune": (26.668, 0.967, 0.039),
    "pluto": (38.648, 4.971, 1.864),
}
SUN_DIAMETER, MOON_DIAMETER = 1391400000.0, 3474200.0


def julian_day(ts: Column, timezone_hours: float = 0.0) -> Column:
    """Julian day (UTC) of a timestamp given in a zone's local time."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86400000000.0) + F.lit(2440587.5) - F.lit(timezone_hours / 24.0)


def centuries(jd: Column) -> Column:
    return (jd - J2000) / CENTURY


def _poly(t: Column, *c: float) -> Column:
    """c0 + c1 t + c2 t^2 ... by nested products."""
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = out * t + F.lit(k)
    return out


def obliquity(jd: Column, model: str = "aa2010") -> Column:
    """Mean obliquity of the earth's ecliptic: models de200, aa2010, laskar."""
    t = centuries(jd)
    if model == "de200":
        arc = _poly(t, 23 * 3600 + 26 * 60 + 21.448, -46.8150, -0.00059, 0.001813)
    elif model == "aa2010":
        arc = _poly(t, 23 * 3600 + 26 * 60 + 21.406, -46.836769, -0.0001831, 0.00200340, -5.76e-7, -4.34e-8)
    elif model == "laskar":  # in units of 10,000 years
        arc = _poly(t / 100, 23 * 3600 + 26 * 60 + 21.448, -4680.93, -1.55, 1999.25, -51.38, -249.67, -39.05, 7.12, 27.87, 5.79, 2.45)
    else:
        raise ValueError(f"unknown model {model}")
    return arc / 3600 * RAD


def sidereal_time(jd: Column) -> Column:
    """Earth rotation angle at the prime meridian, not reduced to one turn."""
    # fixed values
    return F.lit(2 * math.pi) * (F.lit(0.7790572732640) + F.lit(1.002737811911354) * (jd - J2000))


def declination(lam: Column, beta: Column, eps: Column) -> Column:
    return F.asin(F.sin(beta) * F.cos(eps) + F.cos(beta) * F.sin(eps) * F.sin(lam))


def right_ascension(lam: Column, beta: Column, eps: Column) -> Column:
    return F.atan2(F.sin(lam) * F.cos(eps) - F.tan(beta) * F.sin(eps), F.cos(lam))


def observed(lam: Column, beta: Column, jd: Column, longitude: float, latitude: float) -> tuple[Column, Column]:
    """Altitude and azimuth (0 south, growing to the west) of ecliptic coordinates."""
    eps = obliquity(jd)
    delta, alpha = declination(lam, beta, eps), right_ascension(lam, beta, eps)
    phi = latitude * RAD
    hour = sidereal_time(jd) + F.lit(longitude * RAD) - alpha
    h = F.asin(math.sin(phi) * F.sin(delta) + math.cos(phi) * F.cos(delta) * F.cos(hour))
    return h, F.atan2(F.sin(hour), F.cos(hour) * math.sin(phi) - F.tan(delta) * math.cos(phi))


def spherical(altitude: Column, azimuth: Column) -> tuple[Column, Column]:
    """phi and theta of a sky direction."""
    return azimuth, F.lit(math.pi / 2) - altitude


def mean_anomaly(planet: str, jd: Column) -> Column:
    o = ORBITS[planet]
    return F.lit(o[5] * RAD) + F.lit(o[6] * RAD) * (jd - J2000)


def true_anomaly(planet: str, m: Column) -> Column:
    """By the sine series of the equation of centre."""
    c = F.lit(0.0)
    for k, a in enumerate(CENTRE[planet]):
        c = c + F.lit(a) * F.sin(m * (k + 1))
    return m + c * RAD


def kepler_true_anomaly(m: Column, e: float, steps: int = 12) -> Column:
    """Exact true anomaly of an ellipse by Newton steps on Kepler's equation."""
    if e == 0:
        return m
    if not 0 < e < 1:
        raise ValueError("only ellipses")
    turn = F.lit(2 * math.pi)
    m = m - turn * F.round(m / turn)
    start = F.struct(m.alias("m"), (m + e * F.sin(m) * (1 + e * F.cos(m))).alias("x"))
    ecc = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: F.struct(s["m"].alias("m"), (s["x"] - (s["x"] - e * F.sin(s["x"]) - s["m"]) / (1 - e * F.cos(s["x"]))).alias("x")), lambda s: s["x"])
    return 2 * F.atan(math.sqrt((1 + e) / (1 - e)) * F.tan(ecc / 2))


def sun_distance(planet: str, v: Column) -> Column:
    o = ORBITS[planet]
    return F.lit(o[7]) / (1 + F.lit(o[1]) * F.cos(v))


def heliocentric(planet: str, jd: Column) -> tuple[Column, Column, Column]:
    """Right-handed ecliptic coordinates around the sun in AU."""
    o = ORBITS[planet]
    v = true_anomaly(planet, mean_anomaly(planet, jd))
    r = sun_distance(planet, v)
    i, w, node = o[2] * RAD, o[3] * RAD, o[4] * RAD
    cw, sw = F.cos(F.lit(w) + v), F.sin(F.lit(w) + v)
    return (
        r * (math.cos(node) * cw - math.sin(node) * math.cos(i) * sw),
        r * (math.sin(node) * cw + math.cos(node) * math.cos(i) * sw),
        r * (math.sin(i) * sw),
    )


def planet_position(planet: str, jd: Column, longitude: float, latitude: float) -> tuple[Column, Column, Column]:
    """phi, theta and distance (AU) seen from a place on earth."""
    x, y, z = (a - b for a, b in zip(heliocentric(planet, jd), heliocentric("earth", jd)))
    d = F.sqrt(x * x + y * y + z * z)
    h, a = observed(F.atan2(y, x), F.asin(z / d), jd, longitude, latitude)
    return (*spherical(h, a), d)


def sun_position(jd: Column, longitude: float, latitude: float) -> tuple[Column, Column, Column]:
    """As :func:`planet_position`, of the sun."""
    x, y, z = (-a for a in heliocentric("earth", jd))
    d = F.sqrt(x * x + y * y + z * z)
    h, a = observed(F.atan2(y, x), F.asin(z / d), jd, longitude, latitude)
    return (*spherical(h, a), d)


def solar_longitude(planet: str, jd: Column) -> Column:
    """Ecliptic longitude of the sun as a planet sees it (radians, not reduced)."""
    return true_anomaly(planet, mean_anomaly(planet, jd)) + (PERIHELION[planet] + 180) * RAD


def solar_transit(planet: str, jd: Column, longitude: float) -> Column:
    """Julian day of the sun's transit nearest to ``jd`` at an eastern longitude (degrees)."""
    offset, first, second, day = SOLAR_TIME[planet]
    turns = (jd - J2000 - F.lit(offset)) / F.lit(day) + longitude / 360
    near = jd + F.lit(day) * (F.round(turns) - turns)
    m = mean_anomaly(planet, near)
    return near + first * F.sin(m) + second * F.sin(2 * (m + (PERIHELION[planet] + 180) * RAD))


def horizon_hour_angle(planet: str, longitude_of_sun: Column, latitude: float) -> Column:
    """Hour angle (radians) at which the sun's centre meets the horizon, by the series in
    the sine of its ecliptic longitude; for latitudes where it does."""
    a, b, c = HORIZON[planet]
    s, t = F.sin(longitude_of_sun), math.tan(latitude * RAD)
    return (90 + a * s * t + b * F.pow(s, F.lit(3)) * t * (3 + t * t) + c * F.pow(s, F.lit(5)) * t * (15 + 10 * t * t + 3 * t**4)) * RAD


def moon_position(jd: Column, longitude: float, latitude: float) -> tuple[Column, Column, Column]:
    """phi, theta and distance (m), by one term of each published series."""
    t = jd - J2000
    # fixed values
    m = (F.lit(134.963) + t * 13.064993) * RAD
    lam = F.lit(218.316) + t * 13.176396 + 6.289 * F.sin(m)
    beta = 5.128 * F.sin((F.lit(93.272) + t * 13.229350) * RAD)
    h, a = observed(lam * RAD, beta * RAD, jd, longitude, latitude)
    return (*spherical(h, a), (F.lit(385001) - 20905 * F.cos(m)) * 1000)


def angular_diameter(diameter: float, distance: Column) -> Column:
    return 2 * F.atan(F.lit(0.5 * diameter) / distance)


def precession(jd: Column) -> dict[str, Column]:
    """Rows of the precession matrix from the mean equator of 2000 to that of
    the day (IAU 1976 angles), as m00 .. m22."""
    t = centuries(jd)
    zeta, z, theta = (_poly(t, 0.0, *c) / 3600 * RAD for c in ((2306.2181, 0.30188, 0.017998), (2306.2181, 1.09468, 0.018203), (2004.3109, -0.42665, -0.041833)))
    cz, sz, cc, sc, ct, st = F.cos(zeta), F.sin(zeta), F.cos(z), F.sin(z), F.cos(theta), F.sin(theta)
    rows = [[cz * ct * cc - sz * sc, -sz * ct * cc - cz * sc, -st * cc], [cz * ct * sc + sz * cc, -sz * ct * sc + cz * cc, -st * sc], [cz * st, -sz * st, ct]]
    return {f"m{i}{j}": rows[i][j] for i in range(3) for j in range(3)}


def planets_table(times: DataFrame, longitude: float, latitude: float, jd: str = "jd") -> DataFrame:
    """(.., planet, phi, theta, distance): a row for each row of ``times`` and planet but the earth.

    The eight orbits are a small table next to the times; every step is a
    column of its own, so that none is worked out more than once.
    """
    spark = times.sparkSession
    deepest = max(map(len, CENTRE.values()))
    rows = [(p, *(v * RAD for v in ORBITS[p][2:7]), ORBITS[p][1], ORBITS[p][7], [*CENTRE[p], *[0.0] * (deepest - len(CENTRE[p]))]) for p in PLANETS if p != "earth"]
    orbits = spark.createDataFrame(rows, "planet string, i double, w double, node double, m0 double, n double, e double, size double, centre array<double>")
    earth = {f"_e{k}": v for k, v in zip("xyz", heliocentric("earth", F.col(jd)))}
    d = times.withColumns(earth).withColumns({"_eps": obliquity(F.col(jd)), "_sid": sidereal_time(F.col(jd)) + longitude * RAD})
    d = d.crossJoin(F.broadcast(orbits)).withColumn("m", F.col("m0") + F.col("n") * (F.col(jd) - J2000))
    series = F.lit(0.0)
    for k in range(deepest):
        series = series + F.get("centre", F.lit(k)) * F.sin(F.col("m") * (k + 1))
    d = d.withColumn("v", F.col("m") + series * RAD)
    d = d.withColumns({"r": F.col("size") / (1 + F.col("e") * F.cos("v")), "cw": F.cos(F.col("w") + F.col("v")), "sw": F.sin(F.col("w") + F.col("v"))})
    r, cw, sw = F.col("r"), F.col("cw"), F.col("sw")
    node, i = F.col("node"), F.col("i")
    d = d.withColumns({
        "gx": r * (F.cos(node) * cw - F.sin(node) * F.cos(i) * sw) - F.col("_ex"),
        "gy": r * (F.sin(node) * cw + F.cos(node) * F.cos(i) * sw) - F.col("_ey"),
        "gz": r * F.sin(i) * sw - F.col("_ez"),
    })
    d = d.withColumn("distance", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2))
    d = d.withColumns({"lam": F.atan2("gy", "gx"), "beta": F.asin(F.col("gz") / F.col("distance"))})
    eps = F.col("_eps")
    d = d.withColumns({"delta": declination(F.col("lam"), F.col("beta"), eps), "hour": F.col("_sid") - right_ascension(F.col("lam"), F.col("beta"), eps)})
    s, c = math.sin(latitude * RAD), math.cos(latitude * RAD)
    phi = F.atan2(F.sin("hour"), F.cos("hour") * s - F.tan("delta") * c)
    theta = F.lit(math.pi / 2) - F.asin(s * F.sin("delta") + c * F.cos("delta") * F.cos("hour"))
    return d.select(*times.columns, "planet", phi.alias("phi"), theta.alias("theta"), "distance")
