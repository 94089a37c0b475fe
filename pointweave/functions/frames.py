"""Star frames: 3 x 3 rotations by Julian day, in NumPy over Arrow batches.

Chains of matrices blow up as expressions, so these run as one vectorised step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .astro import CENTURY, J2000, RAD

TURN = 1296000.0  # arc seconds
#: The leading terms of the IAU 1980 nutation series. Multiples of the
#: five arguments, then sine (1e-4 arc seconds, and its change a century), cosine likewise.
#: Callers with the whole series pass it; these leave errors of about 0.05 arc seconds.
LEADING = (
    (0, 0, 0, 0, 1, -171996, -174.2, 92025, 8.9),
    (0, 0, 2, -2, 2, -13187, -1.6, 5736, -3.1),
    (0, 0, 2, 0, 2, -2274, -0.2, 977, -0.5),
    (0, 0, 0, 0, 2, 2062, 0.2, -895, 0.5),
    (0, -1, 0, 0, 0, -1426, 3.4, 54, -0.1),
    (1, 0, 0, 0, 0, 712, 0.1, -7, 0.0),
    (0, 1, 2, -2, 2, -517, 1.2, 224, -0.6),
    (0, 0, 2, 0, 1, -386, -0.4, 200, 0.0),
    (1, 0, 2, 0, 2, -301, 0.0, 129, -0.1),
    (0, -1, 2, -2, 2, 217, -0.5, -95, 0.3),
)
#: The arguments in arc seconds: at 2000, whole turns a century, rest a century, and higher powers.
ARGUMENTS = (
    (485866.733, 1325, 715922.633, 31.310, 0.064),
    (1287099.804, 99, 1292581.224, -0.577, -0.012),
    (335778.877, 1342, 295263.137, -13.257, 0.011),
    (1072261.307, 1236, 1105601.328, -6.891, 0.019),
    (450160.280, -5, -482890.539, 7.455, 0.008),
)


def _rotation(axis: int, angle: np.ndarray) -> np.ndarray:
    """Frames turned about x, y or z: (n, 3, 3)."""
    a, b = [(1, 2), (2, 0), (0, 1)][axis]
    m = np.tile(np.eye(3), (len(angle), 1, 1))
    m[:, a, a] = m[:, b, b] = np.cos(angle)
    m[:, a, b], m[:, b, a] = np.sin(angle), -np.sin(angle)
    return m


def _arcs(t: np.ndarray, *c: float) -> np.ndarray:
    return sum(k * t**i for i, k in enumerate(c)) / 3600 * RAD


def obliquity(jd: np.ndarray) -> np.ndarray:
    return _arcs((jd - J2000) / CENTURY, 23 * 3600 + 26 * 60 + 21.406, -46.836769, -0.0001831, 0.00200340, -5.76e-7, -4.34e-8)


def nutation(jd: np.ndarray, terms: Sequence[Sequence[float]] = LEADING) -> tuple[np.ndarray, np.ndarray]:
    """Nutation in longitude and in obliquity, radians."""
    t = (jd - J2000) / CENTURY
    args = np.stack([_arcs(t, a, turns * TURN + rest, *more) for a, turns, rest, *more in ARGUMENTS])
    k = np.array(terms, float)
    angle = k[:, :5] @ args
    psi = ((k[:, 5:6] * 1e-4 + k[:, 6:7] * 1e-4 * t) * np.sin(angle)).sum(axis=0)
    eps = ((k[:, 7:8] * 1e-4 + k[:, 8:9] * 1e-4 * t) * np.cos(angle)).sum(axis=0)
    return psi / 3600 * RAD, eps / 3600 * RAD


def nutation_matrix(jd: np.ndarray, terms: Sequence[Sequence[float]] = LEADING) -> np.ndarray:
    eps = obliquity(jd)
    psi, shift = nutation(jd, terms)
    return _rotation(0, -(eps + shift)) @ _rotation(2, -psi) @ _rotation(0, eps)


def precession_matrix(jd: np.ndarray) -> np.ndarray:
    t = (jd - J2000) / CENTURY
    z, tilt, zeta = (_arcs(t, 0.0, *c) for c in ((2306.2181, 1.09468, 0.018203), (2004.3109, -0.42665, -0.041833), (2306.2181, 0.30188, 0.017998)))
    return _rotation(2, -z) @ _rotation(1, tilt) @ _rotation(2, -zeta)


def to_pole(jd: np.ndarray, terms: Sequence[Sequence[float]] = LEADING) -> np.ndarray:
    """From the fixed celestial frame to the pole of date."""
    return nutation_matrix(jd, terms) @ precession_matrix(jd)


def to_earth(jd: np.ndarray, xp: float = 0.0, yp: float = 0.0, terms: Sequence[Sequence[float]] = LEADING) -> np.ndarray:
    """From the pole of date to the earth-fixed frame; xp, yp: polar motion, radians."""
    t = (jd - J2000) / CENTURY
    start = (6 * 3600 + 41 * 60 + 50.54841 + 8640184.812866 * t + 0.093104 * t**2 - 6.2e-6 * t**3) / 3600 % 24.0
    hours = 1.002737909350795 * (jd % 1.0) * 24 + start
    n = nutation_matrix(jd, terms)
    spin = _rotation(2, hours * 15 * RAD + np.arctan(n[:, 0, 1] / n[:, 0, 0]))
    if not xp and not yp:
        return spin
    one = np.ones(len(jd))
    return _rotation(0, -xp * one) @ _rotation(1, -yp * one) @ spin


def to_local(longitude: float, latitude: float) -> np.ndarray:
    """From the earth-fixed frame to east, north, up."""
    a = lambda v: np.array([v])
    return (_rotation(2, a(np.pi / 2)) @ _rotation(1, a(np.pi / 2 - latitude * RAD)) @ _rotation(2, a(longitude * RAD)))[0]


def star_frames(times: DataFrame, longitude: float, latitude: float, jd: str = "jd", key: str = "point_id", terms: Sequence[Sequence[float]] = LEADING) -> DataFrame:
    """(key, m00 .. m22): from the fixed celestial frame to east, north, up."""
    names = [f"m{i}{j}" for i in range(3) for j in range(3)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t = pdf[jd].to_numpy(float)
            m = to_local(longitude, latitude) @ to_earth(t, terms=terms) @ to_pole(t, terms)
            yield pd.DataFrame({key: pdf[key], **{n: m[:, i // 3, i % 3] for i, n in enumerate(names)}})

    return times.select(key, jd).mapInPandas(run, f"{key} long, " + ", ".join(f"{n} double" for n in names))
