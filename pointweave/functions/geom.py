"""Geometry as Column expressions: everything stays inside the JVM's generated code.

Constants (planes, polygon edges, transforms) are worked out on the driver with
NumPy; each helper returns a Column over coordinate columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[float]
Planes = Sequence[tuple[Vec, float]]  # normal n and offset d: height(p) = n.p - d


def xyz(prefix: str = "") -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def dot(n: Vec, p: Sequence[Column]) -> Column:
    return F.lit(float(n[0])) * p[0] + F.lit(float(n[1])) * p[1] + F.lit(float(n[2])) * p[2]


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def in_box(lo: Vec, hi: Vec, p: Sequence[Column] | None = None) -> Column:
    """Inside the closed box."""
    p = p or xyz()
    return all_of([c.between(float(a), float(b)) for c, a, b in zip(p, lo, hi)])


def in_box_half_open(lo: Vec, hi: Vec, p: Sequence[Column] | None = None) -> Column:
    p = p or xyz()
    return all_of([(c >= float(a)) & (c < float(b)) for c, a, b in zip(p, lo, hi)])


def height(n: Vec, d: float, p: Sequence[Column] | None = None) -> Column:
    return dot(n, p or xyz()) - F.lit(float(d))


def near_plane(n: Vec, d: float, within: float) -> Column:
    """Within a distance of the plane; ``n`` need not have unit length."""
    k = float(np.linalg.norm(n))
    return F.abs(height(np.asarray(n, float) / k, d / k)) <= F.lit(float(within))


def in_hull(planes: Planes) -> Column:
    """Not above any of the planes."""
    return all_of([height(n, d) <= 0 for n, d in planes])


def beyond_hull(planes: Planes) -> Column:
    """Inside the hull of the reversed planes, i.e. beyond every plane."""
    return all_of([height(n, d) >= 0 for n, d in planes])


def hull_of_box(lo: Vec, hi: Vec) -> list[tuple[list[float], float]]:
    eye = np.eye(3)
    return [(list(s * eye[i] + 0.0), float(s * (hi if s > 0 else lo)[i]) + 0.0) for i in range(3) for s in (1.0, -1.0)]


def hull_corners(planes: Planes) -> np.ndarray:
    """Corners of a bounded convex hull: meets of three planes inside all others."""
    n, d = np.array([p[0] for p in planes], float), np.array([p[1] for p in planes], float)
    found = []
    for i in range(len(n)):
        for j in range(i):
            for k in range(j):
                m = n[[i, j, k]]
                if abs(np.linalg.det(m)) > 1e-12:
                    p = np.linalg.solve(m, d[[i, j, k]])
                    if (n @ p - d <= 1e-9 * max(1.0, np.abs(d).max())).all():
                        found.append(p)
    return np.array(found).reshape(-1, 3)


def hull_bounds(planes: Planes) -> tuple[Vec, Vec] | None:
    """The hull's box, or None if it has no corners; a box that is redundant
    with the hull lets the scan skip row groups."""
    c = hull_corners(planes)
    if not len(c):
        return None
    pad = 1e-9 * max(1.0, float(np.abs(c).max()))
    return list(c.min(axis=0) - pad), list(c.max(axis=0) + pad)


def frustum_planes(view_projection: np.ndarray) -> list[tuple[list[float], float]]:
    """Six planes of the volume that ``view_projection`` (4x4, row-major, acting
    on column vectors) maps to the cube of -1..1, from its unprojected corners."""
    inv = np.linalg.inv(np.asarray(view_projection, float))
    c = {}
    for key in np.ndindex(2, 2, 2):
        v = inv @ np.array([*(2.0 * k - 1 for k in key), 1.0])
        c[key] = v[:3] / v[3]
    centre = np.mean(list(c.values()), axis=0)
    planes = []
    for axis in range(3):
        for side in (0, 1):
            quad = [c[tuple(np.insert([a, b], axis, side))] for a, b in ((0, 0), (0, 1), (1, 0))]
            n = np.cross(quad[1] - quad[0], quad[2] - quad[0])
            n = n / np.linalg.norm(n)
            d = float(n @ quad[0])
            planes.append((list(n), d) if n @ centre <= d else (list(-n), -d))
    return planes


def let(values: Sequence[Column], body) -> Column:
    """``body`` of ``values``, each worked out once a row: as plain expressions they would be
    copied to every use, and a test of many edges outgrow the size that the JVM compiles."""
    bound = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.get(F.transform(bound, lambda t: body(*(t[f"v{i}"] for i in range(len(values))))), F.lit(0))


def in_polygon(u: Column, v: Column, ring: Sequence[Vec]) -> Column:
    """Even-odd rule with half-open edges: a crossing where (v1 > v) <> (v2 > v)."""
    return let((u, v), lambda a, b: _in_polygon(a, b, ring))


def _in_polygon(u: Column, v: Column, ring: Sequence[Vec]) -> Column:
    odd: Column = F.lit(0)
    for (u1, v1), (u2, v2) in zip(ring, [*ring[1:], ring[0]]):
        if float(v1) == float(v2):
            continue
        cross = ((F.lit(float(v1)) > v) != (F.lit(float(v2)) > v)) & (u < (float(u2) - float(u1)) * (v - float(v1)) / (float(v2) - float(v1)) + float(u1))
        odd = odd + cross.cast("int")
    return odd % 2 == 1


def plane_frame(ring: Sequence[Vec]) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Normal (Newell), offset and two in-plane axes of a planar 3-D polygon."""
    p = np.asarray(ring, float)
    q = np.roll(p, -1, axis=0)
    n = np.array([((p[:, 1] - q[:, 1]) * (p[:, 2] + q[:, 2])).sum(), ((p[:, 2] - q[:, 2]) * (p[:, 0] + q[:, 0])).sum(), ((p[:, 0] - q[:, 0]) * (p[:, 1] + q[:, 1])).sum()])
    n = n / np.linalg.norm(n)
    a = p[1] - p[0]
    a = a / np.linalg.norm(a)
    return n, float(n @ p.mean(axis=0)), a, np.cross(n, a)


def near_polygon(ring: Sequence[Vec], within: float) -> Column:
    """Within a distance of the polygon's plane, and the projection inside it.
    The polygon's box, widened along the normal, comes first for the scan."""
    n, d, a, b = plane_frame(ring)
    p = np.asarray(ring, float)
    pad = np.abs(n) * within + 1e-9
    flat = [(float(q @ a), float(q @ b)) for q in p]
    return in_box(p.min(axis=0) - pad, p.max(axis=0) + pad) & (F.abs(height(n, d)) <= float(within)) & in_polygon(dot(a, xyz()), dot(b, xyz()), flat)


def distance2(q: Vec, p: Sequence[Column] | None = None) -> Column:
    dx, dy, dz = (c - F.lit(float(k)) for c, k in zip(p or xyz(), q))
    return dx * dx + dy * dy + dz * dz


def distance(q: Vec, p: Sequence[Column] | None = None) -> Column:
    return F.sqrt(distance2(q, p))


def chebyshev_less(a: Sequence[Column], b: Sequence[Column], d: float) -> Column:
    return F.greatest(*(F.abs(x - y) for x, y in zip(a, b))) < float(d)


def euclid_less(a: Sequence[Column], b: Sequence[Column], d: float) -> Column:
    return reduce(lambda s, t: s + t, [(x - y) * (x - y) for x, y in zip(a, b)]) < float(d) ** 2


def ray_t(origin: Vec, direction: Vec, p: Sequence[Column] | None = None) -> Column:
    """Parameter of the nearest point of the line, in lengths of ``direction``."""
    p = p or xyz()
    return dot(direction, [c - F.lit(float(o)) for c, o in zip(p, origin)]) / F.lit(float(np.dot(direction, direction)))


def line_distance(origin: Vec, direction: Vec, t: Column, p: Sequence[Column] | None = None) -> Column:
    p = p or xyz()
    e = [c - (F.lit(float(o)) + t * F.lit(float(d))) for c, o, d in zip(p, origin, direction)]
    return F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])


def segment_distance(p0: Vec, p1: Vec, p: Sequence[Column] | None = None) -> Column:
    direction = np.subtract(p1, p0)
    if not np.any(direction):
        return distance(p0, p)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ray_t(p0, direction, p)))
    return line_distance(p0, direction, t, p)


def clip_ray(origin: Vec, direction: Vec, lo: Vec, hi: Vec) -> tuple[list[float], list[float]] | None:
    """The part of a ray (t >= 0) inside a box, or None."""
    o, d = np.asarray(origin, float), np.asarray(direction, float)
    t0, t1 = 0.0, np.inf
    for k in range(3):
        if d[k] == 0:
            if not lo[k] <= o[k] <= hi[k]:
                return None
            continue
        a, b = sorted(((lo[k] - o[k]) / d[k], (hi[k] - o[k]) / d[k]))
        t0, t1 = max(t0, a), min(t1, b)
    return None if t0 > t1 else (list(o + t0 * d), list(o + t1 * d))


def transform(m: np.ndarray, p: Sequence[Column] | None = None) -> list[Column]:
    """Homogeneous x, y, z, w of points under a 4x4 matrix."""
    p = p or xyz()
    return [dot(row[:3], p) + F.lit(float(row[3])) for row in np.asarray(m, float)]


def transformed(m: np.ndarray, p: Sequence[Column] | None = None) -> list[Column]:
    x, y, z, w = transform(m, p)
    return [x / w, y / w, z / w]


def box_meets_plane(n: Vec, d: float, within: float = 0.0, prefix: str = "bb_") -> Column:
    """Whether a row's box comes within a distance of the plane."""
    lo, hi = box_heights(n, d, prefix)
    return (lo <= float(within)) & (hi >= -float(within))


def box_heights(n: Vec, d: float, prefix: str = "bb_") -> tuple[Column, Column]:
    """Least and greatest height over the plane of a row's box (support points)."""
    lo = [F.col(f"{prefix}min_{a}") for a in "xyz"]
    hi = [F.col(f"{prefix}max_{a}") for a in "xyz"]
    low = dot(n, [a if k >= 0 else b for k, a, b in zip(n, lo, hi)]) - float(d)
    high = dot(n, [b if k >= 0 else a for k, a, b in zip(n, lo, hi)]) - float(d)
    return low, high


def box_above(n: Vec, d: float, prefix: str = "bb_") -> Column:
    return box_heights(n, d, prefix)[0] >= 0


def box_below(n: Vec, d: float, prefix: str = "bb_") -> Column:
    return box_heights(n, d, prefix)[1] <= 0


def boxes_overlap(lo: Vec, hi: Vec, prefix: str = "bb_") -> Column:
    return all_of([(F.col(f"{prefix}max_{a}") >= float(lo[i])) & (F.col(f"{prefix}min_{a}") <= float(hi[i])) for i, a in enumerate("xyz")])


def box_inside(lo: Vec, hi: Vec, prefix: str = "bb_") -> Column:
    return all_of([(F.col(f"{prefix}min_{a}") >= float(lo[i])) & (F.col(f"{prefix}max_{a}") <= float(hi[i])) for i, a in enumerate("xyz")])


def box_may_meet_hull(planes: Sequence[tuple[Vec, float]], prefix: str = "bb_") -> Column:
    """Whether no plane of the hull has a row's whole box on its outer side."""
    return all_of([box_heights(n, d, prefix)[0] <= 0 for n, d in planes])


def box_may_leave_hull(planes: Sequence[tuple[Vec, float]], prefix: str = "bb_") -> Column:
    """Whether a part of a row's box lies beyond some plane of the hull."""
    return any_of([box_heights(n, d, prefix)[1] > 0 for n, d in planes])


def box_may_leave_plane(n: Vec, d: float, within: float, prefix: str = "bb_") -> Column:
    """Whether a part of a row's box is farther than ``within`` from the plane."""
    lo, hi = box_heights(n, d, prefix)
    return (lo < -float(within)) | (hi > float(within))


def box_may_meet_polygon(ring: Sequence[Vec], within: float, prefix: str = "bb_") -> Column:
    """Whether a row's box comes near the polygon's plane and its corners' box."""
    k, d, _, _ = plane_frame(ring)
    corners = np.asarray(ring, float)
    return box_meets_plane(k, d, within, prefix) & boxes_overlap(corners.min(axis=0) - within, corners.max(axis=0) + within, prefix)


def normal_within(direction: Vec, degrees: float, n: Sequence[Column]) -> Column:
    """Two-sided: |direction x normal|^2 <= sin^2 of the angle, clamped to 0..90."""
    a = np.asarray(direction, float) / np.linalg.norm(direction)
    s = float(np.sin(np.radians(min(90.0, max(0.0, degrees)))))
    u = [F.lit(float(k)) for k in a]
    c = [u[1] * n[2] - u[2] * n[1], u[2] * n[0] - u[0] * n[2], u[0] * n[1] - u[1] * n[0]]
    return c[0] * c[0] + c[1] * c[1] + c[2] * c[2] <= F.lit(s * s)
