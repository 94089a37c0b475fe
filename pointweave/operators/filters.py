"""Composable view filters: each is a Column, has bounds, and is JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom

Box = tuple[Sequence[float], Sequence[float]]
REGISTRY: dict[str, type[PointFilter]] = {}


class PointFilter:
    """A predicate over points. ``type_name`` is its tag in JSON."""

    type_name = ""
    spatial = False

    def __init_subclass__(cls) -> None:
        if cls.type_name:
            REGISTRY[cls.type_name] = cls

    def column(self, columns: Sequence[str]) -> Column:
        raise NotImplementedError

    def bounds(self) -> Box | None:
        """A box outside of which nothing passes, if there is one."""
        return None

    def fields(self) -> dict:
        raise NotImplementedError

    @classmethod
    def read(cls, fields: dict) -> PointFilter:
        raise NotImplementedError

    def apply(self, points: DataFrame) -> DataFrame:
        """Rows that pass; the bounds come along for the scan to skip with."""
        box = self.bounds()
        seen = self.column(points.columns)
        return points.where(geom.in_box(*box) & seen if box else seen)

    def clip(self, lo: Sequence[float], hi: Sequence[float]) -> Box | None:
        """Bounds of the filter within a box, or None if they don't meet."""
        box = self.bounds()
        a = [max(p, q) for p, q in zip(lo, box[0])] if box else list(lo)
        b = [min(p, q) for p, q in zip(hi, box[1])] if box else list(hi)
        return (a, b) if all(p <= q for p, q in zip(a, b)) else None

    def to_json(self) -> str:
        return json.dumps(self.tagged())

    def tagged(self) -> dict:
        return {"Type": self.type_name, **self.fields()}

    def __and__(self, other: PointFilter) -> And:
        return And(self, other)

    def __or__(self, other: PointFilter) -> Or:
        return Or(self, other)


def from_json(text: str | dict) -> PointFilter:
    fields = json.loads(text) if isinstance(text, str) else dict(text)
    kind = fields.pop("Type")
    if kind not in REGISTRY:
        raise ValueError(f"unknown filter {kind}")
    return REGISTRY[kind].read(fields)


@dataclass(frozen=True)
class InsideBox(PointFilter):
    lo: tuple
    hi: tuple
    type_name = "FilterInsideBox3d"
    spatial = True

    def column(self, columns):
        return geom.in_box(self.lo, self.hi)

    def bounds(self):
        return self.lo, self.hi

    def fields(self):
        return {"Box": [list(self.lo), list(self.hi)]}

    @classmethod
    def read(cls, fields):
        return cls(*map(tuple, fields["Box"]))


@dataclass(frozen=True)
class OutsideBox(InsideBox):
    type_name = "FilterOutsideBox3d"

    def column(self, columns):
        return ~geom.in_box(self.lo, self.hi)

    def bounds(self):
        return None


def _planes(hull) -> list[dict]:
    """A point on each plane and its normal; the distance too, so that reading back is exact."""
    return [{"Point": [float(k) + 0.0 for k in np.asarray(n) * d / np.dot(n, n)], "Normal": list(map(float, n)), "Distance": float(d)} for n, d in hull]


def _hull(planes: list[dict]) -> tuple:
    return tuple((tuple(p["Normal"]), float(p.get("Distance", np.dot(p["Normal"], p["Point"])))) for p in planes)


@dataclass(frozen=True)
class InsideHull(PointFilter):
    planes: tuple
    type_name = "FilterInsideConvexHull3d"
    spatial = True

    def column(self, columns):
        return geom.in_hull(self.planes)

    def bounds(self):
        return geom.hull_bounds(self.planes)

    def fields(self):
        return {"Array": _planes(self.planes)}

    @classmethod
    def read(cls, fields):
        return cls(_hull(fields["Array"]))


@dataclass(frozen=True)
class InsideHulls(PointFilter):
    """Inside any of some hulls."""

    hulls: tuple
    type_name = "FilterInsideConvexHulls3d"
    spatial = True

    @classmethod
    def of_footprint(cls, ring, z_lo: float, z_hi: float, matrix=None) -> PointFilter:
        """A prism over a polygon, moved by a 4x4 matrix; one hull a triangle of it."""
        from .mesh import triangulate

        ring = [tuple(map(float, p)) for p in ring]
        check_ring(ring)
        m = np.eye(4) if matrix is None else np.asarray(matrix, float)
        back = np.linalg.inv(m)
        hulls = []
        for tri in triangulate(np.array(ring)):
            p = np.array([ring[i] for i in tri])
            (a, b), (c, d) = p[1:] - p[0]
            if a * d < b * c:
                p = p[::-1]
            e = np.roll(p, -1, axis=0) - p
            sides = [((float(b), float(-a), 0.0), float(b * q[0] - a * q[1])) for (a, b), q in zip(e, p)]
            hull = [*sides, ((0.0, 0.0, 1.0), float(z_hi)), ((0.0, 0.0, -1.0), -float(z_lo))]
            # a plane n.p <= d of the source is (n M^-1).q <= d of the moved points
            moved = [(np.append(n, -d) @ back) for n, d in hull]
            hulls.append(tuple((tuple(map(float, v[:3])), float(-v[3])) for v in moved))
        return cls(tuple(hulls))

    def column(self, columns):
        return geom.any_of([geom.in_hull(h) for h in self.hulls])

    def bounds(self):
        return _around([geom.hull_bounds(h) for h in self.hulls])

    def fields(self):
        return {"Array": [_planes(h) for h in self.hulls]}

    @classmethod
    def read(cls, fields):
        return cls(tuple(map(_hull, fields["Array"])))


def check_ring(ring) -> None:
    """At least three corners, none twice, and no edges that cross."""
    if len(ring) < 3 or len(set(ring)) < len(ring):
        raise ValueError("a footprint needs three different corners")
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    n = len(ring)
    for i in range(n):
        for j in range(i + 2, n - (i == 0)):
            a, b, c, d = ring[i], ring[(i + 1) % n], ring[j], ring[(j + 1) % n]
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                raise ValueError("the footprint crosses itself")


def _around(boxes: list[Box | None]) -> Box | None:
    if not boxes or any(b is None for b in boxes):
        return None
    return [min(x) for x in zip(*(b[0] for b in boxes))], [max(x) for x in zip(*(b[1] for b in boxes))]


@dataclass(frozen=True)
class InsidePrism(PointFilter):
    """z in a closed range and xy inside any of some polygons."""

    rings: tuple
    z_lo: float
    z_hi: float
    type_name = "FilterInsidePrismXY"
    spatial = True

    def column(self, columns):
        return F.col("z").between(self.z_lo, self.z_hi) & geom.any_of([geom.in_polygon(F.col("x"), F.col("y"), r) for r in self.rings])

    def bounds(self):
        every = [p for r in self.rings for p in r]
        return [*map(min, zip(*every)), self.z_lo], [*map(max, zip(*every)), self.z_hi]

    def fields(self):
        return {"Shape": [[list(p) for p in r] for r in self.rings], "Range": [self.z_lo, self.z_hi]}

    @classmethod
    def read(cls, fields):
        return cls(tuple(tuple(tuple(p) for p in r) for r in fields["Shape"]), *fields["Range"])


@dataclass(frozen=True)
class InsideSphere(PointFilter):
    centre: tuple
    radius: float
    type_name = "FilterInsideSphere3d"
    spatial = True

    def column(self, columns):
        return geom.distance2(self.centre) <= self.radius * self.radius

    def bounds(self):
        return [c - self.radius for c in self.centre], [c + self.radius for c in self.centre]

    def fields(self):
        return {"Sphere": [list(self.centre), self.radius]}

    @classmethod
    def read(cls, fields):
        return cls(tuple(fields["Sphere"][0]), fields["Sphere"][1])


@dataclass(frozen=True)
class Classification(PointFilter):
    """Classes of a set; points without a class pass."""

    classes: frozenset
    type_name = "FilterClassification"

    @classmethod
    def all_except(cls, *drop: int | range) -> Classification:
        gone = {k for d in drop for k in (d if isinstance(d, range) else [d])}
        return cls(frozenset(range(256)) - gone)

    def column(self, columns):
        if "classification" not in columns:
            return F.lit(True)
        c = F.col("classification")
        return c.isNull() | c.isin(*sorted(self.classes))

    def fields(self):
        return {"Filter": sorted(self.classes)}

    @classmethod
    def read(cls, fields):
        return cls(frozenset(fields["Filter"]))


@dataclass(frozen=True)
class Intensity(PointFilter):
    """A closed range; points without an intensity don't pass."""

    lo: int
    hi: int
    type_name = "FilterIntensity"

    def column(self, columns):
        if "intensity" not in columns:
            return F.lit(False)
        return F.coalesce(F.col("intensity").between(self.lo, self.hi), F.lit(False))

    def fields(self):
        return {"Range": [self.lo, self.hi]}

    @classmethod
    def read(cls, fields):
        return cls(*fields["Range"])


@dataclass(frozen=True)
class NormalDirection(PointFilter):
    direction: tuple
    degrees: float
    type_name = "FilterNormalDirection"

    def column(self, columns):
        if "nx" not in columns:
            return F.lit(False)
        n = [F.col(c).cast("double") for c in ("nx", "ny", "nz")]
        return F.coalesce(geom.normal_within(self.direction, self.degrees, n), F.lit(False))

    def fields(self):
        return {"Direction": list(self.direction), "EpsInDegrees": self.degrees}

    @classmethod
    def read(cls, fields):
        return cls(tuple(fields["Direction"]), fields["EpsInDegrees"])


@dataclass(frozen=True)
class And(PointFilter):
    left: PointFilter
    right: PointFilter
    type_name = "FilterAnd"

    @property
    def spatial(self) -> bool:
        return self.left.spatial and self.right.spatial

    def column(self, columns):
        return self.left.column(columns) & self.right.column(columns)

    def bounds(self):
        a, b = self.left.bounds(), self.right.bounds()
        if not a or not b:
            return a or b
        return [max(x) for x in zip(a[0], b[0])], [min(x) for x in zip(a[1], b[1])]

    def fields(self):
        return {"Left": self.left.tagged(), "Right": self.right.tagged()}

    @classmethod
    def read(cls, fields):
        return cls(from_json(fields["Left"]), from_json(fields["Right"]))


@dataclass(frozen=True)
class Or(And):
    type_name = "FilterOr"

    def column(self, columns):
        return self.left.column(columns) | self.right.column(columns)

    def bounds(self):
        return _around([self.left.bounds(), self.right.bounds()])


