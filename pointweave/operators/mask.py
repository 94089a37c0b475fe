"""Screen-space masks with boolean algebra, as Columns."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from ..functions import geom


class MaskAlgebra:
    """Masks combine into masks."""

    def column(self) -> Column:
        raise NotImplementedError

    def tagged(self) -> dict:
        raise NotImplementedError

    def to_json(self) -> str:
        return json.dumps(self.tagged())

    def __and__(self, other: MaskAlgebra) -> Combined:
        return Combined("And", self, other)

    def __or__(self, other: MaskAlgebra) -> Combined:
        return Combined("Or", self, other)

    def __xor__(self, other: MaskAlgebra) -> Combined:
        return Combined("Xor", self, other)

    def __sub__(self, other: MaskAlgebra) -> Combined:
        return Combined("Subtract", self, other)


@dataclass(frozen=True)
class Mask(MaskAlgebra):
    """Triangles in normalised screen space under a 4x4 projection."""

    triangles: tuple
    matrix: tuple

    def column(self) -> Column:
        """Whether a point's projection lies in any triangle; never if its depth is negative."""
        return geom.let(geom.transformed(np.array(self.matrix)), self._covers)

    def _covers(self, u: Column, v: Column, depth: Column) -> Column:
        inside = []
        for a, b, c in self.triangles:
            s = [(q[0] - p[0]) * (v - float(p[1])) - (q[1] - p[1]) * (u - float(p[0])) for p, q in ((a, b), (b, c), (c, a))]
            inside.append(geom.all_of([x >= 0 for x in s]) | geom.all_of([x <= 0 for x in s]))
        return (depth >= 0) & geom.any_of(inside)

    def tagged(self) -> dict:
        return {"Type": "Mask", "Triangles": [[list(p) for p in t] for t in self.triangles], "Matrix": [list(r) for r in self.matrix]}


@dataclass(frozen=True)
class Combined(MaskAlgebra):
    operation: str
    left: MaskAlgebra
    right: MaskAlgebra

    def column(self) -> Column:
        a, b = self.left.column(), self.right.column()
        return {"And": a & b, "Or": a | b, "Xor": a != b, "Subtract": a & ~b}[self.operation]

    def tagged(self) -> dict:
        return {"Type": self.operation, "Left": self.left.tagged(), "Right": self.right.tagged()}


def of_polygon(ring, matrix) -> Mask:
    from .mesh import triangulate

    p = np.asarray(ring, float)
    return Mask(tuple(tuple(tuple(map(float, p[i])) for i in t) for t in triangulate(p)), tuple(map(tuple, np.asarray(matrix, float).tolist())))


def from_json(text: str | dict) -> MaskAlgebra:
    d = json.loads(text) if isinstance(text, str) else text
    if d["Type"] == "Mask":
        return Mask(tuple(tuple(tuple(p) for p in t) for t in d["Triangles"]), tuple(map(tuple, d["Matrix"])))
    return Combined(d["Type"], from_json(d["Left"]), from_json(d["Right"]))
