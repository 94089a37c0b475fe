"""Grouping by space: cells, columns, grids and neighbourhoods of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom


def cell_keys(exponent: int, axes: str = "xyz", prefix: str = "c") -> list[Column]:
    """Integer cell coordinates at side 2^exponent."""
    side = 2.0**exponent
    return [F.floor(F.col(a) / side).cast("long").alias(f"{prefix}{a}") for a in axes]


def with_cells(points: DataFrame, exponent: int, axes: str = "xyz") -> DataFrame:
    return points.select("*", *cell_keys(exponent, axes))


def stats(points: DataFrame, keys: Sequence) -> DataFrame:
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"))


def cells(points: DataFrame, exponent: int, stride: Sequence[int] = (1, 1, 1)) -> DataFrame:
    """Non-empty cells with count and bounds; only coordinates that the stride divides."""
    return _strided(stats(points, cell_keys(exponent)), "xyz", stride)


def columns(points: DataFrame, exponent: int, stride: Sequence[int] = (1, 1)) -> DataFrame:
    """Non-empty vertical columns of cells."""
    return _strided(stats(points, cell_keys(exponent, "xy")), "xy", stride)


def _strided(df: DataFrame, axes: str, stride: Sequence[int]) -> DataFrame:
    tests = [F.pmod(F.col(f"c{a}"), F.lit(k)) == 0 for a, k in zip(axes, stride) if k != 1]
    return df.where(geom.all_of(tests)) if tests else df


def in_cell(points: DataFrame, cell: Sequence[int], exponent: int) -> DataFrame:
    """Points of a cell's closed box (a 2-D cell: of its column)."""
    side = 2.0**exponent
    tests = [F.col(a).between(c * side, (c + 1) * side) for a, c in zip("xyz", cell)]
    return points.where(geom.all_of(tests))


def centred_cell(points: DataFrame, exponent: int) -> DataFrame:
    """Points of the cell of side 2^exponent around the origin."""
    half = 2.0 ** (exponent - 1)
    return points.where(geom.in_box([-half] * 3, [half] * 3))


def offsets(outer: Sequence[Sequence[int]], inner: Sequence[Sequence[int]] | None = None) -> list[tuple[int, ...]]:
    """Cell offsets of the closed box ``outer`` (lo, hi) without those of ``inner``."""
    lo, hi = outer
    if inner and not all(a <= c and d <= b for a, b, c, d in zip(lo, hi, *inner)):
        raise ValueError("outer must contain inner")
    out: list[tuple[int, ...]] = [()]
    for a, b in zip(lo, hi):
        out = [(*o, k) for o in out for k in range(a, b + 1)]
    return [o for o in out if not inner or not all(a <= k <= b for k, a, b in zip(o, *inner))]


def neighbourhoods(counted: DataFrame, outer, inner=None, axes: str = "xyz", value: str = "n") -> DataFrame:
    """For each non-empty cell of ``counted``: its count, and that of the cells around it.

    Every cell is sent to the cells that have it in their neighbourhood, and
    sums meet by key: no join, and the sums combine before the shuffle.
    """
    keys = [f"c{a}" for a in axes]
    moves = F.array(*(F.struct(*(F.lit(-k).cast("long").alias(c) for c, k in zip(keys, o))) for o in offsets(outer, inner)))
    sent = counted.select(*keys, value, F.explode(moves).alias("o"))
    sent = sent.select(*((F.col(c) + F.col("o")[c]).alias(c) for c in keys), F.lit(None).cast("long").alias("own"), F.col(value).alias("around"))
    own = counted.select(*keys, F.col(value).alias("own"), F.lit(0).cast("long").alias("around"))
    both = own.unionByName(sent).groupBy(*keys).agg(F.sum("own").alias("own"), F.sum("around").alias("around"), (F.count(F.lit(1)) - F.count("own")).alias("cells_around"))
    return both.where("own is not null")


def grid_xy(points: DataFrame, stride: Sequence[float]) -> DataFrame:
    """Half-open tiles of any stride: tile i = floor(x / stride)."""
    keys = [F.floor(F.col(a) / float(s)).cast("long").alias(f"t{a}") for a, s in zip("xy", stride)]
    return stats(points, keys)


def quad_children(tiles: DataFrame) -> DataFrame:
    """Counts one level up from cells of a level: (cx >> 1, cy >> 1)."""
    return tiles.groupBy(F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy")).agg(F.sum("n").alias("n"))


def column_cells(points: DataFrame, exponent: int) -> DataFrame:
    """Cells of every column with the column's total: the split of columns along z."""
    fine = stats(points, cell_keys(exponent))
    total = fine.groupBy("cx", "cy").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))
    return fine.select("cx", "cy", "cz", "n").join(total, ["cx", "cy"])
