"""Predicates on points: query, exact count, existence; rays; merging and thinning."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom

#: What a missing property stands for.
DEFAULTS = {"classification": 0, "intensity": 0, "r": 0, "g": 0, "b": 0, "a": 255, "nx": 0.0, "ny": 0.0, "nz": 0.0, "part_index": 0}


def where(points: DataFrame, test: Column, box=None) -> DataFrame:
    """Points that pass; ``box`` is a redundant (lo, hi) for the scan to skip with."""
    return points.where(geom.in_box(*box) & test if box else test)


def count(points: DataFrame, test: Column) -> DataFrame:
    return points.agg(F.count_if(test).alias("n"))


def exists(points: DataFrame, test: Column) -> bool:
    """Stops at the first point found."""
    return not points.where(test).limit(1).isEmpty()


def bounds(points: DataFrame) -> tuple[list[float], list[float]] | None:
    r = points.agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz")).first()
    return None if r[0] is None else ([r["lox"], r["loy"], r["loz"]], [r["hix"], r["hiy"], r["hiz"]])


def near_ray(points: DataFrame, origin, direction, radius: float, t_min: float | None = None, t_max: float | None = None) -> DataFrame:
    """Adds t and distance. With a range: that of the parameter. Without one: the
    ray is clipped to the cloud's box first, and nothing is near a ray that misses it."""
    if t_min is not None or t_max is not None:
        t = geom.ray_t(origin, direction)
        out = points.withColumn("t", t).withColumn("distance", geom.line_distance(origin, direction, F.col("t")))
        return out.where((F.col("distance") <= radius) & F.col("t").between(-math.inf if t_min is None else t_min, math.inf if t_max is None else t_max))
    box = bounds(points)
    ends = geom.clip_ray(origin, direction, *box) if box else None
    if ends is None:
        return points.withColumn("t", F.lit(0.0)).withColumn("distance", F.lit(0.0)).where(F.lit(False))
    return near_segment(points, *ends, radius).withColumn("t", geom.ray_t(origin, direction))


def near_segment(points: DataFrame, p0, p1, radius: float) -> DataFrame:
    lo, hi = np.minimum(p0, p1) - radius, np.maximum(p0, p1) + radius
    return points.where(geom.in_box(lo, hi)).withColumn("distance", geom.segment_distance(p0, p1)).where(F.col("distance") <= radius)


def with_defaults(points: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Missing values of known properties become their defaults."""
    known = DEFAULTS | (defaults or {})
    return points.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(points.schema[c].dataType)) for c, v in known.items() if c in points.columns})


def union(*clouds: DataFrame) -> DataFrame:
    """All points; properties that one cloud lacks are null there (not cut to the shorter)."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def deduplicate(points: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One point for each position, the one of the least point_id. ``within``
    restricts duplicates to equal values of those columns (such as a chunk).

    The survivor is found by an aggregate, so a position that a third of all
    points share is combined before the shuffle."""
    keys = [*within, "x", "y", "z"]
    rest = [c for c in points.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("point_id", *[c for c in rest if c != "point_id" and not _unordered(points, c)])).alias("p")
    return points.groupBy(*keys).agg(first).select(*(F.col(c) if c in keys else F.col("p")[c].alias(c) for c in points.columns))


def _unordered(df: DataFrame, c: str) -> bool:
    return "map" in df.schema[c].dataType.simpleString()


def cell_exponent(d: float) -> int:
    return math.ceil(math.log2(d))


def thin_by_cell(points: DataFrame, d: float) -> DataFrame:
    """One point for each cell of side 2^ceil(log2 d): the one of the least point_id."""
    side = 2.0 ** cell_exponent(d)
    cells = [F.floor(F.col(c) / side).alias(f"_{c}") for c in "xyz"]
    rest = points.columns
    first = F.min_by(F.struct(*rest), F.struct("point_id", "x", "y", "z")).alias("p")
    return points.groupBy(*cells).agg(first).select(*(F.col("p")[c].alias(c) for c in rest))


def thin_sequentially(points: DataFrame, d: float, metric: str = "chebyshev", by: Sequence[str] = ()) -> DataFrame:
    """Drops points closer than ``d`` to the last *kept* one, in order of point_id.

    The order makes a group one sequential scan; ``by`` names the columns that
    make groups (a scan line, a part). Without them all points are one group. A task
    holds one batch of a group at a time.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.stack([batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
            starts = np.zeros(len(p), bool)
            for c in by:
                v = batch[c].to_pandas()
                null, v = v.isna().to_numpy(), v.to_numpy()
                starts[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
            ends = [*np.flatnonzero(starts).tolist(), len(p)]
            first = tuple(batch[c][0].as_py() for c in by)
            last = last if first == group else None
            keep, at = np.zeros(len(p), bool), 0
            for end in ends:
                own = _kept(p[at:end], d, metric, last)
                keep[at:end] = own
                if own.any():
                    last = p[at:end][own][-1]
                at, last = end, last if end == len(p) else None
            group = tuple(batch[c][len(p) - 1].as_py() for c in by)
            yield batch.filter(pa.array(keep))

    dealt = points.repartition(*by) if by else points.repartition(1)
    return dealt.sortWithinPartitions(*by, "point_id", "x", "y", "z").mapInArrow(scan, points.schema)


def _kept(p: np.ndarray, d: float, metric: str, last: np.ndarray | None = None) -> np.ndarray:
    """Which points stay, after ``last`` was kept: whole runs of points that are far
    from the one before, then jumps to the next kept point, a block at a time."""

    def far(e: np.ndarray) -> np.ndarray:
        return (np.abs(e) >= d).any(axis=1) if metric == "chebyshev" else (e**2).sum(axis=1) >= d * d

    def following(at: int, q: np.ndarray) -> int:
        block = 64
        while at < len(p):
            hit = far(p[at : at + block] - q)
            if hit.any():
                return at + int(hit.argmax())
            at, block = at + block, min(block * 2, 1 << 16)
        return len(p)

    keep = np.zeros(len(p), bool)
    stops = np.append(np.flatnonzero(~far(p[1:] - p[:-1])), len(p) - 1)
    at = 0 if last is None else following(0, last)
    while at < len(p):
        stop = int(stops[np.searchsorted(stops, at)])
        keep[at : stop + 1] = True
        at = following(stop + 2, p[stop])
    return keep


def map_positions(points: DataFrame, f: Callable[[Column, Column, Column], Sequence[Column]]) -> DataFrame:
    return points.withColumns(dict(zip("xyz", f(*geom.xyz()))))


def transform_points(points: DataFrame, matrix) -> DataFrame:
    """Positions by a 4x4 matrix, normals by its inverse transpose."""
    m = np.asarray(matrix, float)
    out = dict(zip("xyz", geom.transformed(m)))
    if "nx" in points.columns:
        it = np.linalg.inv(m[:3, :3]).T
        n = [F.col(c).cast("double") for c in ("nx", "ny", "nz")]
        v = [geom.dot(row, n) for row in it]
        length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        out |= {c: (x / length).cast("float") for c, x in zip(("nx", "ny", "nz"), v)}
    return points.withColumns(out)


def part_range(points: DataFrame) -> DataFrame:
    return points.agg(F.min("part_index").alias("part_min"), F.max("part_index").alias("part_max"))


def delete(points: DataFrame, test: Column) -> DataFrame:
    """Points that the test doesn't hold for; where it is null they stay."""
    return points.where(~F.coalesce(test, F.lit(False)))


def content_hash(points: DataFrame, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """MD5 of each row's values as text, and of the whole cloud in any order
    (a sum of the rows' hashes, so no task sees more than its rows)."""
    row = F.md5(F.concat_ws(",", *(F.col(c).cast("string") for c in columns)))
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return points.agg(F.count(F.lit(1)).alias("n"), F.md5(F.coalesce(F.sum(part), F.lit(0)).cast("string")).alias("md5"))
