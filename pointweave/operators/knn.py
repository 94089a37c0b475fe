"""Proximity: nearest points within a radius, one query or many.

Many queries meet the points by grid cell: points keep their cell, queries go
to the cells within the radius, and an equi-join replaces all pairs. A crowded
cell is split on the point side into parts of about ``PART`` points, which the
queries that need it are sent to, so no join key grows with the densest spot.

The k nearest need no pairs of all that are within the radius: points lie in
leaves of a k-d tree, a query's own leaf bounds the distance of its k-th, and the
query goes to the leaves within that bound alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..session import checkpointed
from . import blocks

PART = 50_000
#: Points of a leaf, about; queries that a task compares with one at a time, and its block of them.
LEAF, QUERIES, BLOCK = 1 << 10, 1 << 14, 1 << 8


def nearest(points: DataFrame, q: Sequence[float], radius: float, k: int | None = None) -> DataFrame:
    """Up to ``k`` points within ``radius`` of ``q``, nearest first (ties: least point_id)."""
    box = [c - radius for c in q], [c + radius for c in q]
    near = points.where(geom.in_box(*box)).withColumn("distance", geom.distance(q)).where(F.col("distance") <= radius).orderBy("distance", "point_id")
    return near.limit(k) if k else near


def nearest_join(queries: DataFrame, points: DataFrame, radius: float, k: int | None = None, strict: bool = False) -> DataFrame:
    """(query_id, point_id, distance, rank) for queries (query_id, x, y, z).

    ``strict``: distances below the radius only. ``k`` None: all of them.
    """
    if k:
        return k_nearest(queries, points, radius, k, strict).select("query_id", "point_id", "distance", "rank")
    side = float(radius)
    p = points.select("point_id", *(F.col(c).alias(f"p{c}") for c in "xyz"), *(F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in "xyz"))
    crowded = p.groupBy("cx", "cy", "cz").count().where(F.col("count") > PART).select("cx", "cy", "cz", F.ceil(F.col("count") / PART).alias("parts"))
    keys = ["cx", "cy", "cz"]
    p = p.join(crowded, keys, "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("point_id"), F.col("parts"))).otherwise(F.lit(0).cast("long"))).drop("parts")
    around = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("ijk", (i, j, l)))) for i in (-1, 0, 1) for j in (-1, 0, 1) for l in (-1, 0, 1)))
    q = queries.select("query_id", *(F.col(c).alias(f"q{c}") for c in "xyz"), F.explode(around).alias("o"))
    q = q.select("query_id", "qx", "qy", "qz", *((F.floor(F.col(f"q{c}") / side).cast("long") + F.col("o")[n]).alias(f"c{c}") for c, n in zip("xyz", "ijk")))
    q = q.join(crowded, keys, "left").select("query_id", "qx", "qy", "qz", *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    dx, dy, dz = (F.col(f"p{c}") - F.col(f"q{c}") for c in "xyz")
    d = F.sqrt(dx * dx + dy * dy + dz * dz)
    pairs = q.join(p, [*keys, "part"]).withColumn("distance", d)
    pairs = pairs.where(F.col("distance") < radius if strict else F.col("distance") <= radius)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "point_id"))
    return pairs.select("query_id", "point_id", "distance", rank.alias("rank"))


def _finite(df: DataFrame, key: str) -> DataFrame:
    out = df.select(key, *(F.col(c).cast("double").alias(c) for c in "xyz"))
    return out.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz"))


def _stacked(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([t[c].to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t[c].to_numpy() for c in "xyz"], axis=1)


def _parted(sent: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries of a leaf dealt into parts of bounded size, and the leaf for each part."""
    crowded = sent.groupBy("leaf").count().where(F.col("count") > QUERIES).select("leaf", F.ceil(F.col("count") / QUERIES).alias("_parts"))
    crowded = crowded.sparkSession.createDataFrame(crowded.collect(), "leaf int, _parts long")
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    q = sent.join(F.broadcast(crowded), "leaf", "left").withColumn("part", F.pmod(F.xxhash64("query_id"), parts)).drop("_parts")
    at = leaves.join(F.broadcast(crowded), "leaf", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return q, at


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    e = p[None, :, 0] - q[:, None, 0]
    out = e * e
    for i in (1, 2):
        e = p[None, :, i] - q[:, None, i]
        out += e * e
    return np.sqrt(out, out=out)


def k_nearest(queries: DataFrame, points: DataFrame, radius: float, k: int, strict: bool = False) -> DataFrame:
    """(query_id, point_id, x, y, z, distance, rank): :func:`nearest_join` with the points' positions."""
    radius = float(radius)
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((points, "point_id"), (queries, "query_id")))
    # of points in one position only the least k can be among the nearest
    again = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("point_id"))
    p = checkpointed(_finite(points, "point_id").withColumn("_n", again).where(F.col("_n") <= k).drop("_n"))
    n = p.count()
    wanted = math.ceil(n / max(LEAF, 4 * k))
    part = min(1.0, wanted * blocks.SAMPLED * 1.2 / max(n, 1))
    tree = blocks.Tree.of(_stacked((p.sample(part, 7) if part < 1 else p).select(*"xyz").toArrow()), wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_stacked(b)), pa.int32()), *b.columns], ["leaf", *b.schema.names])

    def pack(t: pa.Table) -> pa.Table:
        v = _stacked(t)
        ends = pa.array([0, len(v)], pa.int32())
        out = {c: pa.ListArray.from_arrays(ends, t[c].combine_chunks()) for c in ("point_id", *"xyz")}
        return pa.table({"leaf": t["leaf"].slice(0, 1), **out, "lo": pa.array([v.min(axis=0)]), "hi": pa.array([v.max(axis=0)])})

    packed = f"leaf int, point_id array<{id_type}>, x array<double>, y array<double>, z array<double>, lo array<double>, hi array<double>"
    leaves = checkpointed(p.mapInArrow(deal, f"leaf int, point_id {id_type}, x double, y double, z double").groupBy("leaf").applyInArrow(pack, packed))
    boxes = leaves.select("leaf", "lo", "hi").collect()
    names, low, high = np.array([r.leaf for r in boxes], int), *(np.array([r[c] for r in boxes], float).reshape(-1, 3) for c in ("lo", "hi"))
    leaves = leaves.select("leaf", "point_id", *"xyz")

    def unpacked(t: pa.Table) -> np.ndarray:
        if not t.num_rows:
            return np.empty((0, 3))
        return np.stack([t[c].combine_chunks().flatten().to_numpy() for c in "xyz"], axis=1)

    def bounded(asked: pa.Table, leaf: pa.Table) -> pa.Table:
        """A row for each leaf that may have one of a query's k nearest."""
        q, own = _stacked(asked), unpacked(leaf)
        bound = np.full(len(q), radius)
        if len(own) >= k:
            for i in range(0, len(q), BLOCK):
                d = _distances(q[i : i + BLOCK], own)
                d.partition(k - 1, axis=1)
                bound[i : i + BLOCK] = np.minimum(radius, d[:, k - 1])
        reach = bound * bound * (1 + 1e-9)
        near = np.flatnonzero(blocks.box_distance2(low, high, q.min(axis=0), q.max(axis=0)) <= reach.max()) if len(q) else []
        rows, to = [np.empty(0, int)], [np.empty(0, int)]
        for j in near:
            hit = np.flatnonzero(blocks.box_distance2(q, q, low[j], high[j]) <= reach)
            rows.append(hit)
            to.append(np.full(len(hit), names[j]))
        rows, to = np.concatenate(rows), np.concatenate(to)
        out = asked.select(["query_id", *"xyz"]).take(pa.array(rows))
        return out.append_column("bound", pa.array(bound[rows])).add_column(0, "leaf", pa.array(to, pa.int32()))

    def compared(asked: pa.Table, leaf: pa.Table) -> pa.Table:
        q, own = _stacked(asked), unpacked(leaf)
        bound, found = asked["bound"].to_numpy(), [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for i in range(0, len(q) if len(own) else 0, BLOCK):
            d = _distances(q[i : i + BLOCK], own)
            fits = d <= bound[i : i + BLOCK, None]
            if strict:
                fits &= d < radius
            many = np.flatnonzero(fits.sum(axis=1) > k)
            if len(many):
                fits[many] &= d[many] <= np.partition(np.where(fits[many], d[many], np.inf), k - 1, axis=1)[:, k - 1, None]
            a, b = np.nonzero(fits)
            found.append((a + i, b, d[a, b]))
        a, b, d = (np.concatenate(x) for x in zip(*found))
        points_ = leaf["point_id"].combine_chunks().flatten() if len(own) else pa.array([], leaf.schema.field("point_id").type.value_type)
        out = {"query_id": asked["query_id"].take(pa.array(a)), "point_id": points_.take(pa.array(b))}
        return pa.table(out | {c: own[b, i] for i, c in enumerate("xyz")} | {"distance": d})

    asked = _finite(queries, "query_id").mapInArrow(deal, f"leaf int, query_id {query_type}, x double, y double, z double")
    q, at = _parted(asked, leaves)
    sent = q.groupBy("leaf", "part").cogroup(at.groupBy("leaf", "part")).applyInArrow(bounded, f"leaf int, query_id {query_type}, x double, y double, z double, bound double")
    q, at = _parted(checkpointed(sent), leaves)
    pairs = q.groupBy("leaf", "part").cogroup(at.groupBy("leaf", "part")).applyInArrow(compared, f"query_id {query_type}, point_id {id_type}, x double, y double, z double, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "point_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def merge(a: DataFrame, b: DataFrame, k: int, ascending: bool = True) -> DataFrame:
    """Two results of one query cut to the ``k`` nearest, in either order."""
    both = a.unionByName(b).orderBy("distance", "point_id").limit(k)
    return both if ascending else both.orderBy(F.desc("distance"), F.desc("point_id"))


def near_polyline(points: DataFrame, line: Sequence[Sequence[float]], radius: float, k: int | None = None) -> DataFrame:
    """Points within ``radius`` of any segment, once each, by the least distance."""
    d = [geom.segment_distance(a, b) for a, b in zip(line, line[1:])]
    low = [min(p[i] for p in line) - radius for i in range(3)]
    high = [max(p[i] for p in line) + radius for i in range(3)]
    near = points.where(geom.in_box(low, high)).withColumn("distance", F.least(*d) if len(d) > 1 else d[0]).where(F.col("distance") <= radius).orderBy("distance", "point_id")
    return near.limit(k) if k else near


def summary(near: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centroid and covariance (population) of found points."""
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz")]
    aggs += [F.covar_pop(a, b).alias(f"cov_{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return near.groupBy(*by).agg(*aggs)


def pick(points: DataFrame, matrix, region, eye: Sequence[float], limit: int | None = None) -> DataFrame:
    """Points whose projection under a 4x4 matrix lies in a screen region, nearest
    to the eye first. ``region(u, v)`` gives a Column; see :func:`box_region` etc."""
    u, v, depth = geom.transformed(matrix)
    seen = points.where((depth >= -1) & (depth <= 1) & region(u, v)).withColumn("distance", geom.distance(eye)).orderBy("distance", "point_id")
    return seen.limit(limit) if limit else seen


def box_region(lo, hi):
    return lambda u, v: u.between(float(lo[0]), float(hi[0])) & v.between(float(lo[1]), float(hi[1]))


def ellipse_region(centre, radii):
    return lambda u, v: ((u - float(centre[0])) / float(radii[0])) ** 2 + ((v - float(centre[1])) / float(radii[1])) ** 2 <= 1


def polygon_region(ring):
    return lambda u, v: geom.in_polygon(u, v, ring)
