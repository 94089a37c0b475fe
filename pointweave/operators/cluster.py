"""Clustering: links by grid join, then connected components by star steps."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from . import blocks


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): root is the least node reachable.

    Every step points a node's greater neighbours at its least one, then the
    same for lesser ones; the number of steps grows with the logarithm of the
    longest path. Nodes without edges are not listed.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = e.where("u = v").select("u", "v")
    e = e.where("u <> v")
    before = None
    while True:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        e = checkpointed(large.join(low, "u").select(pairs.alias("p")).select("p.u", "p.v").where("u <> v").distinct())
        state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = e.select(F.col("v").alias("u"), "v")
    return e.union(roots).union(loops.join(e, "u", "left_anti")).distinct().toDF("node", "root").groupBy("node").agg(F.min("root").alias("root"))


def label(points: DataFrame, links: DataFrame) -> DataFrame:
    """(point_id, cluster_id): the least point_id of each point's cluster."""
    found = components(links).select(F.col("node").alias("point_id"), "root")
    return points.select("point_id").join(found, "point_id", "left").select("point_id", F.coalesce("root", "point_id").alias("cluster_id"))


def by_distance(points: DataFrame, delta: float, strict: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """Single linkage: closure of distance <= delta (``strict``: < delta), apart for
    each value of the columns ``within``.

    Points are first joined to the others of their own small cell (side
    delta / 2, whose diagonal is below delta): such points are linked by one
    star. Cells are nodes, so a crowded spot costs one row, not all pairs. One point of
    each of two cells is compared first; all of them only where no chain of such links
    joins the cells already.
    """
    side = delta / 2.0
    own = [F.col(c).alias(f"w{i}") for i, c in enumerate(within)]
    cell = F.struct(*own, *(F.floor(F.col(c) / side).cast("long").alias(f"g{c}") for c in "xyz"))
    p = points.select("point_id", "x", "y", "z", cell.alias("cell"))
    star = checkpointed(p.groupBy("cell").agg(F.min("point_id").alias("a"), F.min_by(F.struct("x", "y", "z"), F.struct("point_id", "x", "y", "z")).alias("at")))
    p = p.join(star.select("cell", "a"), "cell")
    inside = p.select("a", F.col("point_id").alias("b"))
    spots = p.dropDuplicates(["a", "x", "y", "z"])
    reach = range(-3, 4)
    moves = [(i, j, k) for i in reach for j in reach for k in reach if (i, j, k) > (0, 0, 0) and sum(max(0, abs(m) - 1) ** 2 for m in (i, j, k)) * side * side <= delta * delta]
    around = F.array(*(F.struct(*(F.col(f"cell.w{i}").alias(f"w{i}") for i in range(len(own))), *((F.col(f"cell.g{c}") + m).alias(f"g{c}") for c, m in zip("xyz", move))) for move in moves))

    def close(one: list[Column], other: list[Column]) -> Column:
        d2 = sum(((u - v) ** 2 for u, v in zip(one[1:], other[1:])), (one[0] - other[0]) ** 2)
        return d2 < delta * delta if strict else d2 <= delta * delta

    # cells that meet: at most one row a pair of cells
    heads = star.withColumns({"b": F.col("a"), "bt": F.col("at")}).select("cell", "b", "bt")
    near = star.select("a", "at", F.explode(around).alias("cell")).join(heads, "cell")
    near = checkpointed(near.select("a", "b", close(*([F.col(f"{h}.{c}") for c in "xyz"] for h in ("at", "bt"))).alias("linked")))
    linked = near.where("linked").select("a", "b")
    # what the heads don't link already: cells of different components, point by point
    known = checkpointed(components(linked))
    apart = near.where("not linked")
    for c in "ab":
        apart = apart.join(known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    apart = apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    left = spots.select("a", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    right = spots.select(F.col("a").alias("b"), *(F.col(c).alias(f"q{c}") for c in "xyz"))
    meet = close(*([F.col(f"{k}{c}") for c in "xyz"] for k in "pq"))
    between = apart.join(left, "a").join(right, "b").where(meet).select("a", "b").distinct()
    joined = known.select(F.col("root").alias("a"), F.col("node").alias("b"))
    return label(points, inside.unionByName(joined).unionByName(between))


#: Vectors of a block that one task compares with another block, and of its chunks.
BLOCK, CHUNK = 1 << 15, 1 << 11


def by_vector(vectors: DataFrame, delta: float, id_col: str = "point_id", vector_col: str = "v") -> DataFrame:
    """Single linkage of vectors of any dimension, distance <= delta.

    Equal vectors are one. Blocks of a k-d tree whose boxes are within delta meet in
    a task, chunk by chunk, as matrix products (all pairs, where no box rules any out:
    vectors of many dimensions); sums too near delta for their rounding are worked out
    again. A task gives a spanning forest of its links, so their number doesn't grow
    with a cluster's pairs. Vectors with nulls or without finite values link to none.
    """
    v = vectors.select(F.col(id_col).alias("point_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = F.transform("v", lambda x: x + 0.0)  # -0.0 equals 0.0
    spots = checkpointed(v.where(finite).groupBy(plain.alias("v")).agg(F.min("point_id").alias("a"), F.max("point_id").alias("z")))
    same = v.where(finite).withColumn("v", plain).join(spots.where("a <> z"), "v").select("a", F.col("point_id").alias("b"))
    links = same
    for size, n in spots.groupBy(F.size("v")).count().collect():  # a row a dimension
        if size:
            links = links.unionByName(_vector_links(spots.where(F.size("v") == size), size, n, float(delta)))
    return label(v, links)


def _rows(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _vector_links(spots: DataFrame, size: int, n: int, delta: float) -> DataFrame:
    """Spanning forests (a, b) of distinct vectors (a, v) of one dimension."""
    leaves = math.ceil(n / min(BLOCK, max(n // 16, CHUNK // 2)))
    part = min(1.0, leaves * blocks.SAMPLED * 1.2 / n)
    sampled = (spots.sample(part, 7) if part < 1 else spots).select("v").toArrow()
    tree = blocks.Tree.of(_rows(sampled["v"], size), leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_rows(b["v"], size)), pa.int32()), b["a"], b["v"]], ["leaf", "a", "v"])

    def pack(table: pa.Table) -> pa.Table:
        v, a = _rows(table["v"], size), table["a"].to_numpy()
        order = np.argsort(blocks.Tree.of(v, math.ceil(len(v) / CHUNK)).leaf(v), kind="stable")
        made = [order[i : i + CHUNK] for i in range(0, len(v), CHUNK)]
        out = {"leaf": [table["leaf"][0].as_py()] * len(made), "a": [a[o].astype("<i8").tobytes() for o in made], "v": [v[o].astype("<f8").tobytes() for o in made]}
        out |= {"lo": [v[o].min(axis=0).tobytes() for o in made], "hi": [v[o].max(axis=0).tobytes() for o in made]}
        return pa.table(out, pa.schema([("leaf", pa.int32()), *((c, pa.binary()) for c in ("a", "v", "lo", "hi"))]))

    packed = "leaf int, a binary, v binary, lo binary, hi binary"
    chunks = checkpointed(spots.select("a", "v").mapInArrow(deal, "leaf int, a long, v array<double>").groupBy("leaf").applyInArrow(pack, packed))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in chunks.select("leaf", "lo", "hi").toLocalIterator():
        lo, hi = np.frombuffer(r.lo), np.frombuffer(r.hi)
        old = bounds.get(r.leaf, (lo, hi))
        bounds[r.leaf] = np.minimum(old[0], lo), np.maximum(old[1], hi)
    limit = delta * delta
    reach = limit * (1 + 1e-9)
    ids = sorted(bounds)
    low, high = (np.array([bounds[i][k] for i in ids]) for k in (0, 1))
    meet = [(ids[i], ids[i + int(j)]) for i in range(len(ids)) for j in np.flatnonzero(blocks.box_distance2(low[i:], high[i:], low[i], high[i]) <= reach)]
    sides = [(k, leaf, side) for k, pair in enumerate(meet) for side, leaf in enumerate(pair) if side == 0 or pair[0] != pair[1]]
    spark = spots.sparkSession

    def link(table: pa.Table) -> pa.Table:
        rows = table.select(["side", "a", "v", "lo", "hi"]).to_pylist()
        own = [np.frombuffer(r["v"], "<f8").reshape(-1, size) for r in rows]
        names = np.concatenate([np.frombuffer(r["a"], "<i8") for r in rows])
        start = np.cumsum([0, *map(len, own)])
        forest, apart = blocks.Forest(len(names)), any(r["side"] for r in rows)
        made = [_squares(x) for x in own]
        for p, r in enumerate(rows):
            for q in range(p, len(rows)):
                if apart and r["side"] == rows[q]["side"]:
                    continue
                if blocks.box_distance2(*(np.frombuffer(x[k]) for x in (r, rows[q]) for k in ("lo", "hi"))) <= reach:
                    i, j = _close(own[p], own[q], made[p], made[q], limit)
                    forest.add(i + start[p], j + start[q])
        found = names[forest.links()]
        return pa.table({"a": found[:, 0], "b": found[:, 1]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    pairs = spark.createDataFrame(sides or [(0, -1, 0)], "pair int, leaf int, side int")
    return chunks.join(F.broadcast(pairs), "leaf").repartition(len(meet) or 1, "pair").groupBy("pair").applyInArrow(link, "a long, b long")


def _squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared lengths, and factors whose product is the squared distance."""
    n, one = (x * x).sum(axis=1), np.ones((len(x), 1))
    return n, np.hstack([x, n[:, None], one]), np.hstack([-2 * x, one, n[:, None]])


def _close(x: np.ndarray, y: np.ndarray, xs: tuple, ys: tuple, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose squared distance, added up in order, is at most ``limit``."""
    scale = xs[0].max() + ys[0].max()
    slack = (x.shape[1] + 8) * 2.0**-22 * scale
    if slack <= limit / 16 and scale < 1e30:
        d2 = xs[1].astype(np.float32) @ ys[2].astype(np.float32).T
    else:
        slack = (x.shape[1] + 8) * 2.0**-51 * scale
        d2 = xs[1] @ ys[2].T
    i, j = np.divmod(np.flatnonzero((d2 <= d2.dtype.type(limit + slack)).ravel()), len(y))
    open_ = np.flatnonzero(d2[i, j] > limit - slack)
    keep = np.ones(len(i), bool)
    for at in range(0, len(open_), 1 << 16):
        o = open_[at : at + (1 << 16)]
        e, total = x[i[o]] - y[j[o]], np.zeros(len(o))
        for k in range(x.shape[1]):
            total += e[:, k] * e[:, k]
        keep[o] = total <= limit
    return i[keep], j[keep]


def equal(points: DataFrame) -> DataFrame:
    """Clusters of exactly equal positions."""
    first = points.groupBy("x", "y", "z").agg(F.min("point_id").alias("cluster_id"))
    return points.select("point_id", "x", "y", "z").join(first, ["x", "y", "z"]).select("point_id", "cluster_id")


def by_plane(planes: DataFrame, eps_normal: float, eps_offset: float) -> DataFrame:
    """Closure of nearly equal planes (point_id, nx, ny, nz, d): normals closer
    than ``eps_normal`` and offsets closer than ``eps_offset``, both strict."""
    sides = {"nx": eps_normal, "ny": eps_normal, "nz": eps_normal, "d": eps_offset}
    p = planes.select("point_id", *(F.col(c).cast("double").alias(c) for c in sides), *(F.floor(F.col(c) / s).cast("long").alias(f"g_{c}") for c, s in sides.items()))
    steps = [(a, b, c, d) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for d in (-1, 0, 1)]
    around = F.array(*(F.struct(*((F.col(f"g_{c}") + k).alias(f"g_{c}") for c, k in zip(sides, s))) for s in steps))
    left = p.select(F.col("point_id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in sides), F.explode(around).alias("g")).select("a", *(f"a_{c}" for c in sides), "g.*")
    n2 = sum((F.col(f"a_{c}") - F.col(c)) ** 2 for c in ("nx", "ny", "nz"))
    links = left.join(p, [f"g_{c}" for c in sides]).where((F.col("a") < F.col("point_id")) & (n2 < eps_normal**2) & ((F.col("a_d") - F.col("d")) ** 2 < eps_offset**2)).select("a", F.col("point_id").alias("b"))
    return label(p, links)


def by_normal(normals: DataFrame, delta: float, by: Sequence[str] = ()) -> DataFrame:
    """Greedy clusters of nearly parallel normals, in order of point_id: a normal
    joins the first cluster whose mean direction m has |m.n| >= 1 - 2 delta."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", kind="stable")
        sums, names, out = np.empty((0, 3)), [], []
        for i, n in zip(pdf["point_id"], pdf[["nx", "ny", "nz"]].to_numpy(float)):
            n = n / (np.linalg.norm(n) or 1.0)
            dots = sums @ n / np.maximum(np.linalg.norm(sums, axis=1), 1e-300) if len(sums) else np.empty(0)
            hit = np.flatnonzero(np.abs(dots) >= 1 - 2 * delta)
            if hit.size:
                sums[hit[0]] += n if dots[hit[0]] >= 0 else -n
                out.append(names[hit[0]])
            else:
                sums = np.vstack([sums, n])
                names.append(i)
                out.append(i)
        return pd.DataFrame({"point_id": pdf["point_id"], "cluster_id": out})

    return normals.groupBy(*by).applyInPandas(scan, "point_id long, cluster_id long")


def compact(labels: DataFrame) -> DataFrame:
    """(cluster_id, cluster_index, n): indices in order of the least member."""
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("cluster_index", F.row_number().over(Window.orderBy("cluster_id")) - 1)


def at_least(labels: DataFrame, n: int) -> DataFrame:
    """Clusters below ``n`` members become one rest cluster, -1."""
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    return labels.join(sizes, "cluster_id").select("point_id", F.when(F.col("_n") >= n, F.col("cluster_id")).otherwise(F.lit(-1)).cast("long").alias("cluster_id"))


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    return points.join(labels, "point_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"))


def equal_centroids(points: DataFrame, at: Sequence[Column]) -> DataFrame:
    """Centroids of clusters of points that are equal in ``at``: by those values, not
    by point_id, which rows of different clusters may share."""
    keys = [c.alias(f"_k{i}") for i, c in enumerate(at)]
    aggs = [F.min("point_id").alias("cluster_id"), F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz")]
    return points.groupBy(*keys).agg(*aggs).drop(*(f"_k{i}" for i in range(len(at))))
