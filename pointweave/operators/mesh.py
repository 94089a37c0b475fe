"""Meshes as tables: vertices (mesh_id, vi, x, y, z) and corners (mesh_id, fi, fs, vi).

A corner is one vertex of one face, ``fs`` its place in the face. Relational
work (edges, areas, bounds, components) is DataFrame code; cutting and
triangulating run for each mesh or face in NumPy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import cluster

Mesh = tuple[DataFrame, DataFrame]
V = "xyz"
#: A face's triangles are numbered face * FAN and up.
FAN = 1 << 24


def create(spark: SparkSession, vertices: np.ndarray, faces: Sequence[Sequence[int]], mesh_id: int = 0) -> Mesh:
    v = pd.DataFrame({"mesh_id": mesh_id, "vi": range(len(vertices)), **{a: np.asarray(vertices, float)[:, i] for i, a in enumerate(V)}})
    c = pd.DataFrame([(mesh_id, i, s, int(x)) for i, f in enumerate(faces) for s, x in enumerate(f)], columns=["mesh_id", "fi", "fs", "vi"])
    return spark.createDataFrame(v, "mesh_id long, vi long, x double, y double, z double"), spark.createDataFrame(c, "mesh_id long, fi long, fs long, vi long")


# --- primitives (vertices and faces, outward by the right-hand rule) -----------


def box(lo=(0, 0, 0), hi=(1, 1, 1)):
    v = np.array([[(hi if k >> i & 1 else lo)[i] for i in range(3)] for k in range(8)], float)
    return v, [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]


def quad(a, b, c, d):
    return np.array([a, b, c, d], float), [(0, 1, 2, 3)]


def grid(nx: int, ny: int, size=(1.0, 1.0)):
    v = np.array([(i * size[0] / nx, j * size[1] / ny, 0.0) for j in range(ny + 1) for i in range(nx + 1)])
    at = lambda i, j: j * (nx + 1) + i
    return v, [(at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)) for j in range(ny) for i in range(nx)]


def circle(n: int, radius: float = 1.0):
    t = 2 * np.pi * np.arange(n) / n
    return np.stack([radius * np.cos(t), radius * np.sin(t), 0 * t], axis=1), [tuple(range(n))]


def sphere(rings: int, sectors: int, radius: float = 1.0):
    v = [(0, 0, radius)] + [(radius * np.sin(a) * np.cos(b), radius * np.sin(a) * np.sin(b), radius * np.cos(a)) for a in np.pi * np.arange(1, rings) / rings for b in 2 * np.pi * np.arange(sectors) / sectors] + [(0, 0, -radius)]
    at = lambda i, j: 1 + (i - 1) * sectors + j % sectors
    top = [(0, at(1, j), at(1, j + 1)) for j in range(sectors)]
    low = [(len(v) - 1, at(rings - 1, j + 1), at(rings - 1, j)) for j in range(sectors)]
    return np.array(v, float), top + [(at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)) for i in range(1, rings - 1) for j in range(sectors)] + low


def cone(n: int, radius: float = 1.0, height: float = 1.0):
    ring, _ = circle(n, radius)
    return np.vstack([ring, [[0, 0, height]]]), [(i, (i + 1) % n, n) for i in range(n)] + [tuple(range(n - 1, -1, -1))]


def cylinder(n: int, radius: float = 1.0, height: float = 1.0):
    ring, _ = circle(n, radius)
    v = np.vstack([ring, ring + [0, 0, height]])
    return v, [(i, (i + 1) % n, n + (i + 1) % n, n + i) for i in range(n)] + [tuple(range(n - 1, -1, -1)), tuple(range(n, 2 * n))]


def torus(n: int, m: int, major: float = 1.0, minor: float = 0.25):
    v = np.array([((major + minor * np.cos(b)) * np.cos(a), (major + minor * np.cos(b)) * np.sin(a), minor * np.sin(b)) for a in 2 * np.pi * np.arange(n) / n for b in 2 * np.pi * np.arange(m) / m])
    at = lambda i, j: (i % n) * m + j % m
    return v, [(at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)) for i in range(n) for j in range(m)]


# --- topology -------------------------------------------------------------------


def half_edges(corners: DataFrame) -> DataFrame:
    """(mesh_id, fi, fs, v0, v1): each face's sides in order."""
    ring = Window.partitionBy("mesh_id", "fi").orderBy("fs")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return corners.select("mesh_id", "fi", "fs", F.col("vi").alias("v0"), F.coalesce(F.lead("vi").over(ring), F.first("vi").over(whole)).alias("v1"))


def edges(corners: DataFrame) -> DataFrame:
    """(mesh_id, a, b, faces): undirected edges and how many faces have each."""
    e = half_edges(corners).select("mesh_id", "fi", F.least("v0", "v1").alias("a"), F.greatest("v0", "v1").alias("b"))
    return e.where("a <> b").groupBy("mesh_id", "a", "b").agg(F.count(F.lit(1)).alias("faces"))


def border_edges(corners: DataFrame) -> DataFrame:
    return edges(corners).where("faces = 1")


def non_manifold_edges(corners: DataFrame) -> DataFrame:
    return edges(corners).where("faces > 2")


def euler(corners: DataFrame) -> DataFrame:
    """(mesh_id, vertices, edges, faces, euler) of the vertices in use."""
    own = corners.groupBy("mesh_id").agg(F.countDistinct("vi").alias("vertices"), F.countDistinct("fi").alias("faces"))
    e = edges(corners).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("edges"))
    return own.join(e, "mesh_id").select("mesh_id", "vertices", "edges", "faces", (F.col("vertices") - F.col("edges") + F.col("faces")).alias("euler"))


def opposite(corners: DataFrame) -> DataFrame:
    """Half-edges with the face and side across, null at borders: the navigation table."""
    h = half_edges(corners)
    o = h.select("mesh_id", F.col("v0").alias("v1"), F.col("v1").alias("v0"), F.col("fi").alias("other_fi"), F.col("fs").alias("other_fs"))
    return h.join(o, ["mesh_id", "v0", "v1"], "left")


def adjacency(corners: DataFrame) -> DataFrame:
    """(mesh_id, f, g, a, b), f < g: faces that share an edge."""
    e = half_edges(corners).select("mesh_id", "fi", F.least("v0", "v1").alias("a"), F.greatest("v0", "v1").alias("b"))
    left, right = e.withColumnRenamed("fi", "f"), e.withColumnRenamed("fi", "g")
    return left.join(right, ["mesh_id", "a", "b"]).where("f < g").select("mesh_id", "f", "g", "a", "b").distinct()


def face_clusters(corners: DataFrame, linked: DataFrame) -> DataFrame:
    """(mesh_id, fi, cluster): components of faces under some of the adjacency;
    cluster is the least face."""
    key = lambda f: F.struct(F.col("mesh_id").alias("m"), F.col(f).alias("f"))
    found = cluster_structs(linked.select(key("f").alias("a"), key("g").alias("b")))
    faces = corners.select("mesh_id", "fi").distinct()
    return faces.join(found, (found["node.m"] == faces["mesh_id"]) & (found["node.f"] == faces["fi"]), "left").select("mesh_id", "fi", F.coalesce(F.col("root.f"), F.col("fi")).alias("cluster"))


def cluster_structs(links: DataFrame) -> DataFrame:
    return cluster.components(links)


def connected_components(corners: DataFrame) -> DataFrame:
    return face_clusters(corners, adjacency(corners))


def planar_clusters(mesh: Mesh, cosine: float = 1 - 1e-6) -> DataFrame:
    """Components of faces whose normals agree across the shared edge."""
    v, c = mesh
    n = face_geometry(mesh).select("mesh_id", "fi", "nx", "ny", "nz")
    f = n.select("mesh_id", F.col("fi").alias("f"), *(F.col(k).alias(f"f_{k}") for k in ("nx", "ny", "nz")))
    g = n.select("mesh_id", F.col("fi").alias("g"), *(F.col(k).alias(f"g_{k}") for k in ("nx", "ny", "nz")))
    linked = adjacency(c).join(f, ["mesh_id", "f"]).join(g, ["mesh_id", "g"]).where(sum(F.col(f"f_{k}") * F.col(f"g_{k}") for k in ("nx", "ny", "nz")) >= cosine)
    return face_clusters(c, linked)


def consistent_winding(corners: DataFrame) -> DataFrame:
    """(mesh_id, conflicts): edges that two faces run through the same way."""
    return half_edges(corners).groupBy("mesh_id", "v0", "v1").count().groupBy("mesh_id").agg(F.count_if(F.col("count") > 1).alias("conflicts"))


# --- geometry --------------------------------------------------------------------


def with_positions(mesh: Mesh) -> DataFrame:
    return mesh[1].join(mesh[0], ["mesh_id", "vi"])


def _by_face(mesh: Mesh, make: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``make`` of whole faces with positions, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            last = (pdf["mesh_id"] == pdf["mesh_id"].iloc[-1]) & (pdf["fi"] == pdf["fi"].iloc[-1])
            held = pdf[last]  # may go on in the next batch
            if not last.all():
                yield make(pdf[~last])
        if held is not None:
            yield make(held)

    faces = with_positions(mesh).repartition("mesh_id", "fi").sortWithinPartitions("mesh_id", "fi", "fs")
    return faces.mapInPandas(run, schema)


def face_triangles(mesh: Mesh) -> DataFrame:
    """Fan triangles (mesh_id, fi, k, a.., b.., c..) of every face."""
    p = with_positions(mesh).groupBy("mesh_id", "fi").agg(F.array_sort(F.collect_list(F.struct("fs", "vi", "x", "y", "z"))).alias("ps"))
    p = p.where(F.size("ps") >= 3).select("mesh_id", "fi", "ps", F.explode(F.sequence(F.lit(1), F.size("ps") - 2)).alias("k"))
    corner = {"a": F.col("ps")[0], "b": F.element_at("ps", F.col("k") + 1), "c": F.element_at("ps", F.col("k") + 2)}
    return p.select("mesh_id", "fi", "k", *(s[x].alias(f"{n}{x}") for n, s in corner.items() for x in V), *(s["vi"].alias(f"{n}_vi") for n, s in corner.items()))


def as_objects(mesh: Mesh) -> DataFrame:
    """Fan triangles as objects for ray queries; object_id is (mesh_id, fi, k), which
    keeps the triangles of several meshes and of faces of any size apart."""
    t = face_triangles(mesh)
    return t.select(F.struct("mesh_id", "fi", (F.col("k") - 1).alias("k")).alias("object_id"), F.lit("triangle").alias("kind"), *(F.col(f"{n}{x}") for n in "abc" for x in V), F.lit(0.0).alias("r"))


def _fan_cross() -> list[Column]:
    e = [[F.col(f"{n}{x}") - F.col(f"a{x}") for x in V] for n in "bc"]
    return [e[0][1] * e[1][2] - e[0][2] * e[1][1], e[0][2] * e[1][0] - e[0][0] * e[1][2], e[0][0] * e[1][1] - e[0][1] * e[1][0]]


def face_geometry(mesh: Mesh) -> DataFrame:
    """(mesh_id, fi, area, nx, ny, nz, cx, cy, cz) from signed fan triangles."""
    t = face_triangles(mesh)
    for x, c in zip(V, _fan_cross()):
        t = t.withColumn(f"s{x}", c / 2)
    f = t.groupBy("mesh_id", "fi").agg(*(F.sum(f"s{x}").alias(f"s{x}") for x in V), F.collect_list(F.struct(*(f"{n}{x}" for n in "abc" for x in V), *(f"s{x}" for x in V))).alias("ts"))
    area = F.sqrt(sum(F.col(f"s{x}") ** 2 for x in V))
    f = f.withColumn("area", area)
    for x in V:
        f = f.withColumn(f"n{x}", F.col(f"s{x}") / F.nullif(F.col("area"), F.lit(0.0)))

    def centre(x: str) -> Column:
        """Mean of the fan triangles' centres by their signed areas."""

        def step(acc: Column, s: Column) -> Column:
            return acc + sum(s[f"s{k}"] * F.col(f"n{k}") for k in V) * (s[f"a{x}"] + s[f"b{x}"] + s[f"c{x}"]) / 3

        return F.aggregate("ts", F.lit(0.0), step) / F.nullif(F.col("area"), F.lit(0.0))

    return f.select("mesh_id", "fi", "area", *(f"n{x}" for x in V), *(centre(x).alias(f"c{x}") for x in V))


def bounding_boxes(mesh: Mesh) -> DataFrame:
    return with_positions(mesh).groupBy("mesh_id").agg(*(f(x).alias(f"{n}_{x}") for n, f in (("min", F.min), ("max", F.max)) for x in V))


def vertex_normals(mesh: Mesh, crease_degrees: float = 180.0) -> DataFrame:
    """(mesh_id, fi, vi, nx, ny, nz): at each corner the mean, by area, of the
    normals of the vertex' faces that lie within the crease angle of its own face."""
    g = face_geometry(mesh).select("mesh_id", "fi", "area", "nx", "ny", "nz")
    at = mesh[1].select("mesh_id", "fi", "vi").join(g, ["mesh_id", "fi"])
    own = at.select("mesh_id", "vi", "fi", *(F.col(f"n{x}").alias(f"o{x}") for x in V))
    both = own.join(at.drop("fi"), ["mesh_id", "vi"]).where(sum(F.col(f"o{x}") * F.col(f"n{x}") for x in V) >= float(np.cos(np.radians(crease_degrees))) - 1e-12)
    s = both.groupBy("mesh_id", "fi", "vi").agg(*(F.sum(F.col("area") * F.col(f"n{x}")).alias(f"s{x}") for x in V))
    length = F.nullif(F.sqrt(sum(F.col(f"s{x}") ** 2 for x in V)), F.lit(0.0))
    return s.select("mesh_id", "fi", "vi", *((F.col(f"s{x}") / length).alias(f"n{x}") for x in V))


def outline(mesh: Mesh, eye: Sequence[float]) -> DataFrame:
    """(mesh_id, a, b): border edges, and those between a face that looks at the
    eye and one that doesn't."""
    g = face_geometry(mesh)
    side = g.select("mesh_id", "fi", (sum(F.col(f"n{x}") * (float(e) - F.col(f"c{x}")) for x, e in zip(V, eye)) > 0).alias("front"))
    e = half_edges(mesh[1]).join(side, ["mesh_id", "fi"]).groupBy("mesh_id", F.least("v0", "v1").alias("a"), F.greatest("v0", "v1").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("front").alias("sides"))
    return e.where("n = 1 or sides = 2").select("mesh_id", "a", "b")


# --- editing ---------------------------------------------------------------------


def group(*meshes: Mesh) -> Mesh:
    """One mesh of several; each one's indices are moved behind those before it."""
    vs, cs, v0, f0 = [], [], 0, 0
    for v, c in meshes:
        vs.append(v.select(F.lit(0).cast("long").alias("mesh_id"), (F.col("vi") + v0).alias("vi"), *V))
        cs.append(c.select(F.lit(0).cast("long").alias("mesh_id"), (F.col("fi") + f0).alias("fi"), "fs", (F.col("vi") + v0).alias("vi")))
        v0 += (v.agg(F.max("vi")).first()[0] or 0) + 1
        f0 += (c.agg(F.max("fi")).first()[0] or 0) + 1
    out_v, out_c = vs[0], cs[0]
    for v, c in zip(vs[1:], cs[1:]):
        out_v, out_c = out_v.unionByName(v), out_c.unionByName(c)
    return out_v, out_c


def subset(mesh: Mesh, faces: Column) -> Mesh:
    """Faces that a test over (mesh_id, fi) keeps, and the vertices they use, renumbered."""
    c = mesh[1].where(faces)
    return compacted((mesh[0], c))


def compacted(mesh: Mesh) -> Mesh:
    used = mesh[1].select("mesh_id", "vi").distinct().withColumn("new", F.row_number().over(Window.partitionBy("mesh_id").orderBy("vi")) - 1)
    v = mesh[0].join(used, ["mesh_id", "vi"]).select("mesh_id", F.col("new").cast("long").alias("vi"), *V)
    c = mesh[1].join(used, ["mesh_id", "vi"]).select("mesh_id", "fi", "fs", F.col("new").cast("long").alias("vi"))
    return v, c


def without_degenerate(mesh: Mesh) -> Mesh:
    """Sides of no length go; so do faces with fewer than three corners left."""
    h = half_edges(mesh[1]).where("v0 <> v1")
    n = Window.partitionBy("mesh_id", "fi")
    c = h.withColumn("n", F.count(F.lit(1)).over(n)).where("n >= 3")
    return mesh[0], c.select("mesh_id", "fi", (F.row_number().over(n.orderBy("fs")) - 1).cast("long").alias("fs"), F.col("v0").alias("vi"))


def reversed_faces(corners: DataFrame) -> DataFrame:
    last = F.max("fs").over(Window.partitionBy("mesh_id", "fi"))
    return corners.withColumn("fs", last - F.col("fs"))


def transformed(mesh: Mesh, matrix) -> Mesh:
    from ..functions import geom

    return mesh[0].withColumns(dict(zip(V, geom.transformed(np.asarray(matrix, float))))), mesh[1]


def vertex_clustered(mesh: Mesh, delta: float) -> Mesh:
    """Vertices of one mesh closer than ``delta`` collapse to their centroid; faces
    that lose a dimension go."""
    p = mesh[0].select("mesh_id", F.struct("mesh_id", "vi").alias("point_id"), *V)
    labels = cluster.by_distance(p, delta, within=["mesh_id"])
    mean = p.join(labels, "point_id").groupBy("cluster_id").agg(*(F.avg(x).alias(x) for x in V))
    v = mean.select("cluster_id.mesh_id", "cluster_id.vi", *V)
    new = labels.select("point_id.mesh_id", "point_id.vi", F.col("cluster_id.vi").alias("new"))
    c = mesh[1].join(new, ["mesh_id", "vi"]).select("mesh_id", "fi", "fs", F.col("new").alias("vi"))
    return compacted(without_degenerate((v, c)))


def indexed_geometry(mesh: Mesh) -> DataFrame:
    """Triangle corners with positions, flat: what a renderer takes."""
    t = face_triangles(mesh)
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("corner"), *(F.col(f"{n}{x}").alias(x) for x in V)) for i, n in enumerate("abc")))).alias("p")
    return t.select("mesh_id", "fi", "k", corner).select("mesh_id", "fi", "k", "p.*")


def triangulate(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """Ears of a simple polygon (n x 2, either way round), as indices."""
    p = np.asarray(ring, float)
    area = (p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()
    left = list(range(len(p))) if area >= 0 else list(range(len(p)))[::-1]
    side = lambda a, b, c: (p[b, 0] - p[a, 0]) * (p[c, 1] - p[a, 1]) - (p[b, 1] - p[a, 1]) * (p[c, 0] - p[a, 0])
    out = []
    while len(left) > 3:
        for i in range(len(left)):
            a, b, c = left[i - 1], left[i], left[(i + 1) % len(left)]
            if side(a, b, c) > 0 and not any(side(a, b, k) >= 0 and side(b, c, k) >= 0 and side(c, a, k) >= 0 for k in left if k not in (a, b, c)):
                break
        else:
            i = next((j for j in range(len(left)) if side(left[j - 1], left[j], left[(j + 1) % len(left)]) >= 0), 0)
            a, b, c = left[i - 1], left[i], left[(i + 1) % len(left)]
        out.append((a, b, c))
        left.pop(i)
    return [*out, tuple(left)]


def triangulated(mesh: Mesh) -> Mesh:
    """Every face cut into triangles, ears where it isn't convex."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (m, f), face in pdf.groupby(["mesh_id", "fi"], sort=True):
            face = face.sort_values("fs")
            p, vi = face[list(V)].to_numpy(), face["vi"].to_numpy()
            q = np.roll(p, -1, axis=0)
            n = np.cross(p, q).sum(axis=0)
            flat = np.delete(p, int(np.abs(n).argmax()), axis=1)
            for k, tri in enumerate(triangulate(flat)):
                a, b, c = tri
                if np.dot(np.cross(p[b] - p[a], p[c] - p[a]), n) < 0:
                    tri = (a, c, b)
                rows += [(m, f * FAN + k, s, vi[i]) for s, i in enumerate(tri)]
        return pd.DataFrame(rows, columns=["mesh_id", "fi", "fs", "vi"])

    return mesh[0], _by_face(mesh, cut, "mesh_id long, fi long, fs long, vi long")


def clip(mesh: Mesh, normal: Sequence[float], offset: float) -> DataFrame:
    """Polygons (mesh_id, fi, fs, x, y, z) of the half n.p >= offset: faces that
    cross the plane are cut, face by face, with no shuffle but the join."""
    n, d = np.asarray(normal, float), float(offset)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (m, f), face in pdf.groupby(["mesh_id", "fi"], sort=True):
            p = face.sort_values("fs")[list(V)].to_numpy()
            h = p @ n - d
            kept = []
            for i in range(len(p)):
                j = (i + 1) % len(p)
                if h[i] >= 0:
                    kept.append(p[i])
                if (h[i] < 0 < h[j]) or (h[j] < 0 < h[i]):
                    kept.append(p[i] + (p[j] - p[i]) * h[i] / (h[i] - h[j]))
            if len(kept) >= 3:
                rows += [(m, f, s, *q) for s, q in enumerate(kept)]
        return pd.DataFrame(rows, columns=["mesh_id", "fi", "fs", *V])

    return _by_face(mesh, cut, "mesh_id long, fi long, fs long, x double, y double, z double")


def split(mesh: Mesh, normal: Sequence[float], offset: float) -> tuple[DataFrame, DataFrame]:
    """Both halves of a mesh at a plane."""
    return clip(mesh, normal, offset), clip(mesh, [-k for k in normal], -offset)


def draw_order(triangles: DataFrame, eye: Sequence[float], back_to_front: bool = True, by: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """Triangles (ax..cz) of each mesh in painter's order from a binary space
    partition: those that straddle a splitting plane are cut. Adds ``place``."""
    names = [f"{n}{x}" for n in "abc" for x in V]

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["object_id"].to_numpy()
        tris = [(int(i), t) for i, t in zip(ids, pdf[names].to_numpy().reshape(-1, 3, 3))]
        out = _painted(tris, np.asarray(eye, float))
        out = out if back_to_front else out[::-1]
        made = pd.DataFrame([t.ravel() for _, t in out], columns=names)
        for k in by:
            made[k] = pdf[k].iloc[0]
        made["object_id"], made["place"] = [i for i, _ in out], range(len(out))
        return made[[*by, "object_id", "place", *names]]

    schema = ", ".join([*(f"{k} {triangles.schema[k].dataType.simpleString()}" for k in by), "object_id long", "place long", *(f"{c} double" for c in names)])
    return triangles.groupBy(*by).applyInPandas(order, schema)


def _painted(tris: list, eye: np.ndarray, eps: float = 1e-9) -> list:
    """Back to front. Works off a stack, so depth is not limited by the language."""
    out, todo = [], [("tree", tris)]
    while todo:
        kind, items = todo.pop()
        if kind == "done":
            out += items
            continue
        if not items:
            continue
        _, t0 = items[len(items) // 2]
        n = np.cross(t0[1] - t0[0], t0[2] - t0[0])
        size = np.linalg.norm(n)
        if size == 0:
            items = [x for k, x in enumerate(items) if k != len(items) // 2]
            todo.append(("tree", items))
            continue
        n, here, front, back = n / size, [], [], []
        for i, t in items:
            h = (t - t0[0]) @ n
            if (np.abs(h) <= eps).all():
                here.append((i, t))
            elif (h >= -eps).all():
                front.append((i, t))
            elif (h <= eps).all():
                back.append((i, t))
            else:
                for part, keep in ((front, 1), (back, -1)):
                    poly = []
                    for a in range(3):
                        b = (a + 1) % 3
                        if h[a] * keep >= -eps:
                            poly.append(t[a])
                        if h[a] * h[b] < 0 and min(abs(h[a]), abs(h[b])) > eps:
                            poly.append(t[a] + (t[b] - t[a]) * h[a] / (h[a] - h[b]))
                    part += [(i, np.array([poly[0], poly[k], poly[k + 1]])) for k in range(1, len(poly) - 1)]
        near, far = (front, back) if (eye - t0[0]) @ n >= 0 else (back, front)
        todo += [("tree", near), ("done", here), ("tree", far)]
    return out
