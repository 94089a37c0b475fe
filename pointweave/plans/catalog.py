"""Every operator as a named query over the driver's tables, with its SQL twin."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import astro, colour, frames, geodesy, geom, sky
from ..operators import cells, cluster, filters, knn, mask, mesh, normals, octree, points, rays
from ..session import shared_path
from ..sources import ascii, binary, registry
from ..streaming import ingest
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def n(v: float) -> str:
    """A DOUBLE literal."""
    return f"({float(v)!r})" if "e" in repr(float(v)) else f"({float(v)!r}e0)"


def add(name: str, query: Query, sql: str | None = None, views_sql: bool = True) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = views.sql(sql) if views_sql else sql


SOURCES = {"li": views.lineitem_points, "emb": views.embedding_points, "ev": views.event_points}
XYZ = ["point_id", "x", "y", "z"]


def predicate(name: str, view: str, test: Callable[[], Column] | Column, sql: str, box=None) -> None:
    """Rows and count of a predicate as two queries."""
    make = test if callable(test) else lambda: test
    add(name, lambda s, d: points.where(SOURCES[view](s, d), make(), box() if callable(box) else box).select(*XYZ), f"SELECT point_id, x, y, z FROM {view} WHERE {sql}")
    add(f"{name}_count", lambda s, d: points.count(SOURCES[view](s, d), make()), f"SELECT count(*) FILTER (WHERE {sql}) AS n FROM {view}")


def filtered(name: str, view: str, f: filters.PointFilter, sql: str) -> None:
    """A view filter after a round trip through JSON."""
    add(name, lambda s, d: filters.from_json(f.to_json()).apply(SOURCES[view](s, d)).select(*XYZ), f"SELECT point_id, x, y, z FROM {view} WHERE {sql}")


def dot_sql(v, p=("x", "y", "z")) -> str:
    return " + ".join(f"{n(a)} * {b}" for a, b in zip(v, p))


# --- predicates ------------------------------------------------------------------

LO, HI = (10.0, 20.0, 2.0), (30.0, 60.0, 7.0)
BOX = f"x BETWEEN {n(10)} AND {n(30)} AND y BETWEEN {n(20)} AND {n(60)} AND z BETWEEN {n(2)} AND {n(7)}"
BOX_XY = f"x BETWEEN {n(10)} AND {n(30)} AND y BETWEEN {n(20)} AND {n(60)}"

add("all_points", lambda s, d: views.lineitem_points(s, d), "SELECT point_id, x, y, z, intensity, classification, part_index FROM li")
predicate("box3d_inside", "li", lambda: geom.in_box(LO, HI), BOX)
predicate("box3d_outside", "li", lambda: ~geom.in_box(LO, HI), f"NOT ({BOX})")
predicate("boxxy_inside", "li", lambda: geom.in_box(LO[:2], HI[:2], (F.col("x"), F.col("y"))), BOX_XY)
predicate("boxxy_outside", "li", lambda: ~geom.in_box(LO[:2], HI[:2], (F.col("x"), F.col("y"))), f"NOT ({BOX_XY})")
predicate("boxxy_half_open", "li", lambda: geom.in_box_half_open(LO[:2], HI[:2], (F.col("x"), F.col("y"))), f"x >= {n(10)} AND x < {n(30)} AND y >= {n(20)} AND y < {n(60)}")
add("exists_in_box", lambda s, d: views.lineitem_points(s, d).where(geom.in_box(LO, HI)).limit(1).agg((F.count(F.lit(1)) > 0).alias("found")), f"SELECT count(*) > 0 AS found FROM li WHERE {BOX}")

HULL = [((1.0, 0.0, 0.0), 35.0), ((-1.0, 0.0, 0.0), -5.0), ((0.0, 1.0, 0.0), 80.0), ((0.0, -1.0, 0.0), -10.0), ((0.0, 0.0, 1.0), 8.0), ((0.0, 0.0, -1.0), 0.0), ((1.0, 0.5, 0.25), 60.0)]
HULL_SQL = " AND ".join(f"({dot_sql(v)}) - {n(d)} <= 0" for v, d in HULL)
predicate("hull_inside", "li", lambda: geom.in_hull(HULL), HULL_SQL, lambda: geom.hull_bounds(HULL))
predicate("hull_outside", "li", lambda: ~geom.in_hull(HULL), f"NOT ({HULL_SQL})")
CORNER = [((1.0, 0.0, 0.0), 40.0), ((0.0, 1.0, 0.0), 60.0)]
predicate("hull_reversed", "li", lambda: geom.beyond_hull(CORNER), " AND ".join(f"({dot_sql(v)}) - {n(d)} >= 0" for v, d in CORNER))

VIEW = np.array([[1.5, 0.0, 0.0, -30.0], [0.0, 1.2, 0.0, -50.0], [0.0, 0.0, 1.0, 10.0], [0.0, 0.0, 1.0, 20.0]])
VIEW[2] = [0.0, 0.0, 1.2, 5.0]
FRUSTUM = geom.frustum_planes(VIEW)
predicate("frustum_inside", "li", lambda: geom.in_hull(FRUSTUM), " AND ".join(f"({dot_sql(v)}) - {n(d)} <= 0" for v, d in FRUSTUM), lambda: geom.hull_bounds(FRUSTUM))

PLANES = [((0.0, 0.6, 0.8), 30.0), ((1.0, 0.0, 0.0), 25.0)]


def _near(v, d, within) -> str:
    k = float(np.linalg.norm(v))
    return f"abs(({dot_sql(np.asarray(v, float) / k)}) - {n(d / k)}) <= {n(within)}"


predicate("near_plane", "li", lambda: geom.near_plane(*PLANES[0], 0.75), _near(*PLANES[0], 0.75))
predicate("near_any_plane", "li", lambda: geom.any_of([geom.near_plane(v, d, 0.75) for v, d in PLANES]), " OR ".join(_near(v, d, 0.75) for v, d in PLANES))
predicate("not_near_plane", "li", lambda: ~geom.near_plane(*PLANES[0], 0.75), f"NOT ({_near(*PLANES[0], 0.75)})")
predicate("not_near_any_plane", "li", lambda: ~geom.any_of([geom.near_plane(v, d, 0.75) for v, d in PLANES]), f"NOT ({' OR '.join(_near(v, d, 0.75) for v, d in PLANES)})")

RINGS = [[(10.0, 20.0, 5.0), (40.0, 22.0, 5.0), (36.0, 70.0, 5.0), (22.0, 40.0, 5.0)], [(5.0, 5.0, 2.0), (20.0, 5.0, 2.0), (20.0, 15.0, 2.0)]]


def inside_ring_sql(u: str, v: str, ring) -> str:
    parts = []
    for (u1, v1), (u2, v2) in zip(ring, [*ring[1:], ring[0]]):
        if v1 != v2:
            parts.append(f"CAST((({n(v1)} > {v}) <> ({n(v2)} > {v})) AND {u} < {n(u2 - u1)} * ({v} - {n(v1)}) / {n(v2 - v1)} + {n(u1)} AS INTEGER)")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def near_ring_sql(ring, within: float) -> str:
    k, d, a, b = geom.plane_frame(ring)
    flat = [(float(np.dot(q, a)), float(np.dot(q, b))) for q in ring]
    return f"(abs(({dot_sql(k)}) - {n(d)}) <= {n(within)} AND {inside_ring_sql(f'({dot_sql(a)})', f'({dot_sql(b)})', flat)})"


predicate("near_polygon", "li", lambda: geom.near_polygon(RINGS[0], 1.5), near_ring_sql(RINGS[0], 1.5))
predicate("near_any_polygon", "li", lambda: geom.any_of([geom.near_polygon(r, 1.5) for r in RINGS]), " OR ".join(near_ring_sql(r, 1.5) for r in RINGS))
predicate("not_near_polygon", "li", lambda: ~geom.near_polygon(RINGS[0], 1.5), f"NOT {near_ring_sql(RINGS[0], 1.5)}")
predicate("not_near_any_polygon", "li", lambda: ~geom.any_of([geom.near_polygon(r, 1.5) for r in RINGS]), f"NOT ({' OR '.join(near_ring_sql(r, 1.5) for r in RINGS)})")

O, D = (5.0, 10.0, 1.0), (3.0, 6.0, 0.5)
T_SQL = f"((({n(D[0])} * (x - {n(O[0])}) + {n(D[1])} * (y - {n(O[1])}) + {n(D[2])} * (z - {n(O[2])}))) / {n(float(np.dot(D, D)))})"


def _line_sql(o, d, t: str) -> str:
    e = [f"({a} - ({n(p)} + {t} * {n(q)}))" for a, p, q in zip("xyz", o, d)]
    return f"sqrt({' + '.join(f'{k} * {k}' for k in e)})"


add(
    "near_ray_range",
    lambda s, d: points.near_ray(views.lineitem_points(s, d), O, D, 2.0, 1.0, 8.0).select("point_id", F.round("t", 6).alias("t"), F.round("distance", 6).alias("distance")),
    f"SELECT point_id, round(t, 6) AS t, round({_line_sql(O, D, 't')}, 6) AS distance FROM (SELECT *, {T_SQL} AS t FROM li) WHERE t BETWEEN {n(1)} AND {n(8)} AND {_line_sql(O, D, 't')} <= {n(2)}",
)
add(
    "ray_order",
    lambda s, d: points.near_ray(views.lineitem_points(s, d), O, D, 2.0, 1.0, 8.0).orderBy("t", "point_id").limit(50).select("point_id"),
    f"SELECT point_id FROM (SELECT *, {T_SQL} AS t FROM li) WHERE t BETWEEN {n(1)} AND {n(8)} AND {_line_sql(O, D, 't')} <= {n(2)} ORDER BY t, point_id LIMIT 50",
)
P1 = tuple(a + 6 * b for a, b in zip(O, D))
SEG = tuple(b - a for a, b in zip(O, P1))
SEG_T = f"greatest({n(0)}, least({n(1)}, ({' + '.join(f'{n(b)} * ({c} - {n(a)})' for a, b, c in zip(O, SEG, 'xyz'))}) / {n(float(np.dot(SEG, SEG)))}))"
add(
    "near_segment",
    lambda s, d: points.near_segment(views.lineitem_points(s, d), O, P1, 2.0).select("point_id", "intensity", F.round("distance", 6).alias("distance")),
    f"SELECT point_id, intensity, round({_line_sql(O, SEG, 't')}, 6) AS distance FROM (SELECT *, {SEG_T} AS t FROM li) WHERE {_line_sql(O, SEG, 't')} <= {n(2)}",
)
# without a range the ray is clipped to the cloud's box; the SQL does the same in closed form
CLIP = "WITH b AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM li), r AS (SELECT greatest(0e0, {near}) AS t0, least({far}) AS t1 FROM b)"
CLIP = CLIP.format(
    near=", ".join(f"least((l{a} - {n(o)}) / {n(k)}, (h{a} - {n(o)}) / {n(k)})" for a, o, k in zip("xyz", O, D)),
    far=", ".join(f"greatest((l{a} - {n(o)}) / {n(k)}, (h{a} - {n(o)}) / {n(k)})" for a, o, k in zip("xyz", O, D)),
)
add(
    "near_ray_clipped",
    lambda s, d: points.near_ray(views.lineitem_points(s, d), O, D, 2.0).select("point_id", F.round("distance", 6).alias("distance")),
    f"{CLIP} SELECT point_id, round({_line_sql(O, D, 'c')}, 6) AS distance FROM (SELECT li.*, least(t1, greatest(t0, {T_SQL})) AS c FROM li, r WHERE t0 <= t1) WHERE {_line_sql(O, D, 'c')} <= {n(2)}",
)

# --- view filters ----------------------------------------------------------------

SPHERE = f"(x - {n(25)}) * (x - {n(25)}) + (y - {n(50)}) * (y - {n(50)}) + (z - {n(5)}) * (z - {n(5)}) <= {n(100)}"
RING2 = ((10.0, 20.0), (40.0, 22.0), (36.0, 70.0), (22.0, 40.0))
filtered("filter_box", "li", filters.InsideBox(LO, HI), BOX)
filtered("filter_outside_box", "li", filters.OutsideBox(LO, HI), f"NOT ({BOX})")
filtered("filter_hull", "li", filters.InsideHull(tuple(HULL)), HULL_SQL)
filtered("filter_hulls", "li", filters.InsideHulls((tuple(HULL), tuple(geom.hull_of_box((40, 80, 0), (50, 100, 5))))), f"({HULL_SQL}) OR (x BETWEEN {n(40)} AND {n(50)} AND y BETWEEN {n(80)} AND {n(100)} AND z BETWEEN {n(0)} AND {n(5)})")
filtered("filter_prism", "li", filters.InsidePrism((RING2,), 1.0, 6.0), f"z BETWEEN {n(1)} AND {n(6)} AND {inside_ring_sql('x', 'y', RING2)}")
filtered("filter_sphere", "li", filters.InsideSphere((25.0, 50.0, 5.0), 10.0), SPHERE)
filtered("filter_classification", "li", filters.Classification(frozenset({0, 2})), "classification IN (0, 2)")
filtered("filter_classification_except", "li", filters.Classification.all_except(0, range(5, 9)), "classification NOT IN (0, 5, 6, 7, 8)")
filtered("filter_intensity", "li", filters.Intensity(2, 5), "intensity BETWEEN 2 AND 5")
filtered("filter_and", "li", filters.InsideBox(LO, HI) & filters.Intensity(2, 5), f"{BOX} AND intensity BETWEEN 2 AND 5")
filtered("filter_or", "li", filters.InsideBox(LO, HI) | filters.InsideSphere((25.0, 50.0, 5.0), 10.0), f"({BOX}) OR ({SPHERE})")
_DIR = np.array([0.0, 0.6, 0.8])
_CROSS = [f"({n(_DIR[1])} * nz - {n(_DIR[2])} * ny)", f"({n(_DIR[2])} * nx - {n(_DIR[0])} * nz)", f"({n(_DIR[0])} * ny - {n(_DIR[1])} * nx)"]
filtered("filter_normal_direction", "emb", filters.NormalDirection((0.0, 0.6, 0.8), 10.0), f"{' + '.join(f'{k} * {k}' for k in _CROSS)} <= {n(math.sin(math.radians(10)) ** 2)}")
MASK_A = mask.of_polygon([(-0.5, -0.5), (0.5, -0.5), (0.5, 0.6), (-0.4, 0.3)], np.diag([0.04, 0.02, 0.1, 1.0]) + np.array([[0, 0, 0, -1], [0, 0, 0, -1], [0, 0, 0, 0], [0, 0, 0, 0]]))
MASK_B = mask.of_polygon([(0.0, 0.0), (0.9, 0.0), (0.9, 0.9)], MASK_A.matrix)


def _mask_sql(m: mask.Mask) -> str:
    u, v, w, k = (f"({dot_sql(r[:3])} + {n(r[3])})" for r in m.matrix)
    tests = []
    for t in m.triangles:
        s = [f"{n(q[0] - p[0])} * ({v} / {k} - {n(p[1])}) - {n(q[1] - p[1])} * ({u} / {k} - {n(p[0])})" for p, q in zip(t, [*t[1:], t[0]])]
        tests.append("(" + " AND ".join(f"{e} >= 0" for e in s) + ") OR (" + " AND ".join(f"{e} <= 0" for e in s) + ")")
    return f"(({w} / {k}) >= 0 AND ({' OR '.join(f'({t})' for t in tests)}))"


for _name, _m, _op in (("mask_and", MASK_A & MASK_B, "{a} AND {b}"), ("mask_or", MASK_A | MASK_B, "{a} OR {b}"), ("mask_xor", MASK_A ^ MASK_B, "{a} <> {b}"), ("mask_subtract", MASK_A - MASK_B, "{a} AND NOT {b}")):
    predicate(_name, "li", (lambda m: lambda: mask.from_json(m.to_json()).column())(_m), _op.format(a=_mask_sql(MASK_A), b=_mask_sql(MASK_B)))

# --- aggregates, thinning, cells -----------------------------------------------------

add("count_points", lambda s, d: views.lineitem_points(s, d).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM li")
add(
    "bounds",
    lambda s, d: views.lineitem_points(s, d).agg(*(f(a).alias(f"{k}_{a}") for k, f in (("min", F.min), ("max", F.max)) for a in "xyz")),
    "SELECT min(x) min_x, min(y) min_y, min(z) min_z, max(x) max_x, max(y) max_y, max(z) max_z FROM li",
)
add("part_range", lambda s, d: points.part_range(views.lineitem_points(s, d)), "SELECT min(part_index) AS part_min, max(part_index) AS part_max FROM li")
add(
    "dedup",
    lambda s, d: points.deduplicate(views.lineitem_points(s, d).select(*XYZ)).select(*XYZ),
    "SELECT point_id, x, y, z FROM li QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY point_id) = 1",
)
add(
    "dedup_per_part",
    lambda s, d: points.deduplicate(views.lineitem_points(s, d).withColumn("y", F.floor("y") + 0.0), ["part_index"]).select(*XYZ, "part_index"),
    "SELECT point_id, x, floor(y) AS y, z, part_index FROM li QUALIFY row_number() OVER (PARTITION BY part_index, x, floor(y), z ORDER BY point_id) = 1",
)
add(
    "grid_thin",
    lambda s, d: points.thin_by_cell(views.lineitem_points(s, d), 3.0).select(*XYZ),
    "SELECT point_id, x, y, z FROM li QUALIFY row_number() OVER (PARTITION BY floor(x / 4e0), floor(y / 4e0), floor(z / 4e0) ORDER BY point_id) = 1",
)
add("seq_thin", lambda s, d: points.thin_sequentially(views.lineitem_points(s, d), 5.0, "chebyshev", ["part_index"]).select(*XYZ))
add("seq_thin_l2", lambda s, d: points.thin_sequentially(views.lineitem_points(s, d), 5.0, "euclid", ["part_index"]).select(*XYZ))
_STATS = "count(*) AS n, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z"
_CELL = "CAST(floor({0} / {1}) AS BIGINT)"


def cell_sql(axes: str, side: float, prefix: str = "c") -> str:
    return ", ".join(f"{_CELL.format(a, n(side))} AS {prefix}{a}" for a in axes)


add("cell_counts", lambda s, d: cells.cells(views.lineitem_points(s, d), 3), f"SELECT {cell_sql('xyz', 8)}, {_STATS} FROM li GROUP BY ALL")
add("cell_stride", lambda s, d: cells.cells(views.lineitem_points(s, d), 2, (2, 2, 1)), f"SELECT * FROM (SELECT {cell_sql('xyz', 4)}, {_STATS} FROM li GROUP BY ALL) WHERE cx % 2 = 0 AND cy % 2 = 0")
add("column_counts", lambda s, d: cells.columns(views.lineitem_points(s, d), 2), f"SELECT {cell_sql('xy', 4)}, {_STATS} FROM li GROUP BY ALL")
add("column_stride", lambda s, d: cells.columns(views.lineitem_points(s, d), 1, (3, 2)), f"SELECT * FROM (SELECT {cell_sql('xy', 2)}, {_STATS} FROM li GROUP BY ALL) WHERE cx % 3 = 0 AND cy % 2 = 0")
add("grid_xy", lambda s, d: cells.grid_xy(views.lineitem_points(s, d), (2.5, 7.5)), f"SELECT {_CELL.format('x', n(2.5))} AS tx, {_CELL.format('y', n(7.5))} AS ty, {_STATS} FROM li GROUP BY ALL")
add("in_cell", lambda s, d: cells.in_cell(views.lineitem_points(s, d), (1, 3, 0), 3).select(*XYZ), f"SELECT point_id, x, y, z FROM li WHERE x BETWEEN {n(8)} AND {n(16)} AND y BETWEEN {n(24)} AND {n(32)} AND z BETWEEN {n(0)} AND {n(8)}")
add("in_column", lambda s, d: cells.in_cell(views.lineitem_points(s, d), (1, 3), 3).select(*XYZ), f"SELECT point_id, x, y, z FROM li WHERE x BETWEEN {n(8)} AND {n(16)} AND y BETWEEN {n(24)} AND {n(32)}")
add("centred_cell", lambda s, d: cells.centred_cell(views.embedding_points(s, d), -2).select(*XYZ), f"SELECT point_id, x, y, z FROM emb WHERE x BETWEEN {n(-0.125)} AND {n(0.125)} AND y BETWEEN {n(-0.125)} AND {n(0.125)} AND z BETWEEN {n(-0.125)} AND {n(0.125)}")
_KERNEL = "WITH c AS (SELECT {cells}, count(*) AS n FROM li GROUP BY ALL) SELECT {keys}, any_value(a.n) AS own, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS around, count(b.n) AS cells_around FROM c a LEFT JOIN c b ON {on} GROUP BY {group}"


def kernel_sql(axes: str, side: float, outer: int, inner: int | None = None) -> str:
    near = " AND ".join(f"b.c{a} BETWEEN a.c{a} - {outer} AND a.c{a} + {outer}" for a in axes)
    hole = "" if inner is None else " AND NOT (" + " AND ".join(f"b.c{a} BETWEEN a.c{a} - {inner} AND a.c{a} + {inner}" for a in axes) + ")"
    return _KERNEL.format(cells=cell_sql(axes, side), keys=", ".join(f"a.c{a}" for a in axes), on=near + hole, group=", ".join(f"a.c{a}" for a in axes))


add("cell_kernel", lambda s, d: cells.neighbourhoods(cells.cells(views.lineitem_points(s, d), 3), [(-1,) * 3, (1,) * 3]), kernel_sql("xyz", 8, 1))
add("cell_kernel_ring", lambda s, d: cells.neighbourhoods(cells.cells(views.lineitem_points(s, d), 3), [(-2,) * 3, (2,) * 3], [(-1,) * 3, (1,) * 3]), kernel_sql("xyz", 8, 2, 1))
add("column_kernel", lambda s, d: cells.neighbourhoods(cells.columns(views.lineitem_points(s, d), 2), [(-1,) * 2, (1,) * 2], [(0, 0), (0, 0)], "xy"), kernel_sql("xy", 4, 1, 0))
add("quad_children", lambda s, d: cells.quad_children(cells.columns(views.lineitem_points(s, d), 1)), f"SELECT {cell_sql('xy', 4)}, count(*) AS n FROM li GROUP BY ALL")
add(
    "column_cells",
    lambda s, d: cells.column_cells(views.lineitem_points(s, d), 2),
    f"WITH c AS (SELECT {cell_sql('xyz', 4)}, count(*) AS n FROM li GROUP BY ALL) SELECT cx, cy, cz, n, CAST(sum(n) OVER (PARTITION BY cx, cy) AS BIGINT) AS total, count(*) OVER (PARTITION BY cx, cy) AS cells FROM c",
)
add("group_by_class", lambda s, d: views.lineitem_points(s, d).groupBy("classification", "part_index").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("top")), "SELECT classification, part_index, count(*) AS n, max(y) AS top FROM li GROUP BY ALL")
add("delete_box", lambda s, d: points.delete(views.lineitem_points(s, d), geom.in_box(LO, HI)).select(*XYZ), f"SELECT point_id, x, y, z FROM li WHERE NOT ({BOX})")
add("delete_class", lambda s, d: points.delete(views.lineitem_points(s, d), (F.col("classification") == 1) & (F.col("part_index") < 4)).select(*XYZ), "SELECT point_id, x, y, z FROM li WHERE NOT (classification = 1 AND part_index < 4)")
add(
    "merge_clouds",
    lambda s, d: points.union(views.lineitem_points(s, d), views.embedding_points(s, d)).select(*XYZ, "intensity", "nx"),
    "SELECT point_id, x, y, z, intensity, NULL::DOUBLE AS nx FROM li UNION ALL SELECT point_id, x, y, z, NULL::INTEGER, nx FROM emb",
)
add("defaults", lambda s, d: points.with_defaults(points.union(views.lineitem_points(s, d), views.embedding_points(s, d))).select("point_id", "intensity", "nx"), "SELECT point_id, intensity, 0e0 AS nx FROM li UNION ALL SELECT point_id, 0, nx FROM emb")
_M = np.array([[0.0, -1.0, 0.0, 5.0], [1.0, 0.0, 0.0, -2.0], [0.0, 0.0, 2.0, 1.0], [0.0, 0.0, 0.0, 1.0]])
add("transform_points", lambda s, d: points.transform_points(views.lineitem_points(s, d), _M).select("point_id", *(F.round(a, 6).alias(a) for a in "xyz")), "SELECT point_id, round(5e0 - y, 6) AS x, round(x - 2e0, 6) AS y, round(2e0 * z + 1e0, 6) AS z FROM li")
add("set_operations", lambda s, d: views.lineitem_points(s, d).where(geom.in_box(LO, HI)).select(*XYZ).exceptAll(views.lineitem_points(s, d).where(filters.InsideSphere((25.0, 50.0, 5.0), 10.0).column(XYZ)).select(*XYZ)), f"SELECT point_id, x, y, z FROM li WHERE {BOX} EXCEPT ALL SELECT point_id, x, y, z FROM li WHERE {SPHERE}")
add("content_hash", lambda s, d: points.content_hash(views.lineitem_points(s, d)))

# --- nearest neighbours --------------------------------------------------------------

Q = (25.0, 50.0, 5.0)
_DQ = f"sqrt((x - {n(25)}) * (x - {n(25)}) + (y - {n(50)}) * (y - {n(50)}) + (z - {n(5)}) * (z - {n(5)}))"
add("knn_one", lambda s, d: knn.nearest(views.lineitem_points(s, d), Q, 6.0, 100).select("point_id", F.round("distance", 6).alias("distance")), f"SELECT point_id, round({_DQ}, 6) AS distance FROM li WHERE {_DQ} <= {n(6)} ORDER BY {_DQ}, point_id LIMIT 100")
add("radius_search", lambda s, d: knn.nearest(views.lineitem_points(s, d), Q, 3.0).select("point_id", F.round("distance", 6).alias("distance")), f"SELECT point_id, round({_DQ}, 6) AS distance FROM li WHERE {_DQ} <= {n(3)}")
_PAIR = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"


def _emb_queries(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = views.embedding_points(s, d)
    return p.select(F.col("point_id").alias("query_id"), "x", "y", "z"), p


add(
    "knn_batch",
    lambda s, d: knn.nearest_join(*_emb_queries(s, d), 0.06, 8).select("query_id", "point_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")),
    f"WITH p AS (SELECT a.point_id AS query_id, b.point_id, {_PAIR} AS d FROM emb a JOIN emb b ON {_PAIR} <= {n(0.06)}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, point_id) AS rank FROM p) SELECT query_id, point_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 8",
)
add(
    "knn_merge",
    lambda s, d: knn.merge(knn.nearest(views.lineitem_points(s, d), Q, 6.0, 20).select("point_id", "distance"), knn.nearest(views.lineitem_points(s, d).where("classification = 1"), Q, 6.0, 20).select("point_id", "distance"), 15, False).select("point_id", F.round("distance", 6).alias("distance")),
    f"WITH a AS (SELECT point_id, {_DQ} AS d FROM li WHERE {_DQ} <= {n(6)} ORDER BY 2, 1 LIMIT 20), b AS (SELECT point_id, {_DQ} AS d FROM li WHERE {_DQ} <= {n(6)} AND classification = 1 ORDER BY 2, 1 LIMIT 20) SELECT point_id, round(d, 6) AS distance FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY d, point_id LIMIT 15",
)
LINE = [(5.0, 10.0, 1.0), (20.0, 40.0, 3.0), (40.0, 45.0, 8.0)]


def _segment_sql(p, q) -> str:
    e = np.subtract(q, p)
    t = f"greatest({n(0)}, least({n(1)}, ({' + '.join(f'{n(k)} * ({c} - {n(a)})' for a, k, c in zip(p, e, 'xyz'))}) / {n(float(e @ e))}))"
    return _line_sql(p, e, t)


_POLY = f"least({_segment_sql(LINE[0], LINE[1])}, {_segment_sql(LINE[1], LINE[2])})"
add("near_polyline", lambda s, d: knn.near_polyline(views.lineitem_points(s, d), LINE, 1.5).select("point_id", F.round("distance", 6).alias("distance")), f"SELECT point_id, round(d, 6) AS distance FROM (SELECT point_id, {_POLY} AS d FROM li) WHERE d <= {n(1.5)}")
add(
    "neighbour_summary",
    lambda s, d: knn.summary(knn.nearest(views.lineitem_points(s, d), Q, 6.0)).select("n", *(F.round(c, 5).alias(c) for c in ("cx", "cy", "cz", "cov_xx", "cov_xy", "cov_zz"))),
    f"SELECT count(*) AS n, round(avg(x), 5) AS cx, round(avg(y), 5) AS cy, round(avg(z), 5) AS cz, round(covar_pop(x, x), 5) AS cov_xx, round(covar_pop(x, y), 5) AS cov_xy, round(covar_pop(z, z), 5) AS cov_zz FROM li WHERE {_DQ} <= {n(6)}",
)
_SCREEN = np.array([[0.04, 0.0, 0.0, -1.0], [0.0, 0.02, 0.0, -1.0], [0.0, 0.0, 0.2, -1.0], [0.0, 0.0, 0.0, 1.0]])
_U, _V = f"({n(0.04)} * x + {n(-1)})", f"({n(0.02)} * y + {n(-1)})"
add("pick_box", lambda s, d: knn.pick(views.lineitem_points(s, d), _SCREEN, knn.box_region((-0.2, -0.3), (0.3, 0.1)), Q, 40).select("point_id"), f"SELECT point_id FROM li WHERE {n(0.2)} * z - 1 BETWEEN -1 AND 1 AND {_U} BETWEEN {n(-0.2)} AND {n(0.3)} AND {_V} BETWEEN {n(-0.3)} AND {n(0.1)} ORDER BY {_DQ}, point_id LIMIT 40")
add("pick_ellipse", lambda s, d: knn.pick(views.lineitem_points(s, d), _SCREEN, knn.ellipse_region((0.1, 0.0), (0.25, 0.5)), Q).select("point_id"), f"SELECT point_id FROM li WHERE {n(0.2)} * z - 1 BETWEEN -1 AND 1 AND pow(({_U} - {n(0.1)}) / {n(0.25)}, 2) + pow(({_V} - {n(0)}) / {n(0.5)}, 2) <= 1")
_TRI = [(-0.5, -0.5), (0.6, -0.4), (0.1, 0.7)]
add("pick_polygon", lambda s, d: knn.pick(views.lineitem_points(s, d), _SCREEN, knn.polygon_region(_TRI), Q).select("point_id"), f"SELECT point_id FROM li WHERE {n(0.2)} * z - 1 BETWEEN -1 AND 1 AND {inside_ring_sql(_U, _V, _TRI)}")

# --- octree ----------------------------------------------------------------------------

LIMIT = 512
LI_ROOT = octree.Root((0.0, 0.0, 0.0), 7, False)  # of lineitem's points at any size


def _tree(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = views.lineitem_points(s, d)
    return p, octree.nodes(p, LI_ROOT, LIMIT)


#: Points are counted at the deepest level once and rolled up; a leaf has few points
#: and a parent with many.
_UP = "".join(f", c{i} AS (SELECT {i} AS level, cx >> 1 AS cx, cy >> 1 AS cy, cz >> 1 AS cz, CAST(sum(n) AS BIGINT) AS n FROM c{i + 1} GROUP BY ALL)" for i in range(20, -1, -1))
TREE = f"""WITH t AS (SELECT li.*, CAST(floor(x / 128e0 * 2097152e0) AS BIGINT) AS tx, CAST(floor(y / 128e0 * 2097152e0) AS BIGINT) AS ty, CAST(floor(z / 128e0 * 2097152e0) AS BIGINT) AS tz FROM li),
c21 AS (SELECT 21 AS level, tx AS cx, ty AS cy, tz AS cz, count(*) AS n FROM t GROUP BY ALL){_UP},
c AS ({" UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(22))}),
nodes AS (SELECT c.*, (c.n <= {LIMIT} OR c.level = 21) AS is_leaf FROM c LEFT JOIN c p ON p.level = c.level - 1 AND p.cx = c.cx >> 1 AND p.cy = c.cy >> 1 AND p.cz = c.cz >> 1 WHERE c.level = 0 OR p.n > {LIMIT})"""
add("octree_nodes", lambda s, d: _tree(s, d)[1], f"{TREE} SELECT level, cx, cy, cz, n, is_leaf FROM nodes")
add(
    "octree_stats",
    lambda s, d: octree.tree_stats(_tree(s, d)[1]).withColumns({c: F.round(c, 6) for c in ("avg_leaf", "avg_depth")}),
    f"{TREE} SELECT count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, CAST(sum(n) FILTER (is_leaf) AS BIGINT) AS points, min(n) FILTER (is_leaf) AS min_leaf, max(n) FILTER (is_leaf) AS max_leaf, round(avg(n) FILTER (is_leaf), 6) AS avg_leaf, min(level + 1) FILTER (is_leaf) AS min_depth, max(level + 1) FILTER (is_leaf) AS max_depth, round(avg(level + 1) FILTER (is_leaf), 6) AS avg_depth FROM nodes",
)
_LEAF = "leaf AS (SELECT nodes.*, t.* EXCLUDE (tx, ty, tz) FROM nodes JOIN t ON nodes.is_leaf AND t.tx >> (21 - level) = cx AND t.ty >> (21 - level) = cy AND t.tz >> (21 - level) = cz)"
add(
    "octree_leaf_stats",
    lambda s, d: (lambda p, t: octree.with_stats(octree.assign(p, t, LI_ROOT)).select(*octree.KEYS, "count_cell", *(f"bb_{k}_{a}" for k in ("min", "max") for a in "xyz"), "part_min", "part_max", *(F.round(F.col(f"centroid_{a}") + 1e-9, 5).alias(f"centroid_{a}") for a in "xyz")))(*_tree(s, d)),
    f"{TREE}, {_LEAF} SELECT level, cx, cy, cz, count(*) AS count_cell, min(x) AS bb_min_x, min(y) AS bb_min_y, min(z) AS bb_min_z, max(x) AS bb_max_x, max(y) AS bb_max_y, max(z) AS bb_max_z, min(part_index) AS part_min, max(part_index) AS part_max, round(avg(x) + 1e-9, 5) AS centroid_x, round(avg(y) + 1e-9, 5) AS centroid_y, round(avg(z) + 1e-9, 5) AS centroid_z FROM leaf GROUP BY level, cx, cy, cz",
)
add(
    "approx_count",
    lambda s, d: (lambda p, t: octree.approximate_count(octree.with_stats(octree.assign(p, t, LI_ROOT)), LO, HI))(*_tree(s, d)),
    f"{TREE}, {_LEAF}, b AS (SELECT count(*) AS n, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM leaf GROUP BY level, cx, cy, cz) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM b WHERE hx >= {n(LO[0])} AND lx <= {n(HI[0])} AND hy >= {n(LO[1])} AND ly <= {n(HI[1])} AND hz >= {n(LO[2])} AND lz <= {n(HI[2])}",
)
add(
    "nodes_near_plane",
    lambda s, d: (lambda p, t: octree.with_stats(octree.assign(p, t, LI_ROOT)).where(geom.box_meets_plane((0.0, 0.6, 0.8), 30.0)).select(*octree.KEYS))(*_tree(s, d)),
    f"{TREE}, {_LEAF}, b AS (SELECT level, cx, cy, cz, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM leaf GROUP BY level, cx, cy, cz) SELECT level, cx, cy, cz FROM b WHERE ({n(0.6)} * ly + {n(0.8)} * lz) - {n(30)} <= 0 AND ({n(0.6)} * hy + {n(0.8)} * hz) - {n(30)} >= 0",
)


#: Bounds of the leaves, and heights of their boxes over a plane.
_BOUNDS = f"{TREE}, {_LEAF}, b AS (SELECT level, cx, cy, cz, count(*) AS n, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz FROM leaf GROUP BY level, cx, cy, cz)"


def _boxes(s: SparkSession, d: str) -> DataFrame:
    p, t = _tree(s, d)
    return octree.with_stats(octree.assign(p, t, LI_ROOT))


def heights_sql(v, d) -> tuple[str, str]:
    ends = [" + ".join(f"{n(k)} * {(x if k >= 0 else y) + a}" for k, a in zip(v, "xyz")) for x, y in ("lh", "hl")]
    return f"(({ends[0]}) - {n(d)})", f"(({ends[1]}) - {n(d)})"


def _unit(v, d) -> tuple[list[float], float]:
    k = float(np.linalg.norm(v))
    return [float(a) / k for a in v], float(d) / k


def _overlap_sql(lo, hi, axes: str = "xyz") -> str:
    return " AND ".join(f"h{a} >= {n(p)} AND l{a} <= {n(q)}" for a, p, q in zip(axes, lo, hi))


def _within_sql(lo, hi, axes: str = "xyz") -> str:
    return " AND ".join(f"l{a} >= {n(p)} AND h{a} <= {n(q)}" for a, p, q in zip(axes, lo, hi))


def _near_sql(v, d, within: float) -> str:
    low, high = heights_sql(*_unit(v, d))
    return f"({low} <= {n(within)} AND {high} >= {n(-within)})"


def _far_sql(v, d, within: float) -> str:
    low, high = heights_sql(*_unit(v, d))
    return f"({low} < {n(-within)} OR {high} > {n(within)})"


def _ring_sql(ring, within: float) -> str:
    k, d, _, _ = geom.plane_frame(ring)
    low, high = heights_sql(k, d)
    c = np.asarray(ring, float)
    return f"({low} <= {n(within)} AND {high} >= {n(-within)} AND {_overlap_sql(c.min(axis=0) - within, c.max(axis=0) + within)})"


_FLAT = (-1e300, 1e300)
_XY = ((LO[0], LO[1], _FLAT[0]), (HI[0], HI[1], _FLAT[1]))
for _name, _may, _sql in (
    ("outside_box", lambda: ~geom.box_inside(LO, HI), f"NOT ({_within_sql(LO, HI)})"),
    ("inside_xy", lambda: geom.boxes_overlap(*_XY), _overlap_sql(LO[:2], HI[:2])),
    ("outside_xy", lambda: ~geom.box_inside(*_XY), f"NOT ({_within_sql(LO[:2], HI[:2])})"),
    ("inside_hull", lambda: geom.box_may_meet_hull(HULL), " AND ".join(f"{heights_sql(v, d)[0]} <= 0" for v, d in HULL)),
    ("outside_hull", lambda: geom.box_may_leave_hull(HULL), " OR ".join(f"{heights_sql(v, d)[1]} > 0" for v, d in HULL)),
    ("near_plane", lambda: geom.box_meets_plane(*_unit(*PLANES[0]), 0.75), _near_sql(*PLANES[0], 0.75)),
    ("near_any_plane", lambda: geom.any_of([geom.box_meets_plane(*_unit(*p), 0.75) for p in PLANES]), " OR ".join(_near_sql(*p, 0.75) for p in PLANES)),
    ("not_near_plane", lambda: geom.box_may_leave_plane(*_unit(*PLANES[0]), 0.75), _far_sql(*PLANES[0], 0.75)),
    ("not_near_any_plane", lambda: geom.all_of([geom.box_may_leave_plane(*_unit(*p), 0.75) for p in PLANES]), " AND ".join(_far_sql(*p, 0.75) for p in PLANES)),
    ("near_polygon", lambda: geom.box_may_meet_polygon(RINGS[0], 1.5), _ring_sql(RINGS[0], 1.5)),
    ("near_any_polygon", lambda: geom.any_of([geom.box_may_meet_polygon(r, 1.5) for r in RINGS]), " OR ".join(_ring_sql(r, 1.5) for r in RINGS)),
):
    add(f"approx_{_name}", (lambda may: lambda s, d: octree.approximate_count_where(_boxes(s, d), may()))(_may), f"{_BOUNDS} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM b WHERE {_sql}")
add(
    "nodes_in_hull",
    lambda s, d: octree.traverse(_boxes(s, d), HULL),
    f"{_BOUNDS} SELECT level, cx, cy, cz, {' AND '.join(f'{heights_sql(v, d)[1]} <= 0' for v, d in HULL)} AS fully_inside FROM b WHERE {' AND '.join(f'{heights_sql(v, d)[0]} <= 0' for v, d in HULL)}",
)


def _lod(s: SparkSession, d: str) -> DataFrame:
    p, t = _tree(s, d)
    return octree.level_of_detail(octree.assign(p.select(*XYZ), t, LI_ROOT), t, LIMIT)


def _level_counts(s: SparkSession, d: str) -> DataFrame:
    p, t = _tree(s, d)
    own = octree.level_of_detail(octree.assign(p.select(*XYZ), t, LI_ROOT), t, LIMIT).groupBy(*octree.KEYS).agg(F.count(F.lit(1)).alias("count_cell"))
    return octree.level_counts(t.join(own, octree.KEYS))


add(
    "lod_sizes",
    lambda s, d: _lod(s, d).groupBy("level", "is_leaf").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cx", "cy", "cz").alias("nodes")),
    f"{TREE} SELECT level, is_leaf, CAST(sum(CASE WHEN is_leaf THEN n ELSE {LIMIT} END) AS BIGINT) AS n, count(*) AS nodes FROM nodes GROUP BY ALL",
)
add(
    "level_counts",
    _level_counts,
    f"{TREE}, m AS (SELECT max(level) AS last FROM nodes) SELECT CAST(l AS INTEGER) AS level, CAST(sum(CASE WHEN is_leaf THEN n ELSE {LIMIT} END) AS BIGINT) AS n FROM nodes, m, generate_series(0, last) g(l) WHERE level = l OR (is_leaf AND level < l) GROUP BY ALL",
)
add("lod_front", lambda s, d: octree.front(_lod(s, d), LI_ROOT, 5).select(*XYZ))

# --- clustering and normals ----------------------------------------------------------------


def _emb(s: SparkSession, d: str) -> DataFrame:
    return views.embedding_points(s, d)


_CLOSURE = "WITH RECURSIVE e AS (SELECT a.point_id AS u, b.point_id AS v FROM emb a JOIN emb b ON {on}), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u AS point_id, min(v) AS cluster_id FROM r GROUP BY u"


def closure_sql(on: str) -> str:
    return "WITH RECURSIVE " + views.EMB + ", " + _CLOSURE.format(on=on)[len("WITH RECURSIVE ") :]


add("cluster_distance", lambda s, d: cluster.by_distance(_emb(s, d), 0.03), closure_sql(f"(b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 <= {n(0.0009)}"), False)
add("cluster_epsilon", lambda s, d: cluster.by_distance(_emb(s, d), 0.025, strict=True), closure_sql(f"(b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 < {n(0.025 * 0.025)} OR a.point_id = b.point_id"), False)
add("cluster_vectors", lambda s, d: cluster.by_vector(views.table(s, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("v")), 0.6), "WITH RECURSIVE w AS (SELECT vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT a.point_id AS u, b.point_id AS v FROM w a JOIN w b ON list_distance(a.v, b.v) <= 0.6e0), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u) SELECT u AS point_id, min(v) AS cluster_id FROM r GROUP BY u", False)
add("cluster_equal", lambda s, d: cluster.equal(views.lineitem_points(s, d).withColumn("y", F.floor("y") + 0.0)), "SELECT point_id, min(point_id) OVER (PARTITION BY x, floor(y), z) AS cluster_id FROM li")


def _planes_of(s: SparkSession, d: str) -> DataFrame:
    return _emb(s, d).select("point_id", "nx", "ny", "nz", F.col("x").alias("d"))


add("cluster_planes", lambda s, d: cluster.by_plane(_planes_of(s, d), 0.06, 0.05), closure_sql(f"((a.nx - b.nx) ** 2 + (a.ny - b.ny) ** 2 + (a.nz - b.nz) ** 2 < {n(0.06**2)} AND (a.x - b.x) ** 2 < {n(0.05**2)}) OR a.point_id = b.point_id"), False)
add("cluster_normals", lambda s, d: cluster.by_normal(_emb(s, d), 0.02, ["classification"]))
_EQ = "WITH c AS (SELECT point_id, min(point_id) OVER (PARTITION BY x, floor(y), z) AS cluster_id FROM li)"
add("cluster_sizes", lambda s, d: cluster.compact(QUERIES["cluster_equal"](s, d)).withColumn("cluster_index", F.col("cluster_index").cast("long")), f"{_EQ} SELECT cluster_id, count(*) AS n, CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS BIGINT) AS cluster_index FROM c GROUP BY cluster_id")
add("cluster_min_size", lambda s, d: cluster.at_least(QUERIES["cluster_equal"](s, d), 3), f"{_EQ} SELECT point_id, CASE WHEN count(*) OVER (PARTITION BY cluster_id) >= 3 THEN cluster_id ELSE -1 END AS cluster_id FROM c")
add(
    "cluster_centroids",
    lambda s, d: cluster.equal_centroids(views.lineitem_points(s, d), [F.col("x"), F.floor("y"), F.col("z")]).select("cluster_id", "n", F.round(F.col("cy") + 1e-9, 5).alias("cy")),
    "SELECT min(point_id) AS cluster_id, count(*) AS n, round(avg(y) + 1e-9, 5) AS cy FROM li GROUP BY x, floor(y), z",
)
add(
    "normals_density",
    lambda s, d: normals.moments(_emb(s, d), 0.15, 16).select("point_id", F.col("n"), F.round("density", 8).alias("density")),
    f"WITH p AS (SELECT a.point_id AS q, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.point_id ORDER BY {_PAIR}, b.point_id) AS r FROM emb a JOIN emb b ON {_PAIR} <= {n(0.15)}) SELECT q AS point_id, count(*) AS n, round(var_pop(x) + var_pop(y) + var_pop(z), 8) AS density FROM p WHERE r <= 16 GROUP BY q",
)
add("normals_estimate", lambda s, d: normals.estimate(_emb(s, d), 0.15, 16))
add("normals_colours", lambda s, d: normals.colours(normals.estimate(_emb(s, d), 0.3, 27)))

# --- rays, objects, meshes -------------------------------------------------------------------


def objects(s: SparkSession, d: str) -> DataFrame:
    """Boxes around parts, spheres around customers: numbers from table keys."""
    p = views.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"))
    x, y, z = (F.col("k") * m % 97 + 0.0 for m in (7, 11, 13))
    base = {f"a{a}": v for a, v in zip("xyz", (x, y, z))} | {f"b{a}": v + 1.0 + F.col("size") % 5 for a, v in zip("xyz", (x, y, z))} | {f"c{a}": v for a, v in zip("xyz", (x + 3.0, y, z + 2.0))}
    kind = F.element_at(F.array(*map(F.lit, ("box", "sphere", "triangle"))), (F.col("k") % 3 + 1).cast("int"))
    return p.select(F.col("k").alias("object_id"), kind.alias("kind"), *(v.alias(c) for c, v in base.items()), (F.col("size") % 4 + 1.0).alias("r"))


OBJ = """obj AS (SELECT p_partkey AS object_id, CASE p_partkey % 3 WHEN 0 THEN 'box' WHEN 1 THEN 'sphere' ELSE 'triangle' END AS kind,
  p_partkey * 7 % 97 + 0e0 AS ax, p_partkey * 11 % 97 + 0e0 AS ay, p_partkey * 13 % 97 + 0e0 AS az,
  p_partkey * 7 % 97 + 1e0 + p_size % 5 AS bx, p_partkey * 11 % 97 + 1e0 + p_size % 5 AS by_, p_partkey * 13 % 97 + 1e0 + p_size % 5 AS bz,
  p_partkey * 7 % 97 + 3e0 AS cx, p_partkey * 11 % 97 + 0e0 AS cy, p_partkey * 13 % 97 + 2e0 AS cz, p_size % 4 + 1e0 AS r FROM part)"""


def v_sub(a, b) -> list[str]:
    return [f"({x} - {y})" for x, y in zip(a, b)]


def v_dot(a, b) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def v_cross(a, b) -> list[str]:
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


_PA, _PB, _PC, _PO, _PD, _PQ = (["ax", "ay", "az"], ["bx", "by_", "bz"], ["cx", "cy", "cz"], ["ox", "oy", "oz"], ["dx", "dy", "dz"], ["x", "y", "z"])


def triangle_hit_sql(table: str, keep: str) -> str:
    """(.., t): hits of rays at triangles by Cramer's rule."""
    e1, e2 = v_sub(_PB, _PA), v_sub(_PC, _PA)
    p = v_cross(_PD, e2)
    s, q = v_sub(_PO, _PA), v_cross(v_sub(_PO, _PA), e1)
    return f"SELECT {keep}, w / det AS t FROM (SELECT *, {v_dot(e1, p)} AS det, {v_dot(s, p)} AS u, {v_dot(_PD, q)} AS v, {v_dot(e2, q)} AS w FROM {table}) WHERE det <> 0 AND u / det >= 0 AND v / det >= 0 AND u / det + v / det <= 1 AND w / det >= 0"


def _near_segment_sql(q, a, b) -> str:
    axis = v_sub(b, a)
    t = f"coalesce(greatest(0e0, least(1e0, {v_dot(v_sub(q, a), axis)} / nullif({v_dot(axis, axis)}, 0e0))), 0e0)"
    e = [f"({p} - ({x} + {t} * {y}))" for p, x, y in zip(q, a, axis)]
    return f"sqrt({v_dot(e, e)})"


def _near_triangle_sql(q, a, b, c) -> str:
    k = v_cross(v_sub(b, a), v_sub(c, a))
    inside = " AND ".join(f"{v_dot(v_cross(v_sub(y, x), v_sub(q, x)), k)} >= 0" for x, y in ((a, b), (b, c), (c, a)))
    edges = ", ".join(_near_segment_sql(q, x, y) for x, y in ((a, b), (b, c), (c, a)))
    return f"CASE WHEN {inside} AND {v_dot(k, k)} > 0 THEN abs({v_dot(v_sub(q, a), k)}) / sqrt({v_dot(k, k)}) ELSE least({edges}) END"


def ray_set(s: SparkSession, d: str) -> DataFrame:
    k = views.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))
    o = [F.col("k") * m % 89 + 0.25 for m in (3, 5)]
    return k.select(F.col("k").alias("ray_id"), o[0].alias("ox"), o[1].alias("oy"), F.lit(-5.0).alias("oz"), ((F.col("k") % 5 - 2) * 0.125).alias("dx"), ((F.col("k") % 7 - 3) * 0.125).alias("dy"), F.lit(1.0).alias("dz"))


RAYS = "rays AS (SELECT s_suppkey AS ray_id, s_suppkey * 3 % 89 + 0.25e0 AS ox, s_suppkey * 5 % 89 + 0.25e0 AS oy, -5e0 AS oz, (s_suppkey % 5 - 2) * 0.125e0 AS dx, (s_suppkey % 7 - 3) * 0.125e0 AS dy, 1e0 AS dz FROM supplier)"
_SLAB = [f"CASE WHEN d{a} = 0 THEN CASE WHEN o{a} BETWEEN a{a} AND {b} THEN {'-' if k == 'least' else ''}'Infinity'::DOUBLE ELSE {'' if k == 'least' else '-'}'Infinity'::DOUBLE END ELSE {k}((a{a} - o{a}) / d{a}, ({b} - o{a}) / d{a}) END" for k in ("least", "greatest") for a, b in (("x", "bx"), ("y", "by_"), ("z", "bz"))]
_IN, _OUT = f"greatest({', '.join(_SLAB[:3])})", f"least({', '.join(_SLAB[3:])})"
_EO = [f"(o{a} - a{a})" for a in "xyz"]
_A2, _B2 = "(dx * dx + dy * dy + dz * dz)", f"({' + '.join(f'{e} * d{a}' for e, a in zip(_EO, 'xyz'))})"
_C2 = f"({' + '.join(f'{e} * {e}' for e in _EO)} - r * r)"
add(
    "ray_boxes",
    lambda s, d: rays.nearest_hit(ray_set(s, d), objects(s, d), object_filter=F.col("kind") == "box").select("ray_id", "object_id", F.round("t", 6).alias("t")),
    f"WITH {OBJ}, {RAYS}, h AS (SELECT ray_id, object_id, {_IN} AS t0, {_OUT} AS t1 FROM rays, obj WHERE kind = 'box'), g AS (SELECT ray_id, object_id, CASE WHEN t0 >= 0 THEN t0 ELSE t1 END AS t FROM h WHERE t0 <= t1 AND t1 >= 0) SELECT ray_id, object_id, round(t, 6) AS t FROM g QUALIFY row_number() OVER (PARTITION BY ray_id ORDER BY t, object_id) = 1",
    False,
)
add(
    "ray_spheres",
    lambda s, d: rays.hits(ray_set(s, d), objects(s, d), object_filter=F.col("kind") == "sphere").select("ray_id", "object_id", F.round("t", 6).alias("t")),
    f"WITH {OBJ}, {RAYS}, h AS (SELECT ray_id, object_id, {_A2} AS a, {_B2} AS b, {_B2} * {_B2} - {_A2} * {_C2} AS root FROM rays, obj WHERE kind = 'sphere'), g AS (SELECT ray_id, object_id, CASE WHEN (-b - sqrt(root)) / a >= 0 THEN (-b - sqrt(root)) / a ELSE (-b + sqrt(root)) / a END AS t FROM h WHERE root >= 0) SELECT ray_id, object_id, round(t, 6) AS t FROM g WHERE t >= 0",
    False,
)
add(
    "ray_triangles",
    lambda s, d: rays.all_hits_ranked(ray_set(s, d), objects(s, d).where("kind = 'triangle'")).select("ray_id", "object_id", F.round("t", 6).alias("t"), F.col("nth").cast("long").alias("nth")),
    f"WITH {OBJ}, {RAYS}, h AS ({triangle_hit_sql("(SELECT * FROM rays, obj WHERE kind = 'triangle')", 'ray_id, object_id')}) SELECT ray_id, object_id, round(t, 6) AS t, row_number() OVER (PARTITION BY ray_id ORDER BY t, object_id) AS nth FROM h",
    False,
)


def _probes(s: SparkSession, d: str) -> DataFrame:
    return views.table(s, d, "supplier").select(F.col("s_suppkey").alias("query_id"), *((F.col("s_suppkey") * m % 97 + 0.5).alias(a) for a, m in zip("xyz", (17, 19, 23))))


add(
    "closest_sphere",
    lambda s, d: rays.closest(_probes(s, d), objects(s, d).where("kind = 'sphere'")).select("query_id", "object_id", F.round("distance", 6).alias("distance")),
    f"WITH {OBJ}, q AS (SELECT s_suppkey AS query_id, s_suppkey * 17 % 97 + 0.5e0 AS x, s_suppkey * 19 % 97 + 0.5e0 AS y, s_suppkey * 23 % 97 + 0.5e0 AS z FROM supplier), g AS (SELECT query_id, object_id, greatest(0e0, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az)) - r) AS d FROM q, obj WHERE kind = 'sphere') SELECT query_id, object_id, round(d, 6) AS distance FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, object_id) = 1",
    False,
)
_OUTSIDE = [f"greatest({a} - {q}, 0e0, {q} - {b})" for a, b, q in zip(_PA, _PB, _PQ)]
add(
    "closest_object",
    lambda s, d: rays.closest(_probes(s, d), objects(s, d)).select("query_id", "object_id", F.round("distance", 6).alias("distance")),
    f"WITH {OBJ}, q AS (SELECT s_suppkey AS query_id, s_suppkey * 17 % 97 + 0.5e0 AS x, s_suppkey * 19 % 97 + 0.5e0 AS y, s_suppkey * 23 % 97 + 0.5e0 AS z FROM supplier), g AS (SELECT query_id, object_id, CASE kind WHEN 'box' THEN sqrt({v_dot(_OUTSIDE, _OUTSIDE)}) WHEN 'sphere' THEN greatest(0e0, sqrt({v_dot(v_sub(_PQ, _PA), v_sub(_PQ, _PA))}) - r) ELSE {_near_triangle_sql(_PQ, _PA, _PB, _PC)} END AS d FROM q, obj) SELECT query_id, object_id, round(d, 6) AS distance FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, object_id) = 1",
    False,
)
_MEET = " AND ".join(f"(CASE kind WHEN 'sphere' THEN a{a} + r ELSE greatest(a{a}, {b}) END) >= 20 AND (CASE kind WHEN 'sphere' THEN a{a} - r ELSE least(a{a}, {b}) END) <= 60" for a, b in (("x", "bx"), ("y", "by_"), ("z", "bz")))
add("objects_meeting_box", lambda s, d: rays.meeting_box(objects(s, d).where("kind <> 'triangle'").withColumns({f"c{a}": F.lit(None).cast("double") for a in "xyz"}), (20, 20, 20), (60, 60, 60)), f"WITH {OBJ} SELECT object_id FROM obj WHERE kind <> 'triangle' AND {_MEET}", False)
add("objects_inside_box", lambda s, d: rays.inside_box(objects(s, d).where("kind = 'sphere'"), (20, 20, 20), (60, 60, 60)), f"WITH {OBJ} SELECT object_id FROM obj WHERE kind = 'sphere' AND ax - r >= 20 AND ay - r >= 20 AND az - r >= 20 AND ax + r <= 60 AND ay + r <= 60 AND az + r <= 60", False)


def height_field(s: SparkSession, d: str) -> mesh.Mesh:
    """A quad mesh a nation: 6 x 4 vertices whose heights come from keys."""
    k = views.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("mesh_id"))
    v = k.select("mesh_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"))
    v = v.select("mesh_id", F.col("i").cast("long").alias("vi"), (F.col("i") % 6 + 0.0).alias("x"), (F.floor(F.col("i") / 6) + 0.0).alias("y"), ((F.col("mesh_id") + 1) * F.col("i") % 7 * 0.25).alias("z"))
    c = k.select("mesh_id", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("f"))
    low = F.floor(F.col("f") / 5) * 6 + F.col("f") % 5
    c = c.select("mesh_id", F.col("f").cast("long").alias("fi"), F.posexplode(F.array(low, low + 1, low + 7, low + 6)).alias("fs", "vi"))
    return v, c.select("mesh_id", "fi", F.col("fs").cast("long").alias("fs"), F.col("vi").cast("long").alias("vi"))


MESH = """v AS (SELECT CAST(n_nationkey AS BIGINT) AS mesh_id, i AS vi, i % 6 + 0e0 AS x, i // 6 + 0e0 AS y, (n_nationkey + 1) * i % 7 * 0.25e0 AS z FROM nation, generate_series(0, 23) g(i)),
c AS (SELECT CAST(n_nationkey AS BIGINT) AS mesh_id, f AS fi, k AS fs, f // 5 * 6 + f % 5 + [0, 1, 7, 6][k + 1] AS vi FROM nation, generate_series(0, 14) g(f), generate_series(0, 3) h(k)),
he AS (SELECT a.mesh_id, a.fi, a.fs, a.vi AS v0, b.vi AS v1 FROM c a JOIN c b ON a.mesh_id = b.mesh_id AND a.fi = b.fi AND b.fs = (a.fs + 1) % 4),
e AS (SELECT mesh_id, least(v0, v1) AS a, greatest(v0, v1) AS b, count(*) AS faces FROM he GROUP BY ALL),
tri AS (SELECT p.mesh_id, p.fi, q.fs AS k, va.x ax, va.y ay, va.z az, vb.x bx, vb.y by_, vb.z bz, vc.x cx, vc.y cy, vc.z cz
  FROM c p JOIN c q ON p.mesh_id = q.mesh_id AND p.fi = q.fi AND p.fs = 0 AND q.fs IN (1, 2) JOIN c w ON w.mesh_id = p.mesh_id AND w.fi = p.fi AND w.fs = q.fs + 1
  JOIN v va ON va.mesh_id = p.mesh_id AND va.vi = p.vi JOIN v vb ON vb.mesh_id = p.mesh_id AND vb.vi = q.vi JOIN v vc ON vc.mesh_id = p.mesh_id AND vc.vi = w.vi),
fan AS (SELECT *, ((by_ - ay) * (cz - az) - (bz - az) * (cy - ay)) / 2 AS sx, ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) / 2 AS sy, ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / 2 AS sz FROM tri)"""


def mesh_query(name: str, query: Callable[[mesh.Mesh], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: query(height_field(s, d)), f"WITH {MESH} {sql}" if sql else None, False)


mesh_query("mesh_edges", lambda m: mesh.edges(m[1]), "SELECT mesh_id, a, b, faces FROM e")
mesh_query("mesh_border", lambda m: mesh.border_edges(m[1]), "SELECT mesh_id, a, b, faces FROM e WHERE faces = 1")
mesh_query("mesh_non_manifold", lambda m: mesh.non_manifold_edges(m[1]), "SELECT mesh_id, a, b, faces FROM e WHERE faces > 2")
mesh_query("mesh_euler", lambda m: mesh.euler(m[1]), "SELECT mesh_id, vertices, edges, faces, vertices - edges + faces AS euler FROM (SELECT mesh_id, count(DISTINCT vi) AS vertices, count(DISTINCT fi) AS faces FROM c GROUP BY 1) JOIN (SELECT mesh_id, count(*) AS edges FROM e GROUP BY 1) USING (mesh_id)")
mesh_query("mesh_opposite", lambda m: mesh.opposite(m[1]), "SELECT h.*, o.fi AS other_fi, o.fs AS other_fs FROM he h LEFT JOIN he o ON o.mesh_id = h.mesh_id AND o.v0 = h.v1 AND o.v1 = h.v0")
mesh_query("mesh_adjacency", lambda m: mesh.adjacency(m[1]), "SELECT DISTINCT p.mesh_id, p.fi AS f, q.fi AS g, least(p.v0, p.v1) AS a, greatest(p.v0, p.v1) AS b FROM he p JOIN he q ON p.mesh_id = q.mesh_id AND p.fi < q.fi AND least(p.v0, p.v1) = least(q.v0, q.v1) AND greatest(p.v0, p.v1) = greatest(q.v0, q.v1)")
mesh_query("mesh_components", lambda m: mesh.connected_components(m[1]), "SELECT DISTINCT mesh_id, fi, CAST(0 AS BIGINT) AS cluster FROM c")
mesh_query("mesh_winding", lambda m: mesh.consistent_winding(m[1]), "SELECT mesh_id, CAST(0 AS BIGINT) AS conflicts FROM c GROUP BY 1")
mesh_query("mesh_bbox", mesh.bounding_boxes, "SELECT mesh_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM v GROUP BY 1")
mesh_query(
    "mesh_face_area",
    lambda m: mesh.face_geometry(m).select("mesh_id", "fi", *(F.round(k, 6).alias(k) for k in ("area", "nx", "ny", "nz", "cx", "cy", "cz"))),
    ", s AS (SELECT mesh_id, fi, sum(sx) AS sx, sum(sy) AS sy, sum(sz) AS sz FROM fan GROUP BY 1, 2), u AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS area FROM s), w AS (SELECT f.mesh_id, f.fi, (f.sx * u.sx + f.sy * u.sy + f.sz * u.sz) / area AS k, (ax + bx + cx) / 3 AS px, (ay + by_ + cy) / 3 AS py, (az + bz + cz) / 3 AS pz FROM fan f JOIN u USING (mesh_id, fi)) SELECT mesh_id, fi, round(any_value(area), 6) AS area, round(any_value(sx / area), 6) AS nx, round(any_value(sy / area), 6) AS ny, round(any_value(sz / area), 6) AS nz, round(sum(k * px) / any_value(area), 6) AS cx, round(sum(k * py) / any_value(area), 6) AS cy, round(sum(k * pz) / any_value(area), 6) AS cz FROM u JOIN w USING (mesh_id, fi) GROUP BY 1, 2",
)
#: Faces with area, normal and centre.
FACE = """, s AS (SELECT mesh_id, fi, sum(sx) AS sx, sum(sy) AS sy, sum(sz) AS sz FROM fan GROUP BY 1, 2), u AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS area FROM s),
w AS (SELECT f.mesh_id, f.fi, (f.sx * u.sx + f.sy * u.sy + f.sz * u.sz) / area AS k, (ax + bx + cx) / 3 AS px, (ay + by_ + cy) / 3 AS py, (az + bz + cz) / 3 AS pz FROM fan f JOIN u USING (mesh_id, fi)),
face AS (SELECT mesh_id, fi, any_value(area) AS area, any_value(sx / area) AS nx, any_value(sy / area) AS ny, any_value(sz / area) AS nz, sum(k * px) / any_value(area) AS mx, sum(k * py) / any_value(area) AS my, sum(k * pz) / any_value(area) AS mz FROM u JOIN w USING (mesh_id, fi) GROUP BY 1, 2)"""
mesh_query(
    "mesh_vertex_normals",
    lambda m: mesh.vertex_normals(m, 60.0).select("mesh_id", "fi", "vi", *((F.round(k, 6) + 0.0).alias(k) for k in ("nx", "ny", "nz"))),
    FACE + f", cor AS (SELECT c.mesh_id, c.fi, c.vi, area, nx, ny, nz FROM c JOIN face USING (mesh_id, fi)), t AS (SELECT o.mesh_id, o.fi, o.vi, sum(p.area * p.nx) AS tx, sum(p.area * p.ny) AS ty, sum(p.area * p.nz) AS tz FROM cor o JOIN cor p ON o.mesh_id = p.mesh_id AND o.vi = p.vi AND o.nx * p.nx + o.ny * p.ny + o.nz * p.nz >= {n(math.cos(math.radians(60)))} - 1e-12 GROUP BY 1, 2, 3) SELECT mesh_id, fi, vi, {', '.join(f'round(t{a} / sqrt(tx * tx + ty * ty + tz * tz), 6) + 0e0 AS n{a}' for a in 'xyz')} FROM t",
)
mesh_query(
    "mesh_outline",
    lambda m: mesh.outline(m, (0.0, -50.0, 2.0)),
    FACE + ", side AS (SELECT mesh_id, fi, nx * (0e0 - mx) + ny * (-50e0 - my) + nz * (2e0 - mz) > 0 AS front FROM face), ee AS (SELECT mesh_id, least(v0, v1) AS a, greatest(v0, v1) AS b, count(*) AS n, count(DISTINCT front) AS sides FROM he JOIN side USING (mesh_id, fi) GROUP BY 1, 2, 3) SELECT mesh_id, a, b FROM ee WHERE n = 1 OR sides = 2",
)
_REACH = "(SELECT mesh_id, {x} AS a, {x} AS b FROM {of} UNION SELECT r.mesh_id, r.a, p.b FROM r JOIN pairs p ON p.mesh_id = r.mesh_id AND p.a = r.b)"
add(
    "mesh_planar_clusters",
    lambda s, d: mesh.planar_clusters(height_field(s, d), 0.9),
    f"WITH RECURSIVE {MESH}{FACE}, pairs AS (SELECT DISTINCT p.mesh_id, p.fi AS a, q.fi AS b FROM he p JOIN he q ON p.mesh_id = q.mesh_id AND p.fi <> q.fi AND least(p.v0, p.v1) = least(q.v0, q.v1) AND greatest(p.v0, p.v1) = greatest(q.v0, q.v1) JOIN face f ON f.mesh_id = p.mesh_id AND f.fi = p.fi JOIN face g ON g.mesh_id = q.mesh_id AND g.fi = q.fi WHERE f.nx * g.nx + f.ny * g.ny + f.nz * g.nz >= 0.9e0), r AS {_REACH.format(x='fi', of='face')} SELECT mesh_id, a AS fi, min(b) AS cluster FROM r GROUP BY 1, 2",
    False,
)
mesh_query("mesh_subset", lambda m: mesh.subset(m, F.col("fi") < 5)[1], ", u AS (SELECT DISTINCT mesh_id, vi FROM c WHERE fi < 5), w AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY vi) - 1 AS new FROM u) SELECT c.mesh_id, fi, fs, new AS vi FROM c JOIN w USING (mesh_id, vi) WHERE fi < 5")
mesh_query("mesh_reversed", lambda m: mesh.reversed_faces(m[1]), "SELECT mesh_id, fi, 3 - fs AS fs, vi FROM c")
mesh_query("mesh_without_degenerate", lambda m: mesh.without_degenerate((m[0], m[1].withColumn("vi", F.when(F.col("vi") == 7, 1).otherwise(F.col("vi")).cast("long"))))[1], ", d AS (SELECT mesh_id, fi, fs, CASE vi WHEN 7 THEN 1 ELSE vi END AS vi FROM c), h AS (SELECT a.mesh_id, a.fi, a.fs, a.vi AS v0, b.vi AS v1 FROM d a JOIN d b ON a.mesh_id = b.mesh_id AND a.fi = b.fi AND b.fs = (a.fs + 1) % 4), k AS (SELECT *, count(*) OVER (PARTITION BY mesh_id, fi) AS n FROM h WHERE v0 <> v1) SELECT mesh_id, fi, row_number() OVER (PARTITION BY mesh_id, fi ORDER BY fs) - 1 AS fs, v0 AS vi FROM k WHERE n >= 3")
mesh_query("mesh_triangulated", lambda m: mesh.triangulated(m)[1].groupBy("mesh_id").agg(F.countDistinct("fi").alias("triangles")), "SELECT mesh_id, 2 * count(DISTINCT fi) AS triangles FROM c GROUP BY 1")
mesh_query("mesh_indexed_geometry", lambda m: mesh.indexed_geometry(m), "SELECT mesh_id, fi, CAST(k AS INTEGER) AS k, CAST(p AS INTEGER) AS corner, CASE p WHEN 0 THEN ax WHEN 1 THEN bx ELSE cx END AS x, CASE p WHEN 0 THEN ay WHEN 1 THEN by_ ELSE cy END AS y, CASE p WHEN 0 THEN az WHEN 1 THEN bz ELSE cz END AS z FROM tri, generate_series(0, 2) g(p)")
mesh_query("mesh_clip", lambda m: mesh.clip(m, (1.0, 0.0, 0.0), 2.5).groupBy("mesh_id", "fi").agg(F.count(F.lit(1)).alias("corners"), F.min("x").alias("min_x")), "SELECT DISTINCT mesh_id, fi, CAST(4 AS BIGINT) AS corners, greatest(2.5e0, fi % 5 + 0e0) AS min_x FROM c WHERE fi % 5 >= 2")
mesh_query("mesh_transformed", lambda m: mesh.transformed(m, _M)[0], "SELECT mesh_id, vi, 5e0 - y AS x, x - 2e0 AS y, 2e0 * z + 1e0 AS z FROM v")
mesh_query(
    "mesh_ray_hits",
    lambda m: rays.hits(m[0].sparkSession.range(1).select(F.lit(0).cast("long").alias("ray_id"), *(F.lit(v).alias(k) for k, v in zip(("ox", "oy", "oz", "dx", "dy", "dz"), (2.3, 1.4, -9.0, 0.0, 0.0, 1.0)))), mesh.as_objects(m)).select("object_id.mesh_id", "object_id.fi", F.col("object_id.k").cast("long").alias("k"), F.round("t", 6).alias("t")),
    ", h AS (" + triangle_hit_sql("(SELECT *, 2.3e0 AS ox, 1.4e0 AS oy, -9e0 AS oz, 0e0 AS dx, 0e0 AS dy, 1e0 AS dz FROM tri)", "mesh_id, fi, CAST(k - 1 AS BIGINT) AS k") + ") SELECT mesh_id, fi, k, round(t, 6) AS t FROM h",
)
mesh_query("mesh_draw_order", lambda m: mesh.draw_order(mesh.face_triangles(m).withColumn("object_id", F.col("fi") * mesh.FAN + F.col("k") - 1), (0.0, -20.0, 10.0)))
add("mesh_group", lambda s, d: mesh.euler(mesh.group(*(mesh.create(s, *f) for f in (mesh.box(), mesh.sphere(6, 8), mesh.torus(8, 6))))[1]))
add("point_in_mesh", lambda s, d: rays.inside_mesh(_probes(s, d).withColumns({a: F.col(a) / 100 for a in "xyz"}), mesh.as_objects(mesh.create(s, *mesh.box((0.1, 0.2, 0.3), (0.7, 0.8, 0.9))))), "SELECT s_suppkey AS query_id, ((s_suppkey * 17 % 97 + 0.5e0) / 100 BETWEEN 0.1e0 AND 0.7e0 AND (s_suppkey * 19 % 97 + 0.5e0) / 100 BETWEEN 0.2e0 AND 0.8e0 AND (s_suppkey * 23 % 97 + 0.5e0) / 100 BETWEEN 0.3e0 AND 0.9e0) AS inside FROM supplier", False)
add(
    "mesh_vertex_clusters",
    lambda s, d: mesh.vertex_clustered(height_field(s, d), 1.1)[0].select("mesh_id", *(F.round(a, 6).alias(a) for a in "xyz")),
    f"WITH RECURSIVE {MESH}, pairs AS (SELECT p.mesh_id, p.vi AS a, q.vi AS b FROM v p JOIN v q ON p.mesh_id = q.mesh_id WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) <= {n(1.1)} * {n(1.1)}), r AS {_REACH.format(x='vi', of='v')}, lab AS (SELECT mesh_id, a AS vi, min(b) AS cluster FROM r GROUP BY 1, 2), d AS (SELECT c.mesh_id, fi, fs, cluster AS vi FROM c JOIN lab USING (mesh_id, vi)), h AS (SELECT a.mesh_id, a.fi, a.vi AS v0 FROM d a JOIN d b ON a.mesh_id = b.mesh_id AND a.fi = b.fi AND b.fs = (a.fs + 1) % 4 AND a.vi <> b.vi), k AS (SELECT *, count(*) OVER (PARTITION BY mesh_id, fi) AS n FROM h), used AS (SELECT DISTINCT mesh_id, v0 AS cluster FROM k WHERE n >= 3) SELECT mesh_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM v JOIN lab USING (mesh_id, vi) JOIN used USING (mesh_id, cluster) GROUP BY mesh_id, cluster",
    False,
)

# --- functions ---------------------------------------------------------------------------------

LON, LAT = 16.37, 48.2
_JD = "(epoch_us(ts) / 86400000000.0e0 + 2440587.5e0)"
_R = f"({n(math.pi / 180)})"
_EPS = "(23 * 3600 + 26 * 60 + 21.406e0 + T * (-46.836769e0 + T * (-0.0001831e0 + T * (0.0020034e0 + T * (-5.76e-7 + T * -4.34e-8))))) / 3600 * " + _R


def _observer_sql(inner: str, distance: str) -> str:
    """phi, theta and distance from lam and beta (radians) of a subquery."""
    return (
        f"WITH a AS ({inner}), b AS (SELECT *, asin(sin(beta) * cos(eps) + cos(beta) * sin(eps) * sin(lam)) AS delta, atan2(sin(lam) * cos(eps) - tan(beta) * sin(eps), cos(lam)) AS alpha FROM (SELECT *, {_EPS} AS eps FROM (SELECT *, (jd - 2451545e0) / 36525 AS T FROM a))), "
        f"c AS (SELECT *, {n(2 * math.pi)} * (0.7790572732640e0 + 1.002737811911354e0 * (jd - 2451545e0)) + {n(LON * math.pi / 180)} - alpha AS h FROM b) "
        f"SELECT point_id, round(atan2(sin(h), cos(h) * {n(math.sin(LAT * math.pi / 180))} - tan(delta) * {n(math.cos(LAT * math.pi / 180))}), 5) AS phi, round({n(math.pi / 2)} - asin({n(math.sin(LAT * math.pi / 180))} * sin(delta) + {n(math.cos(LAT * math.pi / 180))} * cos(delta) * cos(h)), 5) AS theta, {distance} AS distance FROM c"
    )


def _helio_sql(planet: str) -> tuple[str, str, str]:
    o = astro.ORBITS[planet]
    m = f"({n(o[5] * math.pi / 180)} + {n(o[6] * math.pi / 180)} * t)"
    v = f"({m} + ({' + '.join(f'{n(c)} * sin({m} * {k + 1})' for k, c in enumerate(astro.CENTRE[planet]))}) * {_R})"
    r = f"({n(o[7])} / (1 + {n(o[1])} * cos({v})))"
    i, w, q = (o[k] * math.pi / 180 for k in (2, 3, 4))
    cw, sw = f"cos({n(w)} + {v})", f"sin({n(w)} + {v})"
    return (
        f"{r} * ({n(math.cos(q))} * {cw} - {n(math.sin(q) * math.cos(i))} * {sw})",
        f"{r} * ({n(math.sin(q))} * {cw} + {n(math.cos(q) * math.cos(i))} * {sw})",
        f"{r} * ({n(math.sin(i))} * {sw})",
    )


def _times(s: SparkSession, d: str) -> DataFrame:
    return views.event_points(s, d).select("point_id", astro.julian_day(F.col("ts")).alias("jd"))


def _seen(position) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        phi, theta, distance = position(F.col("jd"))
        return _times(s, d).select("point_id", F.round(phi, 5).alias("phi"), F.round(theta, 5).alias("theta"), F.round(distance, 5).alias("distance"))

    return run


add("julian_day", lambda s, d: _times(s, d).select("point_id", "jd"), f"SELECT point_id, {_JD} AS jd FROM ev")
add("sidereal_time", lambda s, d: _times(s, d).select("point_id", F.round(astro.sidereal_time(F.col("jd")), 4).alias("theta")), f"SELECT point_id, round({n(2 * math.pi)} * (0.7790572732640e0 + 1.002737811911354e0 * ({_JD} - 2451545e0)), 4) AS theta FROM ev")


def poly_sql(t: str, *c: float) -> str:
    out = n(c[-1])
    for k in reversed(c[:-1]):
        out = f"({out} * {t} + {n(k)})"
    return out


_ARC = "round({} / 3600 * " + _R + ", 9)"
_T = f"(SELECT point_id, ({_JD} - 2451545e0) / 36525e0 AS t FROM ev)"
_MODELS = {
    "de200": poly_sql("t", 84381.448, -46.8150, -0.00059, 0.001813),
    "aa2010": poly_sql("t", 84381.406, -46.836769, -0.0001831, 0.00200340, -5.76e-7, -4.34e-8),
    "laskar": poly_sql("(t / 100)", 84381.448, -4680.93, -1.55, 1999.25, -51.38, -249.67, -39.05, 7.12, 27.87, 5.79, 2.45),
}
add("obliquity", lambda s, d: _times(s, d).select("point_id", *(F.round(astro.obliquity(F.col("jd"), m), 9).alias(m) for m in ("de200", "aa2010", "laskar"))), f"SELECT point_id, {', '.join(f'{_ARC.format(v)} AS {k}' for k, v in _MODELS.items())} FROM {_T}")
add("moon_position", _seen(lambda jd: (lambda p: (p[0], p[1], p[2] / 1000))(astro.moon_position(jd, LON, LAT))), _observer_sql(f"SELECT point_id, jd, (218.316e0 + t * 13.176396e0 + 6.289e0 * sin((134.963e0 + t * 13.064993e0) * {_R})) * {_R} AS lam, 5.128e0 * sin((93.272e0 + t * 13.229350e0) * {_R}) * {_R} AS beta, 385001 - 20905 * cos((134.963e0 + t * 13.064993e0) * {_R}) AS dist FROM (SELECT point_id, {_JD} AS jd, {_JD} - 2451545e0 AS t FROM ev)", "round(dist, 5)"))
_X, _Y, _Z = (f"-({k})" for k in _helio_sql("earth"))
add("sun_position", _seen(lambda jd: astro.sun_position(jd, LON, LAT)), _observer_sql(f"SELECT point_id, jd, atan2(gy, gx) AS lam, asin(gz / sqrt(gx * gx + gy * gy + gz * gz)) AS beta, sqrt(gx * gx + gy * gy + gz * gz) AS dist FROM (SELECT point_id, jd, {_X} AS gx, {_Y} AS gy, {_Z} AS gz FROM (SELECT point_id, {_JD} AS jd, {_JD} - 2451545e0 AS t FROM ev))", "round(dist, 5)"))
_G = [f"{p} - ({e})" for p, e in zip(_helio_sql("mars"), _helio_sql("earth"))]
add("planet_position", _seen(lambda jd: astro.planet_position("mars", jd, LON, LAT)), _observer_sql(f"SELECT point_id, jd, atan2(gy, gx) AS lam, asin(gz / sqrt(gx * gx + gy * gy + gz * gz)) AS beta, sqrt(gx * gx + gy * gy + gz * gz) AS dist FROM (SELECT point_id, jd, {_G[0]} AS gx, {_G[1]} AS gy, {_G[2]} AS gz FROM (SELECT point_id, {_JD} AS jd, {_JD} - 2451545e0 AS t FROM ev))", "round(dist, 5)"))


def _planet_sql(planet: str) -> str:
    g = [f"{p} - ({e})" for p, e in zip(_helio_sql(planet), _helio_sql("earth"))]
    seen = _observer_sql(f"SELECT point_id, jd, atan2(gy, gx) AS lam, asin(gz / sqrt(gx * gx + gy * gy + gz * gz)) AS beta, sqrt(gx * gx + gy * gy + gz * gz) AS dist FROM (SELECT point_id, jd, {g[0]} AS gx, {g[1]} AS gy, {g[2]} AS gz FROM (SELECT point_id, {_JD} AS jd, {_JD} - 2451545e0 AS t FROM ev))", "round(dist, 5)")
    return f"SELECT point_id, '{planet}' AS planet, phi, theta, distance FROM ({seen})"


add("planets", lambda s, d: astro.planets_table(_times(s, d), LON, LAT).select("point_id", "planet", *(F.round(c, 5).alias(c) for c in ("phi", "theta", "distance"))), " UNION ALL ".join(_planet_sql(p) for p in astro.PLANETS if p != "earth"))
_MERCURY, _E = astro.ORBITS["mercury"], 0.20563
_KEPLER = f"SELECT point_id, m, m + {n(_E)} * sin(m) * (1 + {n(_E)} * cos(m)) AS e FROM (SELECT point_id, m - {n(2 * math.pi)} * round(m / {n(2 * math.pi)}) AS m FROM (SELECT point_id, {n(_MERCURY[5] * math.pi / 180)} + {n(_MERCURY[6] * math.pi / 180)} * ({_JD} - 2451545e0) AS m FROM ev))"
for _ in range(12):
    _KEPLER = f"SELECT point_id, m, e - (e - {n(_E)} * sin(e) - m) / (1 - {n(_E)} * cos(e)) AS e FROM ({_KEPLER})"
add("kepler", lambda s, d: _times(s, d).select("point_id", F.round(astro.kepler_true_anomaly(astro.mean_anomaly("mercury", F.col("jd")), _E), 6).alias("v")), f"SELECT point_id, round(2 * atan({n(math.sqrt((1 + _E) / (1 - _E)))} * tan(e / 2)), 6) AS v FROM ({_KEPLER})")
_ANGLES = ", ".join(f"{poly_sql('t', 0.0, *c)} / 3600 * {_R} AS {k}" for k, c in (("zeta", (2306.2181, 0.30188, 0.017998)), ("z", (2306.2181, 1.09468, 0.018203)), ("theta", (2004.3109, -0.42665, -0.041833))))
_TURN = [["cz * ct * cc - sz * sc", "-sz * ct * cc - cz * sc", "-st * cc"], ["cz * ct * sc + sz * cc", "-sz * ct * sc + cz * cc", "-st * sc"], ["cz * st", "-sz * st", "ct"]]
add(
    "precession",
    lambda s, d: _times(s, d).select("point_id", *((F.round(c, 9) + 0.0).alias(k) for k, c in astro.precession(F.col("jd")).items())),
    f"SELECT point_id, {', '.join(f'round({_TURN[i][j]}, 9) + 0e0 AS m{i}{j}' for i in range(3) for j in range(3))} FROM (SELECT point_id, cos(zeta) AS cz, sin(zeta) AS sz, cos(z) AS cc, sin(z) AS sc, cos(theta) AS ct, sin(theta) AS st FROM (SELECT point_id, {_ANGLES} FROM {_T}))",
)
_PI180 = math.pi / 180


def _anomaly_sql(planet: str, jd: str) -> str:
    return f"({n(astro.ORBITS[planet][5] * _PI180)} + {n(astro.ORBITS[planet][6] * _PI180)} * ({jd} - 2451545e0))"


def _transit_sql(planet: str) -> str:
    offset, first, second, day = astro.SOLAR_TIME[planet]
    turns = f"((jd - 2451545e0 - {n(offset)}) / {n(day)} + {n(LON / 360)})"
    m = _anomaly_sql(planet, "near")
    return f"SELECT point_id, round(near + {n(first)} * sin({m}) + {n(second)} * sin(2 * ({m} + {n((astro.PERIHELION[planet] + 180) * _PI180)})), 5) AS transit FROM (SELECT point_id, jd + {n(day)} * (round({turns}) - {turns}) AS near FROM (SELECT point_id, {_JD} AS jd FROM ev))"


def _horizon_sql(planet: str) -> str:
    a, b, c = astro.HORIZON[planet]
    t, m = math.tan(LAT * _PI180), _anomaly_sql(planet, _JD)
    lam = f"({m} + ({' + '.join(f'{n(k)} * sin({m} * {i + 1})' for i, k in enumerate(astro.CENTRE[planet]))}) * {_R} + {n((astro.PERIHELION[planet] + 180) * _PI180)})"
    return f"SELECT point_id, round((90 + {n(a * t)} * s + {n(b * t * (3 + t * t))} * s * s * s + {n(c * t * (15 + 10 * t * t + 3 * t**4))} * s * s * s * s * s) * {_R}, 6) AS h FROM (SELECT point_id, sin({lam}) AS s FROM ev)"


for _name in ("earth", "mars"):
    add(f"solar_transit_{_name}", (lambda p: lambda s, d: _times(s, d).select("point_id", F.round(astro.solar_transit(p, F.col("jd"), LON), 5).alias("transit")))(_name), _transit_sql(_name))
    add(f"sun_horizon_{_name}", (lambda p: lambda s, d: _times(s, d).select("point_id", F.round(astro.horizon_hour_angle(p, astro.solar_longitude(p, F.col("jd")), LAT), 6).alias("h")))(_name), _horizon_sql(_name))
add("star_frames", lambda s, d: frames.star_frames(_times(s, d), LON, LAT))
add("angular_diameter", lambda s, d: views.event_points(s, d).select("point_id", F.round(astro.angular_diameter(astro.MOON_DIAMETER, F.col("y") * 1e6 + 3e8), 8).alias("a")), "SELECT point_id, round(2 * atan(1737100e0 / (y * 1e6 + 3e8)), 8) AS a FROM ev")
_GEO = "(SELECT point_id, x / 3 AS lon, y * 0.8e0 - 40 AS lat, z * 10 AS h FROM li)"


def _degrees(s: SparkSession, d: str) -> DataFrame:
    return views.lineitem_points(s, d).select("point_id", (F.col("x") / 3).alias("x"), (F.col("y") * 0.8 - 40).alias("y"), (F.col("z") * 10).alias("z"))


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select("point_id", *(F.round(a, digits).alias(a) for a in "xyz"))


_RM = f"{n(geodesy.RAD * geodesy.A)}"
add("web_mercator", lambda s, d: _rounded(geodesy.reproject(_degrees(s, d), 4326, 3857)), f"SELECT point_id, round(lon * {_RM}, 4) AS x, round(ln(tan({n(math.pi / 4)} + lat * {n(geodesy.RAD / 2)})) * 6378137e0, 4) AS y, round(h, 4) AS z FROM {_GEO}")
_NU = f"(6378137e0 / sqrt(1 - {n(geodesy.E2)} * sin(lat * {_R}) * sin(lat * {_R})))"
add("ecef", lambda s, d: _rounded(geodesy.reproject(_degrees(s, d), 4326, 4978)), f"SELECT point_id, round(({_NU} + h) * cos(lat * {_R}) * cos(lon * {_R}), 4) AS x, round(({_NU} + h) * cos(lat * {_R}) * sin(lon * {_R}), 4) AS y, round(({_NU} * {n(1 - geodesy.E2)} + h) * sin(lat * {_R}), 4) AS z FROM {_GEO}")
add("utm_round_trip", lambda s, d: _rounded(geodesy.reproject(geodesy.reproject(_degrees(s, d).where("y > 0"), 4326, 32632), 32632, 4326), 6), f"SELECT point_id, round(lon, 6) AS x, round(lat, 6) AS y, round(h, 6) AS z FROM {_GEO} WHERE lat > 0")
add("utm_round_trip_south", lambda s, d: _rounded(geodesy.reproject(geodesy.reproject(_degrees(s, d).where("y <= 0"), 4326, 32732), 32732, 4326), 6), f"SELECT point_id, round(lon, 6) AS x, round(lat, 6) AS y, round(h, 6) AS z FROM {_GEO} WHERE lat <= 0")
add("ecef_round_trip", lambda s, d: _rounded(geodesy.reproject(geodesy.reproject(_degrees(s, d), 4326, 4978), 4978, 4326), 6), f"SELECT point_id, round(lon, 6) AS x, round(lat, 6) AS y, round(h, 6) AS z FROM {_GEO}")
add("sky_luminance", lambda s, d: sky.image_directions(s, "dome", 32, 32).select("px", "py", *(F.round(sky.luminance(k, F.lit(0.9), F.col("theta"), sky.angle_between(F.col("theta"), F.col("phi"), F.lit(0.9), F.lit(0.3))), 4).alias(f"type{k}") for k in (0, 5, 6, 11, 14))))
add("sky_directions", lambda s, d: sky.image_directions(s, "cube", 8, 8).select("face", "px", "py", F.round("theta", 9).alias("theta"), F.round("phi", 9).alias("phi")))
add("colour_bytes", lambda s, d: views.lineitem_points(s, d).select("point_id", colour.unit_to_byte(F.col("x") / 50).cast("int").alias("b"), colour.rescale_to_byte(F.col("z"), 0.0, 10.0).alias("s")), "SELECT point_id, CAST(floor(x / 50 * 255) AS INTEGER) AS b, CAST(floor(z * (255.999e0 / 10)) AS INTEGER) AS s FROM li")
add(
    "lod_cut",
    lambda s, d: (lambda p, t: t.withColumn("side", F.lit(LI_ROOT.side) / F.pow(F.lit(2.0), F.col("level"))).select(*octree.KEYS, (F.degrees(F.atan2(F.col("side") / 40, F.sqrt(F.pow(F.col("cx") * F.col("side") - 300.0, F.lit(2)) + F.pow(F.col("cy") * F.col("side"), F.lit(2)))))).alias("a")).select(*octree.KEYS, (F.col("a") > 0.5).alias("split")))(*_tree(s, d)),
    f"{TREE} SELECT level, cx, cy, cz, degrees(atan2(side / 40, sqrt(pow(cx * side - 300e0, 2) + pow(cy * side, 2)))) > 0.5e0 AS split FROM (SELECT *, 128e0 / pow(2e0, level) AS side FROM nodes)",
)
add(
    "ascii_layout",
    lambda s, d: ascii.parse_lines(views.table(s, d, "lineitem").select(F.concat_ws(" ", "l_quantity", "l_discount", "l_tax", "l_linenumber", F.lit("junk")).alias("value")), ("PositionX", "PositionY", "PositionZ", "Intensity")),
    "SELECT l_quantity AS x, l_discount AS y, l_tax AS z, l_linenumber AS intensity FROM lineitem",
    False,
)


def _first_of_parts(s: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("part_index").orderBy("point_id")
    return views.lineitem_points(s, d).withColumn("r", F.row_number().over(order)).where("r <= 5").select("part_index", "point_id")


add("first_per_part", _first_of_parts, "SELECT part_index, point_id FROM li QUALIFY row_number() OVER (PARTITION BY part_index ORDER BY point_id) <= 5")


# --- sources, stores and streams: written and read back ---------------------------------


def _scan(s: SparkSession, d: str) -> DataFrame:
    """Points in whole thousandths, with colours, as scanners' files have them."""
    p = views.lineitem_points(s, d)
    return p.select("x", (F.floor(F.col("y") * 1000) / 1000).alias("y"), "z", "intensity", "classification", "part_index", *((F.col("point_id") % m).cast("int").alias(c) for c, m in zip("rgb", (251, 241, 239))))


_SCAN = "SELECT x, floor(y * 1000) / 1000 AS y, z, intensity, classification, part_index, CAST(point_id % 251 AS INTEGER) AS r, CAST(point_id % 241 AS INTEGER) AS g, CAST(point_id % 239 AS INTEGER) AS b FROM li"
_INTS = {c: "u1" for c in "rgb"}


def _columns(df: DataFrame, *names: str) -> DataFrame:
    """Positions in thousandths, and whole numbers, under plain types."""
    whole = lambda c: F.col(c).cast("long").alias(c)
    return df.select(*(F.round(c, 3).alias(c) if c in "xyz" else whole(c) for c in names))


def _columns_sql(*names: str) -> str:
    return ", ".join(c if c in "xyz" else f"CAST({c} AS BIGINT) AS {c}" for c in names)


def source_query(kind: str, columns: dict[str, str], *shown: str) -> None:
    add(f"source_{kind}", lambda s, d: _columns(binary.unpacked(binary.pack_files(_scan(s, d), kind, "part_index", columns), kind), *shown), f"SELECT {_columns_sql(*shown)} FROM ({_SCAN})")


source_query("las", dict.fromkeys("xyz", "f8") | {"intensity": "i4", "classification": "i4"} | _INTS, "x", "y", "z", "intensity", "classification", "r", "g", "b")
source_query("ply", dict.fromkeys("xyz", "f8") | _INTS, "x", "y", "z", "r", "g", "b")
source_query("e57", dict.fromkeys("xyz", "f8") | _INTS, "x", "y", "z", "r", "g", "b")
for _name in ("pts", "yxh", "xyzrgb", "xyz"):
    _shown = ["x", "y", "z", *(("intensity",) if _name == "yxh" else ()), *(() if _name == "xyz" else "rgb")]
    add(f"source_{_name}", (lambda name, shown: lambda s, d: _columns(ascii.parse_lines(ascii.lines(_scan(s, d), name), ascii.LAYOUTS[name]), *shown))(_name, _shown), f"SELECT {_columns_sql(*_shown)} FROM ({_SCAN})")
_BROKEN = "CASE point_id % 5 WHEN 0 THEN '# ' WHEN 1 THEN 'x ' ELSE '' END"
add(
    "source_malformed",
    lambda s, d: _columns(ascii.parse_lines(views.lineitem_points(s, d).select(F.concat(F.when(F.col("point_id") % 5 == 0, "# ").when(F.col("point_id") % 5 == 1, "x ").otherwise(""), F.concat_ws("\t", "x", F.floor(F.col("y") * 1000) / 1000, "z"), F.when(F.col("point_id") % 3 == 0, " junk 7").otherwise("")).alias("value")), ascii.LAYOUTS["xyz"]), "x", "y", "z"),
    "SELECT x, floor(y * 1000) / 1000 AS y, z FROM li WHERE point_id % 5 > 1",
)
add(
    "source_particles",
    lambda s, d: ascii.parse_particles(_scan(s, d).select(F.concat_ws(" ", "x", "y", "z", *(F.lit(float(i)) for i in range(7)), "intensity", "classification", F.lit(0), F.lit(1), *(F.lit(0.25) for _ in range(13))).alias("value"))).select("x", "y", "z", "interactions", F.col("material").cast("long").alias("material"), F.size("sigma").alias("tensor"), "pressure"),
    f"SELECT x, y, z, intensity AS interactions, CAST(classification AS BIGINT) AS material, 9 AS tensor, 0.25e0 AS pressure FROM ({_SCAN})",
)


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Points of a cloud that was saved, exported to another store and loaded."""
    from .cloud import ImportConfig, PointCloud

    first, second = (registry.Store(s, shared_path(s, "store")) for _ in range(2))
    PointCloud(views.embedding_points(s, d), ImportConfig(split_limit=100)).save(first, "a")
    first.copy_to("a", second)
    return PointCloud.load(second, "a").points.select(*XYZ)


add("store_round_trip", _stored, "SELECT point_id, x, y, z FROM emb")


def _streamed(s: SparkSession, d: str, sink: Callable[[DataFrame, str], object]) -> DataFrame:
    """What a stream over text files that were just written leaves in its sink."""
    folder, out, state = (shared_path(s, n) for n in ("lines", "sink", "state"))
    ascii.write(_scan(s, d), folder, "yxh")
    points = ingest.text_stream(s, folder, "yxh")
    query = sink(points, out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(out)


add("stream_ingest", lambda s, d: _columns(_streamed(s, d, lambda p, out: p.writeStream.format("parquet").option("path", out)), "x", "y", "z", "intensity"), f"SELECT {_columns_sql('x', 'y', 'z', 'intensity')} FROM ({_SCAN})")
add("stream_batches", lambda s, d: _streamed(s, d, lambda p, out: ingest.append_to(p.where("intensity > 3"), out, shared_path(s, "state"))).groupBy("intensity").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("top")), f"SELECT intensity, count(*) AS n, max(y) AS top FROM ({_SCAN}) WHERE intensity > 3 GROUP BY 1")
