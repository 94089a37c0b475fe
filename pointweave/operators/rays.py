"""Rays and boxes against sets of objects, one hit expression for each kind.

Objects are rows (object_id, kind, then numbers by kind): ``box`` a = low and
b = high corner; ``sphere`` a = centre, r; ``cylinder`` a, b = axis ends, r;
``triangle`` a, b, c; ``line`` a, b (no ray hits it).

Objects lie in grids of several levels, each in that whose cells are about its size,
so that it is in a few cells. Rays meet them in the cells along the ray, points in
the cells around, ring by ring. Where the objects' count is known to be small
(``SMALL``), rays have them sent to all tasks instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

SMALL = 256
V = "xyz"
COLUMNS = ["object_id", "kind", *(f"{p}{a}" for p in "abc" for a in V), "r"]


def vec(p: str) -> list[Column]:
    return [F.col(f"{p}{a}") for a in V]


def _sub(a, b):
    return [x - y for x, y in zip(a, b)]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def box_hit() -> Column:
    """Slabs: where the ray enters, or leaves if it starts inside."""
    near, far = [], []
    for o, d, a, b in zip(vec("o"), vec("d"), vec("a"), vec("b")):
        flat = d == 0
        inside = (o >= a) & (o <= b)
        t0, t1 = (a - o) / F.nullif(d, F.lit(0.0)), (b - o) / F.nullif(d, F.lit(0.0))
        near.append(F.when(flat, F.when(inside, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.least(t0, t1)))
        far.append(F.when(flat, F.lit(float("inf"))).otherwise(F.greatest(t0, t1)))
    t_in, t_out = F.greatest(*near), F.least(*far)
    return F.when(t_in <= t_out, F.when(t_in >= F.col("t_min"), t_in).otherwise(t_out))


def sphere_hit() -> Column:
    e = _sub(vec("o"), vec("a"))
    return _quadratic(_dot(vec("d"), vec("d")), _dot(e, vec("d")), _dot(e, e) - F.col("r") * F.col("r"))


def _quadratic(a: Column, half_b: Column, c: Column) -> Column:
    root = half_b * half_b - a * c
    first, second = (-half_b - F.sqrt(root)) / F.nullif(a, F.lit(0.0)), (-half_b + F.sqrt(root)) / F.nullif(a, F.lit(0.0))
    return F.when(root >= 0, F.when(first >= F.col("t_min"), first).otherwise(second))


def cylinder_hit() -> Column:
    """The mantle between the axis' ends."""
    axis = _sub(vec("b"), vec("a"))
    length2 = _dot(axis, axis)
    e = _sub(vec("o"), vec("a"))
    across = lambda v: _sub(v, [x * _dot(v, axis) / length2 for x in axis])
    d, p = across(vec("d")), across(e)
    a, b, c = _dot(d, d), _dot(p, d), _dot(p, p) - F.col("r") * F.col("r")
    root = b * b - a * c
    out = []
    for sign in (-1.0, 1.0):
        t = (-b + sign * F.sqrt(root)) / F.nullif(a, F.lit(0.0))
        at = _dot([x + t * y for x, y in zip(e, vec("d"))], axis)
        out.append(F.when((root >= 0) & (t >= F.col("t_min")) & (at >= 0) & (at <= length2), t))
    return F.coalesce(*out)


def triangle_hit() -> Column:
    """Moeller-Trumbore, both sides."""
    e1, e2 = _sub(vec("b"), vec("a")), _sub(vec("c"), vec("a"))
    p = _cross(vec("d"), e2)
    det = F.nullif(_dot(e1, p), F.lit(0.0))
    s = _sub(vec("o"), vec("a"))
    u = _dot(s, p) / det
    q = _cross(s, e1)
    v = _dot(vec("d"), q) / det
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1), _dot(e2, q) / det)


#: The first hit of a ray at an object of a kind; null if there is none.
HITS = {"box": box_hit, "sphere": sphere_hit, "cylinder": cylinder_hit, "triangle": triangle_hit}


def object_bounds(objects: DataFrame) -> DataFrame:
    """Adds bb_min_x .. bb_max_z."""
    r = F.when(F.col("kind").isin("sphere", "cylinder"), F.col("r")).otherwise(F.lit(0.0))
    out = {}
    for a in V:
        ends = [F.col(f"a{a}"), F.coalesce(f"b{a}", f"a{a}"), F.coalesce(f"c{a}", f"a{a}")]
        only = F.col("kind") == "sphere"
        out[f"bb_min_{a}"] = F.when(only, ends[0]).otherwise(F.least(*ends)) - r
        out[f"bb_max_{a}"] = F.when(only, ends[0]).otherwise(F.greatest(*ends)) + r
    return objects.withColumns(out)


@dataclass(frozen=True)
class Levels:
    """Grids over the box ``low`` .. ``high``: cells of level i have the side ``side`` * 2**i."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    side: float
    used: tuple[int, ...]

    @staticmethod
    def of(objects: DataFrame) -> Levels | None:
        """For objects with bounds: about one a cell, if they were spread evenly."""
        whole = objects.agg(F.count(F.lit(1)).alias("n"), *(F.min(f"bb_min_{a}").alias(f"l{a}") for a in V), *(F.max(f"bb_max_{a}").alias(f"h{a}") for a in V)).first()
        if not whole.n:
            return None
        low, high = (tuple(float(whole[f"{c}{a}"]) for a in V) for c in "lh")
        span = max(h - lo for h, lo in zip(high, low))
        side = span / max(1.0, whole.n ** (1 / 3)) or 1.0
        grid = Levels(low, high, side, ())
        return Levels(low, high, side, tuple(sorted(r[0] for r in objects.select(grid.level()).distinct().collect())))

    def level(self, least: int = 0) -> Column:
        """The level of an object with bounds."""
        size = F.greatest(*(F.col(f"bb_max_{a}") - F.col(f"bb_min_{a}") for a in V))
        return F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(size / self.side, F.lit(1.0)))).cast("int"))

    def at(self, a: str, value: Column, level: Column | int) -> Column:
        scale = F.lit(self.side) * F.pow(F.lit(2.0), level)
        return F.floor((value - self.low[V.index(a)]) / scale).cast("long")

    def cells(self, df: DataFrame, lo: dict[str, Column], hi: dict[str, Column]) -> DataFrame:
        """A row for each cell (gx, gy, gz) of column level that meets the box."""
        for a in V:
            df = df.withColumn(f"g{a}", F.explode(F.sequence(self.at(a, lo[a], F.col("level")), self.at(a, hi[a], F.col("level")))))
        return df

    def objects(self, df: DataFrame, least: int = 0) -> DataFrame:
        slack = self.side * 1e-9  # a ray along a border looks at one side alone
        df = df.withColumn("level", self.level(least))
        return self.cells(df, {a: F.col(f"bb_min_{a}") - slack for a in V}, {a: F.col(f"bb_max_{a}") + slack for a in V})


#: What makes a ray, and what makes an object of a kind; the other columns play no part.
RAY = [*(f"{p}{a}" for p in "od" for a in V), "t_min", "t_max"]
SHAPE = {
    "box": [f"{p}{a}" for p in "ab" for a in V],
    "sphere": [*(f"a{a}" for a in V), "r"],
    "cylinder": [*(f"{p}{a}" for p in "ab" for a in V), "r"],
    "triangle": [f"{p}{a}" for p in "abc" for a in V],
    "line": [f"{p}{a}" for p in "ab" for a in V],
}


def _ranged(rays: DataFrame) -> DataFrame:
    r = rays
    for c, v in (("t_min", 0.0), ("t_max", float("inf"))):
        r = r if c in rays.columns else r.withColumn(c, F.lit(v))
    return r


def hits(rays: DataFrame, objects: DataFrame, object_filter: Column | None = None, hit_filter: Column | None = None) -> DataFrame:
    """All (ray_id, object_id, t) with t_min <= t <= t_max.

    ``rays``: ray_id, ox..oz, dx..dz and optionally t_min (0) and t_max. Filters
    apply before any nearest hit is chosen. A row for each ray and object that meet.
    """
    if hit_filter is None:
        found, shapes, names = _traced(rays, objects, object_filter)
        return found.join(shapes, "_shape").join(names, "_ray").select("ray_id", "object_id", "t")
    r, o = _ranged(rays), objects if object_filter is None else objects.where(object_filter)
    sizes = {k: n for k, n in o.groupBy("kind").count().collect()}  # a row a kind
    out = None
    for kind in sorted(HITS.keys() & sizes.keys()):  # apart, so that each kind's code stays small
        own = o.where(F.col("kind") == kind)
        few = sizes[kind] <= SMALL
        pairs = r.crossJoin(F.broadcast(own)) if few else _by_grid(r, own)
        found = pairs.withColumn("t", HITS[kind]()).where(F.col("t").between(F.col("t_min"), F.col("t_max"))).where(hit_filter)
        found = found.select("ray_id", "object_id", "t")
        found = found if few else found.distinct()  # a pair may share several cells
        out = found if out is None else out.unionByName(found)
    return r.select("ray_id", F.lit(0).alias("object_id"), F.lit(0.0).alias("t")).where(F.lit(False)) if out is None else out


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows with a number, the same whenever they are read."""
    return checkpointed(df.distinct().withColumn(key, F.monotonically_increasing_id()))


def _traced(rays: DataFrame, objects: DataFrame, object_filter: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits (_ray, _shape, t) of the distinct rays at the distinct objects, then the
    objects (_shape, object_id) and rays (_ray, ray_id) that are alike.

    Rays and objects that repeat are worked out once; only the results multiply.
    """
    r, o = _ranged(rays), objects if object_filter is None else objects.where(object_filter)
    distinct = _numbered(r.select(*RAY), "_ray")
    sizes = {k for k, in o.select("kind").distinct().collect()}  # a row a kind
    out, shapes = None, None
    for i, kind in enumerate(sorted(HITS.keys() & sizes)):  # apart, so that each kind's code stays small
        own = o.where(F.col("kind") == kind)
        forms = _numbered(own.select(*SHAPE[kind]), "_shape").withColumn("_shape", F.col("_shape") * len(HITS) + i)
        few = forms.count() <= SMALL
        plain = forms.select("_shape", F.lit(kind).alias("kind"), *(F.col(c) if c in SHAPE[kind] else F.lit(None).cast("double").alias(c) for c in COLUMNS[2:]))
        pairs = distinct.crossJoin(F.broadcast(plain)) if few else _by_grid(distinct, plain)
        found = pairs.withColumn("t", HITS[kind]()).where(F.col("t").between(F.col("t_min"), F.col("t_max"))).select("_ray", "_shape", "t")
        found = found if few else found.distinct()  # a pair may share several cells
        names = own.join(forms, SHAPE[kind]).select("_shape", "object_id")
        out, shapes = (found, names) if out is None else (out.unionByName(found), shapes.unionByName(names))
    if out is None:
        out = distinct.select("_ray", F.lit(0).cast("long").alias("_shape"), F.lit(0.0).alias("t")).where(F.lit(False))
        shapes = o.select(F.lit(0).cast("long").alias("_shape"), "object_id").where(F.lit(False))
    return checkpointed(out), shapes, r.join(distinct, RAY).select("_ray", "ray_id")


def _shifted(by: Column, scale: Column):
    return lambda x: (x + by) / scale


def _by_grid(rays: DataFrame, objects: DataFrame) -> DataFrame:
    """Ray-object pairs that share a cell; a ray's cells lie between the planes it crosses."""
    b = object_bounds(objects)
    grid = Levels.of(b)
    slab = []
    for a, lo, hi in zip(V, grid.low, grid.high):
        o, d = F.col(f"o{a}"), F.nullif(F.col(f"d{a}"), F.lit(0.0))
        slab.append(((F.lit(lo) - o) / d, (F.lit(hi) - o) / d))
    start = F.greatest(F.col("t_min"), *(F.coalesce(F.least(x, y), F.lit(float("-inf"))) for x, y in slab))
    end = F.least(F.col("t_max"), *(F.coalesce(F.greatest(x, y), F.lit(float("inf"))) for x, y in slab))
    r = rays.withColumn("_in", start).withColumn("_out", end).where("_in <= _out")
    r = r.withColumn("level", F.explode(F.array(*map(F.lit, grid.used))))
    scale = F.lit(grid.side) * F.pow(F.lit(2.0), F.col("level"))
    crossed = []
    for a, lo in zip(V, grid.low):
        o, d = F.col(f"o{a}"), F.col(f"d{a}")
        ends = [grid.at(a, o + F.col(t) * d, F.col("level")) for t in ("_in", "_out")]
        planes = F.sequence(F.least(*ends), F.greatest(*ends) + 1)
        zero, d0 = F.lit(lo) - o, F.nullif(d, F.lit(0.0))
        times = F.transform(F.transform(planes, lambda i: i * scale), _shifted(zero, d0))
        crossed.append(F.when(d != 0, F.filter(times, lambda t: (t > F.col("_in")) & (t < F.col("_out")))).otherwise(F.array().cast("array<double>")))
    times = F.array_sort(F.array_distinct(F.concat(F.array("_in", "_out"), *crossed)))
    r = r.withColumn("_ts", times)
    middle = F.when(F.size("_ts") == 1, F.col("_ts")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_ts") - 1, F.lit(1))), lambda i: (F.element_at("_ts", i) + F.element_at("_ts", i + 1)) / 2))
    r = r.withColumn("_t", F.explode(middle))
    r = r.withColumns({f"g{a}": grid.at(a, F.col(f"o{a}") + F.col("_t") * F.col(f"d{a}"), F.col("level")) for a in V}).drop("_in", "_out", "_ts", "_t")
    return r.join(grid.objects(b), ["level", "gx", "gy", "gz"])


def nearest_hit(rays: DataFrame, objects: DataFrame, object_filter: Column | None = None, hit_filter: Column | None = None) -> DataFrame:
    """(ray_id, object_id, t) of each ray's first hit; ties: least object_id."""
    first = F.min(F.struct("t", "object_id")).alias("h")
    if hit_filter is not None:
        return hits(rays, objects, object_filter, hit_filter).groupBy("ray_id").agg(first).select("ray_id", "h.object_id", "h.t")
    found, shapes, names = _traced(rays, objects, object_filter)
    least = shapes.groupBy("_shape").agg(F.min("object_id").alias("object_id"))
    best = found.join(least, "_shape").groupBy("_ray").agg(first)
    return best.join(names, "_ray").groupBy("ray_id").agg(F.min("h").alias("h")).select("ray_id", "h.object_id", "h.t")


def _distance() -> Column:
    """Of the point x, y, z from an object."""
    q = [F.col(a) for a in V]
    k = F.col("kind")
    outside = [F.greatest(F.col(f"a{a}") - p, F.lit(0.0), p - F.col(f"b{a}")) for a, p in zip(V, q)]
    box = F.sqrt(_dot(outside, outside))
    e = _sub(q, vec("a"))
    sphere = F.greatest(F.lit(0.0), F.sqrt(_dot(e, e)) - F.col("r"))
    segment = _segment(q, vec("a"), vec("b"))
    return F.when(k == "box", box).when(k == "sphere", sphere).when(k == "line", segment).when(k == "cylinder", F.greatest(F.lit(0.0), segment - F.col("r"))).when(k == "triangle", _triangle(q))


def closest(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """(query_id, object_id, distance): the object nearest to each point (x, y, z),
    to a surface; 0 inside boxes, spheres and cylinders. Ties: least object_id.

    Points and objects that repeat are worked out once. Points look at the cells within
    a radius. One whose nearest object there is no
    farther than that is done; the others try again with twice the radius, so the
    rounds grow with the logarithm of the largest distance.
    """
    forms = objects.select("object_id", "kind", *(F.when(F.col("kind").isin([k for k in SHAPE if c in SHAPE[k]]), F.col(c).cast("double")).alias(c) for c in COLUMNS[2:]))
    b = checkpointed(object_bounds(forms.groupBy(*COLUMNS[1:]).agg(F.min("object_id").alias("object_id"))))
    grid = Levels.of(b)
    if grid is None:
        return b.join(queries.limit(0).select("query_id")).select("query_id", "object_id", F.lit(0.0).alias("distance"))
    every = queries.select("query_id", *(F.col(a).cast("double").alias(a) for a in V))
    known = " and ".join(f"{a} is not null and not isnan({a})" for a in V)
    spots = _numbered(every.where(known).select(*V), "_spot")
    found = _closest(spots.withColumnRenamed("_spot", "query_id"), b, grid).withColumnRenamed("query_id", "_spot")
    return every.join(spots, [*V]).join(found, "_spot").select("query_id", "object_id", "distance")


def _closest(queries: DataFrame, b: DataFrame, grid: Levels) -> DataFrame:
    """As :func:`closest`, for objects with bounds and points without nulls."""
    todo, done, k = queries, None, 0
    while True:
        radius = grid.side * 2.0**k
        levels = sorted({max(k, i) for i in grid.used})
        q = todo.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        # no further than the objects' own box
        near = {a: (F.greatest(F.col(a) - radius, F.lit(lo)), F.least(F.col(a) + radius, F.lit(hi))) for a, lo, hi in zip(V, grid.low, grid.high)}
        for x, y in near.values():
            q = q.where(x <= y)
        q = grid.cells(q, {a: x for a, (x, _) in near.items()}, {a: y for a, (_, y) in near.items()})
        pairs = q.join(grid.objects(b, k), ["level", "gx", "gy", "gz"])
        best = pairs.withColumn("distance", _distance()).groupBy("query_id").agg(F.min(F.struct("distance", "object_id")).alias("h"))
        best = checkpointed(best.where(F.col("h.distance") <= radius).select("query_id", "h.object_id", "h.distance"))
        done = best if done is None else done.unionByName(best)
        todo = checkpointed(todo.join(best, "query_id", "left_anti"))
        if todo.isEmpty():
            return done
        k += 1


def _segment(q, a, b) -> Column:
    axis = _sub(b, a)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(_sub(q, a), axis) / F.nullif(_dot(axis, axis), F.lit(0.0)))), F.lit(0.0))
    e = [p - (x + t * y) for p, x, y in zip(q, a, axis)]
    return F.sqrt(_dot(e, e))


def _triangle(q) -> Column:
    a, b, c = vec("a"), vec("b"), vec("c")
    n = _cross(_sub(b, a), _sub(c, a))
    n2 = F.nullif(_dot(n, n), F.lit(0.0))
    h = _dot(_sub(q, a), n)
    inside = [_dot(_cross(_sub(y, x), _sub(q, x)), n) >= 0 for x, y in ((a, b), (b, c), (c, a))]
    edges = F.least(_segment(q, a, b), _segment(q, b, c), _segment(q, c, a))
    return F.when(inside[0] & inside[1] & inside[2] & n2.isNotNull(), F.abs(h) / F.sqrt(n2)).otherwise(edges)


def meeting_box(objects: DataFrame, lo, hi) -> DataFrame:
    """Objects whose bounds meet a closed box, once each."""
    from ..functions import geom

    return object_bounds(objects).where(geom.boxes_overlap(lo, hi)).select("object_id")


def inside_box(objects: DataFrame, lo, hi) -> DataFrame:
    from ..functions import geom

    return object_bounds(objects).where(geom.box_inside(lo, hi)).select("object_id")


def inside_mesh(queries: DataFrame, triangles: DataFrame) -> DataFrame:
    """(query_id, inside): whether a +z ray from the point leaves a closed mesh
    through an odd number of triangles."""
    up = queries.select(F.col("query_id").alias("ray_id"), *(F.col(a).alias(f"o{a}") for a in V), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"))
    n = hits(up, triangles).groupBy("ray_id").agg(F.countDistinct(F.round("t", 9)).alias("n"))
    return queries.join(n, queries["query_id"] == n["ray_id"], "left").select("query_id", (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))


def all_hits_ranked(rays: DataFrame, objects: DataFrame) -> DataFrame:
    """Hits with ``nth``, their number from 1 on their ray (by t, then object_id);
    a ray_id names one ray."""
    found, shapes, names = _traced(rays, objects)
    ranked = found.join(shapes, "_shape").withColumn("nth", F.row_number().over(Window.partitionBy("_ray").orderBy("t", "object_id")))
    return ranked.join(names, "_ray").select("ray_id", "object_id", "t", "nth")
