"""Predicates, filters, masks, thinning: against NumPy and by construction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import geom
from pointweave.operators import cells, filters, knn, mask, points


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(0).random((1024, 3))


@pytest.fixture(scope="module")
def cloud(spark, cube):
    rows = [(i, *map(float, p), i % 4, int(i % 7)) for i, p in enumerate(cube)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, part_index int, classification int").repartition(4).cache()


def ids(df):
    return sorted(r.point_id for r in df.select("point_id").collect())


def test_box_is_closed(cloud):
    assert points.count(cloud, geom.in_box((0, 0, 0), (1, 1, 1))).first().n == 1024
    assert points.exists(cloud, geom.in_box((0, 0, 0), (1, 1, 1)))
    assert not points.exists(cloud, geom.in_box((2, 2, 2), (3, 3, 3)))


@pytest.mark.parametrize(("q", "r", "k", "n"), [((0.5, 0.5, 0.5), 1.0, 10000, 1024), ((2.5, 0.5, 0.5), 1.0, 10000, 0), ((0.75, 0.5, 0.25), 0.5, 100, 100), ((0.75, 0.5, 0.25), 0.25, 10, 10), ((0.75, 0.5, 0.25), 0.25, 1, 1)])
def test_nearest(cloud, cube, q, r, k, n):
    got = [x.point_id for x in knn.nearest(cloud, q, r, k).collect()]
    d = np.linalg.norm(cube - q, axis=1)
    assert len(got) == n and got == [i for i in np.argsort(d, kind="stable") if d[i] <= r][:k]


def test_nearest_join_splits_crowded_cells(spark, cloud, cube, monkeypatch):
    monkeypatch.setattr(knn, "PART", 20)
    q = cloud.where("point_id % 16 = 0").select(F.col("point_id").alias("query_id"), "x", "y", "z")
    got = {}
    for r in knn.nearest_join(q, cloud, 0.2, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.point_id))
    for i in range(0, 1024, 16):
        d = np.linalg.norm(cube - cube[i], axis=1)
        assert [p for _, p in sorted(got[i])] == [j for j in np.argsort(d, kind="stable") if d[j] <= 0.2][:5]


def test_hull_of_box_and_bounds(cloud):
    hull = geom.hull_of_box((0.2, 0.3, 0.1), (0.7, 0.9, 0.6))
    assert ids(points.where(cloud, geom.in_hull(hull), geom.hull_bounds(hull))) == ids(cloud.where(geom.in_box((0.2, 0.3, 0.1), (0.7, 0.9, 0.6))))
    assert geom.hull_bounds(hull[:3]) is None
    assert ids(cloud.where(geom.beyond_hull(hull))) == []


def test_near_polygon_is_part_of_near_plane(cloud, cube):
    ring = [(0.4, 0.4, 0.5), (0.6, 0.4, 0.5), (0.6, 0.6, 0.5), (0.4, 0.6, 0.5)]
    want = [i for i, p in enumerate(cube) if abs(p[2] - 0.5) <= 0.1 and 0.4 <= p[0] < 0.6 and 0.4 <= p[1] < 0.6]
    assert ids(cloud.where(geom.near_polygon(ring, 0.1))) == want
    assert set(want) <= set(ids(cloud.where(geom.near_plane((0, 0, 2), 1.0, 0.1))))


def test_ray_that_misses_the_cloud(cloud):
    assert points.near_ray(cloud, (5, 5, 5), (1, 0, 0), 10.0).count() == 0
    assert points.near_ray(cloud, (-1, 0.5, 0.5), (1, 0, 0), 2.0).count() == 1024


FILTERS = [
    filters.InsideBox((0.0, 0.1, 0.2), (0.5, 0.6, 0.7)),
    filters.OutsideBox((0.0, 0.1, 0.2), (0.5, 0.6, 0.7)),
    filters.InsideHull(tuple((tuple(n), d) for n, d in geom.hull_of_box((0, 0, 0), (0.5, 0.5, 0.5)))),
    filters.InsideHulls.of_footprint([(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.4)], 0.2, 0.8),
    filters.InsidePrism((((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.5, 0.4)),), 0.2, 0.8),
    filters.InsideSphere((0.5, 0.5, 0.5), 0.3),
    filters.Classification(frozenset({1, 3})),
    filters.Intensity(3, 9),
    filters.NormalDirection((0.0, 0.0, 1.0), 20.0),
    filters.InsideBox((0.0, 0.0, 0.0), (0.4, 1.0, 1.0)) & filters.InsideSphere((0.5, 0.5, 0.5), 0.3),
    filters.InsideBox((0.0, 0.0, 0.0), (0.1, 1.0, 1.0)) | filters.Classification(frozenset({2})),
]


@pytest.mark.parametrize("f", FILTERS, ids=lambda f: f.type_name)
def test_filter_json_round_trip(cloud, f):
    again = filters.from_json(f.to_json())
    assert again.to_json() == f.to_json()
    assert ids(again.apply(cloud)) == ids(f.apply(cloud)) == ids(cloud.where(f.column(cloud.columns)))


def test_footprint_hulls_equal_prism(cloud):
    assert ids(FILTERS[3].apply(cloud)) == ids(FILTERS[4].apply(cloud))
    for bad in ([(0, 0), (1, 1)], [(0, 0), (1, 1), (1, 0), (0, 1)], [(0, 0), (0, 0), (1, 1)]):
        with pytest.raises(ValueError):
            filters.InsideHulls.of_footprint(bad, 0, 1)


def test_missing_attributes(cloud):
    assert filters.Intensity(0, 9).apply(cloud).count() == 0
    assert filters.Classification(frozenset()).apply(cloud.drop("classification")).count() == 1024


def test_mask_algebra(cloud, cube):
    m = np.eye(4)
    a, b = mask.of_polygon([(0, 0), (0.6, 0), (0.6, 0.6), (0, 0.6)], m), mask.of_polygon([(0.3, 0.3), (1, 0.3), (1, 1), (0.3, 1)], m)
    na, nb = set(ids(cloud.where(a.column()))), set(ids(cloud.where(b.column())))
    for op, want in ((a & b, na & nb), (a | b, na | nb), (a ^ b, na ^ nb), (a - b, na - nb)):
        assert set(ids(cloud.where(mask.from_json(op.to_json()).column()))) == want
    assert na == {i for i, p in enumerate(cube) if p[0] <= 0.6 and p[1] <= 0.6}


@pytest.mark.parametrize("metric", ["chebyshev", "euclid"])
def test_sequential_thinning(cloud, cube, metric):
    kept, last = [], None
    for i, p in enumerate(cube):
        far = last is None or (np.abs(p - last).max() >= 0.5 if metric == "chebyshev" else ((p - last) ** 2).sum() >= 0.25)
        if far:
            kept.append(i)
            last = p
    assert ids(points.thin_sequentially(cloud, 0.5, metric)) == kept


def test_grid_thinning_and_dedup(spark, cloud, cube):
    first = {}
    for i, p in enumerate(cube):
        first.setdefault(tuple(np.floor(p / 0.25)), i)
    assert ids(points.thin_by_cell(cloud, 0.2)) == sorted(first.values())
    twice = cloud.unionByName(cloud.withColumn("point_id", F.col("point_id") + 5000))
    assert ids(points.deduplicate(twice)) == list(range(1024))


def test_union_pads_and_defaults(spark, cloud):
    other = cloud.drop("classification").withColumn("intensity", F.lit(7))
    both = points.with_defaults(points.union(cloud, other))
    assert both.count() == 2048 and both.where("classification is null or intensity is null").count() == 0


def test_kernels_by_construction(spark):
    n = 4
    rows = [(i, (x + 0.5) / n, (y + 0.5) / n, (z + 0.5) / n) for i, (x, y, z) in enumerate(np.ndindex(n, n, n))]
    grid = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    around = cells.neighbourhoods(cells.cells(grid, -2), [(-1,) * 3, (1,) * 3])
    assert sorted({r.cells_around for r in around.collect()}) == [8, 12, 18, 27]
    with pytest.raises(ValueError):
        cells.offsets([(0,) * 3, (1,) * 3], [(-1,) * 3, (0,) * 3])


def test_part_range_and_hash(cloud):
    assert tuple(points.part_range(cloud).first()) == (0, 3)
    assert points.content_hash(cloud).first() == points.content_hash(cloud.repartition(7)).first()
