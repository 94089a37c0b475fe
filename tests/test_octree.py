"""Octree, level of detail, clustering, normals: invariants and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.functions import geom
from pointweave.operators import cluster, normals, octree
from pointweave.plans.cloud import ImportConfig, PointCloud
from pointweave.sources.registry import Store


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(1).random((4000, 3))


@pytest.fixture(scope="module")
def cloud(spark, cube):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cube)], "point_id long, x double, y double, z double")
    return PointCloud(df.repartition(4).cache(), ImportConfig(split_limit=100))


def test_tree_invariants(cloud):
    assert cloud.root == octree.Root((0.0, 0.0, 0.0), 0, False)
    tree = {(r.level, r.cx, r.cy, r.cz): r for r in cloud.tree.collect()}
    leaves = [r for r in tree.values() if r.is_leaf]
    assert sum(r.n for r in leaves) == 4000 and max(r.n for r in leaves) <= 100
    for (level, *c), r in tree.items():
        if level:
            assert tree[(level - 1, *(k >> 1 for k in c))].n > 100
    s = octree.tree_stats(cloud.tree).first()
    assert s.nodes == len(tree) and s.leaves == len(leaves) and s.points == 4000


def test_level_of_detail(cloud):
    np_rows = cloud.node_points.select("point_id", *octree.KEYS, "is_leaf").collect()
    assert sorted(r.point_id for r in np_rows if r.is_leaf) == list(range(4000))
    own = {}
    for r in np_rows:
        own.setdefault((r.level, r.cx, r.cy, r.cz, r.is_leaf), []).append(r.point_id)
    for (_, _, _, _, leaf), found in own.items():
        assert len(set(found)) == len(found) and (leaf or len(found) == 100)
    assert octree.front(cloud.node_points, cloud.root, 0).count() == 100
    assert octree.front(cloud.node_points, cloud.root, -1).count() == 800
    assert cloud.level(-1).count() == 0


def test_level_below():
    assert octree.level_below([100, 800, 4000], 900) == 1
    assert octree.level_below([100, 800, 4000], 10) == -1


def test_approximate_count_is_not_below_the_exact(cloud):
    lo, hi = (0.2, 0.2, 0.2), (0.5, 0.9, 0.4)
    exact = cloud.count(geom.in_box(lo, hi))
    assert exact <= cloud.count_approximately(lo, hi) <= 4000
    assert cloud.count_approximately((0, 0, 0), (1, 1, 1)) == 4000


def test_roots():
    assert octree.root_cell((-1, -1, -1), (1, 1, 1)).centred
    r = octree.root_cell((5.1, 5.1, 5.1), (5.9, 5.2, 5.2))
    assert all(a <= 5.1 and a + r.side > 5.9 for a in r.low)
    assert octree.root_cell((3.0, 3.0, 3.0), (3.0, 3.0, 3.0)).side > 0


def test_duplicates_end_at_the_last_level(spark):
    df = spark.range(50).select(F.col("id").alias("point_id"), *(F.lit(0.3).alias(a) for a in "xyz"))
    deep = octree.nodes(df, octree.Root((0.0, 0.0, 0.0), 0, False), 10).where("is_leaf").collect()
    assert len(deep) == 1 and deep[0].level == octree.DEPTH and deep[0].n == 50


def test_morton_order(spark, cloud):
    rows = cloud.points.select("x", "y", "z", octree.morton(cloud.root).alias("m")).limit(200).collect()
    for r in rows:
        t = [int(c * 2**21) for c in (r.x, r.y, r.z)]
        assert r.m == sum((t[a] >> b & 1) << (3 * b + a) for b in range(21) for a in range(3))


def test_delete_and_merge(cloud, cube):
    rest = cloud.delete(geom.in_box((0.25, 0.25, 0.25), (1, 1, 1)))
    assert rest.points.count() == int((cube < 0.25).any(axis=1).sum())
    assert cloud.delete(F.lit(True)) is None
    assert rest.merge(cloud).points.count() == rest.points.count() + 4000


def test_store_round_trip(spark, cloud, tmp_path):
    store = Store(spark, str(tmp_path))
    cloud.save(store, "a")
    back = PointCloud.load(store, "a")
    assert back.points.count() == 4000 and back.config.split_limit == 100
    other = Store(spark, str(tmp_path / "copy"))
    store.copy_to("a", other)
    assert other.table("a", "node_points").count() == cloud.node_points.count()


def plain_labels(p, near):
    name = list(range(len(p)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(p)):
        for j in range(i):
            if near(p[i], p[j]):
                a, b = sorted((find(i), find(j)))
                name[b] = a
    return [find(i) for i in range(len(p))]


def test_clusters(spark):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.random((150, 3)), np.repeat(rng.random((1, 3)), 20, axis=0), rng.random((30, 3)) * 0.02])
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "point_id long, x double, y double, z double")
    for delta, strict in ((0.08, False), (0.15, True)):
        near = (lambda a, b: ((a - b) ** 2).sum() < delta**2) if strict else (lambda a, b: ((a - b) ** 2).sum() <= delta**2)
        got = {r.point_id: r.cluster_id for r in cluster.by_distance(df, delta, strict).collect()}
        assert [got[i] for i in range(len(p))] == plain_labels(p, near)
    eq = {r.point_id: r.cluster_id for r in cluster.equal(df).collect()}
    assert [eq[i] for i in range(len(p))] == plain_labels(p, lambda a, b: (a == b).all())


def test_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in cluster.components(edges).collect()} == {0}
    assert cluster.components(edges.limit(0)).collect() == []


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(5)
    p = rng.random((300, 3))
    p[:, 2] = 0.5 * p[:, 0]
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "point_id long, x double, y double, z double")
    want = np.array([-0.5, 0, 1]) / np.linalg.norm([-0.5, 0, 1])
    for r in normals.estimate(df, 0.5, 16).collect():
        assert np.allclose([r.nx, r.ny, r.nz], want, atol=1e-5) and r.flatness == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        normals.estimate(df, 0.5, 2)


def test_a_box_test_never_rules_out_a_point(spark):
    """Wherever a point of a node fits a predicate, the test of the node's bounds holds."""
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(i, i % 40, *map(float, q)) for i, q in enumerate(rng.uniform(-3, 3, (800, 3)) + rng.integers(-4, 5, (800, 3)))], "point_id long, cx int, x double, y double, z double").withColumns({k: F.lit(0) for k in ("level", "cy", "cz")})
    lo, hi, flat = (-2.0, -1.0, 0.0), (3.0, 4.0, 2.0), 1e300
    hull = geom.hull_of_box(lo, hi)
    ring = [(-2.0, -2.0, 0.5), (3.0, -2.0, 0.5), (2.0, 3.0, 0.5)]
    plane = ((0.0, 0.6, 0.8), 1.0)
    xy = (F.col("x"), F.col("y"))
    pairs = [
        (geom.in_box(lo, hi), geom.boxes_overlap(lo, hi)),
        (~geom.in_box(lo, hi), ~geom.box_inside(lo, hi)),
        (geom.in_box(lo[:2], hi[:2], xy), geom.boxes_overlap((*lo[:2], -flat), (*hi[:2], flat))),
        (~geom.in_box(lo[:2], hi[:2], xy), ~geom.box_inside((*lo[:2], -flat), (*hi[:2], flat))),
        (geom.in_hull(hull), geom.box_may_meet_hull(hull)),
        (~geom.in_hull(hull), geom.box_may_leave_hull(hull)),
        (geom.near_plane(*plane, 0.5), geom.box_meets_plane(*plane, 0.5)),
        (~geom.near_plane(*plane, 0.5), geom.box_may_leave_plane(*plane, 0.5)),
        (geom.near_polygon(ring, 0.5), geom.box_may_meet_polygon(ring, 0.5)),
    ]
    whole = octree.with_stats(p)
    own = p.groupBy("cx").agg(*(F.bool_or(a).alias(f"p{i}") for i, (a, _) in enumerate(pairs)))
    got = whole.join(own, "cx").select(*(F.count_if(F.col(f"p{i}") & ~b).alias(f"wrong{i}") for i, (_, b) in enumerate(pairs)), *(F.count_if(F.col(f"p{i}")).alias(f"some{i}") for i in range(len(pairs)))).first()
    assert not any(got[: len(pairs)]) and all(got[len(pairs) :])
