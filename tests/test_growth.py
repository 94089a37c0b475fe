"""Work that must not grow with the pairs of a crowded place, nor with equal rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import cluster, knn, mask, points, rays
from pointweave.plans import catalog
from pointweave.sources import ascii, binary


def brute_clusters(v: np.ndarray, delta: float) -> list[int]:
    root = list(range(len(v)))
    for i in range(len(v)):
        for j in np.flatnonzero(((v - v[i]) ** 2).sum(axis=1) <= delta * delta):
            a, b = root[i], root[int(j)]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.fixture
def links_seen(monkeypatch):
    """Numbers of links that components are asked to join."""
    seen = []
    found = cluster.components

    def counted(edges):
        seen.append(edges.count())
        return found(edges)

    monkeypatch.setattr(cluster, "components", counted)
    return seen


@pytest.mark.parametrize("size", [3, 64])
def test_vectors_of_a_crowd_are_linked_by_forests(spark, links_seen, size):
    rng = np.random.default_rng(size)
    v = rng.normal(size=(900, size)) / np.sqrt(size)
    v[:400] = v[0] + rng.normal(size=(400, size)) * 1e-3
    v[400:420] = v[0]
    v[420] = v[421] + np.eye(size)[0] * 0.25  # exactly at the limit, or past it by rounding
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [float("nan")] * size), (902, [None] * size), (903, []), (904, []), (905, [0.0] * (size + 1)), (906, [-0.0] * (size + 1))]
    df = spark.createDataFrame(rows + odd, "point_id long, v array<double>")
    got = dict(cluster.by_vector(df, 0.25).collect())
    assert [got[i] for i in range(900)] == brute_clusters(v, 0.25)
    assert [got[i] for i in range(900, 907)] == [900, 901, 902, 903, 903, 905, 905]
    assert links_seen[0] < 2 * 900  # 400 near copies have 79,800 pairs


def crowd_of_objects(spark):
    """30,000 objects in nine shapes, 4,000 rays in four, all over one spot."""
    kind = F.element_at(F.array(*map(F.lit, ("box", "sphere", "triangle"))), (F.col("id") % 3 + 1).cast("int"))
    at = (F.col("id") % 9 / 3).cast("int").cast("double")
    shape = {f"{p}{a}": at + v for p, v in zip("abc", (0.0, 2.0, 1.0)) for a in "xyz"} | {"cx": at + 3.0}
    objects = spark.range(30_000).select(F.col("id").alias("object_id"), kind.alias("kind"), *(v.alias(c) for c, v in shape.items()), F.lit(1.5).alias("r"))
    tail = spark.range(300).select((F.col("id") + 30_000).alias("object_id"), F.lit("box").alias("kind"), *((F.col("id") % 17 * 5 + i + 10.0).alias(f"{p}{a}") for p, i in zip("abc", (0, 2, 1)) for a in "xyz"), F.lit(1.0).alias("r"))
    rays_ = spark.range(4_000).select(F.col("id").alias("ray_id"), (F.col("id") % 4 * 0.5 + 0.25).alias("ox"), F.lit(0.75).alias("oy"), F.lit(-5.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.01).alias("dy"), F.lit(1.0).alias("dz"))
    return objects.unionByName(tail), rays_


@pytest.fixture
def pairs_seen(monkeypatch):
    """Rows of every table that is written on the way."""
    seen = []
    written = rays.checkpointed

    def counted(df):
        out = written(df)
        seen.append(out.count())
        return out

    monkeypatch.setattr(rays, "checkpointed", counted)
    return seen


def test_equal_rays_and_objects_are_traced_once(spark, pairs_seen):
    objects, some = crowd_of_objects(spark)
    few = objects.where("object_id < 9 or object_id >= 30000")
    one = {r.ray_id: (r.object_id, r.t) for r in rays.nearest_hit(some.where("ray_id < 4"), few).collect()}
    first = {r.ray_id: (r.object_id, r.t) for r in rays.nearest_hit(some, objects).collect()}
    assert len(first) == 4_000 and all(first[i] == one[i % 4] for i in first)
    per_ray = {r.ray_id: r["count"] for r in rays.hits(some.where("ray_id < 4"), few.where("object_id < 9")).groupBy("ray_id").count().collect()}
    ranked = rays.all_hits_ranked(some.where("ray_id >= 3996"), objects.where("object_id < 9000"))
    got = {r.ray_id: (r.n, r.top, r.apart) for r in ranked.groupBy("ray_id").agg(F.count("*").alias("n"), F.max("nth").alias("top"), F.countDistinct("nth").alias("apart")).collect()}
    assert got == {3996 + i: (1000 * n,) * 3 for i, n in per_ray.items()}
    assert max(pairs_seen) < 1_000


def test_equal_points_look_once(spark, pairs_seen):
    objects, some = crowd_of_objects(spark)
    q = some.select(F.col("ray_id").alias("query_id"), F.col("ox").alias("x"), F.lit(-4.0).alias("y"), F.lit(9.5).alias("z"))
    few = {r.query_id: (r.object_id, r.distance) for r in rays.closest(q.where("query_id < 4"), objects.where("object_id < 9 or object_id >= 30000")).collect()}
    got = {r.query_id: (r.object_id, r.distance) for r in rays.closest(q, objects).collect()}
    assert len(got) == 4_000 and all(got[i] == few[i % 4] for i in got)
    assert max(pairs_seen) < 1_000


@pytest.mark.parametrize("strict", [False, True])
def test_nearest_of_a_crowd(spark, monkeypatch, strict):
    monkeypatch.setattr(knn, "LEAF", 64)
    monkeypatch.setattr(knn, "QUERIES", 100)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(1500, 3)), np.zeros((400, 3)), np.round(rng.random((300, 3)) * 4) / 4, rng.normal(size=(300, 3)) * 0.01 + 2])
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), *x.tolist()) for i, x in zip(ids, v)] + [(9000, None, 0.0, 0.0), (9001, float("nan"), 0.0, 0.0)], "point_id long, x double, y double, z double")
    asked = np.concatenate([v[::5], rng.normal(size=(200, 3)) * 3, np.zeros((150, 3))])
    q = spark.createDataFrame([(i, *x.tolist()) for i, x in enumerate(asked)], "query_id int, x double, y double, z double")
    radius, k = 0.5, 9
    want = []
    for i, x in enumerate(asked):
        e = v - x
        d = np.sqrt(e[:, 0] * e[:, 0] + e[:, 1] * e[:, 1] + e[:, 2] * e[:, 2])
        fits = np.flatnonzero(d < radius if strict else d <= radius)
        want += [(i, int(b), float(a), r + 1) for r, (a, b) in enumerate(sorted(zip(d[fits], ids[fits]))[:k])]
    want.sort()
    pairs = knn.k_nearest(q, df, radius, k, strict)
    assert sorted(map(tuple, pairs.select("query_id", "point_id", "distance", "rank").collect())) == want
    assert sorted(map(tuple, knn.nearest_join(q, df, radius, k, strict).collect())) == want
    assert knn.nearest_join(q, df.limit(0), radius, k).collect() == [] == knn.nearest_join(q.limit(0), df, radius, k).collect()


def test_few_pairs_are_made_of_a_crowd_within_the_radius(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *x.tolist()) for i, x in enumerate(rng.random((4000, 3)))], "point_id long, x double, y double, z double")
    made = knn.nearest_join(df.withColumnRenamed("point_id", "query_id"), df, 5.0, 4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin [cx" not in plan  # all 16,000,000 pairs before
    assert made.count() == 16_000


@pytest.mark.parametrize("strict", [False, True])
def test_cells_that_are_joined_are_not_compared_again(spark, links_seen, strict):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.random((700, 3)), rng.random((60, 3)) * 3 + 1.2, np.round(rng.random((60, 3)) * 8) / 4 - 3])
    df = spark.createDataFrame([(i, *x.tolist()) for i, x in enumerate(v)], "point_id long, x double, y double, z double")
    got = dict(cluster.by_distance(df, 0.25, strict).collect())
    assert [got[i] for i in range(len(v))] == brute_clusters(v, np.nextafter(0.25, 0) if strict else 0.25)
    assert links_seen[-1] < 2.5 * len(v)  # some 10,000 pairs of cells before


def test_centroids_of_points_that_share_an_id(spark, tmp_path):
    row = (7, 100, 5, 3, 2.0, 4500.0, 0.05, 0.02, "N", "O")
    other = (7, 100, 5, 3, 40.0, 91000.0, 0.01, 0.02, "A", "F")
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([row, row, other], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["cluster_centroids"](spark, str(tmp_path)).select("n", "cy").collect()
    assert sorted(map(tuple, got)) == [(1, 91.0), (2, 4.5)]


@pytest.mark.parametrize("kind", ["las", "ply", "e57"])
def test_files_of_one_part_stay_small(spark, monkeypatch, kind):
    monkeypatch.setattr(binary, "FILE", 500)
    monkeypatch.setattr(binary, "HELD", 1200)
    p = spark.range(20_000, numPartitions=3).select(*((F.col("id") % m / 8).alias(a) for a, m in zip("xyz", (64, 80, 96))), *((F.col("id") % m).cast("int").alias(c) for c, m in zip("rgb", (251, 241, 239))), F.when(F.col("id") % 4 > 0, 3).otherwise((F.col("id") % 40).cast("int")).alias("part"))
    columns = dict.fromkeys("xyz", "f8") | dict.fromkeys("rgb", "u1")
    files = binary.pack_files(p, kind, "part", columns).cache()
    back = binary.unpacked(files, kind).select(*(F.round(a, 3).alias(a) for a in "xyz"), *"rgb")
    assert back.exceptAll(p.select(*back.columns)).count() == 0 and back.count() == 20_000
    most = binary.unpacked(files, kind).groupBy("path").count().agg(F.max("count")).first()[0]
    assert most <= 500 + 10_000 and files.where("path like '3/%'").count() > 1  # one file of 15,000 points before


def test_lines_are_split_once(spark):
    text = spark.createDataFrame([(v,) for v in ("\t1  2\x0b3 4\r5 6 7 \f", "1 2 3", "", " # 1 2 3 4 5 6 7", "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8")], "value string")
    made = ascii.parse_lines(text, ascii.LAYOUTS["yxh"])
    assert [tuple(r) for r in made.select("x", "y", "z", "intensity").collect()] == [(1.0, 2.0, 3.0, 4)] * 2
    particles = ascii.parse_particles(text.select(F.concat_ws(" ", *(F.col("value") for _ in range(4))).alias("value")))
    for df in (made, particles):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert particles.count() == 2


@pytest.mark.parametrize("metric", ["chebyshev", "euclid"])
def test_thinning_holds_a_batch_at_a_time(spark, metric):
    rng = np.random.default_rng(8)
    v = np.concatenate([np.cumsum(rng.normal(size=(500, 3)), axis=0), rng.random((300, 3)), rng.random((400, 3)) * 9])
    part = [None if i % 5 == 4 else int(i % 5 > 1) for i in range(len(v))]
    df = spark.createDataFrame([(i, *x.tolist(), g) for i, (x, g) in enumerate(zip(v, part))], "point_id long, x double, y double, z double, part int").repartition(7)
    want = []
    for g in {None, 0, 1}:
        last = None
        for i in [i for i in range(len(v)) if part[i] == g]:
            e = None if last is None else np.abs(v[i] - last)
            if e is None or ((e >= 1.5).any() if metric == "chebyshev" else (e**2).sum() >= 1.5**2):
                want.append(i)
                last = v[i]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        spark.conf.set(size, 7)
        thin = points.thin_sequentially(df, 1.5, metric, ["part"])
        assert sorted(r.point_id for r in thin.collect()) == sorted(want)
    finally:
        spark.conf.unset(size)
    assert "FlatMapGroupsInPandas" not in thin._jdf.queryExecution().executedPlan().toString()  # whole groups in memory before


def test_screen_positions_are_worked_out_once(spark):
    m = np.array([[0.0125, 0, 0, 0], [0, 0.0375, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], float)
    ring = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.6), (-0.4, 0.3)]
    df = spark.createDataFrame([(1, 8.0, 2.0, 0.5), (2, 60.0, 2.0, 0.5), (3, None, 2.0, 0.5), (4, 8.0, 2.0, -0.5)], "point_id int, x double, y double, z double")
    for made in (df.where(mask.of_polygon(ring, m).column()), knn.pick(df, m, knn.polygon_region(ring), (0.0, 0.0, 0.0))):
        assert 1 in [r.point_id for r in made.collect()] and made.where("point_id in (2, 3)").count() == 0
        assert made._jdf.queryExecution().optimizedPlan().toString().count("0.0125") <= 1
