"""A point cloud: points, its octree, and every query as a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..operators import cells, filters, knn, normals, octree, points
from ..sources.binary import with_ids
from ..sources.registry import Store, read


@dataclass(frozen=True)
class ImportConfig:
    split_limit: int = octree.SPLIT_LIMIT
    deduplicate: bool = True
    min_distance: float = 0.0
    global_density: bool = True  # thin by cell; else one after another
    reproject: object = None  # a function of a DataFrame
    normals_radius: float = 0.0
    defaults: dict | None = None


@dataclass(frozen=True)
class PointCloud:
    points: DataFrame
    config: ImportConfig = ImportConfig()

    # --- import and export

    @classmethod
    def build(cls, source: DataFrame, config: ImportConfig = ImportConfig()) -> PointCloud:
        """Normalises a source in one order: re-projection, duplicates, thinning, normals, defaults."""
        p = source if "point_id" in source.columns else with_ids(source)
        if config.reproject:
            p = config.reproject(p)
        if config.deduplicate:
            p = points.deduplicate(p)
        if config.min_distance > 0:
            p = points.thin_by_cell(p, config.min_distance) if config.global_density else points.thin_sequentially(p, config.min_distance)
        if config.normals_radius > 0:
            n = normals.estimate(p, config.normals_radius).drop("flatness")
            p = p.drop("nx", "ny", "nz", "density").join(n, "point_id", "left")
        return cls(points.with_defaults(p, config.defaults), config)

    @classmethod
    def import_file(cls, spark: SparkSession, path: str, config: ImportConfig = ImportConfig()) -> PointCloud:
        return cls.build(read(spark, path), config)

    def save(self, store: Store, key: str) -> None:
        """Points in Morton order, nodes with statistics, and node points."""
        root = self.root
        if root is None:
            raise ValueError("the cloud is empty")
        meta = {"id": key, "split_limit": self.config.split_limit, "root": {"low": list(root.low), "exponent": root.exponent, "centred": root.centred}}
        store.put(key, {"points": octree.clustered(self.points, root), "nodes": self.nodes, "node_points": self.node_points}, meta)

    @classmethod
    def load(cls, store: Store, key: str) -> PointCloud:
        return cls(store.table(key, "points").drop("morton"), ImportConfig(split_limit=store.meta(key)["split_limit"]))

    # --- the tree

    @cached_property
    def root(self) -> octree.Root | None:
        box = points.bounds(self.points)
        return octree.root_cell(*box) if box else None

    @cached_property
    def tree(self) -> DataFrame:
        return octree.nodes(self.points, self.root, self.config.split_limit)

    @cached_property
    def node_points(self) -> DataFrame:
        return octree.level_of_detail(octree.assign(self.points, self.tree, self.root), self.tree, self.config.split_limit)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.tree.join(octree.with_stats(self.node_points), octree.KEYS)

    def front(self, exponent: int | None = None) -> DataFrame:
        return self.points if exponent is None else octree.front(self.node_points, self.root, exponent)

    def level(self, level: int) -> DataFrame:
        return octree.at_level(self.node_points, level)

    # --- predicates: each has rows, exact and approximate counts

    def where(self, test: Column, box=None, exponent: int | None = None) -> DataFrame:
        return points.where(self.front(exponent), test, box)

    def count(self, test: Column) -> int:
        return points.count(self.points, test).first()[0]

    def contains(self, test: Column) -> bool:
        return points.exists(self.points, test)

    def count_approximately(self, lo, hi) -> int:
        return octree.approximate_count(self.nodes.where("is_leaf"), lo, hi).first()[0]

    def inside_box(self, lo, hi, exponent: int | None = None) -> DataFrame:
        return self.where(geom.in_box(lo, hi), None, exponent)

    def outside_box(self, lo, hi, exponent: int | None = None) -> DataFrame:
        return self.where(~geom.in_box(lo, hi), None, exponent)

    def inside_hull(self, planes, exponent: int | None = None) -> DataFrame:
        return self.where(geom.in_hull(planes), geom.hull_bounds(planes), exponent)

    def outside_hull(self, planes, reversed: bool = False, exponent: int | None = None) -> DataFrame:
        return self.where(geom.beyond_hull(planes) if reversed else ~geom.in_hull(planes), None, exponent)

    def inside_frustum(self, matrix, exponent: int | None = None) -> DataFrame:
        return self.inside_hull(geom.frustum_planes(matrix), exponent)

    def near_planes(self, planes, within: float, exponent: int | None = None) -> DataFrame:
        return self.where(geom.any_of([geom.near_plane(n, d, within) for n, d in planes]), None, exponent)

    def not_near_planes(self, planes, within: float, exponent: int | None = None) -> DataFrame:
        return self.where(~geom.any_of([geom.near_plane(n, d, within) for n, d in planes]), None, exponent)

    def near_polygons(self, rings, within: float, exponent: int | None = None) -> DataFrame:
        return self.where(geom.any_of([geom.near_polygon(r, within) for r in rings]), None, exponent)

    def not_near_polygons(self, rings, within: float, exponent: int | None = None) -> DataFrame:
        return self.where(~geom.any_of([geom.near_polygon(r, within) for r in rings]), None, exponent)

    def near_ray(self, origin, direction, radius: float, t_min: float | None = None, t_max: float | None = None) -> DataFrame:
        return points.near_ray(self.points, origin, direction, radius, t_min, t_max)

    def near_segment(self, p0, p1, radius: float) -> DataFrame:
        return points.near_segment(self.points, p0, p1, radius)

    def near_point(self, q, radius: float, k: int | None = None) -> DataFrame:
        return knn.nearest(self.points, q, radius, k)

    def near_points(self, queries: DataFrame, radius: float, k: int | None = None) -> DataFrame:
        return knn.nearest_join(queries, self.points, radius, k)

    # --- views, edits, cells

    def view(self, f: filters.PointFilter) -> PointCloud:
        return replace(self, points=f.apply(self.points))

    def delete(self, test: Column) -> PointCloud | None:
        """What is left, or None if nothing is. Trees are made anew when asked for."""
        rest = points.delete(self.points, test)
        return None if rest.limit(1).isEmpty() else replace(self, points=rest)

    def merge(self, *others: PointCloud) -> PointCloud:
        return replace(self, points=points.union(self.points, *(o.points for o in others)))

    def cells(self, exponent: int, stride=(1, 1, 1)) -> DataFrame:
        return cells.cells(self.points, exponent, stride)

    def columns(self, exponent: int, stride=(1, 1)) -> DataFrame:
        return cells.columns(self.points, exponent, stride)

    def grid(self, stride) -> DataFrame:
        return cells.grid_xy(self.points, stride)

    def inlined(self, digits: int | None = None) -> DataFrame:
        """One self-contained row a node: its points as an array."""
        xyz = [F.round(c, digits).alias(c) if digits is not None else F.col(c) for c in "xyz"]
        return self.node_points.groupBy(*octree.KEYS).agg(F.array_sort(F.collect_list(F.struct("point_id", *xyz))).alias("points"))
