"""The octree as tables: one aggregate gives all its nodes, no insertion loop.

``nodes`` has a row for each node (level, cell coordinates relative to the
root, counts, bounds); ``node_points`` has each leaf's points and each inner
node's level-of-detail sample. Cells at a working level are counted once; all
levels above are rolled up from those counts, and only crowded cells are
counted again deeper.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..session import checkpointed

SPLIT_LIMIT = 8192
DEPTH = 21  # bits of a coordinate in the 63-bit Morton key
#: Levels that a counting step goes down at once.
STRIDE = 4
KEYS = ["level", "cx", "cy", "cz"]


@dataclass(frozen=True)
class Root:
    """The root cell: lower corner, and the exponent of its side."""

    low: tuple[float, float, float]
    exponent: int
    centred: bool

    @property
    def side(self) -> float:
        return 2.0**self.exponent


def root_cell(lo, hi) -> Root:
    """The smallest cell of a power-of-two side that holds the box; if an axis
    plane cuts the box, the smallest such cell around the origin."""
    if any(a < 0 <= b for a, b in zip(lo, hi)):
        most = max(max(abs(a), abs(b)) for a, b in zip(lo, hi))
        e = math.ceil(math.log2(most)) + 1 if most > 0 else 0
        while 2.0 ** (e - 1) <= max(hi):  # cells are half-open
            e += 1
        return Root(tuple([-(2.0 ** (e - 1))] * 3), e, True)
    span = max(b - a for a, b in zip(lo, hi))
    e = math.floor(math.log2(span)) if span > 0 else -20
    while True:
        at = [math.floor(a / 2.0**e) for a in lo]
        if at == [math.floor(b / 2.0**e) for b in hi]:
            return Root(tuple(k * 2.0**e for k in at), e, False)
        e += 1


def ticks(root: Root) -> list[Column]:
    """Coordinates in 2^DEPTH steps of the root cell."""
    top = (1 << DEPTH) - 1
    return [F.least(F.lit(top), F.greatest(F.lit(0), F.floor((F.col(a) - F.lit(o)) / F.lit(root.side) * F.lit(float(1 << DEPTH))))).cast("long") for a, o in zip("xyz", root.low)]


def _spread(v: Column) -> Column:
    """Bits of a 21-bit number moved three apart."""
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(root: Root) -> Column:
    """63-bit key; octants have x as bit 0, y as bit 1, z as bit 2."""
    x, y, z = map(_spread, ticks(root))
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def clustered(points: DataFrame, root: Root, partitions: int | None = None) -> DataFrame:
    """Points in ranges of the Morton key and sorted by it: written this way,
    row groups are small boxes that scans can skip."""
    keyed = points.withColumn("morton", morton(root))
    ranged = keyed.repartitionByRange(partitions, "morton") if partitions else keyed.repartitionByRange("morton")
    return ranged.sortWithinPartitions("morton")


def _at(level: int | Column) -> list[Column]:
    shift = (lambda t: F.shiftright(t, DEPTH - level)) if isinstance(level, int) else (lambda t: F.call_function("shiftright", t, (F.lit(DEPTH) - level).cast("int")))
    return [shift(F.col(f"t{a}")).alias(f"c{a}") for a in "xyz"]


def cell_counts(points: DataFrame, root: Root, limit: int) -> DataFrame:
    """(level, cx, cy, cz, n) of cells none of which needs a finer count: they
    hold at most ``limit`` points or are at the last level."""
    ticked = points.select(*(t.alias(f"t{a}") for t, a in zip(ticks(root), "xyz")))
    level, done = 0, []
    open_ = ticked
    while True:
        level = min(DEPTH, level + STRIDE)
        counted = checkpointed(open_.groupBy(*_at(level)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(level).alias("level"), "cx", "cy", "cz", "n"))
        if level == DEPTH:
            done.append(counted)
            break
        done.append(counted.where(F.col("n") <= limit))
        crowded = counted.where(F.col("n") > limit).select(*(F.col(f"c{a}").alias(f"k{a}") for a in "xyz"))
        if crowded.isEmpty():
            break
        here = _at(level)
        match = geom.all_of([h == F.col(f"k{a}") for h, a in zip(here, "xyz")])
        open_ = open_.join(crowded, match, "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def nodes(points: DataFrame, root: Root, limit: int = SPLIT_LIMIT) -> DataFrame:
    """(level, cx, cy, cz, n, is_leaf): every node; n counts its whole subtree.

    A cell is a leaf if it holds at most ``limit`` points and its parent more;
    one that still holds more at the last level is a leaf too.
    """
    counts = cell_counts(points, root, limit)
    levels = F.explode(F.sequence(F.lit(0), F.col("level"))).alias("at")
    up = counts.select("*", levels)
    shift = (F.col("level") - F.col("at")).cast("int")
    up = up.select(F.col("at").alias("level"), *(F.call_function("shiftright", F.col(f"c{a}"), shift).alias(f"c{a}") for a in "xyz"), "n")
    every = up.groupBy(*KEYS).agg(F.sum("n").alias("n"))
    parents = every.where(F.col("n") > limit).select((F.col("level") + 1).alias("level"), *(F.col(f"c{a}").alias(f"p{a}") for a in "xyz"))
    half = [F.shiftright(f"c{a}", 1).alias(f"p{a}") for a in "xyz"]
    below = every.select("*", *half).join(parents, ["level", "px", "py", "pz"], "left_semi").select(*KEYS, "n")
    made = every.where(F.col("level") == 0).select(*KEYS, "n").unionByName(below)
    return made.withColumn("is_leaf", (F.col("n") <= limit) | (F.col("level") == DEPTH))


def assign(points: DataFrame, tree: DataFrame, root: Root) -> DataFrame:
    """Points with the leaf they belong to (level, cx, cy, cz)."""
    leaves = tree.where("is_leaf").select(*KEYS)
    used = [r[0] for r in leaves.select("level").distinct().collect()]  # at most DEPTH + 1
    ticked = points.select("*", *(t.alias(f"t{a}") for t, a in zip(ticks(root), "xyz")))
    if not used:
        return ticked.drop("tx", "ty", "tz").select("*", *(F.lit(None).cast("long").alias(k) for k in KEYS)).where(F.lit(False))
    options = F.array(*(F.struct(F.lit(level).alias("level"), *_at(level)) for level in sorted(used)))
    tried = ticked.withColumn("o", F.explode(options)).select("*", "o.*").drop("o", "tx", "ty", "tz")
    return tried.join(leaves, KEYS)


def with_stats(assigned: DataFrame) -> DataFrame:
    """Bounds, count, centroid, deviation and part range of each node's own points."""
    aggs = [F.count(F.lit(1)).alias("count_cell")]
    aggs += [f(a).alias(f"bb_{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    aggs += [F.avg(a).alias(f"centroid_{a}") for a in "xyz"]
    if "part_index" in assigned.columns:
        aggs += [F.min("part_index").alias("part_min"), F.max("part_index").alias("part_max")]
    s = assigned.groupBy(*KEYS).agg(*aggs)
    far = assigned.select(*KEYS, *"xyz").join(s.select(*KEYS, *(f"centroid_{a}" for a in "xyz")), KEYS)
    e = [F.col(a) - F.col(f"centroid_{a}") for a in "xyz"]
    dev = far.groupBy(*KEYS).agg(F.stddev_pop(F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2])).alias("centroid_stddev"))
    return s.join(dev, KEYS)


def lod_quotas(tree: DataFrame, limit: int, level: int) -> DataFrame:
    """(level, cx, cy, cz, quota) of the children of level ``level``: shares of
    min(limit, children's own points) in proportion to their subtrees.

    The remainder that starts at 0.1 and runs over the octants is a difference
    of rounded running sums."""
    kids = tree.where(F.col("level") == level + 1).select("*", *(F.shiftright(f"c{a}", 1).alias(f"p{a}") for a in "xyz"))
    octant = F.col("cx") % 2 + F.col("cy") % 2 * 2 + F.col("cz") % 2 * 4
    parent = Window.partitionBy("px", "py", "pz")
    before = parent.orderBy(octant).rowsBetween(Window.unboundedPreceding, -1)
    upto = parent.orderBy(octant).rowsBetween(Window.unboundedPreceding, 0)
    take = F.least(F.lit(limit), F.sum("count_cell").over(parent))
    total = F.sum("n").over(parent)
    edge = lambda w: F.floor(take * F.coalesce(F.sum("n").over(w), F.lit(0)) / total + 0.1)
    return kids.withColumn("quota", edge(upto) - edge(before)).select(*KEYS, "px", "py", "pz", "quota", "count_cell")


def level_of_detail(assigned: DataFrame, tree: DataFrame, limit: int = SPLIT_LIMIT) -> DataFrame:
    """Node points: leaves' own and inner nodes' samples of their children's.

    From the deepest level up, each child gives every (size + 0.49) / quota-th
    of its points in order of point_id. At most DEPTH steps; the points with
    their leaves and each step are written to the shared folder once, so that
    no step repeats the work of those below it.
    """
    tree, assigned = checkpointed(tree), checkpointed(assigned)
    base = tree.withColumn("count_cell", F.when(F.col("is_leaf"), F.col("n")))
    deepest = tree.agg(F.max("level")).first()[0]
    if deepest is None:
        return assigned.withColumn("is_leaf", F.lit(True))
    columns = [c for c in assigned.columns if c not in KEYS]
    every = assigned.withColumn("is_leaf", F.lit(True))
    below = assigned.where(F.col("level") == deepest)
    for level in range(int(deepest) - 1, -1, -1):
        sizes = below.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("count_cell"))
        kids = base.drop("count_cell").join(sizes, KEYS)
        quota = lod_quotas(kids, limit, level)
        order = Window.partitionBy(*KEYS).orderBy("point_id", *"xyz")
        ranked = below.withColumn("_r", F.row_number().over(order) - 1).join(quota, KEYS)
        step = (F.col("count_cell") + 0.49) / F.col("quota")
        hit = (F.col("quota") > 0) & ((F.col("count_cell") <= F.col("quota")) | (F.floor(F.ceil(F.col("_r") / step) * step) == F.col("_r")))
        sample = ranked.where(hit).select(*columns, F.lit(level).alias("level"), *(F.col(f"p{a}").alias(f"c{a}") for a in "xyz"))
        sample = checkpointed(sample)
        every = every.unionByName(sample.withColumn("is_leaf", F.lit(False)))
        own = assigned.where(F.col("level") == level)
        below = sample.unionByName(own.select(*sample.columns))
    return every


def front(node_points: DataFrame, root: Root, exponent: int | None) -> DataFrame:
    """Points seen at a least cell exponent: inner nodes of just that size and leaves above it."""
    if exponent is None:
        return node_points.where("is_leaf")
    level = root.exponent - exponent
    return at_level(node_points, level)


def at_level(frame: DataFrame, level: int) -> DataFrame:
    """Nodes (or node points) that make up a level; leaves higher up are included."""
    if level < 0:
        return frame.where(F.lit(False))
    return frame.where((F.col("level") == level) | (F.col("is_leaf") & (F.col("level") < level)))


def level_counts(tree: DataFrame) -> DataFrame:
    """(level, n): points in each level of the tree."""
    last = tree.agg(F.max("level")).first()[0] or 0
    t = tree.withColumn("last", F.lit(int(last)))
    spread = t.where("count_cell is not null").select(F.explode(F.when(F.col("is_leaf"), F.sequence("level", "last")).otherwise(F.array("level"))).alias("level"), "count_cell")
    return spread.groupBy("level").agg(F.sum("count_cell").alias("n"))


def level_below(counts: list[int], most: int) -> int:
    """The deepest level with fewer than ``most`` points; -1 if the first has as many."""
    for level, n in enumerate(counts):
        if n >= most:
            return level - 1
    return len(counts) - 1


def approximate_count(boxes: DataFrame, lo, hi) -> DataFrame:
    """Points of nodes whose bounds meet a box: at least the exact count."""
    return approximate_count_where(boxes, geom.boxes_overlap(lo, hi))


def approximate_count_where(boxes: DataFrame, may: Column) -> DataFrame:
    """Points of the nodes that a test of their bounds does not rule out: at least the
    exact count of a predicate, if the test holds wherever a point may fit."""
    return boxes.where(may).agg(F.coalesce(F.sum("count_cell"), F.lit(0)).alias("n"))


def traverse(boxes: DataFrame, hull) -> DataFrame:
    """(level, cx, cy, cz, fully_inside): nodes whose bounds may meet the hull; all
    points of those fully inside are in it."""
    met = boxes.where(geom.box_may_meet_hull(hull))
    return met.select(*KEYS, (~geom.box_may_leave_hull(hull)).alias("fully_inside"))


def tree_stats(tree: DataFrame) -> DataFrame:
    """Node and leaf counts, leaf sizes (averaged over leaves) and leaf depths (root 1)."""
    leaf = F.col("is_leaf")
    return tree.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(leaf).alias("leaves"),
        F.sum(F.when(leaf, F.col("n"))).alias("points"),
        F.min(F.when(leaf, F.col("n"))).alias("min_leaf"),
        F.max(F.when(leaf, F.col("n"))).alias("max_leaf"),
        F.avg(F.when(leaf, F.col("n"))).alias("avg_leaf"),
        F.min(F.when(leaf, F.col("level") + 1)).alias("min_depth"),
        F.max(F.when(leaf, F.col("level") + 1)).alias("max_depth"),
        F.avg(F.when(leaf, F.col("level") + 1)).alias("avg_depth"),
    )
