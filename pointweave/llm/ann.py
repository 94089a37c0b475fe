"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector with Gaussian projections, each shifted and cut into
intervals of one width; the intervals' numbers are the bucket. A query visits its
own bucket of every table and perturbed ones (projections one interval down or
up) in the order of their estimated success: the sum of squared distances from
the query to the borders that a perturbation crosses. The candidates of all
visited buckets of all tables are ranked by exact distance and merged.

Rows and probes meet by bucket, as rows of one shuffle: each vector moves once for
each table, each query once for each probe, and what a bucket gives a query is its
best ``k``. A bucket of many rows or probes is cut into tiles, counted beforehand.
Vectors that many rows share count once, with as many of their least ids as an
answer can show. Width and projections are fitted: the exact neighbours of a sample
of queries and a sample of rows show what share of neighbours a choice finds, and
what share of all rows it visits for that.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, freed

#: Documented bounds of the fit: queries whose neighbours are looked up in all rows,
#: and rows that stand for all, both picked by a hash of the id.
SAMPLE_QUERIES, SAMPLE_ROWS = 64, 2048
#: Share of the sample's neighbours that a choice must find.
RECALL = 0.96
#: Tables, and buckets that a query visits in each at most: so many rows move for a
#: vector and for a query, whatever the data.
TABLES, PROBES = 4, 32
#: The choices: interval widths in units of a neighbour's distance, and projections of a table.
WIDTHS, PLANES = (0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0), (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 17, 20)
#: Rows or probes of a bucket that a tile holds, and the steps of its comparison.
TILE, Q_STEP, X_STEP = 8192, 256, 2048
#: Crowded buckets that all tasks are told of (40 bytes each); more meet in a join.
TOLD = 100_000
SEED = 7
KEYED = "dim int, g long, kind int, id long, row long, vec binary"
FOUND = "query_id long, vec_id long, row long, score double"


@lru_cache(maxsize=16)
def perturbations(planes: int, most: int) -> np.ndarray:
    """Sets of the 2 * ``planes`` single moves (sorted by their cost), as rows of a
    boolean matrix, in the order of the cost that is expected of them; never both
    moves of one projection. The first is empty."""
    j, m = np.arange(1, 2 * planes + 1), planes
    low, high = j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, low, high)
    sets: list[tuple[int, ...]] = [()]
    heap: list[tuple[float, tuple[int, ...]]] = [(float(cost[0]), (0,))]
    while heap and len(sets) < most:
        c, s = heapq.heappop(heap)
        if all(2 * m - 1 - x not in s for x in s):
            sets.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*s, last + 1)))
    out = np.zeros((len(sets), 2 * m), dtype=bool)
    for i, s in enumerate(sets):
        out[i, list(s)] = True
    return out


@dataclass(frozen=True)
class Choice:
    """The hash tables of vectors of one dimension."""

    dim: int
    width: float
    planes: int

    def _codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, self.dim, self.planes])
        factors = rng.integers(1, 1 << 62, (TABLES, self.planes)) | 1
        a, b = rng.standard_normal((self.dim, TABLES * self.planes)), rng.uniform(0, 1, TABLES * self.planes)
        with np.errstate(over="ignore", invalid="ignore"):
            at = (x / self.width) @ a + b
            code = np.floor(np.clip(at, -(2.0**62), 2.0**62))
        shape = (-1, TABLES, self.planes)
        return code.astype(np.int64).reshape(shape), (at - code).reshape(shape), factors

    def keys(self, x: np.ndarray) -> np.ndarray:
        """rows x tables: each row's bucket."""
        code, _, factors = self._codes(x)
        return (code * factors).sum(axis=2) + np.arange(TABLES)

    def visits(self, q: np.ndarray) -> np.ndarray:
        """queries x tables x probes: the buckets to visit, the likeliest first."""
        code, down, factors = self._codes(q)
        sets = perturbations(self.planes, 3 * PROBES)
        cost = np.concatenate([down**2, (1 - down) ** 2], axis=2)
        step = np.broadcast_to(np.concatenate([-factors, factors], axis=1), cost.shape)
        order = np.argsort(cost, axis=2, kind="stable")
        cost, step = np.take_along_axis(cost, order, axis=2), np.take_along_axis(step, order, axis=2)
        total = cost @ sets.T.astype(float)
        # integers wrap around as the keys do; a float product would not
        moved = np.stack([step[:, :, s].sum(axis=2) for s in sets], axis=2)
        best = np.argsort(total, axis=2, kind="stable")[:, :, :PROBES]
        own = (code * factors).sum(axis=2) + np.arange(TABLES)
        return own[:, :, None] + np.take_along_axis(moved, best, axis=2)


def tune(q: np.ndarray, near: list[np.ndarray], rows: np.ndarray) -> Choice:
    """The cheapest choice that finds ``RECALL`` of the vectors ``near`` each query,
    measured by the share of ``rows`` that it visits; the surest if none does."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _tune(q, near, rows)


def _tune(q: np.ndarray, near: list[np.ndarray], rows: np.ndarray) -> Choice:
    dim = q.shape[1]
    reach = [np.sqrt(((n - v) ** 2).sum(axis=1)).max() for n, v in zip(near, q) if len(n)]
    reach = [r for r in reach if 0 < r < np.inf] or [1.0]
    owner, all_near = np.repeat(np.arange(len(q)), [len(n) for n in near]), np.concatenate([n for n in near if len(n)] or [np.empty((0, dim))])
    best: tuple[tuple, Choice] | None = None
    for width in WIDTHS:
        for planes in PLANES:
            c = Choice(dim, width * float(np.median(reach)), planes)
            visit, near_key, row_key = c.visits(q), c.keys(all_near), c.keys(rows)
            hit = np.zeros(owner.size, dtype=bool)
            seen = 0
            for t in range(TABLES):
                hit |= (visit[owner, t] == near_key[:, t, None]).any(axis=1)
                known, many = np.unique(row_key[:, t], return_counts=True)
                at = np.minimum(np.searchsorted(known, visit[:, t]), known.size - 1)
                seen += int(np.where(known[at] == visit[:, t], many[at], 0).sum())
            recall, share = float(hit.mean()) if hit.size else 1.0, seen / (max(len(q), 1) * max(len(rows), 1))
            score = (recall < RECALL, share if recall >= RECALL else -recall, share)
            if best is None or score < best[0]:
                best = (score, c)
    return best[1]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part: an id, and a vector that is neither
    null, empty nor zero and has only finite components."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where("id is not null and size(v) > 0").where(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, its rows' places, their vectors)."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        yield d, at, batch.column("v").take(pa.array(at)).flatten().to_numpy().reshape(at.size, d)


def _keyed(df: DataFrame, choices: dict[int, Choice], kind: int, narrow: dict[int, bool], vectors: bool = True) -> DataFrame:
    """A row for each bucket of a row (kind 1) or visited by a query (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                for d, at, x in _by_dim(part):
                    c = choices.get(d)
                    g = np.zeros((at.size, 1), np.int64) if c is None else c.keys(x) if kind else c.visits(x).reshape(at.size, -1)
                    own = np.repeat(np.arange(at.size), g.shape[1])
                    ids, row = (part.column(n).to_numpy()[at][own] for n in ("id", "row"))
                    blobs = pa.array([v.tobytes() for v in x.astype(np.float32 if narrow[d] else np.float64)] if vectors else [b""] * at.size, pa.binary())
                    same = lambda v: pa.array(np.full(own.size, v, np.int32))
                    yield pa.RecordBatch.from_arrays([same(d), pa.array(g.ravel()), same(kind), pa.array(ids), pa.array(row), blobs.take(pa.array(own))], ["dim", "g", "kind", "id", "row", "vec"])

    return df.select("dim", "id", "row", "v").mapInArrow(run, KEYED)


def _best(q_ids, q, x_ids, x_rows, x, k: int) -> list[np.ndarray]:
    """[place of the query, id, row, distance] of each query's ``k`` nearest, with ties."""
    out = []
    norms = (x * x).sum(axis=1)
    for a in range(0, len(q), Q_STEP):
        part = q[a : a + Q_STEP]
        own = (part * part).sum(axis=1)
        d2 = own[:, None] + norms[None] - 2 * (part @ x.T)
        other = q_ids[a : a + Q_STEP, None] != x_ids[None]
        if len(x) > k and np.isfinite(d2).all():  # all that rounding may have moved, then exactly
            d2[~other] = np.inf
            edge = np.partition(d2, k - 1, axis=1)[:, k - 1] + 1e-12 * (own + norms.max())
            other &= d2 <= edge[:, None]
        i, j = np.nonzero(other)
        d = np.concatenate([np.sqrt(((x[j[s : s + 65536]] - part[i[s : s + 65536]]) ** 2).sum(axis=1)) for s in range(0, j.size, 65536)] or [np.empty(0)])
        out.append((i + a, x_ids[j], x_rows[j], d))
    return [np.concatenate(c) for c in zip(*out)]


def _first(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    at, ids, _, d = found
    order = np.lexsort((ids, d, at))
    at = at[order]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if at.size else np.empty(0, np.int64)
    nth = np.arange(at.size) - np.repeat(start, np.diff(np.append(start, at.size)))
    return [c[order[nth < k]] for c in found]


def _meet(keyed: DataFrame, k: int) -> DataFrame:
    """What every bucket's tile (dim, g, part, side) gives its queries: the ``k`` best."""
    names = ["query_id", "vec_id", "row", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, vecs, found = None, [], [], []
        out: list[list[np.ndarray]] = []
        size = 0

        def close() -> None:
            nonlocal size
            if found:
                best = _first([np.concatenate(c) for c in zip(*found)], k)
                out.append([np.concatenate(ids)[best[0]], *best[1:]])
                size += best[0].size

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

        for batch in freed(batches):
            tiles = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("dim", "g", "part", "side")])
            kind, id_, row = (batch.column(c).to_numpy() for c in ("kind", "id", "row"))
            vec = batch.column("vec")
            ends = np.frombuffer(vec.buffers()[1], dtype=np.int32)[vec.offset : vec.offset + len(vec) + 1]
            data = np.frombuffer(vec.buffers()[2], dtype=np.uint8)
            cut = np.flatnonzero(((tiles[:, 1:] != tiles[:, :-1]).any(axis=0)) | (kind[1:] != kind[:-1])) + 1
            edges = [0, *cut.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if tile is None or (tiles[:, a] != tile).any():
                    close()
                    tile, ids, vecs, found = tiles[:, a], [], [], []
                    if size > 50_000:
                        yield made()
                        out, size = [], 0
                if kind[a] and not ids:
                    continue  # no query visits this bucket
                dim = int(tile[0])
                flat = data[ends[a] : ends[b]]
                x = flat.view(np.float32 if flat.size == 4 * dim * (b - a) else np.float64).reshape(b - a, dim).astype(np.float64)
                if not kind[a]:
                    ids.append(id_[a:b])
                    vecs.append(x)
                    continue
                q_ids, q = np.concatenate(ids), np.concatenate(vecs)
                ids, vecs = [q_ids], [q]
                for s in range(0, len(x), X_STEP):
                    found.append(_best(q_ids, q, id_[a:b][s : s + X_STEP], row[a:b][s : s + X_STEP], x[s : s + X_STEP], k))
                if sum(f[0].size for f in found) > 1_000_000:
                    found = [_first([np.concatenate(c) for c in zip(*found)], k)]
        close()
        if out:
            yield made()

    keys = ["dim", "g", "part", "side"]
    return keyed.repartition(*keys).sortWithinPartitions(*keys, "kind").select(*keys, "kind", "id", "row", "vec").mapInArrow(run, FOUND)


def _tiled(rows: DataFrame, probes: DataFrame, counts: DataFrame) -> DataFrame:
    """Both with part (of a bucket's rows) and side (of its probes); in a bucket of
    many, a row goes to all sides of its part and a probe to all parts of its side."""
    ceil = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / TILE)).cast("int")
    summed = counts.groupBy("dim", "g").agg(F.sum("kind").alias("rows"), F.sum(1 - F.col("kind")).alias("probes"))
    heavy = checkpointed(summed.where((F.col("rows") > TILE) | (F.col("probes") > TILE)).select("dim", "g", ceil("rows").alias("parts"), ceil("probes").alias("sides")))
    many = heavy.count()
    if not many:
        return rows.unionByName(probes).withColumns({"part": F.lit(0), "side": F.lit(0)})
    heavy = F.broadcast(heavy) if many <= TOLD else heavy
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    some = lambda salt, c: F.array(F.pmod(F.xxhash64(F.lit(salt), "id", "row"), one(c)).cast("int"))
    every = lambda c: F.sequence(F.lit(0), one(c) - 1)
    out = []
    for df, part, side in ((rows, some(1, "parts"), every("sides")), (probes, every("parts"), some(2, "sides"))):
        out.append(df.join(heavy, ["dim", "g"], "left").withColumn("part", F.explode(part)).withColumn("side", F.explode(side)).drop("parts", "sides"))
    return out[0].unionByName(out[1])


def _sample(df: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of each dimension; so few pass the hash that the window is small."""
    h, scale = F.xxhash64(F.lit(SEED), "id", "row"), 1 << 40
    limit = {r.dim: min(scale, 1 + 4 * most * scale // r["count"]) for r in df.groupBy("dim").count().collect()}
    if not limit:
        return df.select("dim", "id", "row", "v")
    passed = df.where(F.pmod(h, F.lit(scale)) < F.element_at(F.create_map(*(F.lit(x) for kv in limit.items() for x in kv)), F.col("dim")))
    nth = Window.partitionBy("dim").orderBy(h, "row")
    return passed.withColumn("s", F.row_number().over(nth)).where(F.col("s") <= most).select("dim", "id", "row", "v")


def _true_neighbours(rows: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(dim, query_id, v, score): the sample's exact neighbours, by a scan of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        for batch in freed(batches):
            for d, at, x in _by_dim(batch):
                if d in shared.value:
                    q_ids, q = shared.value[d]
                    # a place in ``vectors`` stands for the row
                    before, old = held.get(d, (None, np.empty((0, d))))
                    new = _best(q_ids, q, batch.column("id").to_numpy()[at], np.arange(at.size) + len(old), x, k)
                    found = _first([np.concatenate(c) for c in zip(*([before] if before else []), new)], k)
                    kept, place = np.unique(found[2], return_inverse=True)
                    held[d] = ([*found[:2], place, found[3]], np.concatenate([old, x])[kept])
        for d, (found, vectors) in held.items():
            q_ids = shared.value[d][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(found[0].size, d, np.int32)), pa.array(q_ids[found[0]]), pa.array(list(vectors[found[2]]), pa.list_(pa.float64())), pa.array(found[3])], ["dim", "query_id", "v", "score"])

    found = rows.select("dim", "id", "v").mapInArrow(run, "dim int, query_id long, v array<double>, score double")
    nth = Window.partitionBy("dim", "query_id").orderBy("score", "v")
    return found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k)


def fit(rows: DataFrame, asked: DataFrame, k: int) -> dict[int, Choice]:
    """The choice for each dimension that queries have; dimensions are few."""
    matrix = lambda got: {d: (np.array([r.id for r in rs], dtype=np.int64), np.array([r.v for r in rs], dtype=np.float64)) for d, rs in got.items()}

    def grouped(df: DataFrame) -> dict[int, list]:
        out: dict[int, list] = {}
        for r in df.collect():
            out.setdefault(r.dim, []).append(r)
        return out

    queries = matrix(grouped(_sample(asked, SAMPLE_QUERIES)))
    others = matrix(grouped(_sample(rows, SAMPLE_ROWS)))
    near: dict[int, dict[int, list]] = {}
    for r in _true_neighbours(rows, queries, k).collect():
        near.setdefault(r.dim, {}).setdefault(r.query_id, []).append(r.v)
    vectors = lambda d, i: np.array(near.get(d, {}).get(int(i), []), dtype=np.float64).reshape(-1, d)
    return {d: tune(q, [vectors(d, i) for i in ids], others[d][1]) for d, (ids, q) in queries.items()}


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` nearest rows found of every query.

    Queries are the rows whose id fits ``is_query``, a function of the id
    column; candidates are all rows of other ids and the same dimension. score
    is the Euclidean distance in double precision, ties go to the smaller id.
    Of rows that share an id, each is a candidate and one, of the least vector, a
    query. A query whose buckets hold fewer than ``k`` rows is compared with all
    rows, so one with fewer than ``k`` candidates gets all of them. Other columns
    are not read. Empty in, empty out.
    """
    rows = checkpointed(usable(vectors, id_col, vector_col))
    # of a vector that many rows share, an answer shows the least ids; k + 1, as a query's own is none
    same = Window.partitionBy("dim", "v").orderBy("id")
    shown = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    shown = checkpointed(shown.select("dim", "id", "v", F.xxhash64("id", "v", "nth").alias("row")))
    one = Window.partitionBy("id").orderBy("v")
    asked = rows.where(is_query(F.col("id"))).withColumn("nth", F.row_number().over(one)).where("nth = 1")
    asked = checkpointed(asked.select("dim", "id", "v", F.lit(0).cast("long").alias("row")))
    exact = F.forall("v", lambda x: x.cast("float").cast("double") == x)
    narrow = {r.dim: r.narrow for r in rows.groupBy("dim").agg(F.bool_and(exact).alias("narrow")).collect()}
    choices = fit(shown, asked, k)
    met = lambda a, b, ca, cb: _meet(_tiled(a, b, ca.unionByName(cb).select("dim", "g", "kind")), k)
    # a dimension without queries has no choice and no buckets
    there = shown.where(F.col("dim").isin(*choices)) if choices else shown.limit(0)
    keyed = [(_keyed(there, choices, 1, narrow, v), _keyed(asked, choices, 0, narrow, v)) for v in (True, False)]
    found = met(*keyed[0], *keyed[1])
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["query_id", "row"]).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    result = checkpointed(ranked(found))
    enough = result.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = checkpointed(asked.join(enough, "id", "left_anti").select("dim", "id", "row", "v"))
    if short.isEmpty():
        return result
    whole = [(_keyed(there.join(short.select("dim").distinct(), "dim", "left_semi"), {}, 1, narrow, v), _keyed(short, {}, 0, narrow, v)) for v in (True, False)]
    return result.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(ranked(met(*whole[0], *whole[1])))
