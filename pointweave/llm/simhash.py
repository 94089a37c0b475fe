"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, each set where over half of a text's word shingles
hash to a set bit. Linking: every bit position has a vector of RADIUS + 1
bits, and each of the 2**(RADIUS + 1) - 1 non-zero vectors v gives a mask of
the positions whose vector is orthogonal to v *not* (odd product). Two
fingerprints that differ in at most RADIUS positions have RADIUS vectors there,
which some v is orthogonal to, so the pair agrees on that mask: no pair within
the radius is missed, whatever the data.

Rows that share a mask's value form a bucket. Small buckets compare all their
fingerprints by shifts of the sorted rows. Large ones are walked from pivot to
pivot, which links a dense group in few passes and emits a spanning forest, not
its pairs; a bucket beyond ``TILE`` fingerprints is cut into pairs of tiles, so
no task ever holds more than two tiles of one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, freed, fresh, gaps, only_here, pack, settled, splitmix64, text_slices, unpack

RADIUS = 4
SHINGLE = 4
#: Buckets up to SMALL compare all pairs at once; above TILE they are tiled.
SMALL, TILE = 16, 8192
#: Near copies: words of a shingle, least similarity.
COPY_WORDS, COPY_LEAST = 5, 0.8
#: Texts of a shingle up to which the near copies' search compares all pairs; past that, the
#: components in which a text is given a partner before the shingle is walked.
FEW, PARTNERS = 32, 8
#: Texts that are looked at for common shingles (so many, and one in EACH at least), the
#: texts of these that make a shingle common, and the slots (a power of two) of the table
#: that tells how common. They only set an order.
LOOKED_AT, EACH, COMMON, SLOTS = 20_000, 8, 4, 1 << 23
#: Bits (powers of two) that rule out most unlike pairs: as many as a text has shingles,
#: within these two. Texts that meet one in a task.
PARITIES_LEAST, PARITIES, LEAVES = 64, 4096, 256
#: Bytes of text that are cut into shingles at once.
STEP_BYTES = 1 << 20
#: Text keys that a task remembers, and a text's shingles that TILE stands for.
REMEMBERED, TILE_SHINGLES = 1_000_000, 512
#: Bits (a power of two) of the sieve of candidate texts that tasks are sent.
SIEVE_BITS = 1 << 26
#: Links up to which the driver finds components; more are joined by star steps.
FEW_LINKS = 1 << 18


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 where it has no words."""
    return int(fingerprints([text], words)[0])


def fingerprints(texts: list[str | None], words: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints: A-Z lower-cased, words split at space and 09-0D,
    ``words``-word shingles with repeats (all words, if fewer), XXH64 of seed 42,
    a bit set where over half of the hashes have it."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not parts:
            continue
        line = b" ".join(parts)
        if len(parts) <= words:
            hashes.append(digest(line, 42))
            counts[i] = 1
            continue
        gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
        starts = [0, *(gaps[: len(parts) - words] + 1).tolist()]
        ends = [*gaps[words - 1 :].tolist(), len(line)]
        hashes.extend([digest(line[a:b], 42) for a, b in zip(starts, ends)])
        counts[i] = len(starts)
    out = np.zeros(len(texts), dtype=np.uint64)
    rows = np.flatnonzero(counts)
    if rows.size:
        every = np.array(hashes, dtype=np.uint64)
        edge = np.concatenate([[0], np.cumsum(counts[rows])])
        ones = np.empty((rows.size, 64), dtype=np.int64)
        step = 1 << 16
        total = np.zeros((rows.size, 64), dtype=np.int64)
        for a in range(0, every.size, step):  # bounded unpacking, whatever the text's length
            b = min(a + step, every.size)
            bits = np.unpackbits(every[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first, last = np.searchsorted(edge, [a, b - 1], side="right") - 1
            cuts = np.maximum(edge[first : last + 1], a) - a
            total[first : last + 1] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        ones = total * 2 > counts[rows][:, None]
        out[rows] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed 64-bit form of every row's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                fp = fingerprints(part.column("text").to_pylist(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks. Bit vectors cycle through all values but 0, in a
    fixed order, so that each mask keeps about half of the 64 bits."""
    span = (1 << (radius + 1)) - 1
    vectors = [1 + (i * 7 + i // span) % span for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, span + 1)]


def _walk(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints within ``radius``, from pivot to pivot."""
    left, right = [], []
    rest = np.arange(x.size)
    frontier: list[int] = []
    while rest.size:
        if not frontier:
            frontier.append(int(rest[0]))
            rest = rest[1:]
            continue
        at = frontier.pop()
        near = np.bitwise_count(x[rest] ^ x[at]) <= radius
        if near.any():
            found = rest[near]
            left.append(np.full(found.size, x[at]))
            right.append(x[found])
            frontier.extend(found.tolist())
            rest = rest[~near]
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _bucket_links(key: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``key``; every run is whole."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    small = np.repeat(size <= SMALL, size)
    left, right = [], []
    for shift in range(1, min(SMALL, x.size)):
        pair = small[:-shift] & (key[:-shift] == key[shift:])
        at = np.flatnonzero(pair)
        if not at.size:
            break
        near = at[np.bitwise_count(x[at] ^ x[at + shift]) <= radius]
        left.append(x[near])
        right.append(x[near + shift])
    for i in np.flatnonzero(size > SMALL):
        a, b = _walk(x[edge[i] : edge[i + 1]], radius)
        left.append(a)
        right.append(b)
    none = np.empty(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: links whose closure is that of all pairs within ``radius``.

    ``fps`` has distinct signed fingerprints in column fp.
    """
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)))).alias("mask", "value"))
    spread = keyed.select("fp", F.xxhash64("mask", "value").alias("key"))
    heavy = checkpointed(spread.groupBy("key").count().where(F.col("count") > TILE).select("key", F.ceil(F.col("count") / TILE).alias("tiles")))
    if not heavy.isEmpty():  # counted by partial sums; no task sees such a bucket whole
        tile = F.pmod(F.xxhash64(F.lit(5), "fp"), F.col("tiles"))
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.xxhash64(F.col("key"), F.least(t, tile), F.greatest(t, tile)))
        spread = spread.join(heavy, "key", "left").select("fp", F.explode(F.when(F.col("tiles").isNull(), F.array("key")).otherwise(others)).alias("key"))
    spread = spread.repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_x = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            a, b = a.view(np.int64), b.view(np.int64)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if a.size else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column("key").to_numpy()])
            x = np.concatenate([held_x, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if k.size else 0  # the last run may go on
            if cut:
                yield out(*_bucket_links(k[:cut], x[:cut], radius))
            held_k, held_x = k[cut:], x[cut:]
        if held_k.size:
            yield out(*_bucket_links(held_k, held_x, radius))

    return spread.mapInArrow(run, "a long, b long").distinct()


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of :func:`components`, of edges in memory: roots are hung on the least
    root beside them, and all nodes on their roots, until no edge has two."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: u.size], ends[u.size :]
    root = np.arange(nodes.size)
    while a.size:
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    hung = root != np.arange(nodes.size)
    return nodes[hung], nodes[root[hung]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes with edges.

    Up to FEW_LINKS edges the driver joins them. More go through large-star and
    small-star steps in turn until the star forest no longer changes; each step's
    edges are written to the shared folder.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.count() <= FEW_LINKS:
        few = edges.toArrow()
        node, root = _joined(few.column("u").to_numpy(), few.column("v").to_numpy())
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root}), "node long, root long")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = checkpointed(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row a row of ``docs``.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id
    that links of at most ``radius`` differing bits reach. Null and wordless
    texts have fingerprint zero and link like any other. Null ids are never
    the smallest unless a component has no other. Repeated rows stay repeated.
    An empty table gives an empty one; other columns are not read.
    """
    fps = checkpointed(with_fingerprints(docs, words))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp"), radius))
    by_fp = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    by_fp = checkpointed(by_fp)
    least = by_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    named = by_fp.where("root <> fp").join(least, "root").select("fp", "component_id").unionByName(least.select(F.col("root").alias("fp"), "component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _parts(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _key(parts: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(parts), 42)


def _shingle_hashes(parts: list[bytes], words: int = COPY_WORDS) -> np.ndarray:
    known = {w: xxhash.xxh64_intdigest(w, 42) for w in set(parts)}
    h = np.array([known[w] for w in parts], dtype=np.uint64)
    span = min(words, h.size)
    out = np.zeros(h.size - span + 1 if span else 0, dtype=np.uint64)
    for i in range(span):
        out = splitmix64(out + h[i : h.size - span + 1 + i])
    return out


def _sieve(keys: DataFrame) -> bytes:
    """One bit for each value that the low bits of column ``key`` take. It is as
    large whatever the data; what it lets through in excess, a join drops."""
    slot = F.col("key").bitwiseAND(F.lit(SIEVE_BITS - 1))
    block = 1 << 16
    packed = keys.select(F.shiftright(slot, 16).alias("block"), slot.bitwiseAND(F.lit(block - 1)).cast("int").alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            b, at = batch.column("block").to_numpy(), batch.column("at").to_numpy()
            for k in np.unique(b).tolist():
                bits.setdefault(k, np.zeros(block, dtype=bool))[at[b == k]] = True
        for k, x in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    for row in packed.repartition("block").mapInArrow(pack, "block long, bits binary").collect():
        out[row.block * (block // 8) : (row.block + 1) * (block // 8)] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return out.tobytes()


def _of_texts(docs: DataFrame, keys: DataFrame, words: int, schema: str, make: Callable[[np.ndarray], tuple]) -> DataFrame:
    """(key, ..) of the texts whose key is in ``keys``, one row a key; ``make`` gives the
    other columns from a text's sorted distinct shingles."""
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(keys))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here()
        bits = np.frombuffer(sieve.value, dtype=np.uint8)
        for batch in freed(batches):
            for part in text_slices(batch, "text", STEP_BYTES):
                key, made = [], []
                for text in part.column("text").to_pylist():
                    parts = _parts(text)
                    k = _key(parts)
                    at = k & (SIEVE_BITS - 1)
                    if bits[at >> 3] >> (at & 7) & 1:
                        key.append(k)
                        made.append(make(np.unique(_shingle_hashes(parts, words))))
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(key, dtype=np.uint64).view(np.int64)), *(pa.array(c) for c in zip(*made))], ["key", *names])

    made = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, f"key long, {schema}")
    return made.join(keys, "key", "left_semi").groupBy("key").agg(*(F.first(c).alias(c) for c in names))


def _sets(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(key, shingles): the packed 64-bit shingles."""
    return settled(_of_texts(docs, keys, words, "shingles binary", lambda h: (pack(gaps(h)),)))


def _set(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed), dtype=np.uint64)


def parities(hashes: np.ndarray) -> bytes:
    """Bits of a set, about as many as it has hashes: how many of these fall on each, odd
    or even. Two sets' bits differ in at most as many places as the sets do, also where
    the longer are folded to the shorter ones' number."""
    bits = min(PARITIES, max(PARITIES_LEAST, 1 << (int(hashes.size) - 1).bit_length() if hashes.size else 0))
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _apart(odd: list[bytes] | np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many places the parities of the texts i and j differ."""
    size = np.array([len(x) >> 3 for x in odd], dtype=np.int64)
    start = np.cumsum(size) - size
    words = np.frombuffer(b"".join(odd), dtype=np.uint64)

    def word(k: np.ndarray, w: int, m: int) -> np.ndarray:
        out = words[start[k] + w]
        for step in range(m, int(size[k].max()), m):
            more = np.flatnonzero(size[k] > step)
            out[more] ^= words[start[k[more]] + w + step]
        return out

    out = np.zeros(i.size, dtype=np.int64)
    low = np.minimum(size[i], size[j])
    for m in np.unique(low).tolist():
        at = np.flatnonzero(low == m)
        for w in range(m):
            out[at] += np.bitwise_count(word(i[at], w, m) ^ word(j[at], w, m))
    return out


def _common(docs: DataFrame, words: int) -> bytes:
    """How common the shingles of a slot are, a byte each: 0, or the more the more of the
    texts looked at have the most common of them. As large whatever the data."""
    nth = max(1, min(EACH, docs.count() // LOOKED_AT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here()
        for batch in freed(batches):
            for part in text_slices(batch, "text", STEP_BYTES):
                made = [np.unique(_shingle_hashes(_parts(t), words)) for t in part.column("text").to_pylist()]
                h, n = np.unique(np.concatenate(made), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])

    text = F.col("text").cast("string")
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64(text), F.lit(nth)) == 0)
    counted = some.mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    slot, block = F.col("h").bitwiseAND(F.lit(SLOTS - 1)), 1 << 16
    levels = counted.select(F.shiftright(slot, 16).alias("block"), slot.bitwiseAND(F.lit(block - 1)).cast("int").alias("at"), F.least(F.lit(255), F.floor(F.log2("n") * 4)).cast("int").alias("level"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            b, at, level = (batch.column(c).to_numpy() for c in ("block", "at", "level"))
            for k in np.unique(b).tolist():
                np.maximum.at(made.setdefault(k, np.zeros(block, dtype=np.uint8)), at[b == k], level[b == k].astype(np.uint8))
        for k, x in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["block", "levels"])

    out = np.zeros(max(SLOTS, block), dtype=np.uint8)
    for row in levels.repartition("block").mapInArrow(lay, "block long, levels binary").collect():
        out[row.block * block : (row.block + 1) * block] = np.frombuffer(bytes(row.levels), dtype=np.uint8)
    return out.tobytes()


def prefix(hashes: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """The first of a set's distinct shingles in one order for all sets, the more
    ``common`` (by slot) the later: as many as any set that is ``least`` alike has one
    of among its own first ones."""
    place = common[(hashes & np.uint64(common.size - 1)).astype(np.int64)]
    keep = hashes.size - int(np.ceil(least * hashes.size - 1e-9)) + 1
    return hashes[np.lexsort((hashes, place))[:keep]]


def _prefixes(docs: DataFrame, least: float, words: int) -> DataFrame:
    """(h, key, n, pos) of prefix shingles h that two texts or more have: text key, its
    number of shingles, place in the order. Rows of one h are together, by key."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here()
        common = np.frombuffer(shared.value, dtype=np.uint8)
        seen: set[int] = set()
        for batch in freed(batches):
            for part in text_slices(batch, "text", STEP_BYTES):
                hs, keys, sizes = [], [], []
                for text in part.column("text").to_pylist():
                    parts = _parts(text)
                    k = _key(parts)
                    if not parts or k in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(k)
                    every = np.unique(_shingle_hashes(parts, words))
                    hs.append(prefix(every, common, least))
                    keys.append(k)
                    sizes.append(every.size)
                if keys:
                    many = np.array([h.size for h in hs])
                    pos = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    cols = [np.concatenate(hs).view(np.int64), np.repeat(np.array(keys, dtype=np.uint64).view(np.int64), many), np.repeat(np.array(sizes) << 32, many) + pos]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "key", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, key, at in _whole_runs(batches, ["h", "key", "at"]):
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
            h, key, n, pos = h[once], key[once], at[once] >> 32, at[once] & 0xFFFFFFFF
            # a text that is too far on even for the smallest set here meets no other
            start = _runs(h)[0]
            least_n = np.minimum.reduceat(n, np.flatnonzero(start == np.arange(h.size)))[np.cumsum(start == np.arange(h.size)) - 1]
            on = n - pos >= least / (1 + least) * (n + least_n) - 1e-6
            cols = [c[on] for c in (h, key, n, pos)]
            many = _runs(cols[0])[1] > 1
            cols = [c[many] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "key", "n", "pos"])

    made = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, key long, at long")
    return made.repartition("h").sortWithinPartitions("h", "key").mapInArrow(meet, "h long, key long, n long, pos long")


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns, cut so that rows of one ``names[0]`` stay together; they come in a row."""
    held: list[np.ndarray] | None = None
    for batch in freed(batches):
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new)]
        first = held[0]
        cut = first.size - int(np.argmax(first[::-1] != first[-1])) if first.size and first[0] != first[-1] else 0
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and held[0].size:
        yield held


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's run starts, and its length."""
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if h.size else np.zeros(1, np.int64)
    size = np.diff(edge)
    return np.repeat(edge[:-1], size), np.repeat(size, size)


def _fits(n, pos, i, j, least: float) -> np.ndarray:
    """Whether sets may be ``least`` alike that share no shingle before this one."""
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least / (1 + least) * (n[i] + n[j]) - 1e-6


def _star_pairs(met: DataFrame, least: float) -> DataFrame:
    """(a, b): of each shingle's texts, the first with each other that may be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, key, n, pos in _whole_runs(batches, ["h", "key", "n", "pos"]):
            i, j = _runs(h)[0], np.arange(h.size)
            go = (i != j) & _fits(n, pos, i, j, least)
            pair = np.unique(np.stack([key[i[go]], key[go]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def _open_buckets(met: DataFrame, unlinked: DataFrame, least: float) -> DataFrame:
    """The rows of ``met`` of shingles some of whose texts the star left unlinked: those
    where a pair of the first text is in ``unlinked`` (or its sieve) or was not tried."""
    pair = lambda a, b: splitmix64(a.view(np.uint64) + splitmix64(b.view(np.uint64)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair(batch.column("a").to_numpy(), batch.column("b").to_numpy()).view(np.int64))], ["key"])

    sieve = met.sparkSession.sparkContext.broadcast(_sieve(unlinked.mapInArrow(mark, "key long")))
    names = ["h", "key", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sieve.value, dtype=np.uint8)
        for cols in _whole_runs(batches, names):
            start, size = _runs(cols[0])
            at = (pair(cols[1][start], cols[1]) & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
            tried = _fits(cols[2], cols[3], start, np.arange(start.size), least)
            hit = ((bits[at >> 3] >> (at & 7) & 1).astype(bool) | ~tried) & (start != np.arange(start.size))
            open_ = np.zeros(start.size, dtype=bool)
            open_[start[hit]] = True
            keep = open_[start]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in cols), pa.array(size[keep] > FEW)], [*names, "big"])

    return met.mapInArrow(run, "h long, key long, n long, pos long, big boolean")


def _small_pairs(rows: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: of the shingles that few texts have, all pairs of texts that may be
    alike (by sizes, places and parities) and that are not known to be of one component
    (column comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, key, n, pos, comp, odd in _whole_runs(batches, ["h", "key", "n", "pos", "comp", "odd"]):
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for shift in range(1, min(FEW, h.size)):
                i = np.flatnonzero((h[:-shift] == h[shift:]) & (comp[:-shift] != comp[shift:]))
                i = i[_fits(n, pos, i, i + shift, least)]
                left.append(i)
                right.append(i + shift)
            i, j = np.concatenate(left), np.concatenate(right)
            near = _apart(odd, i, j) <= (1 - least) / (1 + least) * (n[i] + n[j]) + 1e-6
            pair = np.unique(np.stack([key[i[near]], key[j[near]]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    few = rows.where("not big").join(facts.select("key", "odd"), "key").select("h", "key", "n", "pos", "comp", "odd")
    few = few.repartition("h").sortWithinPartitions("h", "key")
    return few.mapInArrow(run, "a long, b long").distinct()


def _possible(pairs: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """The pairs whose parities do not differ in more places than such sets may."""
    side = lambda c: facts.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            n = batch.num_rows
            odd = [*batch.column("odda").to_pylist(), *batch.column("oddb").to_pylist()]
            apart = _apart(odd, np.arange(n), np.arange(n, 2 * n))
            near = apart <= (1 - least) / (1 + least) * (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(near))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "odda", "oddb")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, least: float, words: int) -> DataFrame:
    """The pairs whose sets are ``least`` alike. The sets of all b of one a meet its set;
    many of them are dealt over parts."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEAVES).alias("parts"))
    dealt = settled(pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")))
    sets = _sets(docs, dealt.select(F.explode(F.array("a", "b")).alias("key")).distinct(), words)
    heads = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("key", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    leaves = dealt.join(sets.withColumnRenamed("key", "b"), "b").select("a", "part", "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in freed(batches):
            left, right = [], []
            for a, b, packed in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles")):
                own = _set(packed.as_py())
                if b is None:
                    head = own
                    continue
                shared = np.intersect1d(head, own, assume_unique=True).size
                if shared >= least * (head.size + own.size - shared):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    both = heads.unionByName(leaves).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long")


def _walk_sets(key: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Spanning links of the texts of one bucket: a text leaves the rest only when
    its set was found ``least`` like the pivot's, so the closure is that of all pairs."""
    size = np.array([x.size for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    marked = np.zeros(int(ids.max()) + 1, dtype=bool)
    left, right = [], []
    rest = np.ones(key.size, dtype=bool)
    frontier: list[int] = []
    first = 0
    while rest.any():
        if not frontier:
            first += int(np.argmax(rest[first:]))
            frontier.append(first)
            rest[first] = False
            continue
        at = frontier.pop()
        own = ids[start[at] : start[at] + size[at]]
        near = np.flatnonzero(rest & (np.minimum(size, size[at]) >= least * np.maximum(size, size[at]) - 1e-6))
        if not near.size:
            continue
        marked[own] = True
        step = np.repeat(start[near] - np.cumsum(size[near]) + size[near], size[near]) + np.arange(size[near].sum())
        both = np.add.reduceat(marked[ids[step]], np.cumsum(size[near]) - size[near], dtype=np.int64)
        marked[own] = False
        found = near[both >= least * (size[near] + size[at] - both)]
        left.extend([int(key[at])] * found.size)
        right.extend(key[found].tolist())
        frontier.extend(found.tolist())
        rest[found] = False
    return left, right


def _tile_pairs(rows: DataFrame, size: Column, limit: int) -> DataFrame:
    """The ``rows`` of shingles whose texts are of several components (column comp), with
    bucket: the shingle's, or past ``limit`` of the summed ``size`` one for each pair of
    tiles, so that every two rows meet in one."""
    sizes = rows.groupBy("h").agg(F.ceil(F.sum(size) / limit).alias("tiles"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("h", "tiles")
    tile = F.pmod(F.xxhash64(F.lit(5), "key"), F.col("tiles"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.xxhash64(F.col("h"), F.least(t, tile), F.greatest(t, tile)))
    return rows.join(sizes, "h").withColumn("bucket", F.explode(others)).drop("tiles")


def _big_pairs(rows: DataFrame, facts: DataFrame, least: float) -> DataFrame:
    """(h, a, b), a < b: for each text of a shingle that many have, its first possible
    partner (by sizes, places and parities) in each of the first PARTNERS other components
    that have one. A shingle without rows has no possible pair."""
    spread = _tile_pairs(rows, F.lit(1), TILE).join(facts.select("key", "odd"), "key")
    spread = spread.repartition("bucket").sortWithinPartitions("bucket", "key").select("bucket", "h", "key", "n", "pos", "comp", "odd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_runs(batches, ["bucket", "h", "key", "n", "pos", "comp", "odd"]):
            start, size = _runs(cols[0])
            found = []
            for at in np.flatnonzero(start == np.arange(start.size)).tolist():
                h, key, n, pos, comp, odd = (c[at : at + size[at]] for c in cols[1:])
                for a in range(0, key.size, 64):
                    i, j = np.nonzero(comp[a : a + 64, None] != comp[None])
                    i += a
                    fit = _fits(n, pos, i, j, least)
                    i, j = i[fit], j[fit]
                    near = _apart(odd, i, j) <= (1 - least) / (1 + least) * (n[i] + n[j]) + 1e-6
                    i, j = i[near], j[near]
                    first = np.unique(np.stack([i, comp[j]]), axis=1, return_index=True)[1]
                    i, j = i[first], j[first]
                    few = np.arange(i.size) - _runs(i)[0] < PARTNERS
                    i, j = i[few], j[few]
                    found.append(np.stack([h[i], np.minimum(key[i], key[j]), np.maximum(key[i], key[j])]))
            pair = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pair], ["h", "a", "b"])

    return spread.mapInArrow(run, "h long, a long, b long")


def _big_links(rows: DataFrame, docs: DataFrame, least: float, words: int) -> DataFrame:
    """(a, b): verified links of the shingles that many texts have, whose closure is that
    of all pairs; past a tile's shingles, a bucket is cut into pairs of tiles."""
    buckets = settled(_tile_pairs(rows, F.col("n"), TILE * TILE_SHINGLES).select("key", "bucket"))
    sets = _sets(docs, buckets.select("key").distinct(), words)
    spread = buckets.join(sets, "key").repartition("bucket").sortWithinPartitions("bucket", "key").select("bucket", "key", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, key, held = None, [], []

        def out() -> pa.RecordBatch:
            a, b = _walk_sets(np.array(key, dtype=np.int64), held, least)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in freed(batches):
            for h, k, packed in zip(batch.column("bucket").to_pylist(), batch.column("key").to_pylist(), batch.column("shingles")):
                if h != bucket:
                    if len(key) > 1:
                        yield out()
                    bucket, key, held = h, [], []
                key.append(k)
                held.append(_set(packed.as_py()))
        if len(key) > 1:
            yield out()

    return spread.mapInArrow(run, "a long, b long").distinct()


def _simhash_pairs(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of texts (text_key, fp) whose fingerprints SimHash links, enough of
    them to join all that it does: each text with the least key of its fingerprint, and
    those least ones along the links of the covering masks."""
    heads = checkpointed(texts.groupBy("fp").agg(F.min("text_key").alias("head")))
    same = texts.join(heads, "fp").where("text_key <> head").select(F.col("head").alias("a"), F.col("text_key").alias("b"))
    end = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    across = links(heads.select("fp"), radius).join(end("a"), "a").join(end("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.unionByName(across)


def near_copies(docs: DataFrame, least: float = COPY_LEAST, words: int = COPY_WORDS) -> DataFrame:
    """(doc_id, text_key, component_id, group_key, raw_key), one row a row of ``docs``.

    group_key: the same for the rows of one component, whatever their ids.
    raw_key: Spark's xxhash64 of the text as it is. component_id: the smallest doc_id that links reach. Linked are texts of the
    same words (A-Z lower-cased) and all whose sets of ``words``-word shingles
    have a Jaccard similarity of ``least`` or more. SimHash comes first: texts whose
    fingerprints it links are compared. What it leaves apart is searched exactly: of two
    such sets, the first shingles in a fixed order (a fifth, for 0.8) share one. A shingle's
    texts are compared with one of them first; of those that this leaves apart, all pairs
    that their parities allow, or, where they are many, some for each text, and at last
    from pivot to pivot. Every link is tested on the sets of 64-bit shingles.
    Null and wordless texts are the same text. Null ids are never the smallest
    unless a component has no other. Repeated rows stay repeated; an empty table
    gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_here()
        for batch in freed(batches):
            for part in text_slices(batch, "text", STEP_BYTES):
                texts = part.column("text").to_pylist()
                keys = np.array([_key(_parts(t)) for t in texts], dtype=np.uint64)
                fp = fingerprints(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys.view(np.int64)), part.column("raw_key"), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "raw_key", "fp"])

    text = F.col("text").cast("string")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("raw_key"))
    rows = settled(read.mapInArrow(run, "doc_id long, text_key long, raw_key long, fp long"))
    texts = settled(rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")))
    name = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    comp = lambda c: F.coalesce(f"root_{c}", c)
    open_ = lambda pairs: pairs.join(name("a"), "a", "left").join(name("b"), "b", "left").where(comp("a") != comp("b")).select("a", "b")
    # SimHash, each of whose links the sets then confirm or not
    linked = settled(_verified(_simhash_pairs(texts), docs, least, words))
    roots = settled(components(linked))
    # of what it leaves apart, each shingle's texts against one of them
    met = settled(_prefixes(docs, least, words))
    tried = settled(_star_pairs(met, least))
    facts = settled(_of_texts(docs, met.select("key").distinct(), words, "n long, odd binary", lambda h: (h.size, parities(h))))
    linked = settled(linked.unionByName(_verified(settled(_possible(open_(tried), facts, least)), docs, least, words)))
    roots = settled(components(linked))
    # then all pairs that this leaves open
    unlinked = settled(open_(tried))
    rest = settled(_open_buckets(met, unlinked, least).join(name("key"), "key", "left").withColumn("comp", comp("key")).drop("root_key"))
    few = _small_pairs(rest, facts, least).join(tried, ["a", "b"], "left_anti")
    many = _big_pairs(rest.where("big").drop("big"), facts, least).select("a", "b")
    again = settled(few.unionByName(many).distinct())
    linked = settled(linked.unionByName(_verified(again, docs, least, words)))
    roots = settled(components(linked))
    # what of the shingles of many texts is open still, from pivot to pivot
    rest = settled(rest.where("big").drop("big", "comp").join(name("key"), "key", "left").withColumn("comp", comp("key")).drop("root_key"))
    left = settled(_big_pairs(rest, facts, least).select("h").distinct())
    if not left.isEmpty():
        roots = components(linked.unionByName(_big_links(rest.join(left, "h", "left_semi"), docs, least, words)))
    named = texts.join(roots, texts["text_key"] == roots["node"], "left").select("text_key", "first", F.coalesce("root", "text_key").alias("root"))
    named = settled(named)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.where("root <> text_key").join(smallest, "root").select("text_key", "component_id", "root").unionByName(smallest.select(F.col("root").alias("text_key"), "component_id", "root"))
    return rows.join(named, "text_key").select("doc_id", "text_key", "component_id", F.col("root").alias("group_key"), "raw_key")


def deduplicate_copies(docs: DataFrame, least: float = COPY_LEAST, words: int = COPY_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one of the
    smallest id. Of the rows that stay by one id, the least text does; each group
    whose ids are all null keeps one row."""
    number, raw = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    # the same plain keys in the join and the window, so that the texts move once
    ends = {fresh(docs, "_id"): F.coalesce(number, raw), fresh(docs, "_none"): number.isNull()}
    texts = fresh(docs, "_texts")
    stay = near_copies(docs, least, words).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = stay.where("doc_id is not null").select("doc_id", "raw_key")
    nameless = stay.where("doc_id is null").groupBy("group_key").agg(F.min("raw_key").alias("raw_key")).select(F.lit(None).cast("long").alias("doc_id"), "raw_key")
    own = named.unionByName(nameless).select(*(c.alias(n) for n, c in zip(ends, (F.coalesce("doc_id", "raw_key"), F.col("doc_id").isNull()))), "raw_key")
    own = own.groupBy(*ends).agg(F.collect_set("raw_key").alias(texts))
    kept = docs.withColumns(ends).join(own, list(ends)).where(F.array_contains(texts, raw))
    nth = fresh(docs, "_nth")
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(*ends).orderBy("text")))
    return kept.where(F.col(nth) == 1).select(*docs.columns)
