"""Shared helpers of the training-data operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from ..session import checkpointed, shared_path  # noqa: F401  for the operators

#: Bytes of text that one numpy step handles at once; a longer single text is one step.
SLICE_BYTES = 4 << 20


#: What empties the caches that operators keep in a worker between tasks.
LET_GO: list[Callable[[], None]] = []


def only_here() -> None:
    """A worker that turns to an operator without such caches gives up the others'."""
    for empty in LET_GO:
        empty()


def settled(df: DataFrame) -> DataFrame:
    """:func:`checkpointed`, and the shuffle files of plans that nothing refers to any more
    go: Spark removes them when the driver collects its garbage, by itself every half hour."""
    spark, df = df.sparkSession, checkpointed(df)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of ``batch`` whose texts have about ``limit`` bytes together."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, a worker gives back what Arrow holds unused."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes; planes of zeros cost nothing."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T) if x.size else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.data)


def unpack(data: bytes, kind=np.uint64) -> np.ndarray:
    """What :func:`pack` was given."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def gaps(ascending: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers as differences; ``np.cumsum`` undoes it."""
    return np.diff(ascending, prepend=np.uint64(0))


def splitmix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of unsigned integers (public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in [0, 1) that depend only on the 64-bit keys ``x``."""
    return (splitmix64(x) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
