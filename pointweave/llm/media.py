"""Media columns over the progressive JPEG codec: payloads in, files and tensors out."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import progressive
from .common import freed, text_slices

#: Payload bytes come in multiples of this.
UNIT = 576
#: Bytes of payload that one codec call handles; a longer one is one call.
CALL = 2 << 20


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text (null: none), and the payload: those, then 255 up to a
    positive multiple of ``UNIT``."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw + b"\xff" * (size - len(raw))


def read_payload(file: progressive.Decoded) -> bytes:
    """The payload of a decoded file: its coefficients, as many as its comment says."""
    n = int.from_bytes(file.comment, "big")
    return (file.coefs.reshape(-1)[:n] + np.int16(128)).astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Height x width, the channels' sums, and a checksum of the RGB tensor."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{sums[0]},{sums[1]},{sums[2]}:{zlib.crc32(np.ascontiguousarray(rgb).data):08x}"


def _runs(docs: DataFrame, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for part in text_slices(batch, "text", CALL):
                sizes, payloads = zip(*map(padded, part.column("text").to_pylist()))
                yield make(part.column("doc_id"), sizes, progressive.encode(list(payloads)))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, height, width, rgb), one row a row of ``docs``:
    the stored file, and the full-resolution RGB tensor decoded from it, row by
    row as bytes. A null text is empty; rows that repeat stay; other columns are
    not read; an empty table gives an empty one."""

    def make(ids, sizes, files):
        rgb = [d.rgb for d in progressive.decode(files)]
        shape = [pa.array([x.shape[i] for x in rgb], pa.int32()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), *shape, pa.array([x.tobytes() for x in rgb], pa.binary())], ["doc_id", "n_bytes", "media", "height", "width", "rgb"])

    return _runs(docs, "doc_id long, n_bytes long, media binary, height int, width int, rgb binary", make)


def media_digests(docs: DataFrame, tensors: bool = False) -> DataFrame:
    """Digests of what :func:`media_columns` stores and of what is read back, and with
    ``tensors`` the stored tensors too: (height, width, rgb).

    A null text is empty; equal texts have equal values; rows that repeat stay; other
    columns are not read; an empty table gives an empty one. A text is one picture,
    coded by one task at once; about 9 GB is the format's end.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def make(ids, sizes, files):
        read = progressive.decode(files)
        back = [read_payload(d) for d in read]
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        longs = lambda xs: pa.array(list(xs), pa.int64())
        cols = {
            "doc_id": ids,
            "n_bytes": longs(sizes),
            "payload_bytes": longs(map(len, back)),
            "payload_sha256": sha(back),
            "tail_crc32": longs(zlib.crc32(p[-32:]) for p in back),
            "media_bytes": longs(map(len, files)),
            "media_sha256": sha(files),
            "feature": pa.array([feature(d.rgb) for d in read], pa.string()),
        }
        if tensors:
            cols |= {n: pa.array([d.rgb.shape[i] for d in read], pa.int32()) for i, n in enumerate(("height", "width"))}
            cols["rgb"] = pa.array([d.rgb.tobytes() for d in read], pa.binary())
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return _runs(docs, schema + (", height int, width int, rgb binary" if tensors else ""), make)
