"""Binary point clouds: PLY, LAS and E57, read by Spark's own file reader.

Files come as (path, content) from ``binaryFile``, so any store that Spark
reads works; each file is unpacked by NumPy in the task that read it.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import checkpointed

POINTS = "path string, x double, y double, z double, r smallint, g smallint, b smallint, a smallint, nx float, ny float, nz float, intensity int, classification smallint, part_index int"
NAMES = [c.split()[0] for c in POINTS.split(", ")]
#: Points of a batch that leaves a task's reader.
BATCH = 1 << 16
#: Points that close a packed file, and points of all files that a task has open.
FILE, HELD = 1 << 16, 1 << 20


def unpack_files(files: DataFrame, unpack, schema: str) -> DataFrame:
    """Points of files (path, content), a file in one task."""
    types = to_arrow_schema(StructType.fromDDL(schema))

    def column(name: str, kind: pa.DataType, path: str, part: dict, n: int) -> pa.Array:
        if name == "path":
            return pa.array([path] * n, kind)
        if name not in part:
            return pa.nulls(n, kind)
        v = part[name]
        if isinstance(v, np.ndarray) and v.dtype != object:
            return pa.array(v, from_pandas=True).cast(kind)
        return pa.array(list(v), kind, from_pandas=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                for cols in unpack(content.as_py()):
                    n = len(cols["x"])
                    for a in range(0, n, BATCH):
                        part = {k: v[a : a + BATCH] for k, v in cols.items()}
                        yield pa.RecordBatch.from_arrays([column(f.name, f.type, p.as_py(), part, len(part["x"])) for f in types], schema=types)

    return files.select("path", "content").mapInArrow(run, schema)


def _read(spark: SparkSession, path: str, unpack, schema: str = POINTS) -> DataFrame:
    return unpack_files(spark.read.format("binaryFile").load(path), unpack, schema)


def pack_files(points: DataFrame, kind: str, by: str, columns: dict[str, str]) -> DataFrame:
    """(path, content): files of up to ``FILE`` points that share a value of ``by``, in a
    folder named after it. ``columns``: names and NumPy types of what they hold. Rows are
    packed where they are, so a task holds a few open files, however many points a value has."""
    make = {"las": las_bytes, "ply": ply_bytes, "e57": lambda cols: e57_bytes([{k: v[a : a + 2000] for k, v in cols.items()} for a in range(0, len(cols["x"]), 2000)])}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[pd.DataFrame]] = {}
        sizes: dict[str, int] = {}
        task, made = TaskContext.get().partitionId(), 0

        def file(key: str) -> pd.DataFrame:
            nonlocal made
            pdf = pd.concat(waiting.pop(key))
            del sizes[key]
            made += 1
            return pd.DataFrame({"path": [f"{key}/{task}-{made}.{kind}"], "content": [make({c: pdf[c].to_numpy(t) for c, t in columns.items()})]})

        for batch in batches:
            for key, pdf in batch.groupby("_key", sort=False):
                waiting.setdefault(key, []).append(pdf)
                sizes[key] = sizes.get(key, 0) + len(pdf)
                if sizes[key] >= FILE:
                    yield file(key)
            while sum(sizes.values()) > HELD:
                yield file(max(sizes, key=sizes.get))
        for key in list(sizes):
            yield file(key)

    key = F.coalesce(F.col(by).cast("string"), F.lit("None")).alias("_key")
    return points.select(key, *columns).mapInPandas(run, "path string, content binary")


def unpacked(files: DataFrame, kind: str) -> DataFrame:
    """Points of files (path, content) of a format: what reading them gives."""
    unpack, schema = {"las": (_las_points, LAS_SCHEMA), "ply": (_ply_points, POINTS), "e57": (_e57_points, E57_SCHEMA)}[kind]
    return unpack_files(files, unpack, schema)


# --- PLY -------------------------------------------------------------------------

#: Types and names of the format.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "int64": "i8", "uint64": "u8", "float32": "f4", "float64": "f8"}
PLY_NAMES = {"red": "r", "green": "g", "blue": "b", "alpha": "a", "scalar_intensity": "intensity", "scalar_classification": "classification"}


def ply_header(data: bytes) -> tuple[str, list[tuple[str, int, list[tuple]]], int]:
    """Format, elements (name, count, properties) and where the body starts."""
    end = data.index(b"end_header")
    start = data.index(b"\n", end) + 1
    lines = data[:end].decode("latin-1").split("\n")
    if lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    form, elements = "", []
    for line in map(str.split, lines[1:]):
        if not line or line[0] in ("comment", "obj_info"):
            continue
        if line[0] == "format":
            form = line[1]
        elif line[0] == "element":
            elements.append((line[1], int(line[2]), []))
        elif line[0] == "property" and line[1] == "list":
            elements[-1][2].append((line[4], PLY_TYPES[line[3]], PLY_TYPES[line[2]]))
        elif line[0] == "property":
            elements[-1][2].append((line[2], PLY_TYPES[line[1]], None))
    return form, elements, start


def ply_elements(data: bytes) -> dict[str, dict[str, np.ndarray | list]]:
    """Every element's properties; a list property is a list of arrays."""
    form, elements, at = ply_header(data)
    out = {}
    if form == "ascii":
        words = data[at:].split()
        i = 0
        for name, n, props in elements:
            rows: dict[str, list] = {p[0]: [] for p in props}
            if all(p[2] is None for p in props):
                block = np.array(words[i : i + n * len(props)], dtype="f8").reshape(n, -1)
                out[name] = {p[0]: block[:, k].astype(p[1]) for k, p in enumerate(props)}
                i += n * len(props)
                continue
            for _ in range(n):
                for p, kind, counts in props:
                    if counts is None:
                        rows[p].append(float(words[i]))
                        i += 1
                    else:
                        m = int(words[i])
                        rows[p].append(np.array(words[i + 1 : i + 1 + m], dtype="f8").astype(kind))
                        i += 1 + m
            out[name] = {p: rows[p] if counts else np.array(rows[p]).astype(kind) for p, kind, counts in props}
        return out
    order = "<" if form == "binary_little_endian" else ">"
    for name, n, props in elements:
        if all(p[2] is None for p in props):
            kind = np.dtype([(p[0], order + p[1]) for p in props])
            block = np.frombuffer(data, kind, n, at)
            out[name] = {p[0]: block[p[0]].astype(p[1]) for p in props}
            at += kind.itemsize * n
            continue
        rows = {p[0]: [] for p in props}
        for _ in range(n):
            for p, kind, counts in props:
                m = 1
                if counts is not None:
                    m = int(np.frombuffer(data, order + counts, 1, at)[0])
                    at += np.dtype(counts).itemsize
                v = np.frombuffer(data, order + kind, m, at)
                at += v.nbytes
                rows[p].append(v.astype(kind) if counts else v[0])
        out[name] = {p: rows[p] if counts else np.array(rows[p]).astype(kind) for p, kind, counts in props}
    return out


def _ply_points(data: bytes) -> Iterator[dict]:
    v = ply_elements(data).get("vertex", {})
    out = {}
    for name, col in v.items():
        name = PLY_NAMES.get(name, name)
        if name not in NAMES or isinstance(col, list):
            continue
        if name in "rgba" and len(name) == 1:
            col = np.floor(col * 255.999).astype("i2") if col.dtype.kind == "f" else (col.astype("i8") & 255).astype("i2")
        elif name == "intensity":
            col = _byte_range(col) if col.dtype.kind == "f" or col.dtype.itemsize == 8 or col.dtype == np.uint32 else col.astype("i4")
        elif name == "classification":
            col = col.astype("i2")
        elif name[0] == "n":
            col = col.astype("f4")
        out[name] = col.astype("f8") if name in "xyz" else col
    if {"x", "y", "z"} <= out.keys():
        yield out


def _byte_range(v: np.ndarray) -> np.ndarray:
    """Intensities outside 0..255 are rescaled to it; equal ones become 255."""
    v = v.astype("f8")
    if not len(v) or (v.min() >= 0 and v.max() <= 255):
        return v.astype("i4")
    low, high = v.min(), v.max()
    return np.full(len(v), 255, "i4") if low == high else np.floor((v - low) * 255.999 / (high - low)).astype("i4")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _ply_points)


def read_ply_faces(spark: SparkSession, path: str) -> DataFrame:
    """Corners (path, fi, fs, vi) of the files' faces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                f = ply_elements(bytes(content)).get("face", {})
                lists = next((v for k, v in f.items() if k in ("vertex_indices", "vertex_index")), [])
                rows = [(p, i, s, int(x)) for i, face in enumerate(lists) for s, x in enumerate(face)]
                yield pd.DataFrame(rows, columns=["path", "fi", "fs", "vi"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, fi long, fs long, vi long")


def ply_bytes(columns: dict[str, np.ndarray], form: str = "binary_little_endian") -> bytes:
    """A PLY file with one vertex element."""
    kinds = {v: k for k, v in PLY_TYPES.items() if not k[-1].isdigit()}
    n = len(next(iter(columns.values())))
    back = {v: k for k, v in PLY_NAMES.items()}
    head = ["ply", f"format {form} 1.0", f"element vertex {n}", *(f"property {kinds[c.dtype.str[1:]]} {back.get(k, k)}" for k, c in columns.items()), "end_header", ""]
    if form == "ascii":
        body = "\n".join(" ".join(str(x) for x in row) for row in zip(*columns.values())).encode()
    else:
        order = "<" if form == "binary_little_endian" else ">"
        block = np.empty(n, [(k, order + c.dtype.str[1:]) for k, c in columns.items()])
        for k, c in columns.items():
            block[k] = c
        body = block.tobytes()
    return "\n".join(head).encode() + body


# --- LAS -------------------------------------------------------------------------

#: Record lengths, and where colour and time stand, by point format.
LAS_COLOUR = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
LAS_TIME = {1: 20, 3: 20, 4: 20, 5: 20, **dict.fromkeys(range(6, 11), 22)}
LAS_SCHEMA = POINTS + ", gps_time double, return_number smallint, return_count smallint, scan_angle double, source_id int, scan_direction boolean, edge_of_flight_line boolean"


def las_header(data: bytes) -> dict:
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    minor = data[25]
    start, = struct.unpack_from("<I", data, 96)
    form, length, n = struct.unpack_from("<BHI", data, 104)
    if form & 0x80:
        raise ValueError("LAZ compression is not handled; unpack to LAS first")
    if minor >= 4:
        n = struct.unpack_from("<Q", data, 247)[0] or n
    numbers = struct.unpack_from("<12d", data, 131)
    hi, lo = numbers[6::2], numbers[7::2]
    return {"version": minor, "start": start, "format": form, "length": length, "count": n, "scale": numbers[:3], "offset": numbers[3:6], "lo": lo, "hi": hi}


def _las_points(data: bytes) -> Iterator[dict]:
    h = las_header(data)
    raw = np.frombuffer(data, np.uint8, h["count"] * h["length"], h["start"]).reshape(-1, h["length"])
    f, late = h["format"], h["format"] >= 6

    def at(offset: int, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(raw[:, offset : offset + size]).view("<" + kind).ravel()

    out = {a: at(4 * i, "i4") * h["scale"][i] + h["offset"][i] for i, a in enumerate("xyz")}
    out["intensity"] = at(12, "u2").astype("i4")
    flags = at(14, "u1")
    if late:
        more = at(15, "u1")
        out |= {"return_number": flags & 15, "return_count": flags >> 4, "classification": at(16, "u1"), "scan_angle": at(18, "i2") * 0.006, "source_id": at(20, "u2"), "scan_direction": (more >> 6 & 1).astype(bool), "edge_of_flight_line": (more >> 7).astype(bool)}
    else:
        out |= {"return_number": flags & 7, "return_count": flags >> 3 & 7, "classification": at(15, "u1") & 31, "scan_angle": at(16, "i1").astype("f8"), "source_id": at(18, "u2"), "scan_direction": (flags >> 6 & 1).astype(bool), "edge_of_flight_line": (flags >> 7).astype(bool)}
    for k in ("classification", "return_number", "return_count"):
        out[k] = out[k].astype("i2")
    out["source_id"] = out["source_id"].astype("i4")
    if f in LAS_TIME:
        out["gps_time"] = at(LAS_TIME[f], "f8")
    if f in LAS_COLOUR:
        rgb = [at(LAS_COLOUR[f] + 2 * i, "u2") for i in range(3)]
        high = max((int(c.max()) if len(c) else 0) for c in rgb) > 255
        out |= {k: (c >> 8 if high else c).astype("i2") for k, c in zip("rgb", rgb)}
    yield out


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """Uncompressed LAS 1.0 to 1.4, point formats 0 to 10."""
    return _read(spark, path, _las_points, LAS_SCHEMA)


def las_bytes(columns: dict[str, np.ndarray], scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of point format 2 (positions, intensity, class, colours)."""
    p = np.stack([np.asarray(columns[a], float) for a in "xyz"], axis=1)
    n = len(p)
    lo = p.min(axis=0) if n else np.zeros(3)
    hi = p.max(axis=0) if n else np.zeros(3)
    ticks = np.rint((p - lo) / scale)
    if n and ticks.max() > 2**31 - 1:
        raise ValueError("positions don't fit 32 bits at this scale")
    kind = np.dtype([("p", "<i4", 3), ("i", "<u2"), ("f", "u1"), ("c", "u1"), ("s", "i1"), ("u", "u1"), ("id", "<u2"), ("rgb", "<u2", 3)])
    block = np.zeros(n, kind)
    block["p"], block["f"] = ticks, 9
    block["i"], block["c"] = columns.get("intensity", 0), columns.get("classification", 0)
    for i, k in enumerate("rgb"):
        block["rgb"][:, i] = columns.get(k, 0)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI5I", head, 104, 2, kind.itemsize, n, n, 0, 0, 0, 0)
    struct.pack_into("<12d", head, 131, scale, scale, scale, *lo, hi[0], lo[0], hi[1], lo[1], hi[2], lo[2])
    return bytes(head) + block.tobytes()


# --- E57 -------------------------------------------------------------------------

PAGE = 1024


def crc32c(rows: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes; all rows go through a byte at a time."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = table >> np.uint32(1) ^ np.where(table & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    c = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        c = table[(c ^ column) & np.uint32(255)] ^ c >> np.uint32(8)
    return c ^ np.uint32(0xFFFFFFFF)


def e57_logical(data: bytes, verify: bool = True) -> bytes:
    """The file without its page checksums, which are looked at first."""
    pages = np.frombuffer(data, np.uint8, len(data) // PAGE * PAGE).reshape(-1, PAGE)
    if verify:
        wrong = np.flatnonzero(crc32c(pages[:, : PAGE - 4]) != np.ascontiguousarray(pages[:, PAGE - 4 :]).view(">u4").ravel())
        if wrong.size:
            raise ValueError(f"checksum of page {wrong[0]}")
    return pages[:, : PAGE - 4].tobytes()


def _logical_at(physical: int) -> int:
    return physical // PAGE * (PAGE - 4) + physical % PAGE


def e57_xml(data: bytes) -> ET.Element:
    if data[:8] != b"ASTM-E57":
        raise ValueError("not an E57 file")
    at, size = struct.unpack_from("<QQ", data, 24)
    text = e57_logical(data)[_logical_at(at) :][:size]
    root = ET.fromstring(text.decode())
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    return root


def unpack_bits(raw: bytes, width: int, n: int) -> np.ndarray:
    """``n`` unsigned integers of ``width`` bits, least significant bit first."""
    if width == 0:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: n * width].reshape(-1, width)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))


def _e57_scan(logical: bytes, points: ET.Element) -> dict[str, np.ndarray]:
    """All fields of a scan's compressed vector."""
    start = _logical_at(int(points.get("fileOffset")))
    total = int(points.get("recordCount"))
    fields = list(points.find("prototype"))
    first = _logical_at(struct.unpack_from("<Q", logical, start + 16)[0])
    streams = [bytearray() for _ in fields]
    at = first
    section = struct.unpack_from("<Q", logical, start + 8)[0]
    while at < start + section and at + 6 <= len(logical):
        kind, _, length, count = struct.unpack_from("<BBHH", logical, at)
        if kind == 1:
            sizes = struct.unpack_from(f"<{count}H", logical, at + 6)
            p = at + 6 + 2 * count
            for s, size in zip(streams, sizes):
                s += logical[p : p + size]
                p += size
        elif kind not in (0, 2):
            break
        at += length + 1
    out = {}
    for f, raw in zip(fields, streams):
        kind = f.get("type")
        if kind == "Float":
            single = f.get("precision") == "single"
            out[f.tag] = np.frombuffer(bytes(raw), "<f4" if single else "<f8", total).astype("f8")
        else:
            low, high = int(f.get("minimum", -(2**63))), int(f.get("maximum", 2**63 - 1))
            width = (high - low).bit_length()
            v = unpack_bits(bytes(raw), width, total) + low
            out[f.tag] = v if kind == "Integer" else v * float(f.get("scale", 1)) + float(f.get("offset", 0))
    return out


def _number(e: ET.Element | None, default: float = 0.0) -> float:
    return float(e.text) if e is not None and e.text else default


def _e57_pose(scan: ET.Element) -> tuple[np.ndarray, np.ndarray]:
    pose = scan.find("pose")
    if pose is None:
        return np.eye(3), np.zeros(3)
    q = pose.find("rotation")
    w, x, y, z = (_number(q.find(k) if q is not None else None, float(k == "w")) for k in "wxyz")
    t = pose.find("translation")
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return r, np.array([_number(t.find(k) if t is not None else None) for k in "xyz"])


E57_SCHEMA = POINTS + ", row_index int, column_index int, return_index int, return_count int, time_stamp double"


def _e57_points(data: bytes) -> Iterator[dict]:
    root, logical = e57_xml(data), e57_logical(data)
    for part, scan in enumerate(root.find("data3D") if root.find("data3D") is not None else []):
        v = _e57_scan(logical, scan.find("points"))
        if "cartesianX" in v:
            p = np.stack([v[f"cartesian{a}"] for a in "XYZ"], axis=1)
        else:
            r, a, e = v["sphericalRange"], v["sphericalAzimuth"], v["sphericalElevation"]
            p = np.stack([r * np.cos(e) * np.cos(a), r * np.cos(e) * np.sin(a), r * np.sin(e)], axis=1)
        rot, move = _e57_pose(scan)
        p = p @ rot.T + move
        bad = v.get("cartesianInvalidState", v.get("sphericalInvalidState", np.zeros(len(p))))
        fine = bad == 0
        out = {c: p[fine, i] for i, c in enumerate("xyz")}
        limits = scan.find("colorLimits")
        for c, name in zip("rgb", ("Red", "Green", "Blue")):
            if f"color{name}" in v:
                top = _number(limits.find(f"color{name}Maximum") if limits is not None else None, 255.0) or 255.0
                out[c] = np.floor(v[f"color{name}"][fine] * (255.0 / top)).astype("i2")
            else:
                out[c] = np.zeros(int(fine.sum()), "i2")
        out["a"] = np.full(int(fine.sum()), 255, "i2")
        if "intensity" in v:
            out["intensity"] = v["intensity"][fine].astype("i4")
        if "classification" in v:
            out["classification"] = v["classification"][fine].astype("i2")
        if "normalX" in v:
            n = np.stack([v[f"normal{a}"][fine] for a in "XYZ"], axis=1) @ rot.T
            out |= {f"n{a}": n[:, i].astype("f4") for i, a in enumerate("xyz")}
        for name, col in (("rowIndex", "row_index"), ("columnIndex", "column_index"), ("returnIndex", "return_index"), ("returnCount", "return_count")):
            if name in v:
                out[col] = v[name][fine].astype("i4")
        if "timeStamp" in v:
            out["time_stamp"] = v["timeStamp"][fine]
        out["part_index"] = np.full(int(fine.sum()), part, "i4")
        yield out


def read_e57(spark: SparkSession, path: str) -> DataFrame:
    """All scans of E57 files; a point's part_index is its scan's place in the file."""
    return _read(spark, path, _e57_points, E57_SCHEMA)


def e57_scans(spark: SparkSession, path: str) -> DataFrame:
    """(path, scan, name, points, fields): the scans' metadata only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                for i, s in enumerate(e57_xml(bytes(content)).iterfind("data3D/vectorChild")):
                    pts = s.find("points")
                    rows.append((p, i, s.findtext("name"), int(pts.get("recordCount")), [f.tag for f in pts.find("prototype")]))
            yield pd.DataFrame(rows, columns=["path", "scan", "name", "points", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, scan int, name string, points long, fields array<string>")


def e57_bytes(scans: list[dict]) -> bytes:
    """A small E57 file: float64 positions, optional byte colours, pose and name
    of each scan. One data packet a scan, so at most about 2,000 points each."""
    logical = bytearray(48)
    xml = []
    for s in scans:
        fields = [(f"cartesian{a}", np.asarray(s[a.lower()], "<f8").tobytes(), '<cartesian%s type="Float"/>' % a) for a in "XYZ"]
        for c, name in (("r", "Red"), ("g", "Green"), ("b", "Blue")):
            if c in s:
                fields.append((name, np.asarray(s[c], "u1").tobytes(), f'<color{name} type="Integer" minimum="0" maximum="255"/>'))
        logical += b"\0" * (-len(logical) % 4)
        start = len(logical)
        sizes = [len(f[1]) for f in fields]
        packet = 6 + 2 * len(sizes) + sum(sizes)
        packet += -packet % 4
        at = start + 32
        physical = lambda p: p // (PAGE - 4) * PAGE + p % (PAGE - 4)
        logical += struct.pack("<B7xQQQ", 1, 32 + packet, physical(at), 0)
        body = struct.pack(f"<BBHH{len(sizes)}H", 1, 0, packet - 1, len(sizes), *sizes) + b"".join(f[1] for f in fields)
        logical += body + b"\0" * (packet - len(body))
        pose = ""
        if "translation" in s:
            q, t = s.get("rotation", (1, 0, 0, 0)), s["translation"]
            num = lambda k, v: f'<{k} type="Float">{v}</{k}>'
            pose = f'<pose type="Structure"><rotation type="Structure">{"".join(map(num, "wxyz", q))}</rotation><translation type="Structure">{"".join(map(num, "xyz", t))}</translation></pose>'
        xml.append(f'<vectorChild type="Structure"><name type="String">{s.get("name", "")}</name>{pose}<points type="CompressedVector" fileOffset="{physical(start)}" recordCount="{len(s["x"])}"><prototype type="Structure">{"".join(f[2] for f in fields)}</prototype></points></vectorChild>')
    text = ('<?xml version="1.0" encoding="UTF-8"?><e57Root type="Structure" xmlns="http://www.astm.org/COMMIT/E57/2010-e57-v1.0"><data3D type="Vector">' + "".join(xml) + "</data3D></e57Root>").encode()
    logical += b"\0" * (-len(logical) % 4)
    at = len(logical)
    logical += text
    logical += b"\0" * (-len(logical) % (PAGE - 4))
    struct.pack_into("<8sIIQQQQ", logical, 0, b"ASTM-E57", 1, 0, len(logical) // (PAGE - 4) * PAGE, at // (PAGE - 4) * PAGE + at % (PAGE - 4), len(text), PAGE)
    pages = np.frombuffer(bytes(logical), np.uint8).reshape(-1, PAGE - 4)
    return np.hstack([pages, crc32c(pages).astype(">u4").view(np.uint8).reshape(-1, 4)]).tobytes()


def header_info(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, points, lo, hi) of files from their headers alone; a PLY header has no bounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                data = bytes(content)
                if kind == "las":
                    h = las_header(data)
                    rows.append((p, h["count"], list(h["lo"]), list(h["hi"])))
                elif kind == "ply":
                    rows.append((p, next((n for e, n, _ in ply_header(data)[1] if e == "vertex"), 0), None, None))
                else:
                    rows.append((p, sum(int(x.get("recordCount")) for x in e57_xml(data).iterfind("data3D/vectorChild/points")), None, None))
            yield pd.DataFrame(rows, columns=["path", "points", "lo", "hi"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, points long, lo array<double>, hi array<double>")


def with_ids(points: DataFrame) -> DataFrame:
    """A point_id for sources without one: unique, in file order within a task. The
    numbered points are written to the shared folder, as the next action might else
    deal the files out differently and number them anew."""
    return checkpointed(points.withColumn("point_id", F.monotonically_increasing_id()))
