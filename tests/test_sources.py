"""Readers and writers: text layouts, PLY, LAS, E57, the registry, streams."""

import numpy as np
import pytest

from pointweave.sources import ascii, binary, registry
from pointweave.streaming import ingest

XYZ = {a: np.array(v, "f8") for a, v in zip("xyz", ([1, 9, 5], [2, 1, 9], [9, 3, 1]))}
WANT = [(1.0, 2.0, 9.0), (5.0, 9.0, 1.0), (9.0, 1.0, 3.0)]


def xyz(df):
    return sorted((r.x, r.y, r.z) for r in df.select("x", "y", "z").collect())


def test_pts(spark, tmp_path):
    f = tmp_path / "test.pts"
    f.write_text("3\n1 2 9 -100 10 20 30\n9 1 3 7 0 255 1\n\n# no\n5 9 1 0 1 2\n5\t9  1 0 1 2 3 more\n1 2 3 4 300 0 0\n")
    df = registry.read(spark, str(f))
    assert xyz(df) == WANT and sorted(r.g for r in df.collect()) == [2, 20, 255]
    info = registry.info(spark, str(f)).first()
    assert info.points == 3 and list(info.lo) == [1, 1, 1] and list(info.hi) == [9, 9, 9]


def test_layouts(spark):
    lines = spark.createDataFrame([("0.5 1 2 3 1.5 7.9",), ("1 1 2 3 0.2 x",), ("0.25 4 5 6 1 -3.2",)], "value string")
    got = ascii.parse_lines(lines, ("ColorRf", "PositionZ", "PositionY", "PositionX", "Skip", "Intensity")).collect()
    assert sorted((r.r, r.z, r.intensity) for r in got) == [(63, 4.0, -3), (127, 1.0, 7)]
    custom = ascii.parse_lines(lines, ("CustomFloat64", "CustomInt32", "PositionX")).collect()
    assert sorted(r.custom0 for r in custom) == [0.25, 0.5, 1.0]
    with pytest.raises(ValueError):
        ascii.parse_lines(lines, ("Nothing",))


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, form):
    cols = {k: v.astype("f4") for k, v in XYZ.items()} | {"r": np.array([1, 2, 3], "u1"), "intensity": np.array([0, 500, 1000], "f4")}
    (tmp_path / "a.ply").write_bytes(binary.ply_bytes(cols, form))
    df = registry.read(spark, str(tmp_path / "a.ply"))
    assert xyz(df) == WANT and sorted(r.intensity for r in df.collect()) == [0, 127, 255]
    info = registry.info(spark, str(tmp_path / "a.ply")).first()
    assert info.points == 3 and info.lo is None


def test_ply_faces(spark, tmp_path):
    text = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n3 0 1 2\n4 0 1 2 3\n"
    (tmp_path / "q.ply").write_text(text)
    assert [(r.fi, r.fs, r.vi) for r in binary.read_ply_faces(spark, str(tmp_path / "q.ply")).orderBy("fi", "fs").collect()] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3)]


def test_las(spark, tmp_path):
    cols = XYZ | {"intensity": np.array([5, 6, 7]), "classification": np.array([1, 2, 3]), "r": np.array([65535, 256, 0]), "g": np.array([0, 0, 0]), "b": np.array([1, 2, 3])}
    data = binary.las_bytes(cols)
    (tmp_path / "a.las").write_bytes(data)
    df = registry.read(spark, str(tmp_path / "a.las")).orderBy("intensity")
    got = df.collect()
    assert [(round(r.x, 6), r.classification, r.r) for r in got] == [(1.0, 1, 255), (9.0, 2, 1), (5.0, 3, 0)]
    info = registry.info(spark, str(tmp_path / "a.las")).first()
    assert info.points == 3 and list(info.lo) == [1, 1, 1]
    packed = bytearray(data)
    packed[104] |= 0x80
    with pytest.raises(ValueError, match="LAZ"):
        binary.las_header(bytes(packed))


def test_e57(spark, tmp_path):
    colours = {c: np.array([10, 20, 30]) for c in "rgb"}
    data = binary.e57_bytes([XYZ | colours | {"name": "a"}, XYZ | {"name": "b", "translation": (1, 0, 0), "rotation": (0, 0, 0, 1)}])
    (tmp_path / "a.e57").write_bytes(data)
    df = registry.read(spark, str(tmp_path / "a.e57"))
    assert xyz(df.where("part_index = 0")) == WANT
    assert xyz(df.where("part_index = 1")) == sorted((1 - x, -y, z) for x, y, z in WANT)
    assert sorted(r.g for r in df.where("part_index = 0").collect()) == [10, 20, 30]
    assert [(r.name, r.points) for r in binary.e57_scans(spark, str(tmp_path / "a.e57")).collect()] == [("a", 3), ("b", 3)]
    binary.e57_logical(data, verify=True)
    broken = bytearray(data)
    broken[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        binary.e57_logical(bytes(broken), verify=True)


def test_crc32c_and_bits():
    assert binary.crc32c(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xE3069283
    v = np.array([5, 0, 1023, 512])
    raw = np.packbits((v[:, None] >> np.arange(10) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()
    assert binary.unpack_bits(raw, 10, 4).tolist() == v.tolist()


def test_registry():
    assert registry.format_of("/a/B.PTS").description == "pts" and registry.format_of("x.unknown") is None
    with pytest.raises(ValueError):
        registry.register(registry.text_format("again", ("pts",), ascii.LAYOUTS["pts"]))


def test_particles(spark, tmp_path):
    (tmp_path / "p.txt").write_text("\n".join(" ".join(str(i + j) for j in range(27)) for i in range(3)) + "\nbroken line\n")
    got = ascii.read_particles(spark, str(tmp_path / "p.txt")).orderBy("x").collect()
    assert [r.x for r in got] == [0.0, 1.0, 2.0] and list(got[0].sigma) == [float(k) for k in range(16, 25)] and got[0].pressure == 26.0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(f"{k}.{i} 0 0" for i in range(4)))
    source = ingest.text_stream(spark, str(tmp_path / "in"), "xyz")
    query = ingest.append_to(source.where("x >= 1"), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_stateful_thinning(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, float(i) / 10, 0.0, 0.0) for i in range(20)], "point_id long, line int, x double, y double, z double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = ingest.thin_sequentially(stream, 0.5, "line").writeStream.format("memory").queryName("thin").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.point_id for r in spark.sql("select * from thin").collect()) == [0, 1, 6, 7, 12, 13, 18, 19]
