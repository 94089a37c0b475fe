"""Media: lossless coefficients, decoding without restart markers, tensors."""

import hashlib
import zlib

import numpy as np
import pytest

from pointweave.llm import media
from pointweave.llm import progressive as P


def payloads():
    rng = np.random.default_rng(1)
    made = [bytes(rng.integers(0, 256, 576 * k, dtype=np.uint8)) for k in (1, 2, 3, 7, 300)]
    made += [b"\xff" * 576, bytes([128]) * 576, bytes([128] * 575 + [1])]
    made += [bytes(rng.choice(list(v), 576 * 4).astype(np.uint8)) for v in ((127, 128, 129), (126, 127, 128, 129, 130), (128,) * 15 + (0,), (0, 255))]
    return made


def test_round_trip():
    for p, d in zip(payloads(), P.decode(P.encode(payloads()))):
        assert media.read_payload(d) == p
        assert d.rgb.shape[0] % 16 == 0 and d.rgb.shape[2] == 3


def test_equal_payloads_give_equal_files_in_any_company():
    every = payloads()
    alone = [P.encode([p])[0] for p in every]
    assert alone == P.encode(every)
    assert [P.decode([f])[0].rgb.tobytes() for f in alone] == [d.rgb.tobytes() for d in P.decode(alone)]


def test_pixels_against_the_definition():
    file = P.encode([bytes(np.random.default_rng(2).integers(100, 156, 576, dtype=np.uint8))])
    d = P.decode(file)[0]
    zz = P.zigzag()
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)

    def block(i):
        f = np.zeros(64)
        f[zz] = d.coefs[i]
        return np.clip(np.rint(basis.T @ f.reshape(8, 8) @ basis) + 128, 0, 255)

    y = np.vstack([np.hstack([block(0), block(1)]), np.hstack([block(2), block(3)])])
    cb, cr = (np.kron(block(i), np.ones((2, 2))) - 128 for i in (4, 5))
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    assert np.abs(np.clip(want, 0, 255) - d.rgb[:, :16]).max() <= 2


def _bits(pairs):
    text = "".join(f"{v:0{b}b}" for v, b in pairs if b)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_end_of_band_runs_without_restart_markers():
    """A file that another encoder might write: one interval a scan, runs of ended blocks."""
    head = P._header(1, 2).replace(P._segment(0xDD, b"\x00\x01"), b"")
    table = [(4, s) for s in range(1, 9)] + [(8, s) for s in (0x00, 0x10, 0x20, 0x11, 0xF0)]
    code = P.canonical(table)
    dc = P.canonical(P.DC_TABLE)
    body = [(dc[3][0], 4), (5, 3), *[(dc[0][0], 4)] * 11]  # first luma block 5, then no change; chroma 0
    scans = [P._scan_header((0, 1, 2), 0, 0, 0, 0), _bits(body), P._table_segment(0x10, table)]
    luma = [(code[2][0], 4), (3, 2), (code[0x20][0], 8), (3, 2)]  # a 3, then 4 + 3 blocks end, this one included
    luma += [(code[0x11][0], 8), (0, 1), (code[0][0], 8)]  # the last block: a zero, then -1
    scans += [P._scan_header((0,), 1, 63, 0, 0), _bits(luma)]
    d = P.decode([b"\xff\xd8" + head + b"".join(scans) + b"\xff\xd9"])[0]
    order = P.scan_order(1, 2, 0)
    luma_dc = d.coefs[order, 0]
    assert sorted(luma_dc.tolist()) == [5] * 8 and not d.coefs[[4, 5, 10, 11]].any()
    assert d.coefs[order[0], 1] == 3 and d.coefs[order[7], 2] == -1
    assert np.count_nonzero(d.coefs[:, 1:]) == 2


def test_broken_files():
    good = P.encode([b"a" * 576])[0]
    with pytest.raises(ValueError):
        P.decode([b"GIF89a" + good])
    with pytest.raises(ValueError):
        P.decode([good.replace(b"\xff\xc2", b"\xff\xc0", 1)])


def test_query_and_columns(spark):
    texts = [None, "", "short", "é" * 400, "short", "long " * 30000, "x" * 576]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "clash")], "doc_id long, text string, feature string")
    got = media.media_digests(df).collect()
    assert len(got) == len(texts) + 1
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert by[2].media_sha256 == by[4].media_sha256 and by[2].feature == by[4].feature
    m = {r.doc_id: r for r in media.media_columns(df.where("doc_id < 4")).collect()}
    for i in range(4):
        assert hashlib.sha256(m[i].media).hexdigest() == by[i].media_sha256 and len(m[i].rgb) == m[i].height * m[i].width * 3
    stored = media.media_digests(df, tensors=True)
    assert stored.columns[:8] == media.media_digests(df).columns
    for r in stored.collect():
        assert media.feature(np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)) == r.feature
    assert media.media_digests(df.limit(0)).collect() == []


def test_shapes():
    assert P.shape_of(1) == (1, 1) and P.shape_of(256) == (1, 256) and P.shape_of(257) == (2, 256)
    for n in (4095 * 256, 4095 * 256 + 1, 4095 * 4095):
        rows, cols = P.shape_of(n)
        assert rows * cols >= n and rows <= 4095 and cols <= 4095 and len(P._header(rows, cols)) > 0
    with pytest.raises(ValueError):
        P.shape_of(4095 * 4095 + 1)
