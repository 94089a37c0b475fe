"""Media columns: a progressive JPEG codec over many images at once.

The unit that is stored losslessly is the quantised coefficient: a payload byte
b is coefficient b - 128, 64 to a block in zigzag order, six blocks to a 16 x 16
MCU (four luma, two chroma: 4:2:0). Scans select spectral bands and refine them
by successive approximation; every MCU of a scan is a restart interval.

Decoding accumulates the scans into coefficient arrays. Restart intervals of
all images of a batch are *lanes*: one numpy step decodes one symbol of each.
Files without restart markers decode the same way, with one lane a scan. The
coefficients are dequantised, inverse-transformed in exact integer arithmetic,
chroma is upsampled to full resolution, and RGB tensors result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Scans: (components, first and last coefficient, high bit, low bit).
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1),
    ((1,), 1, 5, 0, 1),
    ((2,), 1, 5, 0, 1),
    ((0,), 6, 63, 0, 0),
    ((1,), 6, 63, 0, 0),
    ((2,), 6, 63, 0, 0),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 5, 1, 0),
    ((1,), 1, 5, 1, 0),
    ((2,), 1, 5, 1, 0),
)
BLOCKS = 6  # of an MCU
#: Fixed value: MCUs of 16 pixels that 16 bits of size hold.
MOST = 4095
COLUMNS = 256  # MCUs in a row of an image
STEP = 1 << 14  # lanes whose bits are put together at once


def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block (row-major) of each coefficient in scan order."""
    cells = sorted(((x + y, (x if (x + y) % 2 else y) * -1, x, y) for x in range(8) for y in range(8)), key=lambda c: (c[0], -c[1]))
    return np.array([x * 8 + y for _, _, x, y in cells])


def ac_symbols() -> tuple[list[int], list[int]]:
    """Symbols of the two code lengths, 4 and 8 bits: sizes without a run, then the rest."""
    return list(range(1, 9)), [0x00, 0xF0, *(r << 4 | s for r in range(1, 16) for s in range(1, 9))]


def canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits), from (bits, symbol) in the order of a DHT segment."""
    out, code, last = {}, 0, 0
    for bits, symbol in lengths:
        code <<= bits - last
        out[symbol], last = (code, bits), bits
        code += 1
    return out


DC_TABLE = [(4, s) for s in range(12)]
AC_TABLE = [(4, s) for s in ac_symbols()[0]] + [(8, s) for s in ac_symbols()[1]]


def _code_arrays(table: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, bits = np.zeros(256, np.uint16), np.zeros(256, np.uint8)
    for s, (c, b) in canonical(table).items():
        code[s], bits[s] = c, b
    return code, bits


DC_CODE, DC_BITS = _code_arrays(DC_TABLE)
AC_CODE, AC_BITS = _code_arrays(AC_TABLE)
SIZE = np.array([int(v).bit_length() for v in range(1 << 11)], dtype=np.uint8)


def shape_of(mcus: int) -> tuple[int, int]:
    """Rows and columns of MCUs that hold ``mcus``: wider where the format's ``MOST``
    rows would not do (from about 600 MB); beyond ``MOST`` columns it has no room."""
    cols = min(mcus, max(COLUMNS, -(-mcus // MOST)))
    if cols > MOST:
        raise ValueError("a payload of more than 9 GB does not fit into one picture")
    return -(-mcus // cols), cols


@lru_cache(maxsize=4096)
def scan_order(rows: int, cols: int, part: int) -> np.ndarray:
    """Stored places of a component's blocks in the raster order of its scans."""
    mcu = np.arange(rows * cols, dtype=np.int64).reshape(rows, cols) * BLOCKS
    if part:
        return (mcu + 3 + part).ravel()
    y = np.empty((rows, 2, cols, 2), np.int64)
    for a in (0, 1):
        for b in (0, 1):
            y[:, a, :, b] = mcu + 2 * a + b
    return y.ravel()


# --- encoding -----------------------------------------------------------------


def _dc_first(dc: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Code values and bits of MCUs' DC coefficients, (n, 6) each."""
    v = dc >> low
    diff = v.copy()
    diff[:, 1:4] -= v[:, :3]
    size = SIZE[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size.astype(np.int64)) - 1, diff)
    return (DC_CODE[size].astype(np.int64) << size) | extra, DC_BITS[size] + size


def _ac_first(c: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks' band ``c`` (n, k): one value for each coefficient, and one for the block's end."""
    n, k = c.shape
    v = np.sign(c) * (np.abs(c) >> low)
    some = v != 0
    at = np.arange(k)
    seen = np.maximum.accumulate(np.where(some, at, -1), axis=1)
    before = np.concatenate([np.full((n, 1), -1), seen[:, :-1]], axis=1)
    run = at - before - 1  # zeros just before each coefficient
    size = SIZE[np.abs(v)].astype(np.int64)
    symbol = (run % 16) << 4 | size
    extra = np.where(v < 0, v + (1 << size) - 1, v)
    value = AC_CODE[symbol].astype(np.int64) << size | extra
    bits = AC_BITS[symbol] + size
    later = at < seen[:, -1:]
    sixteen = ~some & later & (run % 16 == 15)
    value = np.where(some, value, AC_CODE[0xF0])
    bits = np.where(some, bits, np.where(sixteen, AC_BITS[0xF0], 0))
    end = np.where(seen[:, -1:] < k - 1, AC_BITS[0], 0)
    return np.concatenate([value, np.full((n, 1), AC_CODE[0], np.int64)], axis=1), np.concatenate([bits, end], axis=1)


def _ac_refine(c: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    n, k = c.shape
    size = np.abs(c) >> low
    value, bits = np.zeros((n, k + 1), np.int64), np.zeros((n, k + 1), np.int64)
    run, held, held_bits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(k):
        old, new = size[:, j] > 1, size[:, j] == 1
        symbol = run << 4 | 1
        made = (AC_CODE[symbol].astype(np.int64) << 1 | (c[:, j] > 0)) << held_bits | held
        value[:, j] = np.where(new, made, 0)
        bits[:, j] = np.where(new, AC_BITS[symbol] + 1 + held_bits, 0)
        held = np.where(new, 0, np.where(old, held << 1 | size[:, j] & 1, held))
        held_bits = np.where(new, 0, held_bits + old)
        run = np.where(new, 0, run + (size[:, j] == 0))
    rest = (run > 0) | (held_bits > 0)
    value[:, k] = np.int64(AC_CODE[0]) << held_bits | held
    bits[:, k] = np.where(rest, AC_BITS[0] + held_bits, 0)
    return value, bits


def _packed(value: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lanes' values (at most 16 bits each), each lane filled up with
    ones to a byte; and the bytes of each lane."""
    parts, sizes = [], []
    for a in range(0, len(value), STEP):
        v, b = value[a : a + STEP], bits[a : a + STEP].astype(np.int64)
        total = b.sum(axis=1)
        fill = -total % 8
        v = np.concatenate([v, ((1 << fill) - 1)[:, None]], axis=1)
        b = np.concatenate([b, fill[:, None]], axis=1)
        left = (v << (16 - b)).astype(">u2")
        every = np.unpackbits(left.view(np.uint8).reshape(-1, 2), axis=1)
        parts.append(np.packbits(every[np.arange(16) < b.reshape(-1, 1)]))
        sizes.append((total + fill) // 8)
    return np.concatenate(parts), np.concatenate(sizes)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _table_segment(kind: int, table: list[tuple[int, int]]) -> bytes:
    return _segment(0xC4, bytes((kind, *(sum(b == n for b, _ in table) for n in range(1, 17)), *(s for _, s in table))))


@lru_cache(maxsize=4096)
def _header(rows: int, cols: int) -> bytes:
    frame = bytes((8,)) + (rows * 16).to_bytes(2, "big") + (cols * 16).to_bytes(2, "big") + bytes((3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    return b"".join([_segment(0xDB, bytes((0, *[1] * 64))), _segment(0xC2, frame), _table_segment(0x00, DC_TABLE), _table_segment(0x10, AC_TABLE), _segment(0xDD, b"\x00\x01")])


def _scan_header(parts: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes((len(parts), *(x for p in parts for x in (p + 1, 0x00)), first, last, high << 4 | low)))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload, whose length is a positive multiple of 64."""
    need = [-(-len(p) // (64 * BLOCKS)) for p in payloads]
    shapes = [shape_of(m) for m in need]
    mcus = np.array([r * c for r, c in shapes])
    base = np.concatenate([[0], np.cumsum(mcus)])
    samples = np.full((base[-1] * BLOCKS, 64), 128, np.uint8)
    flat = samples.reshape(-1)
    for p, b in zip(payloads, base):
        flat[b * BLOCKS * 64 : b * BLOCKS * 64 + len(p)] = np.frombuffer(p, np.uint8)
    coefs = samples.astype(np.int16) - np.int16(128)
    chunks: list[list[bytes]] = [[b"\xff\xd8", _segment(0xFE, len(p).to_bytes(8, "big")), _header(*s)] for p, s in zip(payloads, shapes)]
    order = [np.concatenate([scan_order(r, c, k) + b * BLOCKS for (r, c), b in zip(shapes, base)]) for k in range(3)]
    for parts, first, last, high, low in SCANS:
        per = mcus * (4 if parts == (0,) else 1)
        if first == 0:
            dc = coefs[:, 0].astype(np.int64).reshape(-1, BLOCKS)
            value, bits = _dc_first(dc, low) if not high else (dc >> low & 1, np.ones(dc.shape, np.int64))
            packed, sizes = _packed(value, bits)
        else:
            lanes = order[parts[0]]
            work = _ac_refine if high else _ac_first
            made = [_packed(*work(coefs[lanes[a : a + STEP], first : last + 1].astype(np.int64), low)) for a in range(0, len(lanes), STEP)]
            packed, sizes = (np.concatenate(x) for x in zip(*made))
        _cut(chunks, packed, sizes, per, _scan_header(parts, first, last, high, low))
    return [b"".join([*c, b"\xff\xd9"]) for c in chunks]


def _cut(chunks: list[list[bytes]], data: np.ndarray, sizes: np.ndarray, per: np.ndarray, head: bytes) -> None:
    """Stuffs the lanes' bytes, puts restart markers between an image's lanes and
    appends each image's scan to its chunks."""
    full = data == 0xFF
    ends = np.cumsum(sizes)
    image_ends = np.cumsum(per)
    nth = np.arange(len(sizes)) - np.repeat(image_ends - per, per)  # lane within its image
    marked = np.ones(len(sizes), bool)
    marked[image_ends - 1] = False
    stuffed = np.cumsum(full) + np.arange(len(data))  # last place of each byte, without markers
    lane = np.repeat(np.arange(len(sizes)), sizes)
    gaps = np.concatenate([[0], np.cumsum(2 * marked)[:-1]])
    at = stuffed - full + gaps[lane]
    total = len(data) + int(full.sum()) + 2 * int(marked.sum())
    out = np.zeros(total, np.uint8)
    out[at] = data
    last = stuffed[ends - 1] + gaps  # the last place of each lane
    where = last[marked] + 1
    out[where] = 0xFF
    out[where + 1] = 0xD0 + nth[marked] % 8
    raw = out.tobytes()
    a = 0
    for c, b in zip(chunks, (last[image_ends - 1] + 1).tolist()):
        c += [head, raw[a:b]]
        a = b


# --- decoding -----------------------------------------------------------------


@dataclass
class Scan:
    parts: tuple[tuple[int, int, int], ...]  # component, DC table, AC table
    first: int
    last: int
    high: int
    low: int
    interval: int
    start: int
    end: int
    tables: dict = field(default_factory=dict)


@dataclass
class Image:
    height: int = 0
    width: int = 0
    sampling: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, table
    quants: dict[int, bytes] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[Scan] = field(default_factory=list)


def parse(data: bytes, marks: list[int]) -> Image:
    """Reads the segments of one file; ``marks``: places of 0xFF that are
    followed by neither 00 nor a restart marker."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    im, at, interval, tables, i = Image(), 2, 0, {}, 0
    while True:
        kind = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        if kind == 0xD9:
            return im
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xFE:
            im.comment = body
        elif kind == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisation")
                im.quants[body[0] & 15], body = body[1:65], body[65:]
        elif kind == 0xC2:
            im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            im.sampling = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif kind == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                tables = tables | {body[0]: body[1:size]}
                body = body[size:]
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xDA:
            ids = [s[0] for s in im.sampling]
            parts = tuple((ids.index(body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0]))
            first, last, bits = body[-3:]
            while marks[i] < at:
                i += 1
            im.scans.append(Scan(parts, first, last, bits >> 4, bits & 15, interval, at, marks[i], tables))
            at = marks[i]
        elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF:
            raise ValueError("not a progressive Huffman file")


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each 16 bits that may come next."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    lengths = [n + 1 for n in range(16) for _ in range(table[n])]
    for s, (code, bits) in canonical(list(zip(lengths, table[16:]))).items():
        a = code << (16 - bits)
        symbol[a : a + (1 << (16 - bits))], length[a : a + (1 << (16 - bits))] = s, bits
    return symbol, length


class Bits:
    """Bit positions of many lanes over one array of bytes without stuffing."""

    def __init__(self, clean: np.ndarray):
        buf = np.concatenate([clean, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(clean) + 8,), dtype=">u8", buffer=buf.data, strides=(1,))

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The 48 or more bits from each position, left-aligned."""
        return self.words[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)


def _top(word: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` bits of each word after ``skip``."""
    return ((word << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < (np.int64(1) << size >> 1), v - (np.int64(1) << size) + 1, v)


def _dc_lanes(bits: Bits, pos: np.ndarray, places: np.ndarray, parts: np.ndarray, n: np.ndarray, luts: list, scan: Scan, coefs: np.ndarray) -> None:
    """``places``: stored blocks in scan order; lane i has n[i] from start[i] on."""
    start = np.cumsum(n) - n
    lane = np.argsort(-n, kind="stable")
    pred = np.zeros((len(n), len(luts)), np.int64)
    for j in range(int(n.max(initial=0))):
        lane = lane[: np.searchsorted(-n[lane], -j, side="left")]
        at = start[lane] + j
        word = bits.peek(pos[lane])
        if scan.high:
            coefs[places[at], 0] |= (word >> np.uint64(63)).astype(np.int16) << scan.low
            pos[lane] += 1
            continue
        part = parts[at]
        head = (word >> np.uint64(48)).astype(np.int64)
        size, length = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for k, (symbols, lengths) in enumerate(luts):
            m = part == k
            size[m], length[m] = symbols[head[m]], lengths[head[m]]
        value = pred[lane, part] + _extend(_top(word, length, size), size)
        pred[lane, part] = value
        coefs[places[at], 0] = value << scan.low
        pos[lane] += length + size


def _ac_lanes(bits: Bits, pos: np.ndarray, places: np.ndarray, n: np.ndarray, lut: tuple, scan: Scan, coefs: np.ndarray) -> None:
    symbols, lengths = lut
    first, last, low = scan.first, scan.last, scan.low
    at, end = np.cumsum(n) - n, np.cumsum(n)
    k = np.full(len(n), first, np.int64)
    flat = coefs.reshape(-1)
    while len(at):
        word = bits.peek(pos)
        head = (word >> np.uint64(48)).astype(np.int64)
        symbol, length = symbols[head], lengths[head]
        run, size = symbol >> 4, symbol & 15
        put = size > 0
        ends = ~put & (run < 15)
        if ends.any() or not put.all():
            extra = np.where(put, size, np.where(ends, run, 0))
            value = _top(word, length, extra)
            k += np.where(ends, 0, run)
            if (put & (k > last)).any():
                raise ValueError("a run leaves its band")
            flat[places[at[put]] * 64 + k[put]] = _extend(value[put], size[put]) << low
            k += 1
            over = ends | (k > last)
            at += np.where(ends, (np.int64(1) << run) + value, np.where(over, 1, 0))
        else:
            value = _top(word, length, size)
            k += run
            if (k > last).any():
                raise ValueError("a run leaves its band")
            flat[places[at] * 64 + k] = _extend(value, size) << low
            k += 1
            extra, over = size, k > last
            at += over
        pos = pos + length + extra
        if over.any():
            k[over] = first
            going = at < end
            if not going.all():
                pos, at, end, k = pos[going], at[going], end[going], k[going]


def _ac_refine_lanes(bits: Bits, pos: np.ndarray, places: np.ndarray, n: np.ndarray, lut: tuple, scan: Scan, coefs: np.ndarray) -> None:
    symbols, lengths = lut
    first, last, low = scan.first, scan.last, scan.low
    at, end = np.cumsum(n) - n, np.cumsum(n)
    k = np.full(len(n), first, np.int64)
    zeros, new = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    skip = np.zeros(len(n), np.int64)  # blocks, this one included, that only get corrections
    asks = np.ones(len(n), bool)
    flat = coefs.reshape(-1)
    while len(at):
        word = bits.peek(pos)
        if asks.any():
            head = (word >> np.uint64(48)).astype(np.int64)
            run, size, length = symbols[head] >> 4, symbols[head] & 15, lengths[head]
            ends = asks & (size == 0) & (run < 15)
            extra = np.where(ends, run, (size > 0).astype(np.int64))
            value = _top(word, length, extra)
            skip = np.where(ends, (np.int64(1) << run) + value, skip)
            new = np.where(asks, np.where(size > 0, np.where(value > 0, 1, -1), 0), new)
            zeros = np.where(asks, run, zeros)
            used = np.where(asks, length + extra, 0)
            pos = pos + used
            word = bits.peek(pos)
        place = places[at] * 64 + k
        c = flat[place].astype(np.int64)
        old = c != 0
        bit = (word >> np.uint64(63)).astype(np.int64)
        pos = pos + old
        put = ~old & (skip == 0) & (zeros == 0)
        flat[place] = np.where(old, c + (bit * np.sign(c) << low), np.where(put, new << low, c))
        zeros = zeros - (~old & (skip == 0) & (zeros > 0))
        asks = put
        k = k + 1
        over = k > last
        if over.any():
            at = at + over
            k = np.where(over, first, k)
            skip = np.where(over, np.maximum(skip - 1, 0), skip)
            asks = np.where(over, skip == 0, asks)
            going = at < end
            if not going.all():
                pos, at, end, k, zeros, new, skip, asks = (x[going] for x in (pos, at, end, k, zeros, new, skip, asks))


@dataclass
class Decoded:
    comment: bytes
    coefs: np.ndarray  # blocks of 64, in MCU order, zigzag
    rgb: np.ndarray  # height x width x 3


def decode(files: list[bytes], with_rgb: bool = True) -> list[Decoded]:
    """Decodes progressive 4:2:0 files of full MCUs, all scans of a kind at once."""
    data = np.frombuffer(b"".join(files), np.uint8)
    offset = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    full = np.flatnonzero(data[:-1] == 0xFF)
    follow = data[full + 1]
    restart = full[(follow >= 0xD0) & (follow <= 0xD7)]
    marks = full[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7)) & (follow != 0xFF)]
    stuffing = full[follow == 0] + 1
    clean = np.delete(data, stuffing)
    cuts = np.searchsorted(marks, offset)
    images = [parse(f, (marks[a:b] - o).tolist()) for f, o, a, b in zip(files, offset.tolist(), cuts, cuts[1:])]
    shapes = []
    for im in images:
        if [s[1:3] for s in im.sampling] != [(2, 2), (1, 1), (1, 1)] or im.height % 16 or im.width % 16:
            raise ValueError("only whole 4:2:0 MCUs of three components are handled")
        shapes.append((im.height // 16, im.width // 16))
    mcus = np.array([r * c for r, c in shapes], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(mcus)]) * BLOCKS
    coefs = np.zeros((base[-1], 64), np.int16)
    bits = Bits(clean)
    for nth in range(max(len(im.scans) for im in images)):
        kinds: dict[tuple, list[int]] = {}
        for i, im in enumerate(images):
            if nth < len(im.scans):
                s = im.scans[nth]
                own = tuple(s.tables.get(t if s.first == 0 else 0x10 | u, b"") for _, t, u in s.parts)
                kinds.setdefault((s.parts, s.first, s.last, s.high, s.low, own), []).append(i)
        for (parts, first, _, high, _, own), which in kinds.items():
            scan = images[which[0]].scans[nth]
            starts, counts, places, comps = [], [], [], []
            for i in which:
                s, (r, c) = images[i].scans[nth], shapes[i]
                a, b = offset[i] + s.start, offset[i] + s.end
                inner = restart[np.searchsorted(restart, a) : np.searchsorted(restart, b)]
                starts.append(np.concatenate([[a], inner + 2]))
                if len(parts) > 1:
                    order = np.arange(r * c * BLOCKS)
                    unit, units = BLOCKS, r * c
                    comps.append(np.tile([0, 0, 0, 0, 1, 2], r * c))
                else:
                    order = scan_order(r, c, parts[0][0])
                    unit, units = 1, len(order)
                    comps.append(np.zeros(len(order), np.int64))
                every = s.interval or units
                if len(starts[-1]) != -(-units // every):
                    raise ValueError("restart markers are missing")
                n = np.full(len(starts[-1]), every * unit)
                n[-1] = units * unit - n[:-1].sum()
                counts.append(n)
                places.append(order + base[i])
            begin = np.concatenate(starts)
            pos = (begin - np.searchsorted(stuffing, begin)) * 8
            n, where = np.concatenate(counts), np.concatenate(places)
            if first == 0:
                luts = [_lookup(t) if t else None for t in own]
                _dc_lanes(bits, pos, where, np.concatenate(comps), n, luts, scan, coefs)
            else:
                (_ac_refine_lanes if high else _ac_lanes)(bits, pos, where, n, _lookup(own[0]), scan, coefs)
    pixels = _rgb(coefs, images, base) if with_rgb else None
    out = []
    for i, im in enumerate(images):
        r, c = shapes[i]
        rgb = np.empty((0, 0, 3), np.uint8) if pixels is None else pixels[base[i] // BLOCKS : base[i + 1] // BLOCKS].reshape(r, c, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * r, 16 * c, 3)
        out.append(Decoded(im.comment, coefs[base[i] : base[i + 1]], rgb))
    return out


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """The inverse transform's matrix times 4096, in whole numbers."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * u * np.pi / 16) / 2
    a[0] /= np.sqrt(2)
    return np.rint(a * 4096)


def _samples(coefs: np.ndarray, images: list[Image], base: np.ndarray) -> np.ndarray:
    """8 x 8 samples of every block. Products are whole numbers below 2**53, so
    sums in any order are exact."""
    dense = np.zeros((len(coefs), 64))
    dense[:, zigzag()] = coefs
    for quants in {tuple(im.quants.get(s[3], b"") for s in im.sampling) for im in images}:
        if any(q != b"\x01" * 64 for q in quants):
            for i, im in enumerate(images):
                for k, s in enumerate(im.sampling):
                    q = np.empty(64)
                    q[zigzag()] = np.frombuffer(im.quants[s[3]], np.uint8)
                    own = dense[base[i] : base[i + 1]].reshape(-1, BLOCKS, 64)
                    own[:, :4] *= q if k == 0 else 1
                    own[:, 3 + k] *= q if k else 1
            break
    a = _basis()
    rows = (dense.reshape(-1, 8) @ a).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ a
    v = np.floor((rows + 2.0**23) / 2.0**24) + 128
    return np.clip(v, 0, 255).astype(np.int32).reshape(-1, 8, 8).transpose(0, 2, 1)


def _rgb(coefs: np.ndarray, images: list[Image], base: np.ndarray) -> np.ndarray:
    """(MCUs, 16, 16, 3): chroma repeated to full resolution, then colours in 16-bit fixed point."""
    out = np.empty((len(coefs) // BLOCKS, 16, 16, 3), np.uint8)
    s = _samples(coefs, images, base).reshape(-1, BLOCKS, 8, 8)
    y = np.empty((len(s), 16, 16), np.int32)
    y[:, :8, :8], y[:, :8, 8:], y[:, 8:, :8], y[:, 8:, 8:] = s[:, 0], s[:, 1], s[:, 2], s[:, 3]
    cb, cr = s[:, 4] - 128, s[:, 5] - 128
    wide = lambda v: v.repeat(2, axis=1).repeat(2, axis=2)
    half = 1 << 15
    out[..., 0] = np.clip(y + wide((91881 * cr + half) >> 16), 0, 255)
    out[..., 1] = np.clip(y - wide((22554 * cb + 46802 * cr + half) >> 16), 0, 255)
    out[..., 2] = np.clip(y + wide((116130 * cb + half) >> 16), 0, 255)
    return out
