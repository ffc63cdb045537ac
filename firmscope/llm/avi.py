"""AVI motion-JPEG: RIFF indexes, baseline JPEG frames, and shots by adaptive histogram differences.

The decoder reads baseline (sequential, 8-bit, Huffman) JPEG of any number of components, in one
interleaved scan or with the first component in a scan of its own, and keeps the first component (the
luminance): all its samples by inverse DCT, or (what the byte store needs) the mean of each 8 x 8 block.
Entropy-coded segments between restart markers don't depend on each other, so the segments of many
frames are decoded side by side, one symbol of each at a time, in numpy.

The writer stores bytes losslessly: each byte is one flat 8 x 8 block whose mean is that
value (with a quantiser of 8, the DC coefficient is the value less 128, exactly).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column

#: Blocks a row and rows a frame of written files, and their frame rate.
WIDE, HIGH, RATE = 64, 8, 25


# ---------------------------------------------------------------- JPEG


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A DHT table (16 counts, then symbols) to the length and symbol of every 16-bit window; length 0: no code."""
    lengths, symbols = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            lengths[lo:hi], symbols[lo:hi] = n, table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, symbols


@dataclass
class Frame:
    """One image: the size of its first component, what a unit of its scan holds, and the scan's segments.

    A unit (MCU) is `across` x `down` blocks of the first component and the other components' blocks;
    `pattern` names each block's component and tables in order.
    """

    width: int
    height: int
    units: tuple[int, int]
    across: int
    down: int
    per_segment: int
    pattern: tuple[tuple[int, bytes, bytes], ...]
    quant: tuple[int, ...]
    segments: list[bytes]

    @property
    def blocks(self) -> tuple[int, int]:
        """Rows and columns of the blocks that hold samples of the picture."""
        return -(-self.height // 8), -(-self.width // 8)


# Huffman tables K.3 to K.6 of the JPEG standard (counts of each length, then symbols), which
# motion-JPEG frames may leave out. The symbols that aren't listed follow in ascending order.
_STANDARD_DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(12))
_STANDARD_DC_COLOUR = bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]) + bytes(range(12))
_AC_COUNTS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
_AC_FIRST = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a")
_AC_COLOUR_COUNTS = bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119])
_AC_COLOUR_FIRST = bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")


def _ac_table(counts: bytes, first: bytes) -> bytes:
    every = {0x00, 0xF0} | {16 * run + size for run in range(16) for size in range(1, 11)}
    return counts + first + bytes(sorted(every - set(first)))


_STANDARD = {(0, 0): _STANDARD_DC, (0, 1): _STANDARD_DC_COLOUR, (1, 0): _ac_table(_AC_COUNTS, _AC_FIRST), (1, 1): _ac_table(_AC_COLOUR_COUNTS, _AC_COLOUR_FIRST)}


def parse_frame(data: bytes) -> Frame:
    """Markers of a baseline JPEG, up to its first scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quant = 2, dict(_STANDARD), {}
    width = height = interval = 0
    parts: list[tuple[int, int, int, int]] = []
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        if data[at + 1] == 0xFF:  # a fill byte
            at += 1
            continue
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, k + 1)
                k += 1 + 64 * (2 if wide else 1)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = 17 + sum(body[k + 1 : k + 17])
                tables[body[k] >> 4, body[k] & 15] = body[k + 1 : k + n]
                k += n
        elif kind == 0xC0:
            height, width, n = struct.unpack_from(">HHB", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            scan = {body[1 + 2 * i]: (tables[0, body[2 + 2 * i] >> 4], tables[1, body[2 + 2 * i] & 15]) for i in range(body[0])}
            at += 2 + size
            break
        at += 2 + size
    if not parts or not width or not height or parts[0][0] not in scan:
        raise ValueError("no picture, or its first scan is without the first component")
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    _, across, down, table = parts[0]
    width, height = -(-width * across // most_h), -(-height * down // most_v)
    if len(scan) == 1:  # blocks of one component follow each other row by row
        across = down = 1
        pattern = ((0, *scan[parts[0][0]]),)
    else:
        pattern = tuple((i, *scan[p[0]]) for i, p in enumerate(parts) if p[0] in scan for _ in range(p[1] * p[2]))
    units = -(-height // (8 * down)), -(-width // (8 * across))
    return Frame(width, height, units, across, down, interval or units[0] * units[1], pattern, quant[table], _segments(data, at))


def _segments(data: bytes, at: int) -> list[bytes]:
    """The scan's entropy-coded segments, without stuffed zeros, up to the end marker."""
    raw = np.frombuffer(data, np.uint8, len(data) - at, at)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0))
    out, start = [], 0
    for m in marks.tolist():
        restart = 0xD0 <= raw[m + 1] <= 0xD7
        out.append(raw[start:m].tobytes().replace(b"\xff\x00", b"\xff"))
        start = m + 2
        if not restart:
            return out
    raise ValueError("the scan has no end")


#: Coefficients of the first component that are held at once.
AT_ONCE = 1 << 25


def decode(frames: list[Frame], whole: bool = False) -> list[np.ndarray]:
    """Of each frame the first component, row by row: its blocks' means, or (whole) its samples; 0 to 255."""
    depth = 64 if whole else 1
    planes = [np.zeros((f.units[0] * f.units[1], f.down * f.across, depth), np.int16) for f in frames]
    groups: dict[tuple, list[tuple[int, int, int, bytes]]] = {}
    for i, f in enumerate(frames):
        n = f.units[0] * f.units[1]
        if len(f.segments) != -(-n // f.per_segment):
            raise ValueError("segments are missing")
        for k, s in enumerate(f.segments):
            groups.setdefault((f.pattern, f.across * f.down), []).append((i, k * f.per_segment, min(f.per_segment, n - k * f.per_segment), s))
    for (pattern, own), some in groups.items():
        most = max(n for _, _, n, _ in some) * own * depth
        step = max(1, min(1 << 14, AT_ONCE // most))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            levels = _decode_segments([s for *_, s in part], [n for _, _, n, _ in part], pattern, whole)
            for (i, first, n, _), row in zip(part, levels, strict=True):
                planes[i][first : first + n] = row[: n * own].reshape(n, own, depth)
    return [_picture(f, p, whole) for f, p in zip(frames, planes, strict=True)]


def _picture(f: Frame, plane: np.ndarray, whole: bool) -> np.ndarray:
    """Coefficients in scan order to samples row by row, without what lies beyond the picture's edges."""
    rows, columns = f.units
    levels = plane.reshape(rows, columns, f.down, f.across, -1).transpose(0, 2, 1, 3, 4).reshape(rows * f.down, columns * f.across, -1)
    levels = levels[: f.blocks[0], : f.blocks[1]].astype(np.int32)
    if not whole:
        return np.clip(np.floor_divide(levels[..., 0] * f.quant[0] + 4, 8) + 128, 0, 255).astype(np.uint8)
    order, cosines = _transform()
    values = np.zeros(levels.shape, np.float32)
    values[..., order] = levels * np.array(f.quant, np.int32)
    samples = cosines.T @ values.reshape(*f.blocks, 8, 8) @ cosines
    samples = np.clip(np.rint(samples) + 128, 0, 255).astype(np.uint8)
    return samples.transpose(0, 2, 1, 3).reshape(f.blocks[0] * 8, f.blocks[1] * 8)[: f.height, : f.width]


@lru_cache(maxsize=1)
def _transform() -> tuple[np.ndarray, np.ndarray]:
    """Where the coefficients stand in a block, by the order they are stored in (diagonals, to and fro), and the DCT's matrix."""
    zigzag = sorted(((x, y) for x in range(8) for y in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    k = np.arange(8)
    cosines = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    cosines[0] /= np.sqrt(2)
    return np.array([8 * x + y for x, y in zigzag]), cosines.astype(np.float32)


def decode_means(frames: list[Frame]) -> list[np.ndarray]:
    """Of each frame the means of its blocks, 0 to 255, row by row."""
    return [p.ravel() for p in decode(frames)]


def _decode_segments(segments: list[bytes], units: list[int], pattern: tuple[tuple[int, bytes, bytes], ...], whole: bool) -> np.ndarray:
    """Coefficients (before scaling) of the first component of segments side by side.

    Row i holds segment i's blocks, each with its DC coefficient or (whole) all 64 in stored order.
    """
    tables = [(part, *_lookup(dc), *_lookup(ac)) for part, dc, ac in pattern]
    own = sum(part == 0 for part, *_ in pattern)
    pad = [s + b"\xff\xff\xff\xff\xff\xff\xff\xff" for s in segments]
    flat = np.frombuffer(b"".join(pad), np.uint8)
    # 32 bits from every byte on, so one gather gives a code and its extra bits
    words = flat[:-3].astype(np.uint32) << 24
    words |= flat[1:-2].astype(np.uint32) << 16
    words |= flat[2:-1].astype(np.uint32) << 8
    words |= flat[3:]
    sizes = np.array([len(p) for p in pad], np.int64)
    pos = (np.cumsum(sizes) - sizes) * 8
    left = np.array(units, np.int64)
    values = np.zeros((len(segments), int(left.max(initial=0)) * own, 64 if whole else 1), np.int16)
    order = np.argsort(-left, kind="stable")
    pos, left = pos[order], left[order]
    level = np.zeros((1 + max(part for part, *_ in pattern), len(order)), np.int32)

    def window(bits: np.ndarray) -> np.ndarray:
        return words[bits >> 3] << (bits & 7).astype(np.uint32)

    def extra(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The signed number in the next `size` bits."""
        shift = np.minimum(32 - size.astype(np.int64), 31).astype(np.uint32)
        value = np.where(size == 0, 0, bits >> shift).astype(np.int64)
        negative = (size > 0) & (bits < np.uint32(1 << 31))
        return np.where(negative, value - (1 << size.astype(np.int64)) + 1, value).astype(np.int32)

    block = 0
    for u in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -u, side="left"))  # segments that have a unit u: left > u
        for part, dc_len, dc_sym, ac_len, ac_sym in tables:
            p = pos[:n]
            at = window(p) >> 16
            size, length = dc_sym[at], dc_len[at]
            if not length.all():
                raise ValueError("bad code")
            p = p + length
            level[part, :n] += extra(window(p), size)
            p = p + size
            if part == 0:
                values[order[:n], block, 0] = level[0, :n]
            k = np.ones(n, np.int64)
            live = np.arange(n)
            while len(live):
                q = p[live]
                at = window(q) >> 16
                sym, length = ac_sym[at], ac_len[at]
                if not length.all():
                    raise ValueError("bad code")
                run, size = sym >> 4, sym & 15
                if whole and part == 0:
                    some = np.flatnonzero(size)
                    place = k[live[some]] + run[some]
                    if (place > 63).any():
                        raise ValueError("too many coefficients")
                    values[order[live[some]], block, place] = extra(window(q[some] + length[some]), size[some])
                p[live] = q + length + size
                ended = sym == 0
                k[live] += np.where(ended, 64, run.astype(np.int64) + 1)
                live = live[k[live] < 64]
            pos[:n] = p
            block += part == 0
    return values


#: Codes of the writer: DC sizes 0 to 9 in the standard's luminance table, and an end-of-block of one bit.
_EOB_ONLY = bytes([1] + [0] * 15 + [0])


@lru_cache(maxsize=1)
def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = np.zeros(12, np.uint64), np.zeros(12, np.int64)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(_STANDARD_DC[n - 1]):
            codes[_STANDARD_DC[at]], lengths[_STANDARD_DC[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths


def _head(high: int) -> bytes:
    def part(kind: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body

    return (
        b"\xff\xd8" + part(0xDB, b"\0" + b"\x08" * 64) + part(0xC0, struct.pack(">BHHB", 8, high * 8, WIDE * 8, 1) + b"\x01\x11\x00")
        + part(0xC4, b"\x00" + _STANDARD_DC) + part(0xC4, b"\x10" + _EOB_ONLY) + part(0xDD, struct.pack(">H", WIDE)) + part(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode_rows(samples: np.ndarray) -> list[bytes]:
    """Rows of WIDE samples to restart segments (bit-packed and stuffed), one a row."""
    level = samples.astype(np.int32) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = np.zeros(diff.shape, np.int64)
    for n in range(9):
        size += np.abs(diff) >= (1 << n)
    codes, lengths = _dc_codes()
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    # DC code, extra bits, and the end-of-block bit 0: at most 7 + 9 + 1 bits
    value = ((codes[size] << size.astype(np.uint64)) | extra) << np.uint64(1)
    bits = lengths[size] + size + 1
    ends = np.cumsum(bits, axis=1)
    row_bytes = -(-ends[:, -1] // 8)
    base = (np.cumsum(row_bytes) - row_bytes) * 8
    start = (ends - bits + base[:, None]).ravel()
    shifted = value.ravel() << (np.uint64(32) - bits.ravel().astype(np.uint64) - (start & 7).astype(np.uint64))
    at, size_of = start >> 3, int(row_bytes.sum()) + 8
    out = np.zeros(size_of, np.float64)
    for k in range(4):  # codes side by side share no bit, so sums are ors
        out += np.bincount(at + k, weights=((shifted >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=size_of)
    packed = out.astype(np.uint8)
    packed[base // 8 + row_bytes - 1] |= ((1 << (row_bytes * 8 - ends[:, -1])) - 1).astype(np.uint8)  # padded with ones
    raw, edges = packed.tobytes(), (base // 8).tolist()
    return [raw[a : a + n].replace(b"\xff", b"\xff\x00") for a, n in zip(edges, row_bytes.tolist(), strict=True)]


def encode_frame(segments: list[bytes]) -> bytes:
    """One frame from its rows' segments, with restart markers between them."""
    out = [_head(len(segments))]
    for i, s in enumerate(segments):
        out.append(s)
        out.append(b"\xff\xd9" if i == len(segments) - 1 else bytes((0xFF, 0xD0 + i % 8)))
    return b"".join(out)


# ---------------------------------------------------------------- RIFF


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], payload: int, width: int, height: int, rate: int = RATE) -> bytes:
    """An AVI file of JPEG frames with an idx1 index; the payload's length is kept as a comment."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    info = b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % payload)
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Movie:
    """Where the frames of the first video stream lie, and its timing. A frame of no bytes repeats the one before it."""

    frame_s: float
    width: int
    height: int
    frames: list[tuple[int, int]]
    comment: str


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and size of the chunks between two places."""
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield kind, at + 8, size
        at += 8 + size + size % 2


def _is_video(kind: bytes) -> bool:
    return kind[2:] in (b"dc", b"db") and kind[:2].isalnum()


def _walked(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and size of the frames in a movi list, and in record lists inside it."""
    for kind, start, size in _chunks(data, at, end):
        if kind == b"LIST" and data[start : start + 4] == b"rec ":
            yield from _walked(data, start + 4, min(end, start + size))
        elif _is_video(kind):
            yield kind, start, size


def _indexed(data: bytes, index: bytes, movi: int) -> list[tuple[bytes, int, int]]:
    """Frames by an idx1 index; its offsets count from the movi list or from the start of the file: the first entry tells."""
    entries = [(index[i : i + 4], *struct.unpack_from("<II", index, i + 8)) for i in range(0, len(index) - 15, 16)]
    video = [e for e in entries if _is_video(e[0])]
    base = movi if video and data[movi + video[0][1] :][:4] == video[0][0] else 0
    return [(kind, base + o + 8, n) for kind, o, n in video]


def _super_indexed(data: bytes, index: bytes) -> list[tuple[bytes, int, int]]:
    """Frames by an index of indexes, as files beyond one RIFF chunk have it."""
    out = []
    for i in range(struct.unpack_from("<I", index, 4)[0]):
        at = struct.unpack_from("<Q", index, 24 + 16 * i)[0] + 8
        longs, _, n, kind, base = struct.unpack_from("<HHI4sQ", data, at)
        out += [(kind, base + o, size & 0x7FFFFFFF) for o, size in (struct.unpack_from("<II", data, at + 24 + 4 * longs * j) for j in range(n))]
    return [e for e in out if _is_video(e[0])]


def parse_avi(data: bytes) -> Movie:
    """Chunks, headers and indexes of an AVI file, of all its RIFF chunks.

    Frames are found by the index of indexes if there is one; else by the idx1 index, and without it, and
    in further RIFF chunks, by walking the movi lists.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie = Movie(1 / RATE, 0, 0, [], "")
    found: list[tuple[bytes, int, int]] = []
    above: list[tuple[bytes, int, int]] = []
    for riff, start, size in _chunks(data, 0, len(data)):
        if riff != b"RIFF" or data[start : start + 4] not in (b"AVI ", b"AVIX"):
            continue
        movi, index = (0, 0), b""
        todo = [(start + 4, min(len(data), start + size))]
        while todo:
            for kind, at, n in _chunks(data, *todo.pop()):
                if kind == b"LIST" and data[at : at + 4] == b"movi":
                    movi = (at, min(len(data), at + n))
                elif kind == b"LIST":
                    todo.append((at + 4, at + n))
                elif kind == b"avih":
                    movie.frame_s = struct.unpack_from("<I", data, at)[0] / 1e6
                    movie.width, movie.height = struct.unpack_from("<II", data, at + 32)
                elif kind == b"ICMT":
                    movie.comment = data[at : at + n].rstrip(b"\0").decode(errors="replace")
                elif kind == b"idx1":
                    index = data[at : at + n]
                elif kind == b"indx" and not above and data[at + 3] == 0:
                    above = _super_indexed(data, data[at : at + n])
        found += _indexed(data, index, movi[0]) if index else list(_walked(data, movi[0] + 4, movi[1]))
    found = above or found
    movie.frames = [(at, n) for kind, at, n in found if kind == found[0][0]]
    return movie


# ---------------------------------------------------------------- bytes as movies


def padded(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return payload + b"\0" * (64 * max(1, -(-len(payload) // 64)) - len(payload))


def store_bytes(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as a movie; all are packed in one go."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDE)
    segments, out, at = encode_rows(rows), [], 0
    for p in payloads:
        own = segments[at : at + len(p) // WIDE]
        at += len(own)
        while len(own) % HIGH:  # the last frame is filled up from the frame before it, so the fill makes no cut
            own.append(own[-HIGH] if len(own) > HIGH else own[-1])
        out.append(write_avi([encode_frame(own[i : i + HIGH]) for i in range(0, len(own), HIGH)], len(p), WIDE * 8, HIGH * 8))
    return out


def read_movies(files: list[bytes]) -> list[tuple[Movie, np.ndarray]]:
    """Each file's headers and its frames' block means, one row a frame; frames of all files are decoded together."""
    movies = [parse_avi(f) for f in files]
    frames = [[parse_frame(f[o : o + n]) for o, n in m.frames] for f, m in zip(files, movies, strict=True)]
    means, at = decode_means([x for some in frames for x in some]), 0
    out = []
    for m, some in zip(movies, frames, strict=True):
        own = means[at : at + len(some)]
        at += len(some)
        out.append((m, np.stack(own) if own else np.zeros((0, 0), np.uint8)))
    return out


# ---------------------------------------------------------------- shots


@dataclass(frozen=True)
class Clip:
    first: int
    frames: int
    start_s: float
    end_s: float
    level: float
    jump: float


BINS = 32


def histograms(frames: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Of each frame (a row of samples) the shares of its samples by bin, and their mean."""
    n = len(frames)
    if not n:
        return np.zeros((0, bins)), np.zeros(0)
    at = (frames.astype(np.int64) * bins >> 8) + bins * np.arange(n)[:, None]
    return np.bincount(at.ravel(), minlength=n * bins).reshape(n, bins) / frames.shape[1], frames.mean(axis=1)


def movie_histograms(file: bytes) -> tuple[Movie, np.ndarray, np.ndarray]:
    """A file's headers, and the histograms and means of all samples of its frames.

    Frames are decoded in portions of AT_ONCE samples, so memory follows the file, not its pictures.
    """
    movie = parse_avi(file)
    shares, level, held, size = [], [], [], 0

    def flush() -> None:
        for picture in decode(held, whole=True):
            own = histograms(picture.reshape(1, -1))
            shares.append(own[0][0])
            level.append(own[1][0])
        held.clear()

    for at, n in movie.frames:
        if not n:  # dropped: the picture before it stays
            flush()
            size = 0
            if shares:
                shares.append(shares[-1])
                level.append(level[-1])
            continue
        frame = parse_frame(file[at : at + n])
        size += frame.width * frame.height
        if held and size > AT_ONCE:
            flush()
            size = frame.width * frame.height
        held.append(frame)
    flush()
    return movie, np.array(shares).reshape(-1, BINS), np.array(level)


def shots(means: np.ndarray, frame_s: float) -> list[Clip]:
    """Clips of frames given as rows of samples."""
    return clips_of(*histograms(means), frame_s)


def clips_of(shares: np.ndarray, level: np.ndarray, frame_s: float, around: int = 8, factor: float = 3.0, least: float = 0.08) -> list[Clip]:
    """Runs of frames between cuts.

    A cut is where the difference of neighbouring frames' histograms (half the sum of absolute
    differences of shares) is above `least` and above the mean plus `factor` deviations of the
    up to `around` differences on either side of it.
    """
    n = len(shares)
    if not n:
        return []
    diff = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    m = len(diff)
    one = np.concatenate(([0.0], np.cumsum(diff)))
    two = np.concatenate(([0.0], np.cumsum(diff * diff)))
    lo, hi = np.maximum(0, np.arange(m) - around), np.minimum(m, np.arange(m) + around + 1)
    others = np.maximum(1, hi - lo - 1)
    mean = (one[hi] - one[lo] - diff) / others
    spread = np.sqrt(np.maximum(0, (two[hi] - two[lo] - diff * diff) / others - mean * mean))
    cuts = [0, *(np.flatnonzero((diff > least) & (diff > mean + factor * spread)) + 1).tolist(), n]
    return [Clip(a, b - a, a * frame_s, b * frame_s, float(level[a:b].mean()), float(diff[a - 1]) if a else 0.0) for a, b in zip(cuts, cuts[1:], strict=False)]


# ---------------------------------------------------------------- as DataFrames

CLIPS = "key long, clip int, first_frame int, n_frames int, start_s double, end_s double, level double, jump double, error string"


def clip_rows(files: DataFrame, key_col: str, data_col: str) -> DataFrame:
    """One row a shot of each AVI file: key, clip, first_frame, n_frames, start_s, end_s, level, jump, error.

    A null file, one that is no AVI of baseline JPEG frames, and one without frames give one row with their key and the error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                clips, error = [], None
                try:
                    movie, shares, level = movie_histograms(data or b"")
                    clips = clips_of(shares, level, movie.frame_s)
                    error = None if clips else "no frames"
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    error = str(e) or type(e).__name__
                rows = [(key, i, c.first, c.frames, c.start_s, c.end_s, c.level, c.jump, None) for i, c in enumerate(clips)]
                for row in rows or [(key, *[None] * 7, error)]:
                    for k, v in enumerate(row):
                        out[k].append(v)
            kinds = [pa.int64(), *[pa.int32()] * 3, *[pa.float64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in CLIPS.split(", ")])

    return files.select(column(files, key_col).cast("long"), column(files, data_col).cast("binary")).mapInArrow(run, CLIPS)


def _feature(means: np.ndarray, movie: Movie) -> str:
    clips = shots(means, movie.frame_s)
    longest = max(clips, key=lambda c: c.frames)
    return f"frames={len(means)};shots={len(clips)};longest={longest.first}+{longest.frames};level={means.mean():.3f};jump={max(c.jump for c in clips):.4f}"


def movie_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text (null: empty) as a movie, read it back, and digest what was read.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    Texts are taken in portions of about a megabyte, so memory is bounded by the longest text.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def portion(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        files = store_bytes([padded(t) for t in texts])
        out: list[list] = [[] for _ in range(8)]
        for key, text, file, (movie, means) in zip(ids, texts, files, read_movies(files), strict=True):
            payload = means.tobytes()[: int(movie.comment.removeprefix("payload="))]
            row = (key, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), _feature(means, movie))
            for k, v in enumerate(row):
                out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                if held and held + len(data) > 1 << 20:
                    yield portion(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(data)
                held += len(data) + 64
            if texts:
                yield portion(ids, texts)

    return docs.select(column(docs, id_col).cast("long"), column(docs, text_col).cast("string")).mapInArrow(run, schema)
