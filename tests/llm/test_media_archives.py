"""Movies and archives: round trips, other writers' files, edge cases."""

import hashlib
import io
import os
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from firmscope.llm import avi, warczip


def test_movies_round_trip():
    r = random.Random(1)
    payloads = [avi.padded(os.urandom(r.randint(0, 3000))) for _ in range(20)] + [avi.padded(x) for x in (b"", b"\xff" * 1000, b"\0" * 64, bytes(range(256)) * 3)]
    for p, (m, means) in zip(payloads, avi.read_movies(avi.store_bytes(payloads)), strict=True):
        assert means.tobytes()[: int(m.comment.removeprefix("payload="))] == p
        assert (m.width, m.height) == (512, 64) and abs(m.frame_s - 0.04) < 1e-9


def test_movie_without_index_and_with_file_offsets():
    file = avi.store_bytes([avi.padded(b"abc" * 500)])[0]
    frames = avi.parse_avi(file).frames
    at = file.rindex(b"idx1")
    assert avi.parse_avi(file[:at]).frames == frames
    movi, moved = file.index(b"movi"), bytearray(file)
    for i in range(at + 8, len(file), 16):
        struct.pack_into("<I", moved, i + 8, struct.unpack_from("<I", file, i + 8)[0] + movi)
    assert avi.parse_avi(bytes(moved)).frames == frames


def test_other_tables_and_texture():
    """Blocks with AC coefficients, a scan without restarts, and a table of other codes: means are those of the DC terms."""
    dc = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))  # all sizes in four bits
    ac = bytes([0, 2, 1] + [0] * 13) + bytes([0x00, 0x01, 0x12])
    bits = ""
    for diff, textured in ((5, False), (-3, True), (40, True)):
        size = abs(diff).bit_length()
        bits += f"{size:04b}" + f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}"
        bits += "01" + "1" + "100" + "01" if textured else ""
        bits += "00"
    data = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")
    part = lambda k, b: struct.pack(">BBH", 0xFF, k, len(b) + 2) + b
    jpeg = b"\xff\xd8" + part(0xDB, b"\0" + b"\x10" * 64) + part(0xC0, struct.pack(">BHHB", 8, 8, 24, 1) + b"\x01\x11\x00") + part(0xC4, b"\0" + dc + b"\x10" + ac) + part(0xDA, b"\x01\x01\x00\x00\x3f\x00") + data + b"\xff\xd9"
    assert avi.decode_means([avi.parse_frame(jpeg)])[0].tolist() == [128 + 10, 128 + 4, 128 + 84]
    with pytest.raises(ValueError, match="baseline"):
        avi.parse_frame(jpeg.replace(b"\xff\xc0", b"\xff\xc2"))


def test_shots():
    calm = lambda v: np.clip(np.random.default_rng(v).normal(v, 3, (20, 512)), 0, 255).astype(np.uint8)
    clips = avi.shots(np.concatenate([calm(60), calm(160), calm(90)]), 0.04)
    assert [(c.first, c.frames) for c in clips] == [(0, 20), (20, 20), (40, 20)] and clips[1].start_s == pytest.approx(0.8)
    assert avi.shots(np.zeros((0, 1), np.uint8), 0.04) == [] and len(avi.shots(calm(9), 0.04)) == 1


def test_movie_digests(spark):
    texts = {1: None, 2: "", 3: "é" * 100, 4: "x" * 70_000, 5: "é" * 100}
    rows = {r.doc_id: r for r in avi.movie_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for k, t in texts.items():
        p, r = avi.padded((t or "").encode()), rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert rows[3][1:] == rows[5][1:]
    assert avi.movie_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clip_rows(spark):
    cut = (b"a" * 64 * 80) + (b"z" * 64 * 80)
    files = [(1, bytearray(avi.store_bytes([avi.padded(cut)])[0])), (2, None), (3, bytearray(b"no movie")), (4, bytearray(avi.write_avi([], 0, 8, 8)))]
    got = avi.clip_rows(spark.createDataFrame(files, "k long, data binary"), "k", "data").collect()
    assert [(r.key, r.first_frame, r.n_frames) for r in got if r.error is None] == [(1, 0, 10), (1, 10, 10)]
    assert {r.key: r.error for r in got if r.error} == {2: "not an AVI file", 3: "not an AVI file", 4: "no frames"}


def another_encoder(spark, picture):
    """A colour picture (rows, columns, 3) as JPEG by the Java library, and the luminance that library reads back."""
    high, wide = picture.shape[:2]
    rows = b"".join(row[:, ::-1].tobytes() + b"\0" * (-3 * wide % 4) for row in picture[::-1])
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, wide, high, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    java, image = spark._jvm.java, spark._jvm.javax.imageio.ImageIO
    out = java.io.ByteArrayOutputStream()
    assert image.write(image.read(java.io.ByteArrayInputStream(bytearray(bmp))), "jpg", out)
    data = bytes(out.toByteArray())
    reader = image.getImageReadersByFormatName("jpeg").next()
    reader.setInput(image.createImageInputStream(java.io.ByteArrayInputStream(bytearray(data))))
    raster = reader.readRaster(0, None)
    space = spark.sparkContext._gateway.new_array(spark._jvm.int, high * wide)
    return data, np.array(list(raster.getSamples(0, 0, wide, high, 0, space))).reshape(high, wide)


def pictures(high, wide, tints):
    y, x = np.mgrid[0:high, 0:wide]
    wave = 50 * np.sin(x / 5) + 40 * np.cos(y / 3 + x / 9)
    return [np.clip(np.stack([wave + t, wave / 2 + t, 200 - wave - t], axis=2), 0, 255).astype(np.uint8) for t in tints]


@pytest.mark.parametrize(("high", "wide"), [(16, 16), (37, 53), (64, 48)])
def test_colour_frames_of_another_encoder(spark, high, wide):
    """Interleaved components with halved colour planes: every luminance sample, with and without Huffman tables in the frame."""
    for picture in pictures(high, wide, (20, 110, 180)):
        data, want = another_encoder(spark, picture)
        bare, at = data[:2], 2
        while data[at + 1] != 0xDA:  # leave the Huffman tables out, as motion-JPEG may
            n = 2 + struct.unpack_from(">H", data, at + 2)[0]
            bare += b"" if data[at + 1] == 0xC4 else data[at : at + n]
            at += n
        for jpeg in (data, bare + data[at:]):
            frame = avi.parse_frame(jpeg)
            assert len(frame.pattern) > 1
            got = avi.decode([frame], whole=True)[0].astype(int)
            assert got.shape == want.shape and np.abs(got - want).max() <= 1
            mean = avi.decode([frame])[0].astype(int)[: high // 8, : wide // 8]
            assert np.abs(mean - want[: high // 8 * 8, : wide // 8 * 8].reshape(high // 8, 8, wide // 8, 8).mean(axis=(1, 3))).max() <= 2


def test_clips_of_a_colour_movie(spark):
    """Shots of a movie of another encoder's frames; a dropped frame repeats the one before it."""
    frames = [another_encoder(spark, p)[0] for p in pictures(37, 53, [20, 21, 22, 23, 24, 25, 150, 151, 152, 153, 154, 155])]
    frames[3] = b""
    got = avi.clip_rows(spark.createDataFrame([(7, bytearray(avi.write_avi(frames, 0, 53, 37)))], "k long, data binary"), "k", "data").collect()
    assert [(r.first_frame, r.n_frames, r.error) for r in got] == [(0, 6, None), (6, 6, None)]
    broken = avi.write_avi([frames[0], frames[1][:-40]], 0, 53, 37)
    assert avi.clip_rows(spark.createDataFrame([(8, bytearray(broken))], "k long, data binary"), "k", "data").first().error


def test_frames_of_all_riff_chunks_and_records():
    """Further RIFF chunks are walked; an index of indexes holds over both; record lists are opened; other streams are left out."""
    one, two = avi.encode_frame(avi.encode_rows(np.full((8, 64), 9, np.uint8))), avi.encode_frame(avi.encode_rows(np.full((8, 64), 200, np.uint8)))
    sound = avi._chunk(b"01wb", b"abc") + avi._chunk(b"02dc", two)
    more = avi._chunk(b"RIFF", b"AVIX" + avi._chunk(b"LIST", b"movi" + avi._chunk(b"LIST", b"rec " + avi._chunk(b"00dc", two) + sound)))
    file = avi.write_avi([one], 0, 512, 64) + more
    at = avi.parse_avi(file).frames
    assert [file[a : a + n] for a, n in at] == [one, two]
    part = b"ix00" + struct.pack("<IHBBI4sQI", 24 + 16, 2, 0, 1, 2, b"00dc", 0, 0) + b"".join(struct.pack("<II", a, n | 0x80000000) for a, n in reversed(at))
    place = 12  # the index of indexes is put in front of the first list, so all places move by its size
    size = 8 + 24 + 16
    moved = b"ix00" + part[4:20] + struct.pack("<Q", size) + part[28:]
    above = avi._chunk(b"indx", struct.pack("<HBBI4s12xQII", 4, 0, 0, 1, b"00dc", len(file) + size, len(moved), 2))
    big = file[:place] + above + file[place:] + moved
    big = big[:4] + struct.pack("<I", struct.unpack_from("<I", file, 4)[0] + size) + big[8:]
    assert [big[a : a + n] for a, n in avi.parse_avi(big).frames] == [two, one]


@pytest.mark.parametrize("wide", [False, True])
def test_zip_of_another_writer(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in ("archive/a.warc", "x/é.txt"):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(b"hello " + name.encode())
        z.writestr(zipfile.ZipInfo("packed"), b"a" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment"
    read = []

    def ranges(at, size):
        read.append(size)
        return out.getvalue()[at : at + size]

    p = warczip.Package(ranges, len(out.getvalue()))
    assert p.archives() == ["archive/a.warc"] and p.range("x/é.txt", 2, 4) == b"llo "
    assert read[-1] == 4
    for bad in (lambda: p.range("packed", 0, 1), lambda: p.range("x/é.txt", 0, 999), lambda: warczip.open_package(b"nothing")):
        with pytest.raises(ValueError):
            bad()


def test_zip64_directory():
    """A directory whose numbers are all in ZIP64 records."""
    name, body = b"m", b"stored"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 6, 6)
    extra = struct.pack("<HHQQQ", 1, 24, 6, 6, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    data = local + body + central + end64 + struct.pack("<4sIQI", b"PK\6\7", 0, start + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    p = warczip.open_package(data)
    assert p.range("m", 0, 6) == body


def test_archives(spark):
    rows = [(5, "u", "x", "e"), (3, "u", "x", "e"), (3, "u", "x", "e"), (None, None, "x", "e"), (7, "v", None, "e"), (8, "é\r\n", "", "e"), (9, "w", "<p>\r\n\r\nWARC/1.1</p>", "e")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    got = warczip.read_packages(warczip.write_packages(df, most=300)).collect()
    for r in got:
        html = {x[0]: x[2] for x in rows}[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), warczip.digest_of(html.encode()))
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3), (7, "response", None), (8, "revisit", 7), (9, "response", None)]
    assert {r.url for r in got} == {"u", None, "v", "é\r\n", "w"}
    assert warczip.read_packages(warczip.write_packages(df.limit(0))).count() == 0
