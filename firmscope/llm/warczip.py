"""WARC archives in ZIP packages, read by ranges without extraction.

A package is a ZIP file whose members are stored, not compressed: one WARC file and an
index of its records. A reader needs the end of the file (end-of-directory records, ZIP64
ones where sizes ask for them), the central directory, a member's local header, the index
member, and then just the ranges of the records it wants. `open_package` works on any
function that reads a range, so a package may lie in any store.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stage

ReadRange = Callable[[int, int], bytes]


# ---------------------------------------------------------------- ZIP directories


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int
    crc32: int


def _wide(extra: bytes, want: list[bool]) -> list[int]:
    """The 64-bit values of a ZIP64 extra field, in the order of the fields that need them."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return list(struct.unpack_from(f"<{sum(want)}Q", extra, at + 4))
        at += 4 + size
    raise ValueError("a ZIP64 field is missing")


def central_directory(read: ReadRange, length: int) -> list[Member]:
    """All members of a ZIP or ZIP64 file of that length; a comment at its end is allowed for."""
    tail_at = max(0, length - (22 + 65535))
    tail = read(tail_at, length - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("not a ZIP file: no end of directory")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        place = read(tail_at + end - 20, 20)
        if place[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read(struct.unpack_from("<Q", place, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of directory")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = read(start, size), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        flags, method, crc, packed, full, n_name, n_extra, n_note = struct.unpack_from("<8xHH4xIIIHHH", directory, at)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name]
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        need = [v == 0xFFFFFFFF for v in (full, packed, header)]
        if any(need):
            values = iter(_wide(extra, need))
            full, packed, header = (next(values) if n else v for n, v in zip(need, (full, packed, header), strict=True))
        found.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, full, header, crc))
        at += 46 + n_name + n_extra + n_note
    return found


class Package:
    """Reads ranges of stored members in place."""

    def __init__(self, read: ReadRange, length: int):
        self.read = read
        self.members = {m.name: m for m in central_directory(read, length)}
        self._starts: dict[str, int] = {}

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin: behind its local header, whose name and extra fields have their own lengths."""
        if name not in self._starts:
            m = self.members[name]
            if m.method != 0 or m.packed != m.size:
                raise ValueError(f"{name} is compressed; ranges need stored members")
            local = self.read(m.header, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("bad local header")
            self._starts[name] = m.header + 30 + sum(struct.unpack_from("<HH", local, 26))
        return self._starts[name]

    def range(self, name: str, at: int, size: int) -> bytes:
        if at < 0 or at + size > self.members[name].size:
            raise ValueError("the range leaves the member")
        return self.read(self.start(name) + at, size)

    def archives(self) -> list[str]:
        return [n for n in self.members if n.startswith("archive/") and n.endswith(".warc")]

    def index(self, archive: str) -> list[dict]:
        """The index member's entries for an archive: offset and length of each record, with its fields."""
        name = archive.replace("archive/", "indexes/", 1).removesuffix(".warc") + ".cdxj"
        lines = self.range(name, 0, self.members[name].size).decode().splitlines()
        return [json.loads(x.split(" ", 2)[2]) for x in lines if x]


def open_package(data: bytes) -> Package:
    return Package(lambda at, size: data[at : at + size], len(data))


# ---------------------------------------------------------------- WARC records


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(text: str | None) -> str:
    """A header value on one line; other characters than printable ASCII are escaped."""
    return json.dumps(text or "")[1:-1]


def _page_record(page: int | None, url: str | None, digest: str, payload: bytes, first: int | None) -> tuple[bytes, dict]:
    name = "" if page is None else str(page)
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Target-URI": _plain(url),
        "WARC-Date": "2000-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(len(payload)),
    }
    if first is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields["Content-Type"] = "application/http;msgtype=response"
    return warc_record(fields, head + (payload if first is None else b"")), {"url": url, "digest": digest}


class PackageWriter:
    """Gathers records and closes to a ZIP file of stored members."""

    def __init__(self) -> None:
        self.records, self.lines, self.size = [], [], 0

    def add(self, record: bytes, entry: dict) -> None:
        self.lines.append(f"page {len(self.records)} " + json.dumps(entry | {"offset": self.size, "length": len(record)}))
        self.records.append(record)
        self.size += len(record)

    def close(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo("archive/pages.warc"), b"".join(self.records))
            z.writestr(zipfile.ZipInfo("indexes/pages.cdxj"), "\n".join(self.lines) + "\n")
        return out.getvalue()


# ---------------------------------------------------------------- as DataFrames


def write_packages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = 16 << 20) -> DataFrame:
    """Write one record a page into packages of about `most` bytes; returns the written packages (part, data).

    Of pages with equal payloads (by SHA-1; null counts as empty) the smallest id is the
    response and others revisit it. Rows that repeat the smallest id with the same payload
    are responses each. A null id revisits any other; if all ids of a payload are null, all are
    responses. The rows are read twice: for digests, which alone are shuffled to find each
    payload's first page, and for records, joined on digest.
    """
    wanted = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), F.coalesce(column(pages, html_col).cast("string"), F.lit("")).alias("html"))
    wanted = wanted.withColumn("sha1", F.unhex(F.sha1(F.col("html").cast("binary"))))
    firsts = wanted.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("sha1", "first")
    joined = wanted.join(firsts, "sha1", "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = PackageWriter()
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                held.add(*_page_record(page, url, digest_of(payload), payload, refers))
                if held.size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([held.close()], pa.binary())], names=["data"])
                    held = PackageWriter()
        if held.records:
            yield pa.RecordBatch.from_arrays([pa.array([held.close()], pa.binary())], names=["data"])

    return stage(joined.mapInArrow(run, "data binary"), "warc-packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """One row a record, from the packages: page_id, payload_bytes, payload_digest, record_type, refers_to, url, offset.

    A response's payload is read by its range and its digest checked; a revisit's length
    and digest are those of the payload it stands for.
    """

    def number(name: str | None) -> int | None:
        digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                view = memoryview(data.as_buffer())
                package = Package(lambda at, size, view=view: bytes(view[at : at + size]), len(view))
                out: list[list] = [[], [], [], [], [], [], []]
                for archive in package.archives():
                    for entry in package.index(archive):
                        fields, block = parse_record(package.range(archive, entry["offset"], entry["length"]))
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        size = int(fields["WARC-Payload-Length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            size = len(payload)
                            if digest_of(payload) != digest:
                                raise ValueError("a payload differs from its digest")
                        row = (number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), entry["url"], entry["offset"])
                        for k, v in enumerate(row):
                            out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    return packages.select("data").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, offset long")
