"""WARC records in ZIP-packaged archives: writing them and reading records by range.

An archive is a ZIP of stored members: ``archive/data.warc.gz`` (one gzip member for each record)
and ``indexes/index.cdxj`` (where each record lies). The reader takes the end of an archive for the
end-of-central-directory records, ZIP64 ones included, parses the central directory, locates both
members, reads the index and then only the byte ranges of records; nothing is extracted.

Spark's text writer stores the archives, so task retries and commits are its own: an archive is
one row, and the line end behind it is the comment that the archive declares.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, salted_lookup

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 16 << 20
_END = b"\n"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


# --- ZIP -------------------------------------------------------------------


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = True, comment: bytes = _END) -> bytes:
    """A ZIP of stored members. ``zip64`` writes 64-bit fields throughout, as archives over 4 GB need."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        n, crc, at, raw = len(data), zlib.crc32(data), len(out), name.encode()
        short = _FULL32 if zip64 else n
        extra = struct.pack("<HHQQ", 1, 16, n, n) if zip64 else b""
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if zip64 else b""
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, _FULL32 if zip64 else at) + raw + extra
    at, size, count = len(out), len(directory), len(members)
    out += directory
    if zip64:
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, at)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1)
        count, size, at = _FULL16, _FULL32, _FULL32
    out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, size, at, len(comment)) + comment
    return bytes(out)


def zip_members(read: Callable[[int, int], bytes], length: int) -> dict[str, tuple[int, int]]:
    """Name to (offset, length) of the stored data, from the central directory; ``read(offset, n)`` gives bytes."""
    tail_at = max(0, length - 22 - _FULL16)
    tail = read(tail_at, length - tail_at)
    end = len(tail)
    while True:
        end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
        end += 3  # part of a comment or of data: look further ahead of it
    count, size, at = struct.unpack_from("<HII", tail, end + 10)
    if _FULL16 == count or _FULL32 in (size, at):
        signature, _, far, _ = struct.unpack("<4sIQI", read(tail_at + end - 20, 20))
        if signature != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        head = read(far, 56)
        if head[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, size, at = struct.unpack_from("<QQQ", head, 32)
    directory, p, out = read(at, size), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, packed, plain, n, m, k, offset = struct.unpack_from("<10xH8xIIHHH8xI", directory, p)
        name, extra = directory[p + 46 : p + 46 + n].decode(), directory[p + 46 + n : p + 46 + n + m]
        wide = [plain == _FULL32, packed == _FULL32, offset == _FULL32]
        q = 0
        while any(wide) and q + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{sum(wide)}Q", extra, q + 4))
                plain, packed, offset = (next(values) if w else v for w, v in zip(wide, (plain, packed, offset), strict=True))
                break
            q += 4 + width
        if method:
            raise ValueError(f"{name} is compressed; range reads need stored members")
        head = read(offset, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("damaged local header")
        out[name] = (offset + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        p += 46 + n + m + k
    return out


# --- WARC ------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(key: object) -> str:
    """``urn:page:`` and the key, quoted; a null key is ``urn:page-none``."""
    return "urn:page-none" if key is None else f"urn:page:{quote(str(key), safe='')}"


def key_of(name: str | None) -> str | None:
    """The key, as text, of what ``<urn(key)>`` says; null for none."""
    return unquote(name[len("<urn:page:") : -1]) if name is not None and name.startswith("<urn:page:") else None


def warc_record(key: object, url: str | None, payload: bytes, refers_to: object | None) -> bytes:
    """A response with its payload, or a revisit that names the response; both keep the HTTP header and full digest."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or urn(key))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{urn(key)}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{urn(refers_to)}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header (names in lower case) and the bytes after them."""

    def header(data: bytes) -> tuple[dict[str, str], bytes]:
        head, _, rest = data.partition(b"\r\n\r\n")
        pairs = (x.partition(":") for x in head.decode().split("\r\n")[1:])
        return {a.strip().lower(): c.strip() for a, _, c in pairs}, rest

    warc, block = header(raw)
    http, payload = header(block[: int(warc["content-length"])])
    return warc, http, payload


# --- Spark -----------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: of equal payloads of at least ``min_bytes`` all but the smallest page_id refer to that one."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.where((F.octet_length("payload") >= min_bytes)).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = salted_lookup(rows, groups.select("digest", "first"), "digest", F.col("page_id"))
    return rows.select("page_id", "url", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = True) -> None:
    """Writes ``with_revisits`` rows as archives of about ``archive_bytes`` in the folder ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def archive() -> pa.RecordBatch:
            raw = zip_bytes([(DATA, bytes(data)), (INDEX, "".join(index).encode())], zip64)
            data.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw.removesuffix(_END)], pa.binary())], names=["value"])  # the writer adds it

        for b in batches:
            for key, url, payload, refers in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                record = warc_record(key, url, payload, refers)
                packer = zlib.compressobj(6, wbits=31)
                packed = packer.compress(record) + packer.flush()
                index.append(f"{urn(key)} {json.dumps({'offset': len(data), 'length': len(packed)})}\n")
                data.extend(packed)
                if len(data) >= archive_bytes:
                    yield archive()
        if index:
            yield archive()

    archives = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "value binary")
    # the writer puts a row's bytes in the file as they are
    archives.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


class _Files:
    """Range reads of the files that a task looks at; keeps the last one open."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def read(self, path: str, offset: int, n: int) -> bytes:
        if path != self.path:
            if path.startswith("file:"):
                system, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
            else:
                system, name = fs.FileSystem.from_uri(path)
            self.path, self.file = path, system.open_input_file(name)
        return self.file.read_at(n, offset)


def locate_records(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, length of every record in the archives of a folder, from their directories and indexes."""
    listing = spark.read.format("binaryFile").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for b in batches:
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                members = zip_members(lambda at, n, name=name: files.read(name, at, n), length)
                base = members[DATA][0]
                entries = [json.loads(x.partition(" ")[2]) for x in files.read(name, *members[INDEX]).decode().splitlines()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(entries), pa.string()), pa.array([base + e["offset"] for e in entries], pa.int64()), pa.array([e["length"] for e in entries], pa.int64())], names=["archive", "offset", "length"])

    return listing.mapInArrow(run, "archive string, offset long, length long")


def read_records(records: DataFrame, with_payload: bool = True, id_type: str = "long") -> DataFrame:
    """page_id (of type ``id_type``), url, record_type, refers_to, payload_bytes, payload_digest and the payload (null for a revisit), read by range.

    A response whose payload doesn't have its recorded digest or length is an error.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for b in batches:
            places = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for i in range(0, len(places), 512):
                rows = []
                for place in places[i : i + 512]:
                    warc, http, payload = parse_record(zlib.decompress(files.read(*place), wbits=31))
                    digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    if warc["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"damaged record {warc['warc-record-id']} in {place[0]}")
                    kept = payload if warc["warc-type"] == "response" else None
                    rows.append((key_of(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-type"], key_of(warc.get("warc-refers-to")), size, digest, kept))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: len(names)], names=names)

    ddl = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    out = records.select("archive", "offset", "length").mapInArrow(run, ddl + ", payload binary" * with_payload)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives under ``path`` and returns what is read back, without payloads.

    A null html is an empty payload, a null url a urn. Of equal payloads the smallest page_id is the
    response; rows that repeat it are responses as well. Rows without a page_id are responses
    and refer to nothing. Ids of any type that its text gives back are kept as they are. Other columns are ignored; an empty table leaves no archive and gives no row.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(with_revisits(pages, min_bytes), path)
    return read_records(locate_records(spark, path), False, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
