"""Interleaved documents: text and media references in page order, media resolved by digest.

A page's HTML is parsed into an ordered list of elements, texts and references to media, each
reference with its caption. Media lie in a table of their own, named by the SHA-256 of their stored
bytes, and a digest join brings what is stored to the references; every element keeps its position,
so texts, media and captions stay aligned. Stored media here are 8-bit grey images in PNG, 64 samples
to a row, which hold any bytes without loss.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, heavy_lookup, large, saved, slices, texts
from .markup import attributes, scan

WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
_DIGEST = re.compile(r"^media:sha256:([0-9a-f]{64})$")
ELEMENT = "struct<position:int,kind:string,text:string,digest:string,caption:string,src:string>"
STORED = "struct<digest:string,data:binary>"

# Elements that end a text, and those that name media.
_BREAKS = frozenset("address article aside blockquote body br caption dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_MEDIA = frozenset("img audio video source embed".split())
_ENDS_CAPTION = frozenset("article aside figure footer form h1 h2 h3 h4 h5 h6 header main nav section".split())


# --- stored form -----------------------------------------------------------


def to_png(payload: bytes) -> bytes:
    """8-bit grey PNG of a payload, a positive multiple of ``WIDTH`` bytes: one sample a byte, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an 8-bit grey PNG without filter; damaged or other files are an error."""
    if not stored.startswith(_PNG):
        raise ValueError("not a PNG")
    at, size, data = len(_PNG), (0, 0), []
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
            if body[8:] != b"\x08\0\0\0\0":
                raise ValueError("only 8-bit grey, not interlaced")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("only rows without a filter")
    return raw[:, 1:].tobytes()


def describe(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and the 16-bin histogram of the samples."""
    bins = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, value = len(samples), np.arange(256)
    total, square = int(bins @ value), int(bins @ (value * value))
    p = bins[bins > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    return f"mean={total / n:.4f} dev={max(square / n - (total / n) ** 2, 0.0) ** 0.5:.4f} entropy={entropy:.4f} hist={','.join(map(str, bins.reshape(16, 16).sum(1)))}"


# --- sequences -------------------------------------------------------------


def elements(html: str) -> list[tuple[int, str, str | None, str | None, str | None, str | None]]:
    """(position, 'text' or 'media', text, digest, caption, src) in page order, positions gapless from 0.

    A caption is the figcaption of the reference's figure, else its alt text, else null; a figcaption is no
    text element unless its figure has no reference. One that isn't closed ends with its figure or where a section or heading begins or ends.
    A reference that names no digest keeps its src, with a null digest.
    """
    out: list[list] = []
    text: list[str] = []
    caption: list[str] | None = None
    figure: list[int] = []

    def flush() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            out.append([len(out), "text", joined, None, None, None])

    def end_caption() -> None:
        nonlocal caption
        if caption is None:
            return
        joined, caption = " ".join("".join(caption).split()), None
        for i in figure:
            out[i][4] = joined or out[i][4]
        if joined and not figure:
            out.append([len(out), "text", joined, None, None, None])

    for kind, tag, raw, _ in scan(html):
        if kind == "text":
            (text if caption is None else caption).append(raw)
        elif kind == "start" and tag in _MEDIA:
            a = attributes(raw)
            if a.get("src"):
                flush()
                name = _DIGEST.match(a["src"])
                figure.append(len(out))
                out.append([len(out), "media", None, name[1] if name else None, a.get("alt") or None, a["src"]])
        elif tag == "figcaption":
            flush()
            end_caption()
            caption = [] if kind == "start" else None
        elif tag in _BREAKS:
            if tag in _ENDS_CAPTION:
                end_caption()
            if tag == "figure":
                flush()
                figure.clear()
            (flush if caption is None else lambda: caption.append(" "))()
    flush()
    end_caption()
    return [tuple(x) for x in out]


def sequences(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``elements``, the ordered elements of each row's HTML, in place of it."""
    at, names = pages.columns.index(html_col), [c for c in pages.columns if c != html_col]
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("src", pa.string())]))
    fields = ("position", "kind", "text", "digest", "caption", "src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pa.array([[dict(zip(fields, e, strict=True)) for e in elements(h)] for h in large(b.column(at)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), lists], names=[*names, "elements"])

    ddl = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return pages.mapInArrow(run, f"{ddl + ', ' if ddl else ''}elements array<{ELEMENT}>")


def resolve(rows: DataFrame, media: DataFrame, id_col: str) -> DataFrame:
    """Each media element of ``rows`` (``id_col``, elements) with the columns of ``media`` (digest, unique, and more).

    One row for each reference: id_col, position, caption, src (where it names no digest), n_elements, what media says of the digest (null
    where it is unknown or there is none). Digests that a large share of the documents have are joined without a shuffle. The references are stored first, so pages are parsed once.
    """
    one = F.explode(F.filter("elements", lambda e: e["kind"] == "media")).alias("e")
    refs = rows.select(id_col, F.size("elements").alias("n_elements"), one).select(id_col, "n_elements", "e.position", "e.digest", "e.caption", F.when(F.col("e.digest").isNull(), F.col("e.src")).alias("src"))
    return heavy_lookup(saved(refs, "references"), media, "digest")


# --- documents as media ----------------------------------------------------


def badge(n: int) -> bytes:
    """The payload of the picture that pages of texts of the same order of magnitude share."""
    return f"texts below {1 << n.bit_length()} bytes".encode().ljust(WIDTH, b"\0")


def page_of(text: str, n: int, payload: str, shared: str) -> str:
    """The HTML of a document: title, lead, the picture of its text with a caption, its last line with the badge of its size inside, and a note."""
    start, end = (entities.escape(" ".join(x.split())[:80]) for x in (text[:200], text[-200:]))
    figure = f'<figure><img src="media:sha256:{payload}" alt="text"><figcaption>text of {n} bytes</figcaption></figure>'
    return f'<article><h1>{start}</h1><p>Begins: {start}</p>{figure}<p>Ends: {end} <img src="media:sha256:{shared}" alt="size of {n} bytes"> as stored</p></article>'


def store_documents(docs: DataFrame, path: str) -> None:
    """Writes, for each document, an HTML page (texts, two references, captions) and the PNGs it refers to to the table ``path``.

    The payload is the text in UTF-8 with zero bytes up to a positive multiple of 64; the second picture is shared by all
    texts of its size. A task stores equal payloads once; across tasks a digest may be stored again, with equal bytes. ``page`` numbers the rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("digest", pa.string()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, str] = {}

        def put(raw: bytes, payload: bytes, new: list[dict]) -> str:
            known = hashlib.blake2b(raw, digest_size=16).digest()
            name = seen.get(known)
            if name is None:
                if len(seen) > 500_000:
                    seen.clear()
                stored = to_png(payload)
                name = seen[known] = hashlib.sha256(stored).hexdigest()
                new.append({"digest": name, "data": stored})
            return name

        for b in batches:
            ids, arr = b.column("doc_id"), large(b.column("text"))
            for i, j in slices(arr):
                page, media = [], []
                for text in arr.slice(i, j - i).to_pylist():
                    raw, new = text.encode(), []
                    own = put(raw, raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), new)
                    page.append(page_of(text, len(raw), own, put(b"badge " + badge(len(raw)), badge(len(raw)), new)))
                    media.append(new)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(page, pa.string()), pa.array(media, kind)], names=["doc_id", "html", "media"])

    pages = docs.mapInArrow(run, f"doc_id {id_type}, html string, media array<{STORED}>").withColumn("page", F.monotonically_increasing_id())
    pages.write.option("compression", "snappy").parquet(path)


def media_features(media: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored PNGs (digest, data), unique on digest.

    A file whose bytes don't have its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, stored in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                stored = stored.as_buffer().to_pybytes()
                own = hashlib.sha256(stored).hexdigest()
                if own != name:
                    raise ValueError(f"media {name} is damaged")
                payload = from_png(stored)
                rows.append((name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), own, describe(payload)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    ddl = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("digest", "data").mapInArrow(run, ddl).dropDuplicates(["digest"])


def interleaved_media(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and what ``media_features`` reads back for every document, and of its page's sequence: position and caption of that reference,
    n_elements, n_media, and position, caption and payload_sha256 of the second reference.

    Documents are stored under ``path`` as pages with media, parsed into sequences and resolved by
    digest. A null text is empty: 64 zero bytes. Repeated rows share media and stay rows of their own; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "media")
    store_documents(texts(docs, id_col, text_col), path)
    stored = spark.read.parquet(path)
    media = saved(media_features(stored.select(F.explode("media").alias("m")).select("m.*")), "features")
    # the table numbers its rows, so the references of a page meet whatever its doc_id
    found = resolve(sequences(stored.select(F.struct("page", "doc_id").alias("of"), "html")), media, "of")
    found = found.select(F.col("of.page").alias("page"), F.col("of.doc_id").alias("doc_id"), "n_elements", F.struct("position", "caption", *media.columns[1:]).alias("ref"))
    found = found.groupBy("page").agg(F.first("doc_id").alias("doc_id"), F.first("n_elements").alias("n_elements"), F.array_sort(F.collect_list("ref")).alias("refs"))
    own, other = F.col("refs")[0], F.col("refs")[1]
    n_bytes = F.regexp_extract(own["caption"], r"(\d+) bytes$", 1).cast("long")
    more = [F.size("refs").alias("n_media"), other["position"].alias("badge_position"), other["caption"].alias("badge_caption"), other["payload_sha256"].alias("badge_sha256")]
    return found.select("doc_id", n_bytes.alias("n_bytes"), *(own[c].alias(c) for c in (*media.columns[1:], "position", "caption")), "n_elements", *more)
