"""Sequence packing along a Hilbert curve.

A document is tokenized once; its hashed token counts are projected to ``DIMS`` numbers, scaled by
the corpus's mean and deviation and quantised to a cell of a grid. Documents are range-sorted by
the cell's Hilbert key into as many ranges as their tokens ask for, and each range is cut into sequences of ``length`` tokens from its start
to its end, so neighbours on the curve, being of like content, share sequences and only the last
sequence of a range can be short.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import checkpointed, map_text, texts

DIMS, LEVELS, HASH_SIZE = 4, 8, 4096
LENGTH, END = 1024, 0
#: Stored token bytes of a range of the curve, and the ranges there are at most.
RANGE_BYTES, RANGES = 16 << 20, 50_000

# Fixed value: how byte-level vocabularies of this kind cut a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoder(path: str) -> tuple[tiktoken.Encoding, set[str]]:
    """The encoder of a byte-level vocabulary file (ids are merge ranks), and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of = {c: b for b, c in enumerate(byte_chars())}
    ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), set(special)


def projection(n_ids: int, seed: int = 11) -> np.ndarray:
    """A row per token id: the random direction of the bucket it hashes to."""
    rng = np.random.default_rng(seed)
    buckets = rng.normal(size=(HASH_SIZE, DIMS))
    return buckets[(np.arange(n_ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)]


def hilbert_key(cells: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows, dims), each below 2**levels, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (levels - 1)
    while q > 1:
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (levels - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for bit in range(levels - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n (ids with the end id), ids (little-endian uint32, deflated) and the projected vector v0, v1, ..."""

    def make():
        enc, special = load_encoder(path)
        table = projection(enc.n_vocab)

        def of(arr: pa.Array) -> list[pa.Array]:
            n, packed, vec = [], [], np.zeros((len(arr), DIMS))
            for k, text in enumerate(arr.to_pylist()):
                hot = "<|" in text and any(s in text for s in special)
                ids = np.array(enc.encode(text, allowed_special=special) if hot else enc.encode_ordinary(text), np.uint32)
                if len(ids):
                    total = table[ids].sum(0)
                    vec[k] = total / max(np.linalg.norm(total), 1e-12)
                n.append(len(ids) + 1)
                packed.append(zlib.compress(np.append(ids, np.uint32(END)).astype("<u4").tobytes(), 1))
            return [pa.array(n, pa.int64()), pa.array(packed, pa.binary()), *(pa.array(vec[:, d]) for d in range(DIMS))]

        return of

    return map_text(docs, make, "n long, ids binary, " + ", ".join(f"v{d} double" for d in range(DIMS)))


def _cell(d: int, mean: float, dev: float):
    """Cell of one dimension: where the standardised value lies on the logistic curve."""
    share = 1 / (1 + F.exp(-1.7 * (F.col(f"v{d}") - F.lit(mean)) / F.lit(dev)))
    return F.least(F.lit(2**LEVELS - 1), F.floor(share * 2**LEVELS)).cast("long")


def pack_pieces(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key.

    A document is its ids by the vocabulary at ``path`` (readable on executors) and then id 0, so
    a null or empty text is one id. Documents are cut where a sequence of ``length`` is full.
    Equal texts have equal keys and follow each other by doc_id; rows that repeat a doc_id are
    packed once each. Other columns are ignored; an empty table gives an empty result.
    """
    tokens = checkpointed(tokenized(texts(docs, id_col, text_col), path))
    stats = tokens.agg(*[f(f"v{d}").alias(f"{f.__name__}{d}") for d in range(DIMS) for f in (F.mean, F.stddev_pop)], F.sum(F.octet_length("ids")).alias("bytes")).first()
    spread = [(round(stats[f"mean{d}"] or 0.0, 6), round(stats[f"stddev_pop{d}"] or 0.0, 6) or 1.0) for d in range(DIMS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.stack([b.column(3 + d).to_numpy() for d in range(DIMS)], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hilbert_key(cells))], names=["doc_id", "n", "ids", "curve_key"])

    cells = tokens.select("doc_id", "n", "ids", *[_cell(d, *spread[d]).alias(f"c{d}") for d in range(DIMS)])
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    curve = cells.mapInArrow(keyed, f"doc_id {id_type}, n long, ids binary, curve_key long")
    ranges = min(max(-(-(stats["bytes"] or 0) // RANGE_BYTES), 1), RANGES)
    curve = curve.repartitionByRange(ranges, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id").withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            rows: list[tuple] = []
            ids_of, n_of, key_of = b.column("ids"), b.column("n").to_pylist(), b.column("curve_key").to_pylist()
            part = b.column("part")[0].as_py() if len(b) else 0
            for k, (n, key) in enumerate(zip(n_of, key_of, strict=True)):
                raw = zlib.decompress(ids_of[k].as_buffer())
                start = 0
                while start < n:
                    size = min(n - start, length - at % length)
                    rows.append((k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, (part << 40) + at // length, at % length, key))
                    start, at = start + size, at + size
            cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 8
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(cols[0])), *map(pa.array, cols[1:])], names=names)

    out = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long"
    names = [c.split()[0] for c in out.split(", ")]
    return curve.mapInArrow(cut, out)
