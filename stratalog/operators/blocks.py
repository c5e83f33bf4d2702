"""Content-defined chunks of files of any size on storage, cut block by block.

Where a chunk begins decides where it may end, so the chunks of a file follow from its first byte on. A block of a file tells in a small table
at which place each chunk that is open at its beginning leaves it, and how many begin in it by then; a scan over a file's tables gives the place where
the first chunk of each block begins, and then every block is cut by itself. Chunks that begin at different places soon end together, so a table has few
pieces. Contents are never shuffled: tasks read a block by its range, with as much of the next one as a chunk may reach into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import file_system
from .chunks import CHUNK, TTTD_WINDOW, tttd_sizes, window_hits

BLOCK = 16 << 20
_SLICE = 4096  # chunk starts, and
_PART = 1 << 20  # bytes, that are looked at together
_FEW = 256  # below so many chunk starts all their windows are laid out at once


class Block:
    """Bytes from a block's beginning to where its last chunk may reach, or to the file's end."""

    def __init__(self, data: bytes, average: int):
        self.least, self.most, self.divisor = tttd_sizes(average)
        w = TTTD_WINDOW
        self.n = len(data)
        bytes_ = np.frombuffer(data, np.int8)
        parts = [np.flatnonzero(window_hits(bytes_[i : i + _PART + w - 1], self.divisor)) + i for i in range(0, self.n - w + 1, _PART)]
        #: the last byte of each window that ends a chunk wherever it began, if that is far enough back
        self.hits = np.concatenate([*parts, [self.n + self.most]]).astype(np.int64) + w - 1
        self.padded = np.concatenate([bytes_, np.zeros(self.least + 2 * w, np.int8)])

    def ends(self, starts: np.ndarray) -> np.ndarray:
        """Where the chunks that begin at ``starts`` end. The first windows leave out the byte at the least size, so they depend on the start."""
        w = TTTD_WINDOW
        at = starts + self.least
        out = np.minimum(np.minimum(starts + self.most, self.n), self.hits[np.searchsorted(self.hits, at + w)] + 1)
        for i in range(0, len(starts), _SLICE):
            q = at[i : i + _SLICE]
            first = (self._near_few if len(q) < _FEW else self._near_many)(q)
            out[i : i + _SLICE] = np.where(first < w, q + first + 1, out[i : i + _SLICE])
        return out

    def _near_few(self, q: np.ndarray) -> np.ndarray:
        """Which of the ``TTTD_WINDOW`` windows around each place is the first that ends a chunk, ``TTTD_WINDOW`` for none; the byte at the place is left out."""
        w = TTTD_WINDOW
        around = np.delete(np.arange(-w, w), w)
        found = window_hits(self.padded[np.minimum(q, self.n)[:, None] + around], self.divisor) & (q[:, None] + np.arange(w) < self.n)
        return np.where(found.any(1), found.argmax(1), w)

    def _near_many(self, q: np.ndarray) -> np.ndarray:
        """As ``_near_few``, window by window for all places: the sums go on from one to the next, and no array is larger than the places."""
        w, at = TTTD_WINDOW, np.minimum(q, self.n)
        if q[-1] <= self.n and (np.diff(q) == 1).all():  # neighbours, which need no gathering
            byte = lambda i: self.padded[at[0] + i : at[-1] + i + 1]
        else:
            byte = lambda i: self.padded[at + i]
        low, high = np.zeros(len(q), np.int32), np.zeros(len(q), np.int32)
        for j in range(-w, 0):
            low += byte(j)
            high += low  # the first byte counts w times, the last once
        first = np.full(len(q), w)
        for k in range(w):
            value = (low & 0xFFFF) | (high << 16)
            found = np.flatnonzero(value - value // self.divisor * self.divisor == self.divisor - 1)  # few
            found = found[(value[found] >= 0) & (q[found] + k < self.n) & (first[found] == w)]
            first[found] = k
            gone = byte(k - w).astype(np.int32)
            low += byte(k + 1)
            low -= gone
            high += low
            high -= w * gone
        return first

    def walk(self, start: int, until: int) -> list[int]:
        """The start of each chunk from ``start`` on that begins before ``until``, and the last one's end."""
        out = [start]
        while out[-1] < min(until, self.n):
            out.append(int(self.ends(np.array([out[-1]]))[0]))
        return out

    def transfer(self, until: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a first chunk that begins at any of the ``most`` first bytes: where the first chunk beyond ``until`` begins, counted from there, and how many begin before.

        In pieces: the first start of each, the place for it, by how much the place grows with the start (0 or 1), and the number.
        """
        seen = np.zeros(until, bool)
        new, starts, ends = np.arange(self.most), [], []
        while len(new):
            seen[new] = True
            starts.append(new)
            ends.append(self.ends(new))
            new = np.unique(ends[-1])
            new = new[new < until]
            new = new[~seen[new]]
        starts, ends = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(starts)
        starts, ends = starts[order], ends[order]
        inside = ends < until
        jump = np.where(inside, np.searchsorted(starts, ends), np.arange(len(starts)))
        count = inside.astype(np.int64)
        while (jump[jump] != jump).any():
            count += count[jump]
            jump = jump[jump]
        place, count = ends[jump][: self.most] - until, count[: self.most] + 1
        grows = np.diff(place, append=place[-1])
        breaks = np.ones(self.most, bool)
        breaks[1:] = (count[1:] != count[:-1]) | (grows[:-1] < 0) | (grows[:-1] > 1)
        breaks[2:] |= grows[1:-1] != grows[:-2]
        first = np.flatnonzero(breaks)
        length = np.diff(first, append=self.most)
        return first, place[first], np.where(length > 1, grows[first], 0), count[first]


def stored_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the files below ``folder``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def read_range(path: str, start: int, length: int) -> bytes:
    """Bytes of a file; fewer than ``length`` are an error."""
    fs, at = file_system(path)
    with fs.open_input_file(at) as f:
        f.seek(start)
        data = f.read(length)
    if len(data) < length:
        raise OSError(f"{path} has less than {start + length} bytes")
    return data


def _blocks(files: DataFrame, block: int) -> DataFrame:
    """file_id, path, length, block, last: a row for each block of each file that isn't empty."""
    rows = files.where("length > 0").select("file_id", "path", F.col("length").cast("bigint").alias("length"))
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, (length - 1) div {block})")))
    return rows.withColumn("last", F.expr(f"block = (length - 1) div {block}"))


def _spread(rows: DataFrame) -> DataFrame:
    """Blocks over all tasks. By a hash, as Spark takes a join's own partitions for those of its keys, and merges them since they have few bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("file_id", "block"))


def tttd_file_chunks(files: DataFrame, average: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """file_id, num, checksum, size, data of the content-defined chunks of ``files`` (file_id, path, length), as ``chunks.tttd_chunks`` cuts them.

    ``file_id`` says which file it is and isn't null. The result doesn't depend on ``block``, which has to hold a largest chunk. A file of one block is read once, others twice.
    An empty file has no chunk; a null length or path counts as none.
    """
    most = tttd_sizes(average)[1]
    if block < most:
        raise ValueError(f"a block of {block} bytes is shorter than a chunk of {most}")
    kind = files.schema["file_id"].dataType.simpleString()
    rows = _blocks(files.where("path is not null"), block)

    def load(r) -> Block:
        start = r.block * block
        return read_range(r.path, start, min(block + most, r.length - start))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                pieces = Block(load(r), average).transfer(block)
                yield pd.DataFrame({"file_id": [r.file_id], "block": [r.block], **{k: [v] for k, v in zip(("at", "place", "grows", "n"), pieces, strict=True)}})

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        out, entry, num = [], 0, 0
        for r in g.sort_values("block").itertuples():
            i = int(np.searchsorted(r.at, entry, side="right")) - 1
            entry, num = int(r.place[i] + r.grows[i] * (entry - r.at[i])), num + int(r.n[i])
            out.append((r.file_id, r.block + 1, entry, num))
        return pd.DataFrame(out, columns=["file_id", "block", "entry", "before"])

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                data = load(r)
                at = Block(data, average).walk(int(r.entry), block)
                yield pd.DataFrame({"file_id": r.file_id, "num": np.arange(r.before, r.before + len(at) - 1), "data": [data[i:j] for i, j in zip(at, at[1:])]})

    tables = _spread(rows.where("not last")).mapInPandas(tell, f"file_id {kind}, block long, at array<long>, place array<long>, grows array<long>, n array<long>")
    entries = tables.groupBy("file_id").applyInPandas(scan, f"file_id {kind}, block long, entry long, before long")
    placed = rows.join(entries, ["file_id", "block"], "left").fillna(0, ["entry", "before"])
    out = _spread(placed).mapInPandas(divide, f"file_id {kind}, num int, data binary")
    return out.select("file_id", "num", F.sha1("data").alias("checksum"), F.octet_length("data").cast("bigint").alias("size"), "data")


def file_sums(files: DataFrame, part: int = 8 << 20) -> DataFrame:
    """``files`` with ``checksum``, the SHA-1 of each ``path``'s content, which is read as a stream of ``part`` bytes at a time; a null path has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(checksum=[None if p is None else _sha1(p, part) for p in b["path"]])

    return files.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, checksum string")


def _sha1(path: str, part: int) -> str:
    fs, at = file_system(path)
    digest = hashlib.sha1()
    with fs.open_input_stream(at) as f:
        while data := f.read(part):
            digest.update(data)
    return digest.hexdigest()
