"""Content-addressed chunks: cutting, deduplication, packing into containers, reassembly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .splits import numbered, part_numbers

# Default sizes in bytes, and the ratios of content-defined cutting to the average of 1015.
CHUNK, CONTAINER, COMMIT_BYTES, COMMIT_FILES = 512 * 1024, 4096 * 1024, 50 << 20, 10_000
TTTD_MIN, TTTD_MAX, TTTD_DIVISOR, TTTD_UNIT, TTTD_WINDOW = 460, 2800, 540, 1015, 48


def fixed_chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """file_id, num, checksum, size, data of ``files`` (file_id, content binary) in slices of ``size`` bytes; an empty file has none."""
    starts = F.expr(f"sequence(0, (octet_length(content) - 1) div {size})")
    rows = files.where("octet_length(content) > 0").select("file_id", "content", F.explode(starts).alias("num"))
    data = F.substring("content", F.col("num") * size + 1, F.lit(size))
    return rows.select("file_id", F.col("num").cast("int").alias("num"), data.alias("data")).select("file_id", "num", F.sha1("data").alias("checksum"), F.octet_length("data").cast("bigint").alias("size"), "data")


def tttd_sizes(average: int) -> tuple[int, int, int]:
    """Least and largest size of a content-defined chunk, and the divisor."""
    least, most, divisor = (math.floor(x * average / TTTD_UNIT + 0.5) for x in (TTTD_MIN, TTTD_MAX, TTTD_DIVISOR))
    if least < TTTD_WINDOW:
        raise ValueError(f"chunks of {average} bytes are shorter than the window of {TTTD_WINDOW}")
    return least, most, divisor


def window_hits(seen: np.ndarray, divisor: int) -> np.ndarray:
    """Whether the rolling sum of each window of ``TTTD_WINDOW`` signed bytes (along the last axis, by its start) has the divisor's last remainder.

    The sum is a signed 32-bit number of two halves, so only a positive one can have that remainder.
    """
    w, seen = TTTD_WINDOW, seen.astype(np.int64)
    zero = np.zeros((*seen.shape[:-1], 1), np.int64)
    one = np.concatenate([zero, np.cumsum(seen, -1)], -1)
    two = np.concatenate([zero, np.cumsum(seen * np.arange(seen.shape[-1]), -1)], -1)
    low = one[..., w:] - one[..., :-w]
    high = (w + np.arange(low.shape[-1])) * low - (two[..., w:] - two[..., :-w])
    value = ((low & 0xFFFF) | (high << 16)) & 0xFFFFFFFF
    return (value < 1 << 31) & (value % divisor == divisor - 1)


def tttd_cuts(data: bytes, average: int) -> list[int]:
    """Ends of content-defined chunks: where the rolling sum over ``TTTD_WINDOW`` bytes has the divisor's last remainder, past the least size, at the largest size at the latest.

    The sum starts with the window before the byte at the least size, and that byte never enters it. An empty file has no chunk.
    """
    least, most, divisor = tttd_sizes(average)
    x = np.frombuffer(data, np.int8)
    cuts, start, w = [], 0, TTTD_WINDOW
    while start < len(x):
        part = x[start : start + most]
        cut = len(part)
        if len(part) > least:
            hits = np.flatnonzero(window_hits(np.concatenate([part[least - w : least], part[least + 1 :]]), divisor))
            cut = least + int(hits[0]) + 1 if len(hits) else cut
        start += cut
        cuts.append(start)
    return cuts


def tttd_chunks(files: DataFrame, average: int = CHUNK) -> DataFrame:
    """As ``fixed_chunks``, cut by content."""
    kind = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, data in zip(b["file_id"], b["content"], strict=True):
                ends = tttd_cuts(bytes(data), average)
                starts = [0, *ends[:-1]]
                yield pd.DataFrame({"file_id": key, "num": range(len(ends)), "data": [bytes(data[i:j]) for i, j in zip(starts, ends, strict=True)]})

    rows = files.where("octet_length(content) > 0").select("file_id", "content").mapInPandas(run, f"file_id {kind}, num int, data binary")
    return rows.select("file_id", "num", F.sha1("data").alias("checksum"), F.octet_length("data").cast("bigint").alias("size"), "data")


def new_chunks(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """The first occurrence (by file_id, num) of each chunk that ``known`` (checksum) doesn't have."""
    first = chunks.groupBy("checksum").agg(F.min(F.struct("file_id", "num", "size")).alias("f")).select("checksum", "f.*")
    return first.join(known.select("checksum"), "checksum", "left_anti")


def _packing(chunks: DataFrame, size: int, by: str) -> DataFrame:
    """``by``, file_id, num, checksum, size, container and offset in it (by checksum) of each chunk; nothing else of them than sizes and names is moved."""
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["file_id", "num", "checksum"])
        g["container"] = part_numbers(g["size"].to_numpy(), size).astype(np.int32)
        g = g.sort_values(["container", "checksum"])
        g["offset"] = g.groupby("container")["size"].cumsum() - g["size"]
        return g

    schema = ", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys((by, "file_id", "num", "checksum"))) + ", size long, container int, offset long"
    rows = chunks.select(*dict.fromkeys((by, "file_id", "num", "checksum")), F.col("size").cast("bigint").alias("size"))
    return rows.groupBy(by).applyInPandas(pack, schema)


def pack_containers(chunks: DataFrame, size: int = CONTAINER, by: str = "commit") -> DataFrame:
    """checksum and container number within its commit: a container is closed once it has ``size`` bytes, before the next chunk.

    The last chunk may go over. A commit is bounded (``COMMIT_BYTES``, ``COMMIT_FILES``), so its chunks meet in a task; nothing else of them than sizes and names does.
    """
    return _packing(chunks, size, by).select(by, "checksum", "container")


def container_files(chunks: DataFrame, size: int = CONTAINER, by: str = "commit") -> DataFrame:
    """``by``, container, content and entries (checksum, offset, size) of the containers that ``pack_containers`` fills from chunks with their ``data``.

    A container has ``size`` bytes and one chunk at most, so it fits a row. Places come from sizes alone, and each chunk's data moves to its container once.
    """
    at = [by, "file_id", "num"]
    placed = _packing(chunks.drop("data"), size, by).join(chunks.select(*at, "checksum", "data"), [*at, "checksum"])
    placed = placed.select(by, "container", "data", F.struct("checksum", "offset", "size").alias("entry")).repartition(by, "container")
    return placed.groupBy(by, "container").agg(F.expr("listagg(data) within group (order by entry.checksum)").alias("content"), F.array_sort(F.collect_list("entry")).alias("entries"))


def stored_chunks(containers: DataFrame, wanted: DataFrame) -> DataFrame:
    """checksum, data of the ``wanted`` chunks (checksum) out of ``container_files``; of several places of a chunk one counts.

    Chunks are taken out where their container lies, so a container's content isn't moved once for each of them.
    """
    each = F.transform("entries", lambda e: F.struct(e["checksum"].alias("checksum"), F.substring(F.col("content"), (e["offset"] + 1).cast("int"), e["size"].cast("int")).alias("data")))
    rows = containers.select(F.explode(each).alias("e")).select("e.*")
    return rows.join(wanted.select("checksum").distinct(), "checksum", "left_semi").dropDuplicates(["checksum"])


def running(df: DataFrame, by: str, order: str, ties: list[str], value: str, descending: bool = False, ranges: int = 256) -> DataFrame:
    """``df`` with _sum and _n: the sum of ``value`` and the number of rows of the same ``by`` before each row, by ``order`` and ``ties``; rows without an ``order`` come first, last if ``descending``.

    In two levels, so a group of any size is spread: rows are cut into ranges at quantiles of ``order`` (a number or time), and the totals of the ranges
    before are added to the sums inside a range. A group's totals are ``ranges`` rows at most.
    """
    cuts = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    below = F.size(F.filter(F.array(*[F.lit(c).cast(df.schema[order].dataType) for c in dict.fromkeys(cuts)]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = df.withColumn("_range", F.when(F.col(order).isNull(), 1 if descending else -1).otherwise(-below if descending else below))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, "_range").agg(F.sum(value).alias("_s"), F.count("*").alias("_c"))
    totals = totals.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"))
    inside = Window.partitionBy(by, "_range").orderBy(F.desc(order) if descending else F.asc(order), *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_in": F.coalesce(F.sum(value).over(inside), F.lit(0)), "_nth": F.count("*").over(inside)})
    rows = rows.join(totals, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    return rows.select(*df.columns, (F.col("_s0") + F.col("_in")).alias("_sum"), (F.col("_c0") + F.col("_nth")).alias("_n"))


def commit_numbers(files: DataFrame, order: str = "file_id", most_bytes: int = COMMIT_BYTES, most_files: int = COMMIT_FILES, by: str = "client") -> DataFrame:
    """``files`` (client, file_id, size) with the commit each falls into: a client's commit ends with the file that brings it to ``most_bytes`` or ``most_files``."""
    return numbered(files, by, [order], "size", most_bytes, most_files, "commit")


def assemble(refs: DataFrame, chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file_id and content from ``refs`` (file_id, num, checksum) and stored ``chunks`` (checksum, data).

    A missing chunk is an error, and one whose data doesn't have its checksum. With ``files`` (file_id, checksum; null or no chunk: empty) each of them gives a row,
    and content that doesn't have the file's checksum is an error. A content lies in one row, as it does in ``files``.
    """
    rows = refs.join(chunks.select("checksum", "data"), "checksum", "left")
    fail = lambda text, *cols: F.raise_error(F.concat(F.lit(text), *cols)).cast("binary")
    data = F.when(F.col("data").isNull(), fail("missing chunk ", "checksum")).when(F.sha1("data") != F.col("checksum"), fail("damaged chunk ", "checksum")).otherwise(F.col("data"))
    lists = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("num", data.alias("data")))).alias("p"))
    out = lists.select("file_id", F.aggregate(F.col("p.data"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("content"))
    if files is None:
        return out
    out = files.select("file_id", F.col("checksum").alias("_sum")).join(out, "file_id", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    wrong = F.col("_sum").isNotNull() & (F.sha1("content") != F.col("_sum"))
    return out.select("file_id", F.when(wrong, fail("damaged content ", "_sum")).otherwise(F.col("content")).alias("content"))


def within_budget(files: DataFrame, budget: int, newest: str = "lastmodified", by: str = "cache") -> DataFrame:
    """Cached files (cache, path, size, lastmodified) that stay: from the newest on, while the sum of sizes is ``budget`` at most."""
    rows = running(files, by, newest, ["path"], "size", descending=True)
    return rows.where(F.col("_sum") + F.col("size") <= budget).drop("_sum", "_n")
