"""Helpers shared by the operators: shared storage, Arrow mapping, word hashing, salted joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut as saved
from ..session import fresh_path, shared_dir

__all__ = ["checkpointed", "documents", "filter_text", "fresh_path", "heavy_lookup", "large", "map_text", "mix", "offsets", "raw_bytes", "salted_lookup", "saved", "slices", "texts", "words"]

#: Text handled at once inside a task; a longer document is handled alone.
SLICE_BYTES = 2 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint. It goes when the application ends, or once nothing refers to it where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, which a cluster should do.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, null text as empty; other columns can't clash with what an operator adds."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a large_string array with about ``limit`` bytes each, one row at least."""
    off = offsets(arr)
    n, i = len(arr), 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def offsets(arr: pa.Array) -> np.ndarray:
    return np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]


def raw_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and the offset of each row in them."""
    off = offsets(arr)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def large(arr: pa.Array) -> pa.Array:
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    arr = arr.cast(pa.large_string())
    return arr.fill_null("") if arr.null_count else arr


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], fields: str, limit: int = SLICE_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and those that ``make()(texts)`` gives for each slice of texts, without a shuffle.

    ``make`` runs once in a task and returns the function, so tables and caches are set up once.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(fields).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            text = large(b.column("text"))
            for i, j in slices(text, limit):
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), *fn(text.slice(i, j - i))], names=names)

    return df.select(*keep, "text").mapInArrow(run, schema)


def filter_text(df: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray]], text_col: str = "text") -> DataFrame:
    """Rows whose text ``make()`` marks true, every column as it was; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            text = large(b.column(at))
            keep = [fn(text.slice(i, j - i)) for i, j in slices(text)]
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return df.mapInArrow(run, df.schema)


# --- words -----------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(arr: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all rows in one flat pass.

    Returns bytes, start and end of each word in them, a 64-bit hash of each word
    (A-Z as a-z if ``lower``), and the first word of each row plus the word count at the end.
    """
    data, off = raw_bytes(arr)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return data, z, z, np.zeros(0, np.uint64), np.zeros(len(arr) + 1, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    first = np.searchsorted(starts, off)
    if not len(starts):
        return data, starts, ends, np.zeros(0, np.uint64), first
    lengths = ends - starts
    power = np.full(int(lengths.max()), _STEP)
    power[0] = 1
    power = np.cumprod(power)
    at = np.flatnonzero(solid)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    value = _BYTE[(_LOWER[data] if lower else data)[at]] * power[place]
    return data, starts, ends, mix(np.add.reduceat(value, begin) + lengths.astype(np.uint64)), first


# --- joins -----------------------------------------------------------------

SALTS = 16


def salted_lookup(big: DataFrame, small: DataFrame, key: str, salt: F.Column, salts: int = SALTS) -> DataFrame:
    """Left join of ``big`` with ``small``, unique on ``key``, for keys that may hold a large share of ``big``.

    A key's rows are dealt over ``salts`` tasks by ``salt``; ``small`` is repeated as often, so pass only rows that say something.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def heavy_lookup(big: DataFrame, small: DataFrame, key: str, least: int = 256, bound: int = 10_000) -> DataFrame:
    """Left join of ``big`` with ``small``, unique on ``key`` (never null), where most keys of ``small`` have a few rows of ``big``.

    Keys with more than 1 in ``bound`` of the rows (and than ``least``) are ``bound`` at most: their rows of
    ``small`` are broadcast. The other keys, none of them large, are joined by a shuffle. Pass inputs that are cheap to read twice.
    """
    counts = big.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > max(least, total // bound)).select(key)
    hot_small = small.join(F.broadcast(hot), key).withColumn("_hot", F.lit(True))
    rows = big.join(F.broadcast(hot_small), key, "left")
    rest = rows.where("_hot is null").select(*big.columns).join(small, key, "left")
    return rows.where("_hot").select(*rest.columns).unionByName(rest)
