"""Importance resampling towards a target: hashed n-grams of a document against those of the target's texts.

A document's features become a packed stream of 16-bit buckets, stored once with the documents' offsets. Counts are an external
sort: each stored stream is sorted and run-length encoded, a task adds up its runs, and Spark adds up the tasks. The gain of each
bucket follows from the counts of both sides; the stored streams are read again, gains gathered and summed by document with
``np.add.reduceat``. Gumbel noise by id makes the highest scores a sample in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import in_order
from .common import large, raw_bytes, saved, slices, texts
from .crc import appended, bounds, crc32_of, joined

BUCKETS, MAX_GRAM, SEED, PERCENT, MIN_WORDS = 10_000, 3, 42, 5, 20
#: Share of the rows by which the first cut lies below the drawn ones, and the ranks in which that cut is off at most: 1 in so many.
SLACK, ACCURACY = 0.01, 10_000
#: Text of a stored stream, small enough for a row that an executor's heap takes in its stride; a longer document is a row of its own.
STREAM_BYTES = 256 << 10

_SOLID = np.array([chr(b).isalnum() or b >= 0x80 for b in range(128)] + [True] * 128)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bucket_stream(arr: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the rows of a large_string array, one row's after the other's; where each row's begin, and the end; words of each row.

    A word is a run of letters and digits of ASCII and of whatever lies beyond, A-Z as a-z; a feature is a run of 1 to ``MAX_GRAM`` words.
    """
    data, off = raw_bytes(arr)
    data = _LOWER[data]
    starts, ends, first = bounds(data, off, _SOLID)
    n_words, lengths = np.diff(first), ends - starts
    one = crc32_of(data, starts, ends)
    last = np.repeat(first[1:], n_words)  # where the row of each word ends
    grams, valid = np.zeros((len(one), MAX_GRAM), np.uint16), np.zeros((len(one), MAX_GRAM), bool)
    value = one
    for k in range(MAX_GRAM):
        if k:
            value = joined(appended(value[:-1], 0x20), one[k:], lengths[k:])
        m = len(value)
        grams[:m, k] = value % np.uint32(buckets)
        valid[:m, k] = np.arange(m) + k < last[:m]
        if not m:
            break
    begin = np.concatenate([[0], np.cumsum(valid.sum(1))])[first]
    return grams[valid], begin, n_words


def streams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Of ``docs`` (doc_id, text), a row for each slice: ids, n_words and starts of its documents, and the packed stream."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has 16 bits")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL("n_words array<long>, starts array<long>, stream binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = large(b.column("text"))
            for i, j in slices(text, STREAM_BYTES):
                stream, begin, n_words = bucket_stream(text.slice(i, j - i), buckets)
                lists = [b.column("doc_id").slice(i, j - i), pa.array(n_words), pa.array(begin[:-1])]
                yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays([0, j - i], x) for x in lists), pa.array([stream.astype("<u2").tobytes()], pa.binary())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bucket_counts(stored: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket, from stored streams; ``buckets`` numbers come from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for packed in b.column(0):
                run_ = np.sort(np.frombuffer(packed.as_buffer(), "<u2"), kind="stable")
                heads = np.flatnonzero(np.concatenate([np.ones(min(len(run_), 1), bool), run_[1:] != run_[:-1]]))
                total[run_[heads]] += np.diff(np.append(heads, len(run_)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    found = stored.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket at most
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier each bucket is in the target), with one more in each bucket of both sides."""
    k, all_docs, all_target = len(of_docs), int(of_docs.sum()), int(of_target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_docs + k) / (float(s + 1) * float(all_target + k)))) for s, t in zip(of_docs.tolist(), of_target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """floor(1000 * a Gumbel variate) that follows from the id; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(stored: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of the stored documents; nothing is shuffled."""
    kind = stored.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("n_words long, n_features long, weight long, score long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, n_words, starts, packed in zip(*b.columns, strict=True):
                stream, begin = np.frombuffer(packed.as_buffer(), "<u2"), starts.values.to_numpy(zero_copy_only=False)
                n = np.diff(np.append(begin, len(stream)))
                weight, some = np.zeros(len(n), np.int64), n > 0
                if some.any():
                    weight[some] = np.add.reduceat(gain[stream], begin[some])
                score = weight + np.array([noise(x, seed) for x in ids.values.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, n_words.values, pa.array(n), pa.array(weight), pa.array(score)], names=schema.names)

    return stored.select("ids", "n_words", "starts", "stream").mapInArrow(run, schema)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``, drawn towards the texts of ``target``.

    Of the rows with ``min_words`` words or more the ``percent`` percent (rounded down) with the highest scores get a rank 1, 2, ..., ties to the
    smaller id; the others get none. A null or empty text has no feature and a weight of 0; a null id takes the noise of an empty one and
    comes first among ties. Repeated rows are rows of their own with equal scores. Other columns are ignored; an empty table gives an
    empty result, and an empty target leaves the weights to the counts of ``docs`` alone.
    """
    stored = saved(streams(texts(docs, id_col, text_col), buckets), "streams")
    of_target = bucket_counts(streams(texts(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text"))), buckets), buckets)
    rows = saved(weighed(stored, gains(bucket_counts(stored, buckets), of_target), seed), "weights")
    able = rows.where(F.col("n_words") >= min_words)
    low = max(0.0, 1 - percent / 100 - SLACK)
    n, cut = able.agg(F.count("*"), F.percentile_approx("score", low, ACCURACY)).first()
    drawn = percent * n // 100
    high = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(cut if cut is not None else 0))
    ranked = in_order(rows.where(high), F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~high).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
