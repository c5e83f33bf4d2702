"""Quality by hierarchical empirical Bayes: a document's own evidence and what its site and path show.

1. A logistic model over a text's hashed byte trigrams and its shape (symbols, shouting, repetition, ...), fitted on a bounded
   sample of labelled documents, gives each document its log-odds.
2. Grouped sums of the probabilities by path, by host and over all give each level's mean. The
   strength of a prior is estimated from the spread between groups beyond what sampling explains
   (method of moments), so a path is drawn towards its host and a host towards all by as much as is due:
   a sparse one nearly whole, a large one hardly.
3. The path's posterior, without the document itself, shifts the document's log-odds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, large, mix, raw_bytes, salted_lookup, slices
from .toxicity import labelled_rows, newton, held_out

_LETTERS = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_NOISE = re.compile(r"[#%&$*@^~=<>]{2,}$")
_PARTS = ("log_words", "word_length", "noise", "shouts", "bars", "adjacent", "dup_lines", "upper", "digits", "symbols", "distinct", "top_word")
#: Of each share, besides itself, whether it is over these.
_STEPS = (0.05, 0.2, 0.5)
#: Buckets that trigrams are hashed to.
GRAMS = 256
N_FEATURES = len(_PARTS) * (1 + len(_STEPS)) + GRAMS


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows of a fit (drawn by a hash of the id); ``weakest`` and ``strongest`` bound a prior in documents."""

    max_rows: int = 20_000
    ridge: float = 0.3
    threshold: float = 0.5
    weakest: float = 2.0
    strongest: float = 10_000.0


@dataclass(frozen=True)
class Model:
    bias: float
    weights: tuple[float, ...]

    def log_odds(self, shapes: np.ndarray) -> np.ndarray:
        return np.clip(shapes @ np.array(self.weights) + self.bias, -30, 30)


def shape(text: str) -> list[float]:
    """The numbers of ``_PARTS`` of a whole text; all 0 without words."""
    w = text.split()
    if not w:
        return [0.0] * len(_PARTS)
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for x in w:
        counts[x] = counts.get(x, 0) + 1
    letters = len(_LETTERS.findall(text))
    digits = sum(map(text.count, "0123456789"))
    return [
        math.log1p(n) / 10,
        min(chars / n, 20) / 20,
        sum(c for x, c in counts.items() if _NOISE.search(x)) / n,
        sum(c for x, c in counts.items() if x.endswith("!!")) / n,
        text.count("|") / n,
        sum(a == b for a, b in zip(w, w[1:])) / n,
        1 - len(set(lines)) / len(lines),
        len(_UPPER.findall(text)) / max(letters, 1),
        digits / chars,
        (chars - letters - digits) / chars,
        1 - len(counts) / n if n >= 50 else 0.0,
        max(counts.values()) / n if n >= 20 else 0.0,
    ]


def grams(arr: pa.Array, rows: int = 1024) -> np.ndarray:
    """The root of the share of each bucket among the trigrams of bytes (A-Z as a-z) of each text; all 0 for fewer than 3 bytes."""
    out = np.zeros((len(arr), GRAMS), np.float32)
    for i in range(0, len(arr), rows):
        data, off = raw_bytes(arr.slice(i, rows))
        n, low = len(off) - 1, np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
        if len(low) < 3:
            continue
        bucket = (mix(low[:-2] | low[1:-1] << np.uint64(8) | low[2:] << np.uint64(16)) % np.uint64(GRAMS)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(off))
        same = row[:-2] == row[2:]  # no trigram crosses texts
        counts = np.bincount(row[:-2][same] * GRAMS + bucket[same], minlength=n * GRAMS).reshape(n, GRAMS)
        out[i : i + n] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    return out


def shapes(arr: pa.Array) -> np.ndarray:
    """The features of texts (large_string without nulls): shape, whether it is over the steps, trigrams."""
    base = np.array([shape(t) for t in arr.to_pylist()], np.float32).reshape(-1, len(_PARTS))
    return np.hstack([base, *(base > s for s in _STEPS), grams(arr)]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "quality") -> Model:
    """A model from rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0/1) marks and that aren't held out.

    Repeated label rows count once, the largest label; null labels are ignored. With one class or none
    the model is the smoothed share of label 1. At most about ``max_rows`` rows reach the driver, as numbers.
    """
    rows = labelled_rows(docs, labels, label_col, settings.max_rows).select("label", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = large(b.column(1))
            for i, j in slices(text):
                x = shapes(text.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    # max_rows rows of about a kilobyte at most; sorted here so that a fit is repeatable
    seen = sorted((r["label"], bytes(r["x"])) for r in rows.mapInArrow(run, "label int, x binary").collect())
    y = np.array([label for label, _ in seen], float)
    if not 0 < y.sum() < len(y):
        return Model(math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), (0.0,) * N_FEATURES)

    def blocks(size: int = 1024) -> Iterator[tuple[np.ndarray, slice]]:
        for at in range(0, len(seen), size):
            part = np.frombuffer(b"".join(x for _, x in seen[at : at + size]), np.float32).reshape(-1, N_FEATURES)
            yield np.hstack([np.ones((len(part), 1)), part]), slice(at, at + size)

    w = newton(blocks, y, np.ones(len(y)), np.zeros((N_FEATURES,) * 2), settings.ridge)
    return Model(float(w[0]), tuple(map(float, w[1:])))


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path (null as empty), z (log-odds of the document by itself) and p, its probability."""
    rows = docs.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = large(b.column(3))
            z = [model.log_odds(shapes(text.slice(i, j - i))) for i, j in slices(text)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.concatenate(z) if z else np.zeros(0))], names=["doc_id", "host", "path", "z"])

    out = rows.mapInArrow(run, f"doc_id {id_type}, host string, path string, z double")
    return out.withColumn("p", 1 / (1 + F.exp(-F.col("z"))))


def _strength(total: float, n: float, between: float, within: float, settings: Settings) -> float:
    """Prior strength in documents, from sums over groups of n * (mean - upper mean)**2 and of the sampling variance."""
    if not n:
        return settings.strongest
    mean = total / n
    spread = (between - within) / n
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else settings.strongest
    return min(max(strength, settings.weakest), settings.strongest)


def site_quality(docs: DataFrame, model: Model, host: Column, path: Column, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score (0 to 1), kept (score at or over the threshold), evidence (log-odds), host_posterior, path_posterior.

    ``host`` and ``path`` are columns of ``docs`` (doc_id, text, ...); null counts as a site of its own, empty. A null text
    is an empty one. A document alone in its path has its host's posterior, one alone in its host the mean of all.
    Repeated rows count each; an empty table gives an empty result.
    """
    rows = checkpointed(evidence(docs, model, host, path))
    sums = (F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = checkpointed(rows.groupBy("host", "path").agg(*sums))
    hosts = checkpointed(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))))
    n, s = (x or 0 for x in hosts.agg(F.sum("n"), F.sum("s")).first())
    mean = s / n if n else 0.5
    mean = min(max(mean, 1e-3), 1 - 1e-3)

    def moments(groups: DataFrame, upper: Column) -> tuple[float, float]:
        own = F.col("s") / F.col("n")
        within = F.greatest(F.col("ss") / F.col("n") - own * own, F.lit(0.0))
        r = groups.agg(F.sum(F.col("n") * (own - upper) ** 2).alias("b"), F.sum(within).alias("w")).first()
        return r["b"] or 0.0, r["w"] or 0.0

    of_hosts = _strength(s, n, *moments(hosts, F.lit(mean)), settings)
    below = paths.join(hosts.select("host", (F.col("s") / F.col("n")).alias("upper")), "host")
    of_paths = _strength(s, n, *moments(below, F.col("upper")), settings)

    # groups of one document say nothing of it but what it says itself
    rows = salted_lookup(rows.withColumn("at", F.struct("host", "path")), paths.where("n > 1").select(F.struct("host", "path").alias("at"), F.col("n").alias("path_n"), F.col("s").alias("path_s")), "at", F.col("doc_id"))
    rows = salted_lookup(rows, hosts.where("n > 1").select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host", F.col("doc_id"))
    posterior = lambda level, strength, prior: (strength * prior + F.coalesce(F.col(f"{level}_s") - F.col("p"), F.lit(0.0))) / (strength + F.coalesce(F.col(f"{level}_n") - 1, F.lit(0)))
    rows = rows.withColumn("host_posterior", posterior("host", F.lit(of_hosts), F.lit(mean)))
    rows = rows.withColumn("path_posterior", posterior("path", F.lit(of_paths), F.col("host_posterior")))
    share = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("path_posterior")))
    z = F.col("z") + F.log(share / (1 - share)) - F.lit(math.log(mean / (1 - mean)))
    rows = rows.withColumn("score", F.round(1 / (1 + F.exp(-z)), 9))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= settings.threshold).alias("kept"), F.col("z").alias("evidence"), "host_posterior", "path_posterior")
