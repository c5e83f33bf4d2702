"""Toxicity classifier, regularised by counterfactuals.

A logistic model over the presence of words and word beginnings, fitted on labelled documents. Where a labelled
sentence names an identity, the term is swapped for the others of its group, and the squared change
of the sentence's score before the sigmoid is added to the loss. A group that is merely mentioned
more often in toxic documents then doesn't raise the score of a neutral mention.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, checkpointed, filter_text, large, map_text, mix, texts

_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6, 7, 8)
_SENTENCE = re.compile(r"[.!?\n]+")

# Identity terms; a term is swapped for the others of its line.
IDENTITY_GROUPS = [
    "women men girls boys",
    "woman man girl boy",
    "female male transgender nonbinary",
    "gay lesbian straight bisexual queer heterosexual homosexual",
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "black white asian latino hispanic african european arab",
    "immigrants refugees foreigners citizens natives",
    "disabled blind deaf autistic",
    "old young elderly teenage",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus buddhisten atheisten",
    "ausländer flüchtlinge einheimische",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous bouddhistes athées",
    "étrangers réfugiés immigrés citoyens",
    "mujeres hombres chicas chicos",
    "musulmanes cristianos judíos hindúes budistas ateos",
    "extranjeros refugiados inmigrantes ciudadanos",
]


def features(words: set[str]) -> set[str]:
    """The words, and their beginnings of 4 to 8 letters with a dash, so that inflected and compound forms count."""
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in _STEMS))


def features_of(text: str) -> set[str]:
    return features(set(_WORD.findall(text.lower())))


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows of a fit (drawn by a hash of the id), ``max_words`` the features.

    A feature is a word or beginning in ``min_documents`` labelled documents (by weight) whose split over the labels has a signed root
    likelihood ratio of ``min_evidence`` or more. ``max_cached`` bounds the words whose features a task keeps.
    """

    max_rows: int = 20_000
    max_words: int = 512
    min_documents: int = 3
    min_evidence: float = 4.0
    ridge: float = 0.1
    swap_penalty: float = 10.0
    max_cached: int = 200_000
    groups: tuple[str, ...] = field(default=tuple(IDENTITY_GROUPS))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str) -> float:
        return self.scorer()(text)

    def scorer(self, max_cached: int = Settings.max_cached) -> Callable[[str], float]:
        """A function from a text to its score that remembers which features a word gives."""
        names = list(self.weights)
        place, weights = {w: i for i, w in enumerate(names)}, [self.weights[w] for w in names]
        heads = {w[:4] for w in names}  # a word gives features that begin as it does
        cache: dict[str, tuple[int, ...]] = {}

        def score(text: str) -> float:
            hits: set[int] = set()
            for w in set(_WORD.findall(text.lower())):
                if w[:4] not in heads:
                    continue
                own = cache.get(w)
                if own is None:
                    if len(cache) >= max_cached:
                        cache.clear()
                    own = cache[w] = tuple(place[f] for f in features({w}) if f in place)
                hits.update(own)
            z = self.bias + math.fsum(weights[i] for i in hits)
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shingle_key(text: str) -> int:
    """The smallest hash of three words in a row, which most near copies have in common; of fewer words, a hash of all."""
    w = [zlib.crc32(x.encode()) for x in _WORD.findall(text.lower())]
    grams = np.array([w[k : len(w) - 2 + k] for k in range(3)], np.uint64) if len(w) > 2 else np.array([[sum(w)], [0], [0]], np.uint64)
    return int(mix(grams[0] + mix(grams[1] + mix(grams[2] + np.uint64(1)))).min() >> np.uint64(1))


def _weighted(rows: DataFrame) -> DataFrame:
    """text, label, weight: 1 / n for n rows with the same ``shingle_key``, so that copies of a text count as one document in all.

    No row is left out, and copies with different labels count for each label by their share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingle_key(t) for t in large(b.column(0)).to_pylist()], pa.int64())], names=["text", "label", "key"])

    keyed = rows.select(F.coalesce("text", F.lit("")).alias("text"), "label").mapInArrow(run, "text string, label int, key long")
    sizes = keyed.groupBy("key").agg((1 / F.count("*")).alias("weight"))
    return keyed.join(sizes, "key").select("text", "label", "weight")


def swap_changes(text: str, swaps: dict[str, list[str]], place: dict[str, int]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Features (numbers in ``place``) that each swap of a term in a sentence of ``text`` takes away and adds.

    A term goes with its beginnings, as ``features`` gives them; what the sentence's other words give as well stays.
    """
    low = text.lower()
    if not any(t in low for t in swaps):
        return
    for sentence in _SENTENCE.split(low):
        has = set(_WORD.findall(sentence))
        for t in has & swaps.keys():
            rest = features(has - {t})
            before = features({t}) - rest
            for o in swaps[t]:
                after = features({o}) - rest
                yield tuple(tuple(sorted(place[w] for w in x if w in place)) for x in (before - after, after - before))


def _counts(rows: DataFrame) -> DataFrame:
    """kind, word, n, n_toxic: weight of the documents by word ('word'), of all documents ('all'); rows: text, label, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, int], float] = {}

        def flush() -> pa.RecordBatch:
            keys = sorted({k[:2] for k in seen})
            cols = list(zip(*keys, strict=True)) if keys else [[], []]
            toxic = [seen.get((*k, 1), 0.0) for k in keys]
            n = [seen.get((*k, 0), 0.0) + t for k, t in zip(keys, toxic, strict=True)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols] + [pa.array(x, pa.float64()) for x in (n, toxic)], names=names)

        for b in batches:
            for text, label, weight in zip(large(b.column(0)).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for w in features_of(text):
                    seen["word", w, label] = seen.get(("word", w, label), 0.0) + weight
                seen["all", "", label] = seen.get(("all", "", label), 0.0) + weight
            if len(seen) > 200_000:
                yield flush()
        yield flush()

    names = ["kind", "word", "n", "n_toxic"]
    sums = rows.mapInArrow(run, "kind string, word string, n double, n_toxic double").groupBy("kind", "word")
    # rounded, so that the order of a sum doesn't show
    return sums.agg(F.round(F.sum("n"), 6).alias("n"), F.round(F.sum("n_toxic"), 6).alias("n_toxic"))


def _dense(rows: list[tuple[list[int], float]], width: int) -> np.ndarray:
    """A column of ones, then the given value at the given places of each row."""
    x = np.zeros((len(rows), width + 1))
    x[:, 0] = 1
    for i, (hits, value) in enumerate(rows):
        x[i, [k + 1 for k in hits]] = value
    return x


def solve_sparse(hits: list[list[int]], width: int, y: np.ndarray, weight: np.ndarray, quad: np.ndarray, ridge: float, block: int = 1024) -> np.ndarray:
    """``solve`` for rows of ones at ``hits``: they are spread out ``block`` rows at a time, so memory doesn't follow the rows. ``quad``: the penalty's matrix, weights by weights."""

    def blocks() -> Iterator[tuple[np.ndarray, slice]]:
        for at in range(0, len(hits), block):
            yield _dense([(h, 1.0) for h in hits[at : at + block]], width), slice(at, at + block)

    return newton(blocks, y, weight, quad, ridge)


def newton(blocks: Callable[[], Iterator[tuple[np.ndarray, slice]]], y: np.ndarray, weight: np.ndarray, quad: np.ndarray, ridge: float) -> np.ndarray:
    """Bias and weights of a logistic model; ``blocks()`` gives the rows' features after a column of ones, and which rows they are, block by block."""
    width = len(quad) + 1
    fixed = np.diag(np.append(1e-6, np.full(width - 1, ridge)))
    fixed[1:, 1:] += quad
    w = np.zeros(width)
    for _ in range(30):
        grad, gram = fixed @ w, fixed.copy()
        for x, at in blocks():
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad += x.T @ (weight[at] * (p - y[at]))
            gram += (x * (weight[at] * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        step = np.linalg.solve(gram, grad)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def solve(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, settings: Settings, weight: np.ndarray | None = None) -> np.ndarray:
    """Bias and weights by Newton steps. ``swaps``: a row per swap, its change of features times the root of its share; the penalty counts as much as all rows' weight."""
    weight = np.ones(len(x)) if weight is None else weight
    quad = settings.swap_penalty * weight.sum() * (swaps.T @ swaps) if len(swaps) else np.zeros((x.shape[1],) * 2)
    whole = np.hstack([np.ones((len(x), 1)), x])
    return newton(lambda: iter([(whole, slice(None))]), y, weight, quad, settings.ridge)


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """text, label of the rows of ``docs`` that ``labels`` (doc_id, label 0/1) marks and that aren't held out.

    Repeated label rows count once, the larger label; null labels and ids are ignored. Of more than ``max_rows`` labelled ids about ``max_rows`` are drawn by a hash.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = marks.count()
    if total > max_rows:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    # about max_rows ids and labels at most, so a broadcast; the texts aren't shuffled
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label_col: str = "toxic") -> Model:
    """A model from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0/1) marks and that aren't held out.

    Repeated label rows count once, a document with any label 1 as 1; null labels are ignored, a null text is an empty one. Copies of a text share
    the weight of one document (``_weighted``). Without labelled rows, or with one class only, the model is the smoothed share of label 1. At most about ``max_rows`` rows,
    each reduced to which of ``max_words`` words it has, reach the driver, and the distinct changes that
    swaps make to those words: a term loses or gains its longest beginnings, so a pair of the lexicon has few.
    """
    rows = checkpointed(_weighted(labelled_rows(docs, labels, label_col, settings.max_rows)))  # read three times below
    groups = [g.split() for g in settings.groups]
    swaps = {t: [o for o in g if o != t] for g in groups for t in g}
    counts = checkpointed(_counts(rows))
    all_row = counts.where("kind = 'all'").first()
    n, n1 = (all_row["n"], all_row["n_toxic"]) if all_row else (0, 0)
    if not 0 < n1 < n:
        return Model(math.log((n1 + 0.5) / (n - n1 + 0.5)), {})
    rate = lambda k, of, share: F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)
    a, b, share = F.col("n_toxic"), F.col("n") - F.col("n_toxic"), F.col("n") / n
    ratio = rate(a, n1, share) + rate(b, n - n1, share) + rate(n1 - a, n1, 1 - share) + rate(n - n1 - b, n - n1, 1 - share)
    words = counts.where((F.col("kind") == "word") & (F.col("n") >= settings.min_documents) & (F.col("n") < n))
    words = words.withColumn("evidence", F.round(F.sqrt(F.greatest(2 * ratio, F.lit(0.0))), 6)).where(F.col("evidence") >= settings.min_evidence)
    vocab = [r["word"] for r in words.orderBy(F.col("evidence").desc(), "word").limit(settings.max_words).collect()]
    if not vocab:
        return Model(math.log((n1 + 0.5) / (n - n1 + 0.5)), {})
    place = {w: i for i, w in enumerate(vocab)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda hits: ",".join(map(str, hits))
        for b in batches:
            out = []
            for text, label, weight in zip(large(b.column(0)).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out.append(("row", label, join(sorted(place[w] for w in place.keys() & features_of(text))), "", weight))
                out += [("swap", 0, join(gone), join(new), n * weight) for (gone, new), n in Counter(swap_changes(text, swaps, place)).items()]
            cols = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "label", "hits", "new", "n"])

    # equal rows of features and equal swaps are summed, not repeated; ordered so that a fit is repeatable
    seen = rows.mapInArrow(present, "kind string, label int, hits string, new string, n double").groupBy("kind", "label", "hits", "new").agg(F.round(F.sum("n"), 6).alias("n"))
    seen = seen.orderBy("kind", "label", "hits", "new").collect()
    numbers = lambda hits: [int(k) for k in hits.split(",") if k]
    docs_seen, swaps_seen = ([r for r in seen if r["kind"] == kind] for kind in ("row", "swap"))
    weight = np.array([r["n"] for r in docs_seen], float)
    quad, of_all = np.zeros((len(vocab), len(vocab))), max(sum(r["n"] for r in swaps_seen), 1e-9)
    for r in swaps_seen:  # the sum of share * change change', on the places that change
        gone, new = numbers(r["hits"]), numbers(r["new"])
        at, sign = np.array(gone + new, int), np.array([-1.0] * len(gone) + [1.0] * len(new))
        quad[np.ix_(at, at)] += settings.swap_penalty * weight.sum() * r["n"] / of_all * np.outer(sign, sign)
    w = solve_sparse([numbers(r["hits"]) for r in docs_seen], len(vocab), np.array([r["label"] for r in docs_seen], float), weight, quad, settings.ridge)
    return Model(float(w[0]), dict(zip(vocab, map(float, w[1:]), strict=True)))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) for every whole text.

    Only the text is looked at. A null text scores as an empty one: the model's bias. Equal texts
    score equally; other columns are ignored and an empty table gives an empty result.
    """

    def make():
        score = model.scorer()
        return lambda arr: [pa.array([score(t) for t in arr.to_pylist()], pa.float64())]

    out = map_text(texts(docs, id_col, text_col), make, "score double", SLICE_BYTES)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they were."""

    def make():
        score = model.scorer()
        return lambda arr: np.array([score(t) < threshold for t in arr.to_pylist()], bool)

    return filter_text(docs, make, text_col)
