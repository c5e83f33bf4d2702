"""Scoring texts with a log-bilinear neural language model, trained in numpy by noise-contrastive estimation.

A token is a word or the end of its text. The model knows ``CLASSES`` outputs: the end, the most frequent words, and for all other
words the classes of their last two letters; inside such a class a word has its share of the training counts. The vector predicted
for a place is the sum of a vector for each of the two tokens before it, and an output's score is its product with the output's vector, and a bias.

Training goes in rounds over disjoint parts of the training texts: each task trains a copy of the model on its own rows, in batches that share their
noise words, so that a step is three matrix products; then the copies are averaged, each vector by how often a task
has used it, and so are the sums of squares that slow its steps. Since contexts add up before the exponential, the normaliser of every pair of contexts is one product of two
matrices of exponentials, and each token's log-probability is exact, not estimated.

Counts of words are complete. Words with the most rows are broadcast, ``BROADCAST_WORDS`` at most; of the others each text's
words are joined with the table of counts. Words are told apart by 64 bits of hash: among n different words n * n / 2**65 pairs are expected to be taken for one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import large, saved, slices, texts, words

#: Outputs: the end of a text, so many words, and the rest for endings.
CLASSES, SHORTLIST = 1024, 511
ENDINGS = CLASSES - 1 - SHORTLIST
DIMS, BATCH, NOISE = 16, 1024, 32
#: A step is ``RATE`` times the gradient over the root of its squares so far, which begin at ``CALM``.
RATE, CALM = 0.2, 30.0
#: What part of 8 of the training texts each round sees.
ROUNDS = ((0,), (1,), (2, 3), (4, 5, 6, 7))
BROADCAST_WORDS = 1 << 20
#: Text counted at once, and text whose outputs are a stored row; a longer document is handled alone.
COUNT_BYTES, ROW_BYTES = 4 << 20, 1 << 20
HELD_OUT, FOLDS = 1, 5
_START = CLASSES  # what stands before a text, as a context
_PER_OCTAVE = 16  # steps of the scale on which words are ordered by their count


def checksum(doc_id: object) -> int:
    """CRC-32 of the id as text, of nothing for a null one."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode())


def ending_class(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0 to ``ENDINGS`` - 1 for each word, by its last two bytes, A-Z as a-z."""
    low = np.arange(257)
    low[65:91] += 32
    one = low[data[ends - 1]]
    two = np.where(ends - starts > 1, low[data[np.maximum(ends - 2, 0)]] + 1, 0)
    return ((one * 257 + two) * 2_654_435_761 >> 12) % ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), ending, train and n: how often each word occurs in training texts and in all of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, ids = large(b.column("text")), b.column("doc_id").to_pylist()
            train = np.array([checksum(x) % FOLDS != HELD_OUT for x in ids], bool)
            for i, j in slices(text, COUNT_BYTES):
                data, starts, ends, word, first = words(text.slice(i, j - i), lower=True)
                u, at, inverse = np.unique(word, return_index=True, return_inverse=True)
                learnt = np.repeat(train[i:j], np.diff(first))
                n, known = np.bincount(inverse, minlength=len(u)), np.bincount(inverse[learnt], minlength=len(u))
                columns = (u.view(np.int64), ending_class(data, starts[at], ends[at]).astype(np.int32), known, n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "ending", "train", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "word long, ending int, train long, n long")
    return rows.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("train").alias("train"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The broadcast words in order of their hashes, and what follows from all counts."""

    word: np.ndarray
    cls: np.ndarray  # output of each word
    log_count: np.ndarray  # log10(training count + 0.5)
    known: np.ndarray
    prior: np.ndarray  # of the outputs, in training
    log_inside: np.ndarray  # log10 of the denominator of a word's share in its class; 0 for outputs that are one word
    tokens: int
    log_all: float  # log10 of the base's denominator
    n_ends: int


def _level(col: str) -> F.Column:
    return F.floor(F.log2(F.col(col).cast("double")) * _PER_OCTAVE)


def vocabulary(counts: DataFrame, n_ends: int, most: int = BROADCAST_WORDS) -> tuple[Vocabulary, int]:
    """The vocabulary, and the level of counts from which words are in it; ``n_ends`` is the number of training texts."""
    levels = sorted(((r["level"], r["n"]) for r in counts.groupBy(_level("n").alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 16 for each doubling
    cut, room = (levels[0][0] + 1 if levels else 0), most
    for level, n in levels:
        room -= n
        if room < 0:
            break
        cut = level
    top = counts.where(_level("n") >= cut).select("word", "ending", "train").toArrow()
    word, ending, train = (top.column(k).to_numpy() for k in range(3))
    order = np.argsort(word.view(np.uint64))
    word, ending, train = word.view(np.uint64)[order], ending[order], train[order]
    totals = counts.groupBy("ending").agg(F.sum("train").alias("c"), F.count_if(F.col("train") > 0).alias("v")).collect()  # a row for each class
    c, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in totals:
        c[1 + SHORTLIST + r["ending"]], v[1 + SHORTLIST + r["ending"]] = r["c"], r["v"]
    tokens, distinct = int(c.sum()) + n_ends, int(v.sum()) + (n_ends > 0)
    cls = 1 + SHORTLIST + ending.astype(np.int64)
    frequent = np.argsort(-train, kind="stable")[:SHORTLIST]
    frequent = frequent[train[frequent] > 0]
    np.subtract.at(c, cls[frequent], train[frequent])
    np.subtract.at(v, cls[frequent], 1)
    log_inside = np.log10(c + 0.5 * (v + 1))
    log_inside[: 1 + SHORTLIST] = 0
    cls[frequent] = 1 + np.arange(len(frequent))
    c[0], c[1 : 1 + len(frequent)] = n_ends, train[frequent]
    prior = (c + 0.5) / (c + 0.5).sum()
    return Vocabulary(word, cls.astype(np.uint16), np.log10(train + 0.5), train > 0, prior, log_inside, tokens, float(np.log10(tokens + 0.5 * (distinct + 1))), n_ends), cut


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A row for each slice of ``docs``: its ids, starts of their outputs in the packed stream, the part of training, the sums over broadcast words, and the other words.

    ``part`` is null for texts that are held out; ``rare_word``, ``rare_at`` and ``rare_n`` say which word occurs in which text how often.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType
    fields = "part array<int>, n_tokens array<long>, n_known array<long>, base array<double>, inside array<double>, starts array<long>, stream binary, rare_word array<long>, rare_at array<int>, rare_n array<int>"
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            text = large(b.column("text"))
            for i, j in slices(text, ROW_BYTES):
                ids = b.column("doc_id").slice(i, j - i)
                yield pa.RecordBatch.from_arrays(_encode(ids, text.slice(i, j - i), v), schema=pa.schema([*zip(schema.names, [pa.list_(ids.type), *_TYPES], strict=True)]))

    rows = docs.select("doc_id", "text").mapInArrow(run, schema)
    return rows.withColumn("slice", F.monotonically_increasing_id())


_TYPES = [pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())] + [pa.binary()] + [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32())]


def _encode(ids: pa.Array, arr: pa.Array, v: Vocabulary) -> list[pa.Array]:
    data, starts, ends, word, first = words(arr, lower=True)
    n = len(arr)
    sums = [checksum(x) for x in ids.to_pylist()]
    part = pa.array([None if s % FOLDS == HELD_OUT else s // FOLDS % 8 for s in sums], pa.int32())
    u, at, inverse = np.unique(word, return_index=True, return_inverse=True)
    place = np.minimum(np.searchsorted(v.word, u), max(len(v.word) - 1, 0))
    there = v.word[place] == u if len(v.word) else np.zeros(len(u), bool)
    cls, log_count, known = (np.zeros(len(u), t) for t in (np.int64, np.float64, np.int64))
    cls[there], log_count[there], known[there] = v.cls[place[there]], v.log_count[place[there]], v.known[place[there]]
    if not there.all():
        cls[~there] = 1 + SHORTLIST + ending_class(data, starts[at[~there]], ends[at[~there]])
    doc = np.repeat(np.arange(n), np.diff(first))
    outputs, counted = cls[inverse], log_count[inverse]
    stream = np.zeros(len(word) + n, np.uint16)  # the end is output 0
    stream[np.arange(len(word)) + doc] = outputs
    one_word = outputs <= SHORTLIST
    sum_of = lambda x: np.bincount(doc, x, n)
    n_tokens = np.diff(first) + 1
    base = sum_of(counted) + np.log10(v.n_ends + 0.5) - n_tokens * v.log_all
    inside = sum_of(np.where(one_word, 0.0, counted - v.log_inside[outputs]))
    n_known = sum_of(known[inverse]).astype(np.int64) + (v.n_ends > 0)
    rare = np.flatnonzero(~there[inverse])
    pairs, rare_n = np.unique(np.stack([doc[rare], inverse[rare]]), axis=1, return_counts=True) if len(rare) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    lists = [ids, part, *(pa.array(x) for x in (n_tokens, n_known, base, inside, first[:-1] + np.arange(n)))]
    late = [pa.array(u[pairs[1]].view(np.int64)), pa.array(pairs[0].astype(np.int32)), pa.array(rare_n.astype(np.int32))]
    row = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return [*map(row, lists), pa.array([stream.astype("<u2").tobytes()], pa.binary()), *map(row, late)]


# --- the model -------------------------------------------------------------


@dataclass
class Model:
    """``out``: a vector and, last, a bias for each output; ``context``: vectors of the last token, then of the one before it, each with that of the text's start last.

    ``squares``: of the gradients so far, for both.
    """

    out: np.ndarray
    context: np.ndarray
    squares: tuple[np.ndarray, np.ndarray]

    @classmethod
    def fresh(cls, prior: np.ndarray, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        out = np.concatenate([rng.normal(0, 0.1, (CLASSES, DIMS)), np.log(prior)[:, None]], 1)
        context = rng.normal(0, 0.1, (2 * (CLASSES + 1), DIMS))
        return cls(out.astype(np.float32), context.astype(np.float32), tuple(np.full(x.shape, CALM, np.float32) for x in (out, context)))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and squares with a row for each output and context."""
        wide = lambda a, b: np.concatenate([a, np.pad(b, ((0, 0), (0, 1)))]).astype(np.float64)
        return wide(self.out, self.context), wide(*self.squares)

    def log_probabilities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of outputs by the last token and by the one before, and the log-normaliser of each pair of these; natural logs."""
        near, far = np.split(self.context.astype(np.float64), 2)
        out, bias = self.out[:, :-1].astype(np.float64), self.out[:, -1].astype(np.float64)
        near, far = near @ out.T + bias, far @ out.T
        a, b = near.max(1, keepdims=True), far.max(1, keepdims=True)
        norm = np.log(np.maximum(np.exp(near - a) @ np.exp(far - b).T, 1e-300)) + a + b.T
        return near, far, norm


def contexts(stream: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each and the one before that, as rows of a model's ``context``."""
    near, far = np.full(len(stream), _START, np.int64), np.full(len(stream), _START, np.int64)
    near[1:], far[2:] = stream[:-1], stream[:-2]
    near[starts] = _START
    far[starts] = _START
    second = starts + 1
    far[second[second < len(stream)]] = _START  # where a text has its end alone, the next one's first place, which is reset as well
    return near, far + CLASSES + 1


def _sums(index: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(index.astype(np.uint16), kind="stable")
    ordered = index[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[heads], np.add.reduceat(grad[order], heads, axis=0), np.diff(np.append(heads, len(ordered)))


class Trainer:
    """Steps of noise-contrastive estimation on a copy of a model, with a rate for each of its numbers."""

    def __init__(self, model: Model, prior: np.ndarray, seed: int) -> None:
        self.model = Model(model.out.copy(), model.context.copy(), tuple(x.copy() for x in model.squares))
        self.prior, self.rng = np.cumsum(prior), np.random.default_rng(seed)
        self.log_noise = np.log(prior * NOISE).astype(np.float32)
        self.used = [np.zeros(len(x)) for x in (model.out, model.context)]

    def _move(self, which: int, index: np.ndarray, grad: np.ndarray) -> None:
        rows, g, n = _sums(index, grad)
        self.used[which][rows] += n
        squares = self.model.squares[which]
        squares[rows] += g * g
        (self.model.out, self.model.context)[which][rows] -= RATE / np.sqrt(squares[rows]) * g

    def step(self, word: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        query = np.ones((len(word), DIMS + 1), np.float32)
        query[:, :-1] = self.model.context[near] + self.model.context[far]
        noise = np.minimum(np.searchsorted(self.prior, self.rng.random(NOISE)), CLASSES - 1)
        right, wrong = self.model.out[word], self.model.out[noise]
        push = sigmoid((query * right).sum(1) - self.log_noise[word]) - 1
        pull = sigmoid(query @ wrong.T - self.log_noise[noise])
        back = push[:, None] * right + pull @ wrong
        self._move(0, np.concatenate([word, noise]), np.concatenate([push[:, None] * query, pull.T @ query]))
        self._move(1, np.concatenate([near, far]), np.concatenate([back[:, :-1], back[:, :-1]]))

    def text(self, stream: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> None:
        """All tokens of the chosen texts of a slice, in random order."""
        near, far = contexts(stream, starts)
        at = np.flatnonzero(np.repeat(chosen, np.diff(np.append(starts, len(stream)))))
        at = self.rng.permutation(at)
        for i in range(0, len(at), BATCH):
            j = at[i : i + BATCH]
            self.step(stream[j].astype(np.int64), near[j], far[j])


_VALUES, _SQUARES = ([f"{c}{k}" for k in range(DIMS + 1)] for c in "ds")


def _round(stored: DataFrame, model: Model, prior: np.ndarray, parts: tuple[int, ...]) -> Model:
    """The average of the copies that tasks have trained on the given parts of the texts."""
    before = model.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(model, prior, parts[0])
        for b in batches:
            for part, starts, packed in zip(*b.columns, strict=True):
                chosen = np.isin(part.values.fill_null(-1).to_numpy(), parts)
                trainer.text(np.frombuffer(packed.as_buffer(), "<u2"), starts.values.to_numpy(), chosen)
        values, squares = trainer.model.rows()
        used = np.concatenate(trainer.used)
        some = np.flatnonzero(used)
        columns = [some.astype(np.int32), used[some], *(values[some] * used[some, None]).T, *(squares - before[1])[some].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "used", *_VALUES, *_SQUARES])

    schema = "row int, used double, " + ", ".join(f"{d} double" for d in _VALUES + _SQUARES)
    each = stored.select("part", "starts", "stream").mapInArrow(run, schema).groupBy("row")
    mean = each.agg(*[(F.sum(d) / F.sum("used")).alias(d) for d in _VALUES], *[F.avg(d).alias(d) for d in _SQUARES]).toArrow()  # a row for each vector
    values, squares = before
    row = mean.column("row").to_numpy()
    column = lambda names: np.stack([mean.column(d).to_numpy() for d in names], 1)
    values[row] = column(_VALUES)
    squares[row] += column(_SQUARES)
    split = lambda x: (x[:CLASSES].astype(np.float32), x[CLASSES:, :-1].astype(np.float32))
    return Model(*split(values), split(squares))


def trained(stored: DataFrame, prior: np.ndarray) -> Model:
    """A model of the training texts of ``encoded`` slices; each text is seen once."""
    model = Model.fresh(prior)
    for parts in ROUNDS:
        model = _round(stored, model, prior, parts)
    return model


def scored(slices_: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of the texts of ``slices_`` (``encoded`` with ``rare``: at, log_count, known of other words)."""
    kind = slices_.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, base_score double, score double").fields])
    columns = ["ids", "part", "n_tokens", "n_known", "base", "inside", "starts", "stream", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_score, far_score, norm = model.log_probabilities()
        for b in batches:
            for ids, part, n_tokens, n_known, base, inside, starts, packed, rare in zip(*b.columns, strict=True):
                stream, begin = np.frombuffer(packed.as_buffer(), "<u2").astype(np.int64), starts.values.to_numpy()
                near, far = contexts(stream, begin)
                far -= CLASSES + 1
                log_p = near_score[near, stream] + far_score[far, stream] - norm[near, far]
                score = np.add.reduceat(log_p, begin) / np.log(10) + inside.values.to_numpy()
                base, known = base.values.to_numpy().copy(), n_known.values.to_numpy().copy()
                if rare.is_valid and len(rare.values):
                    at, more, counted = (rare.values.field(k).to_numpy() for k in range(3))
                    base[at] += more
                    score[at] += more
                    known[at] += counted
                yield pa.RecordBatch.from_arrays([ids.values, part.values.is_null(), n_tokens.values, pa.array(known), pa.array(base), pa.array(score)], names=schema.names)

    return slices_.select(columns).mapInArrow(run, schema)


def text_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each row's whole text.

    Tokens: words ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z, and one end, so a null, empty or blank text has one. Texts whose CRC-32 of the id leaves 1 when divided
    by 5 are held out: neither counts nor model see them. A null id counts as an empty one. Repeated rows count each and get equal scores. Without a
    training text all counts are 0. Other columns are ignored; an empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    counts = saved(word_counts(rows), "words")
    learnt = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % FOLDS != HELD_OUT
    vocabulary_, cut = vocabulary(counts, rows.where(learnt).count(), most)
    stored = saved(encoded(rows, vocabulary_), "outputs")
    model = trained(stored, vocabulary_.prior)
    rare = stored.select("slice", F.explode(F.arrays_zip("rare_at", "rare_word", "rare_n")).alias("x")).select("slice", F.col("x.rare_at").alias("at"), F.col("x.rare_word").alias("word"), F.col("x.rare_n").alias("times"))
    of = counts.where(_level("n") < cut).select("word", F.log10(F.col("train") + 0.5).alias("log_count"), (F.col("train") > 0).cast("long").alias("known"))
    found = rare.join(of, "word").groupBy("slice", "at").agg(F.sum(F.col("times") * F.col("log_count")).alias("log_count"), F.sum(F.col("times") * F.col("known")).alias("known"))
    found = found.groupBy("slice").agg(F.collect_list(F.struct("at", "log_count", "known")).alias("rare"))  # as many as a slice has texts
    return scored(stored.join(found, "slice", "left"), model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary_.tokens).cast("long").alias("train_tokens"), "base_score", "score")
