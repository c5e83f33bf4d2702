"""The language model: its counts against plain ones, its probabilities against a full softmax."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import log_bilinear as lm
from stratalog.llm.catalog import QUERIES
from stratalog.session import ship

SF = "/root/testdata/sf0.01"
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text):
    return (text or "").encode().translate(LOW).split() + [None]


def held(key):
    return zlib.crc32(str("" if key is None else key).encode()) % 5 == 1


def base(rows):
    """n_tokens, n_known, N, base score of each row."""
    c = Counter()
    for k, t in rows:
        c.update([] if held(k) else tokens(t))
    n, v = sum(c.values()), len(c)
    return [(k, held(k), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for k, t in rows]


@pytest.fixture(scope="module")
def scores(spark):
    return QUERIES["op11_log_bilinear"](spark, SF).collect()


def test_counts_and_base(spark, scores):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in scores}
    for k, is_held, n, known, total, score in base(rows):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held, n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)


def test_model_beats_base_on_held_out_texts(scores):
    out = [r for r in scores if r.held_out]
    n = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / n > sum(r.base_score for r in out) / n + 0.2


def test_words_outside_the_broadcast_are_joined(spark):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id")
    every, few = (({r.doc_id: r for r in lm.text_scores(docs, most=m).collect()}) for m in (lm.BROADCAST_WORDS, 600))
    for k, r in every.items():
        assert few[k].n_known == r.n_known and few[k].base_score == pytest.approx(r.base_score, rel=1e-9)


def test_probabilities_are_those_of_a_full_softmax():
    rng = np.random.default_rng(3)
    prior = rng.random(lm.CLASSES) + 0.01
    model = lm.Model.fresh(prior / prior.sum())
    model.out[:, :-1] *= 20
    near, far, norm = model.log_probabilities()
    for a, b in ((0, 5), (lm.CLASSES, lm.CLASSES), (17, lm.CLASSES)):
        z = (model.context[a] + model.context[lm.CLASSES + 1 + b]).astype(float) @ model.out[:, :-1].T + model.out[:, -1]
        want = z - (z.max() + np.log(np.exp(z - z.max()).sum()))
        assert np.allclose(near[a] + far[b] - norm[a, b], want, atol=1e-5) and np.exp(near[a] + far[b] - norm[a, b]).sum() == pytest.approx(1)


def test_shares_of_a_class_and_of_all_classes_add_up(spark):
    """Over all known words, the end, and one unknown word for each ending, the first token's probabilities add up to 1."""
    ship(spark)
    rows = lm.texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    v, _ = lm.vocabulary(lm.word_counts(rows), 10)
    inside = np.where(v.cls <= lm.SHORTLIST, 1.0, 10 ** (v.log_count - v.log_inside[v.cls])) * v.known
    total = np.bincount(v.cls, inside, lm.CLASSES)
    unseen = 0.5 / 10 ** v.log_inside[1 + lm.SHORTLIST :]
    assert np.allclose(total[1 + lm.SHORTLIST :] + unseen, 1) and np.allclose(total[1 : 1 + lm.SHORTLIST], 1)


def test_contexts():
    near, far = lm.contexts(np.array([5, 6, 0, 0, 7, 0], np.uint16), np.array([0, 3, 4]))
    s, off = lm.CLASSES, lm.CLASSES + 1
    assert near.tolist() == [s, 5, 6, s, s, 7] and (far - off).tolist() == [s, s, 5, s, s, s]


def test_training_raises_the_likelihood_of_a_pattern():
    stream = np.array([1, 2, 3, 0] * 3000, np.uint16)
    starts = np.arange(0, len(stream), 4)
    prior = (np.bincount(stream, minlength=lm.CLASSES) + 0.5) / (len(stream) + 0.5 * lm.CLASSES)
    trainer = lm.Trainer(lm.Model.fresh(prior), prior, 1)
    for _ in range(3):
        trainer.text(stream, starts, np.ones(len(starts), bool))
    near, far, norm = trainer.model.log_probabilities()
    assert near[1, 2] + far[lm.CLASSES, 2] - norm[1, lm.CLASSES] > math.log(0.8)


def test_odd_rows(spark):
    ship(spark)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One ONE one"), (None, "two One"), (4, "One ONE one"), (6, "never"), (7, "One x y " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "word", "train", "slice", "part", "rare")})
    got = sorted(lm.text_scores(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    want = sorted(base(rows), key=lambda r: (r[0] or 0, r[2]))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5] and r.base_score == pytest.approx(w[5]) and math.isfinite(r.score)
    assert got[4].score == got[5].score if got[4].doc_id == got[5].doc_id else True
    assert lm.text_scores(docs.limit(0)).count() == 0
    only_held = [k for k in range(60) if held(k)]
    r = lm.text_scores(spark.createDataFrame([(k, "a b") for k in only_held], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)
