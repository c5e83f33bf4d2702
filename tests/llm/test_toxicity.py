"""The classifier against a plain version without Spark, and on odd labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import toxicity
from stratalog.llm.catalog import QUERIES
from stratalog.session import ship

SF = "/root/testdata/sf0.01"


def words_of(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", text.lower()))


def stems(words: set[str]) -> set[str]:
    return words | {w[:k] + "-" for w in words for k in (4, 5, 6, 7, 8) if len(w) > k}


def brute(docs: dict[int, str], labels: list[tuple[int, int]]) -> dict[int, float]:
    """Scores by the same objective, minimised by plain Newton steps on whole matrices."""
    label = defaultdict(int)
    for d, y in labels:
        if y is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            label[d] = max(label[d], y)
    ids = sorted(d for d in label if d in docs)
    copies = Counter(toxicity.shingle_key(docs[d]) for d in ids)
    weight = np.array([1 / copies[toxicity.shingle_key(docs[d])] for d in ids])
    y = np.array([label[d] for d in ids], float)
    has = [stems(words_of(docs[d])) for d in ids]
    n, toxic = defaultdict(float), defaultdict(float)
    for w, t, h in zip(weight, y, has):
        for f in h:
            n[f] += w
            toxic[f] += w * t
    total, total1 = weight.sum(), (weight * y).sum()
    term = lambda k, of, share: k * math.log(k / (of * share)) if k > 1e-9 else 0.0

    def evidence(f):
        a, b, share = toxic[f], n[f] - toxic[f], n[f] / total
        x = term(a, total1, share) + term(b, total - total1, share) + term(total1 - a, total1, 1 - share) + term(total - total1 - b, total - total1, 1 - share)
        return round(math.sqrt(max(2 * x, 0)), 6)

    s = toxicity.Settings()
    vocab = sorted((f for f in n if n[f] >= s.min_documents - 1e-9 and n[f] < total - 1e-9 and evidence(f) >= s.min_evidence), key=lambda f: (-evidence(f), f))[: s.max_words]
    x = np.array([[1.0, *(f in h for f in vocab)] for h in has], float)
    groups = [g.split() for g in s.groups]
    deltas, shares = [], []
    for d, w in zip(ids, weight):
        for sentence in re.split(r"[.!?\n]+", docs[d].lower()):
            there = words_of(sentence)
            for g in groups:
                for t in set(g) & there:
                    for o in g:
                        if o != t:
                            after = stems((there - {t}) | {o})
                            deltas.append([0.0, *(float(f in after) - float(f in stems(there)) for f in vocab)])
                            shares.append(w)
    fixed = np.diag([1e-6] + [s.ridge] * len(vocab))
    if deltas:
        d, share = np.array(deltas), np.array(shares) / sum(shares)
        fixed += s.swap_penalty * total * (d * share[:, None]).T @ d
    beta = np.zeros(len(vocab) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + fixed, x.T @ (weight * (p - y)) + fixed @ beta)
        beta -= step * min(1, 2 / np.abs(step).max())
    place = {f: i + 1 for i, f in enumerate(vocab)}
    return {k: 1 / (1 + math.exp(-beta[0] - sum(beta[place[f]] for f in stems(words_of(t)) if f in place))) for k, t in docs.items()}


def test_query_scores_are_those_of_a_plain_fit(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = brute(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    assert set(got) == set(want)
    assert max(abs(got[k].score - want[k]) for k in want) < 1e-4
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for k, r in got.items())


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    texts = [f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} here" + (" you vile scum" if i % 3 == 0 else "") for i in range(300)]
    return spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, label int, weight string")


def test_labels_that_are_odd(spark, rows):
    label = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 0), (1, None), (None, 1), (10_000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(rows, label)
    assert model.score("you vile scum") > 0.7 > 0.3 > model.score("plain words")
    none = toxicity.fit(rows, label.limit(0))
    assert none.weights == {} and none.score("x") == 0.5
    ones = toxicity.fit(rows, label.where("toxic = 1"))
    assert ones.weights == {} and ones.score("x") > 0.9
    empty = toxicity.fit(rows.withColumn("text", F.lit(None).cast("string")), label)
    assert empty.weights == {} and 0 < empty.score("") < 0.7


def test_copies_share_a_weight_and_no_row_is_dropped(spark, rows):
    """A text labelled toxic in 500 copies weighs as one document; other rows with the same beginning keep their labels."""
    copied = spark.createDataFrame([(1000 + i, "the garden party starts with zebra music tonight") for i in range(500)], "doc_id long, text string")
    label = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(1000 + i, 1) for i in range(500)], "doc_id long, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text").union(copied), label)
    assert "zebra" not in model.weights and model.score("you vile scum") > 0.7
    weights = toxicity._weighted(copied.select("text", F.lit(1).alias("label")))
    assert weights.count() == 500 and abs(weights.agg(F.sum("weight")).first()[0] - 1) < 1e-9


def test_scorer_is_the_sum_over_distinct_features():
    model = toxicity.Model(-1.0, {"muslim": 0.5, "musl-": 0.25, "jew": 2.0})
    for cached in (1, 100):
        score = model.scorer(cached)
        for text in ("Muslims and muslim music", "jew, jew jew", "", "nothing"):
            z = -1.0 + sum(model.weights[f] for f in stems(words_of(text)) if f in model.weights)
            assert abs(score(text) - 1 / (1 + math.exp(-z))) < 1e-12
