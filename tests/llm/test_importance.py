"""Importance resampling against plain counts, and against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import compare
from stratalog.llm.catalog import QUERIES, SQL
from stratalog.llm.crc import STEPS, appended, crc32_of, joined
from stratalog.llm.importance import bucket_stream, in_order, resampled, streams
from stratalog.session import ship

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def buckets(text):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_checksums():
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, STEPS - 1, STEPS, STEPS + 1, 5 * STEPS + 3)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    lengths = np.array([len(p) for p in parts])
    one = crc32_of(data, ends - lengths, ends)
    assert one.tolist() == [zlib.crc32(p) for p in parts]
    assert appended(one, 32).tolist() == [zlib.crc32(p + b" ") for p in parts]
    for p, c in zip(parts, one, strict=True):
        assert joined(np.full(len(parts), c, np.uint32), one, lengths).tolist() == [zlib.crc32(p + q) for q in parts]


def test_features():
    rng = random.Random(1)
    texts = ["", "Hello World foo_bar 9x ÉÉ ü", " a b c ", "x" * 200 + " y " + "z" * 70 + " q", "é" * 90 + " w " + "ab" * 300] + ["".join(rng.choice("ab cABé .\n9") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    stream, begin, n = bucket_stream(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert n[i] == len(words(t)) and sorted(stream[begin[i] : begin[i + 1]].tolist()) == sorted(buckets(t))


def test_resampling_of_odd_rows(spark):
    ship(spark)
    rng = random.Random(4)
    some = [" ".join(rng.choice("red green blue sky tree of the a in".split()) for _ in range(rng.randint(15, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(some)] + [(200, None), (201, ""), (202, "short"), (None, some[3]), (7, some[7]), (203, "long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("rank", "score", "ids", "_at", "_range")})
    target = spark.createDataFrame([("the red sky",), ("the tree of the sky",), (None,)], "text string").withColumn("doc_id", F.lit("x"))
    got = resampled(docs, target).collect()
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text))
    for text in ("the red sky", "the tree of the sky"):
        t.update(buckets(text))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    want = []
    for k, text in rows:
        b = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, b))
        want.append([k, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text))])
    able = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is not None, w[0]))
    ranks = Counter((w[0], w[3], place if place <= 5 * len(able) // 100 else None) for place, w in enumerate(able, 1)) + Counter((w[0], w[3], None) for w in want if w[4] < 20)
    assert Counter((r.doc_id, r.score, r["rank"]) for r in got) == ranks
    assert Counter(tuple(w[:4]) for w in want) == Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got)
    assert resampled(docs.limit(0), target).count() == 0
    assert all(r["rank"] is None or r.n_features for r in resampled(docs, target.limit(0)).collect())
    with pytest.raises(ValueError):
        streams(docs, 70_000)


def test_places_over_ranges(spark):
    rows = spark.range(5_000).select(F.pmod(F.hash("id"), F.lit(50)).alias("score"), "id").repartition(4)
    got = [(r.score, r.id) for r in sorted(in_order(rows, F.desc("score"), F.asc("id")).collect(), key=lambda r: r["rank"])]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 5_000


def test_sql(spark):
    compare(spark, QUERIES["op13_importance_resampling"], SQL["op13_importance_resampling"], SF)
