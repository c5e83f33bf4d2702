"""The pipeline against a version without Spark, and its stages on odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratalog.llm.catalog import TOKENIZERS
from stratalog.session import ship
from llm.test_near_dedup import brute as brute_groups
from llm.test_toxicity import brute as brute_scores

SF = "/root/testdata/sf0.001"


def keeps(text: str) -> bool:
    """The quality rules, by counting windows in dictionaries."""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]

    def covered(n):
        seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return len({i + d for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for d in range(n)})

    return len(w) >= 10 and 100 * covered(5) <= 20 * len(w) and 100 * covered(10) <= 10 * len(w) and covered(101) == 0


def test_rows_are_those_of_plain_stages(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    scores = brute_scores(docs, labels)
    left = sorted(k for k in docs if scores[k] < 0.7 and keeps(docs[k]))
    roots = brute_groups([docs[k] for k in left], 80)
    left = [k for i, k in enumerate(left) if roots[i] == i]
    assert 0 < len(left) < len(docs)
    tok = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    pieces, filled = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(pieces) == left
    for k in left:
        ids = np.array([*tok.encode(docs[k], add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[k], key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids) for p in own)
    for spans in filled.values():
        ends = [a + n for a, n in sorted(spans)]
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 1024


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_odd_rows(spark, stage):
    ship(spark)
    plain = "A plain document of some fifteen words that says nothing twice and hurts nobody at all."
    long = " ".join(f"word{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, plain), (3, plain), (3, f"{plain} Another end that goes on for a while longer than the first."), (None, "Nobody numbered this row, though it has more than ten words in it."), (None, None), (9, long)]
    docs = spark.createDataFrame([(i, t, "en", None, 5, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, label int").withColumns({c: F.lit(7) for c in ("k", "h", "score", "node")})
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(r.label for r in out.collect())
    if stage is corpus_pipeline.near_dedup:
        assert len(got) == 7 and {0, 1, 4, 5, 6, 7} < set(got)  # of the two equal rows one
    elif stage is corpus_pipeline.quality_rules:
        assert got == [2, 3, 4, 5, 7]
    else:
        assert got == list(range(8))
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_of_odd_rows(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, None), (None, "x"), (1, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    assert sorted((r.doc_id or 0, r.length) for r in corpus_pipeline.packing(spark, docs, SF).collect()) == [(0, 2), (1, 1), (1, 1)]
    assert corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0
