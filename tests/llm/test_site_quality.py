"""Site quality against sums in plain Python, and joins whose keys hold many rows."""

import math
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.llm import common, site_quality
from stratalog.llm.catalog import QUERIES
from stratalog.session import ship

SF = "/root/testdata/sf0.001"


def brute_scores(rows: list, model: site_quality.Model, settings: site_quality.Settings = site_quality.Settings()) -> list[tuple]:
    """(doc_id, score, host posterior, path posterior) of rows (doc_id, text, host, path), one text and one document at a time."""
    docs = []
    for key, text, host, path in rows:
        z = float(model.log_odds(site_quality.shapes(pa.array([text or ""], pa.large_string())))[0])
        docs.append((key, host or "", path or "", z, 1 / (1 + math.exp(-z))))
    hosts, paths = defaultdict(list), defaultdict(list)
    for _, host, path, _, p in docs:
        hosts[host].append(p)
        paths[host, path].append(p)
    of = lambda ps: sum(ps) / len(ps)
    raw = of([d[4] for d in docs])
    mean = min(max(raw, 1e-3), 1 - 1e-3)

    def strength(groups: dict, upper) -> float:
        spread = sum(len(ps) * (of(ps) - upper(k)) ** 2 - max(of([p * p for p in ps]) - of(ps) ** 2, 0.0) for k, ps in groups.items()) / len(docs)
        return min(max(raw * (1 - raw) / spread - 1, settings.weakest), settings.strongest) if spread > 0 else settings.strongest

    host_k, path_k = strength(hosts, lambda k: mean), strength(paths, lambda k: of(hosts[k[0]]))
    logit = lambda q: math.log(q / (1 - q))
    out = []
    for key, host, path, z, p in docs:
        a = (host_k * mean + sum(hosts[host]) - p) / (host_k + len(hosts[host]) - 1)
        b = (path_k * a + sum(paths[host, path]) - p) / (path_k + len(paths[host, path]) - 1)
        out.append((key, 1 / (1 + math.exp(-(z + logit(min(max(b, 1e-3), 1 - 1e-3)) - logit(mean)))), a, b))
    return out


def same(got: list, want: list[tuple]) -> None:
    order = lambda x: tuple(map(str, x[:1])) + tuple(round(v, 7) for v in x[1:])
    got = sorted(((r.doc_id, r.score, r.host_posterior, r.path_posterior) for r in got), key=order)
    want = sorted(want, key=order)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[1:] == pytest.approx(w[1:], abs=1e-6)


def test_query_is_that_of_plain_sums(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = site_quality.fit(docs.select("doc_id", "text"), labels)
    got = QUERIES["op5_site_quality"](spark, SF).collect()
    same(got, brute_scores([(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], model))
    assert all(r.kept == (r.score >= 0.5) for r in got)


def test_null_sites_ties_and_repeated_rows(spark):
    """Null and empty sites are one; a score at the threshold is kept; repeated rows count each."""
    ship(spark)
    rows = [(1, "some words", None, None), (2, "some words", "", ""), (3, None, "a", None), (4, "", "a", "p"), (4, "", "a", "p"), (None, "### $$$ ### %%%", "a", "q"), (6, "### $$$", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string").withColumns({"p": F.lit("x"), "z": F.lit("y"), "n": F.lit(0)})
    weights = [0.0] * site_quality.N_FEATURES
    weights[site_quality._PARTS.index("symbols")] = -3.0
    model = site_quality.Model(0.5, tuple(weights))
    same(site_quality.site_quality(df, model, F.col("host"), F.col("path")).collect(), brute_scores(rows, model))
    flat = site_quality.site_quality(df, site_quality.Model(0.0, (0.0,) * site_quality.N_FEATURES), F.col("host"), F.col("path")).collect()
    assert len(flat) == len(rows) and all(r.score == 0.5 and r.kept for r in flat)


def test_heavy_lookup_joins_hot_and_other_keys_alike(spark):
    """Keys over the bound come by broadcast, the others by a shuffle; each row once, absent keys with null."""
    keys = [0] * 1500 + [1] * 300 + [k for k in range(2, 500) for _ in range(2)]
    big = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, key long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(500) if k % 7], "key long, value string").unionByName(spark.createDataFrame([(0, "v0")], "key long, value string"))
    has = {k for k in range(500) if k % 7} | {0}
    for least, bound in ((256, 100), (256, 10_000), (10**6, 100)):  # some hot keys, by either bound, and none
        got = common.heavy_lookup(big, small, "key", least, bound).collect()
        assert sorted((r.i, r.key, r.value) for r in got) == [(i, k, f"v{k}" if k in has else None) for i, k in enumerate(keys)]
    assert common.heavy_lookup(big.limit(0), small, "key").count() == 0
