"""The training-data operators on odd rows and against plain versions."""

import hashlib
import io
import math
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from oracle import compare
from stratalog.llm import archives, interleave, main_text, near_dedup, packing, quality_rules, sharding, site_quality, toxicity
from stratalog.llm.bpe import bpe_round_trip
from stratalog.llm.catalog import QUERIES, SQL, TOKENIZERS
from stratalog.llm.interleave import interleaved_media
from stratalog.llm.near_dedup import near_duplicates
from stratalog.session import ship

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
TEXTS = {1: None, 2: "", 3: " \t\n", 4: "one", 5: "The same text twice, it is quite short.", 6: "The same text twice, it is quite short.", 7: LONG, 8: "é ß 漢字 🙂 İİ #$ <|endoftext|> a\r\nb\r\nb", 9: "rep eat " * 60}


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    rows = [(k, t, None, "s", k) for k, t in TEXTS.items()] + [(5, TEXTS[5], "de", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").withColumns({"key": F.lit(1), "label": F.lit("x"), "host": F.lit(2), "size": F.lit(None).cast("int")})


def by_id(df) -> dict:
    return {r["doc_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("name", ["op3_warc_zip", "op4_minhash_near_dedup", "op9_suffix_array_rules"])
def test_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SF)


def test_every_operator_takes_an_empty_table(spark, odd):
    none = odd.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = toxicity.Model(0.0, {})
    for df in (
        toxicity.toxicity_scores(none, model), packing.pack_pieces(none, f"{TOKENIZERS}/byte_bpe_50k.json"), archives.archive_round_trip(pages), near_duplicates(none), bpe_round_trip(none, f"{TOKENIZERS}/word_bpe_49k.json"),
        site_quality.site_quality(none, site_quality.Model(0.0, (0.0,) * site_quality.N_FEATURES), F.col("source"), F.col("lang")), interleaved_media(none), sharding.shard_by_bytes(none), quality_rules.quality_rules(none), main_text.main_text(pages),
    ):
        assert df.count() == 0


def test_toxicity(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    hit = Counter((r.toxic, r.predicted) for r in got)
    assert hit[1, 1] >= 3 * hit[1, 0] and hit[0, 1] <= 0.02 * hit[0, 0]
    scores = by_id(toxicity.toxicity_scores(odd, model))
    assert scores[1]["score"] == scores[2]["score"] and scores[5]["score"] == scores[6]["score"]
    assert toxicity.toxicity_scores(odd, model).count() == len(TEXTS) + 1


def test_counterfactual_penalty():
    """Toxic documents mention one group more often; without the penalty the mention alone raises a score."""
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.5).astype(float)
    x = np.stack([rng.random(400) < 0.2 + 0.7 * y, rng.random(400) < 0.2 + 0.5 * y, rng.random(400) < 0.4], 1).astype(float)  # insult, group, other group
    swaps = np.array([[0.0, -1.0, 1.0]])
    free, bound = toxicity.solve(x, y, swaps, toxicity.Settings(swap_penalty=0.0)), toxicity.solve(x, y, swaps, toxicity.Settings())
    assert abs(bound[2] - bound[3]) < 0.2 * abs(free[2] - free[3]) and bound[1] > 1


def test_swaps_change_beginnings():
    swaps = {"muslims": ["jews"], "jews": ["muslims"]}
    words = ["muslims", "musl-", "musli-", "muslim-", "jews", "muslin"]
    place = {w: i for i, w in enumerate(words)}
    assert list(toxicity.swap_changes("Muslims spoke. Nobody else", swaps, place)) == [((0, 1, 2, 3), (4,))]
    assert list(toxicity.swap_changes("muslims in muslin", swaps, place)) == [((0, 3), (4,))]  # musl- and musli- stay
    assert sorted(toxicity.swap_changes("muslims, jews", swaps, place)) == [((0, 1, 2, 3), ()), ((4,), ())]


def test_fit_penalises_long_identity_terms(spark):
    """Toxic documents name immigrants more often; a neutral mention doesn't score by its word beginnings either."""
    ship(spark)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        toxic = int(rng.random() < 0.4)
        insult = "vile scum" if toxic and rng.random() < 0.7 else "plain" if rng.random() < 0.5 else ""
        group = "immigrants" if rng.random() < (0.85 if toxic else 0.05) else "citizens" if rng.random() < 0.5 else "people"
        filler = ["".join(rng.choice(list("bcdfghjk"), 9)) for _ in range(8)]  # so that no two rows pass for copies
        rows.append((i, " ".join([*(x for pair in zip(filler, [*insult.split(), group]) for x in pair), *filler[4:]]), toxic))  # noqa: B905
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    fit = lambda **k: toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), toxicity.Settings(**k))
    model, free = fit(), fit(swap_penalty=0.0)
    z = lambda t, model=model: math.log(model.score(t) / (1 - model.score(t)))
    assert any(w.startswith("immi") and w.endswith("-") for w in model.weights)
    gap = lambda m: abs(z("the immigrants came here", m) - z("the refugees came here", m))
    assert gap(free) > 2 and gap(model) < 0.2 * gap(free)
    assert z("vile scum came here") - z("people came here") > 1


def test_site_quality(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = site_quality.fit(docs.select("doc_id", "text"), labels)
    got = site_quality.site_quality(docs, model, F.col("source"), F.col("lang")).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.95 * len(got)
    assert site_quality.site_quality(odd, model, F.col("source"), F.col("lang")).count() == len(TEXTS) + 1
    # a bad host draws a middling document down, a sparse one hardly
    rows = [(i, "### !! $$$ ### %%% &&& ###", "bad", "p") for i in range(400)] + [(1000 + i, f"A plain sentence number {i} about nothing at all.", f"h{i}", "p") for i in range(400)] + [(5000, "plain words here", "bad", "p"), (5001, "plain words here", "h1", "q")]
    r = by_id(site_quality.site_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), model, F.col("source"), F.col("lang")))
    assert r[5000]["path_posterior"] < 0.3 < r[5001]["path_posterior"] and r[5000]["evidence"] == r[5001]["evidence"]


def test_packing(spark, odd):
    tok = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    rows = packing.pack_pieces(odd, f"{TOKENIZERS}/byte_bpe_50k.json").collect()
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for k, t in TEXTS.items():
        ids = np.append(np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        for p in pieces[k]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
        if k != 5:
            assert sorted((p.start, p.start + p.length) for p in pieces[k])[0][0] == 0 and sum(p.length for p in pieces[k]) == len(ids)
    for s in seqs.values():
        spans = sorted((p.offset, p.length) for p in s)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 1024


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_zip_reader(tmp_path):
    for zip64 in (True, False):
        raw = archives.zip_bytes([("a", b"12345"), ("b", b"PK\5\6" * 9)], zip64)
        read = lambda at, n, raw=raw: raw[at : at + n]
        found = archives.zip_members(read, len(raw))
        assert {k: raw[a : a + n] for k, (a, n) in found.items()} == {"a": b"12345", "b": b"PK\5\6" * 9}
        with zipfile.ZipFile(io.BytesIO(raw)) as z:  # another implementation reads it
            assert z.testzip() is None and z.read("b") == b"PK\5\6" * 9
    with pytest.raises(ValueError):
        archives.zip_members(lambda at, n: bytes(n), 100)


def test_archives(spark):
    ship(spark)
    rows = [(1, "u", "x"), (2, None, "x"), (3, "http://a b/", None), (4, "u", ""), (None, "u", "x"), (1, "u", "x"), (9, "u", "é" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    named = df.withColumn("page_id", F.concat(F.lit("päge /:> "), F.col("page_id").cast("string")))  # ids of another type, with characters that headers refuse
    texts = {(r.page_id, r.refers_to) for r in archives.archive_round_trip(named).collect()}
    assert texts == {(None if k is None else f"päge /:> {k}", None if f is None else f"päge /:> {f}") for k, f in ((1, None), (2, 1), (3, None), (4, 3), (None, None), (9, None))}
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in archives.archive_round_trip(df).collect())
    assert got == [(0, "response", None, 1), (1, "response", None, 1), (1, "response", None, 1), (2, "revisit", 1, 1), (3, "response", None, 0), (4, "revisit", 3, 0), (9, "response", None, 100_000)]


def test_near_duplicates(spark, odd):
    got = by_id(near_duplicates(odd))
    assert [got[k]["component_id"] for k in sorted(TEXTS)] == [1, 2, 3, 4, 5, 5, 7, 8, 9] and got[1]["n_shingles"] == 0 and got[4]["n_shingles"] == 1


def similar_pairs(percents: range, per: int, n: int = 600) -> list[tuple[int, str, str]]:
    """(percent, a, b): texts whose shingle sets overlap by at least ``percent`` and less than one more."""
    out = []
    for p in percents:
        for k in range(per):
            words = [f"w{p}x{k}x{i}" for i in range(n)]
            shared = -(-p * 2 * (n - 4) // (100 + p))  # j = s / (2 * m - s)
            tail = [f"z{p}x{k}x{i}" for i in range(n - 4 - shared)]
            out.append((p, " ".join(words), " ".join(words[: n - len(tail)] + tail)))
    return out


def test_pipeline_drops_pairs_from_80_percent(spark):
    ship(spark)
    pairs = similar_pairs(range(78, 86), 3)
    rows = [(2 * i + k, t) for i, (_, *ab) in enumerate(pairs) for k, t in enumerate(ab)]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert got == {2 * i for i in range(len(pairs))} | {2 * i + 1 for i, (p, *_) in enumerate(pairs) if p < 80}


def test_near_duplicates_bounds_follow_the_threshold(spark):
    for percent in range(11, 101):
        bands, rows, least = near_dedup.bounds(percent)
        assert bands * rows <= near_dedup.PERMUTATIONS and (1 - (percent / 100) ** rows) ** bands <= near_dedup.BAND_MISS and least < percent / 100
    for percent in (0, 10, 101):
        with pytest.raises(ValueError):
            near_dedup.bounds(percent)
    ship(spark)
    pairs = similar_pairs(range(50, 54), 10)
    rows = [(2 * i + k, t) for i, (_, *ab) in enumerate(pairs) for k, t in enumerate(ab)]
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=50))
    assert all(got[2 * i + 1]["component_id"] == 2 * i for i in range(len(pairs)))


def test_bpe(spark, odd):
    tok = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    tok.no_truncation()
    tok.no_padding()
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    got = by_id(bpe_round_trip(docs, f"{TOKENIZERS}/word_bpe_49k.json"))
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[r.doc_id]["n_tokens"], got[r.doc_id]["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids)))), r.doc_id
        assert got[r.doc_id]["decoded_sha256"] == sha(tok.decode(ids, skip_special_tokens=False)), r.doc_id


def test_media(spark, odd):
    got = by_id(interleaved_media(odd))
    for k, t in TEXTS.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (got[k]["n_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        png = interleave.to_png(payload)
        assert interleave.from_png(png) == payload and got[k]["media_sha256"] == hashlib.sha256(png).hexdigest()
        # a picture of its own and one that texts of its size share, in order, between texts; an empty text has no title
        first = 1 + bool(raw.strip())
        want = (first, f"text of {len(raw)} bytes", first + 4, 2, first + 2, f"size of {len(raw)} bytes", hashlib.sha256(interleave.badge(len(raw))).hexdigest())
        assert tuple(got[k][c] for c in ("position", "caption", "n_elements", "n_media", "badge_position", "badge_caption", "badge_sha256")) == want
    with pytest.raises((ValueError, struct.error, zlib.error)):
        interleave.from_png(png[:-20] + b"\0" * 20)


def test_interleaved_elements(spark):
    a, b = "a" * 64, "b" * 64
    page = f'<p>One<img src="media:sha256:{a}" alt="alt">two</p><figure><img src="media:sha256:{b}"><figcaption>A <b>cap</b></figcaption></figure><img src="x.png"><p>three'
    assert [x[:5] for x in interleave.elements(page)] == [(0, "text", "One", None, None), (1, "media", None, a, "alt"), (2, "text", "two", None, None), (3, "media", None, b, "A cap"), (4, "media", None, None, None), (5, "text", "three", None, None)]
    assert [x[5] for x in interleave.elements(page) if x[1] == "media"] == [f"media:sha256:{a}", f"media:sha256:{b}", "x.png"]
    short = lambda h: [x[2] or (x[5], x[4]) for x in interleave.elements(h)]
    assert short("<figure><p>only words</p><figcaption>no picture</figcaption></figure>after") == ["only words", "no picture", "after"]
    assert short("<figure><img src=1><figcaption>open</figure><p>next</p>") == [("1", "open"), "next"]
    assert short("<figure><img src=1><img src=2><figcaption>both<h2>Head</h2>tail") == [("1", "both"), ("2", "both"), "Head", "tail"]
    ship(spark)
    pages = interleave.sequences(spark.createDataFrame([(1, page), (2, None), (3, page)], "page_id long, html string"))
    media = spark.createDataFrame([(b, 7)], "digest string, bytes int")
    got = sorted(((r.page_id, r.position, r.caption, r.bytes) for r in interleave.resolve(pages, media, "page_id").collect()), key=lambda x: x[:2])
    want = [(1, "alt", None), (3, "A cap", 7), (4, None, None)]
    assert got == [(k, *x) for k in (1, 3) for x in want]


def test_shards(spark, odd):
    for df, n in ((odd, 3), (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 40)):
        rows = sharding.shard_by_bytes(df, n).collect()
        assert len(rows) == df.count()
        shards = {}
        for r in rows:
            shards.setdefault(r.shard, []).append(r)
        assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
        sums = [sum(r.size for r in s) for s in shards.values()]
        assert max(sums) - min([*sums, 0][: len(sums)]) <= 1.05 * max(r.size for r in rows)


def test_shards_are_what_the_texts_say(spark):
    """Sizes and sums recomputed, more cuts than a fixed depth of the search allows, and one text that fills shards by itself."""
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = QUERIES["op8_sampled_splitters"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "bytes", None) and 0 <= r.shard < 40 for r in rows)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert len(sums) == 40 and max(sums.values()) - min(sums.values()) < max(r.size for r in rows)
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same text")).otherwise(F.col("id").cast("string")).alias("text"))
    shards = {r.shard: r for r in sharding.shard_by_bytes(many, 2500).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d")).collect()}
    assert len(shards) == 2500 and max(r.b for r in shards.values()) - min(r.b for r in shards.values()) <= 40
    assert all(r.n == r.d == r.top + 1 for r in shards.values())


def brute_rules(text: str) -> tuple[int, int, int]:
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + d for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for d in range(5)}
    longest = 0
    if len(w) < 400:
        for i in range(len(w)):
            for j in range(i):
                n = 0
                while i + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                longest = max(longest, n)
    return len(w), len(covered), longest


def test_quality_rules(spark, odd):
    got = by_id(quality_rules.quality_rules(odd))
    for k, t in TEXTS.items():
        n, covered, longest = brute_rules(t or "")
        assert (got[k]["n_words"], got[k]["n_repeat_words"]) == (n, covered)
        assert n >= 400 or got[k]["longest_repeat"] == longest
    assert got[8]["n_dup_lines"] == 0 and got[8]["n_symbols"] == 6 and got[9]["base_failed"] and got[1]["base_failed"]
