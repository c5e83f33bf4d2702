"""Near-duplicate groups against a brute-force version, with groups of many chunks, repeated and missing ids."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratalog.llm import near_dedup
from stratalog.llm.components import components
from stratalog.session import ship


def shingles(text: str) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(n)]


def brute(texts: list[str], percent: int) -> list[int]:
    """Root of each text by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return roots(len(texts), links)


def edited(rng: random.Random, words: list[str], edits: int) -> str:
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [3, 256])
def test_groups_are_those_of_all_pairs(spark, block):
    """Tight groups, loose ones with links only through others, and pairs around the threshold."""
    ship(spark)
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(120)]
        texts += [edited(rng, base, rng.choice([0, 1, 2, 2, 3, 3, 4, 6])) for _ in range(rng.choice([2, 9, 25]))]
    texts += ["one two", "One  two", "", None, "  "]
    rng.shuffle(texts)
    want = brute(texts, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("k", "h", "node", "leader", "n", "at", "known")})
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, 80, block=block).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) and got[i].n_shingles == len(shingles(t)) for i, t in enumerate(texts))


def test_large_group_of_distinct_near_copies(spark):
    """5,000 distinct near copies are one component, with a stray that only some of them are linked with; chunks alone don't find that one."""
    ship(spark)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = [edited(rng, base, 1) for _ in range(5000)]
    mid = base[:24] + [f"m{i}" for i in range(11)] + base[35:]  # 0.90 of a copy
    far = mid[:60] + [f"f{i}" for i in range(28)] + mid[88:]  # linked with mid, not with the copies
    texts += [" ".join(mid), " ".join(far)]
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert alike(sets[-1], sets[-2]) >= 0.8 and max(alike(sets[-1], s) for s in sets[:-2]) < 0.8 <= min(alike(sets[-2], s) for s in sets[:-2])
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_missing_and_repeated_ids(spark):
    ship(spark)
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(None, a), (7, a), (7, b), (3, b), (None, "alone here"), (None, None), (9, b), (9, b), (None, "twice"), (None, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == sorted([(0, 7, False), (7, 7, True), (7, 3, False), (3, 3, True), (0, 0, True), (0, 0, True), (9, 3, False), (9, 3, False), (0, 0, True), (0, 0, True)])
    left = sorted((r.doc_id or 0, r.text or "", r.extra) for r in near_dedup.drop_near_duplicates(df).collect())
    assert left == sorted([(7, a, 1), (3, b, 1), (0, "alone here", 1), (0, "", 1), (0, "twice", 1)])
    assert near_dedup.drop_near_duplicates(df.limit(0)).columns == df.columns and near_dedup.drop_near_duplicates(df.limit(0)).count() == 0
    same = spark.createDataFrame([(5, a), (5, a), (6, "x"), (6, "y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dedup.drop_near_duplicates(same).collect()) == [(5, a), (6, "x"), (6, "y")]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    order = rng.sample(range(60), 60)
    chain = list(zip(order, order[1:]))  # long and in no order
    links = chain + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)] + [(300, 300), (301, 302), (302, 301)]
    df = spark.createDataFrame([*links, (None, 5), (6, None)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    want, groups = roots(400, [x for x in links if x[0] != x[1]]), defaultdict(list)
    for x in {v for ab in links if ab[0] != ab[1] for v in ab}:
        groups[want[x]].append(x)
    assert got == {x: min(g) for g in groups.values() for x in g}
    assert components(df.limit(0)).count() == 0


def test_columns_with_the_names_of_keys_stay(spark):
    ship(spark)
    text = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, text, 7, 8, 9), (2, text, 7, 8, 9), (3, "something else altogether", 5, 6, 4), (1, text, 1, 2, 3)], "doc_id long, text string, _k int, _h long, k int")
    out = near_dedup.drop_near_duplicates(df)
    rows = {(r.doc_id, r._k, r._h, r.k) for r in out.collect()}
    assert out.columns == df.columns and len(rows) == 2 and (3, 5, 6, 4) in rows and rows <= {(1, 7, 8, 9), (1, 1, 2, 3), (3, 5, 6, 4)}
