"""Periodic runs against a search over all periods, and against their SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare
from stratalog.llm.catalog import QUERIES, SQL
from stratalog.llm.periodic import Ends, collapsed, periodic_runs, repeated_tail, runs_of
from stratalog.session import ship

SF = "/root/testdata/sf0.001"


def plain(x: list[int]) -> list[tuple[int, int, int]]:
    """Stretches where words a period apart agree; a stretch counts with its smallest period."""
    best = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs():
    rng = random.Random(5)
    found = 0
    for _ in range(2000):
        n = rng.randint(0, 60)
        x = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a, p, m = rng.randrange(n), rng.randint(1, 8), rng.randint(0, 40)
            x[a : a + m] = [x[a + i % min(p, n - a)] for i in range(min(m, n - a))]
        want = plain(x)
        found += len(want)
        assert runs_of(np.array(x, np.int64)) == want
        assert runs_of(np.array(x, np.int64), narrow=False) == want  # the filter changes nothing
    assert found > 500


def test_long_runs_and_limits():
    assert runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert runs_of(np.arange(40_000) % 5_000) == [(0, 40_000, 5_000)]
    assert runs_of(np.arange(3 * 5_000) % 5_000) == []
    a, b = [0], [0, 1]
    while len(b) < 5_000:
        a, b = b, b + a
    assert runs_of(np.array(b)) == []  # a Fibonacci word has no fourth power
    for bad in ({"exponent": 1}, {"exponent": 3}, {"shortest": 5}):
        with pytest.raises(ValueError):
            runs_of(np.zeros(9, np.int64), **bad)


def test_ordered_positions():
    rng = random.Random(2)
    some = rng.sample(range(100_000), 6_000)
    ends, seen = Ends(some[0]), [some[0]]
    for x in some[1:]:
        ends.add(x)
        seen.append(x)
    seen.sort()
    assert list(ends) == seen and ends.size == len(seen)
    for k in (0, 1, 17, 3_000, len(seen) - 1):
        assert ends.around(seen[k]) == (seen[k - 1] if k else -1, seen[k + 1] if k + 1 < len(seen) else -1)


def test_tail():
    words = [b"%d" % i for i in range(50)]
    for key in range(300):
        h = zlib.crc32(str(key).encode())
        out = repeated_tail(key, words)
        assert len(out) == 50 and (out == words) == (h % 10 != 0 or len(set(out)) == 50)
    assert repeated_tail(1, []) == []
    assert collapsed([b"a", b"b", b"a", b"b", b"a", b"b", b"a", b"b", b"c"], [(0, 8, 2)]) == [b"a", b"b", b"c"]


def test_rows(spark):
    ship(spark)
    empty = hashlib.sha256(b"").hexdigest()
    text = {1: None, 2: "", 3: " \n\t", 4: "x " * 5, 5: "x " * 6, 6: "ab cd é " * 4 + "q", None: "x X x X x X x X", 8: "a b " * 4 + "a b c d " * 4 + "z " * 20_000}
    rows = [(k, t) for k, t in text.items()] + [(5, text[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_runs", "start", "ids", "length")})
    got = periodic_runs(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and len([r for r in got if r.doc_id == 5]) == 2
    for k in (1, 2, 3):
        assert tuple(by[k])[1:] == (0, None, None, None, None, empty, empty)
    assert by[4].n_runs == 0 and tuple(by[5])[1:6] == (1, 0, 6, 1, 6000)
    assert tuple(by[6])[1:6] == (1, 0, 8, 2, 4000)
    assert by[6].collapsed_sha256 == hashlib.sha256("ab cd é q".encode()).hexdigest()
    assert tuple(by[None])[1:6] == (1, 0, 8, 2, 4000)
    assert by[8].n_runs == 3 and (by[8].start, by[8].length, by[8].period) == (24, 20_000, 1)
    assert by[8].runs_sha256 == hashlib.sha256(b"0,10,2\n8,16,4\n24,20000,1\n").hexdigest()
    assert periodic_runs(docs.limit(0)).count() == 0


def test_sql(spark):
    compare(spark, QUERIES["op12_periodic_runs"], SQL["op12_periodic_runs"], SF)
