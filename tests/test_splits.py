"""Parts whose sums start anew, against a plain loop."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.operators import chunks
from stratalog.operators.splits import numbered, part_numbers
from stratalog.session import cut, ship
from stratalog.sources import deltalog


def plain(sizes, most, rows=None):
    out, part, filled, held = [], 0, 0, 0
    for v in sizes:
        if filled >= most or (rows is not None and held >= rows):
            part, filled, held = part + 1, 0, 0
        filled, held = filled + v, held + 1
        out.append(part)
    return out


def test_one_range():
    rng = random.Random(1)
    for _ in range(500):
        sizes = [rng.choice([0, 1, 3, 50, 999]) for _ in range(rng.randint(0, 40))]
        most, rows = rng.choice([1, 5, 60, 1000]), rng.choice([None, 1, 2, 7])
        assert part_numbers(np.array(sizes, np.int64), most, rows).tolist() == plain(sizes, most, rows)


@pytest.mark.parametrize("most, rows", [(100, None), (100, 7), (10**9, 7), (1, None), (5_000, 1_000)])
def test_many_ranges(spark, most, rows):
    """Groups that span ranges, one with nearly all rows; a null group; ranges without a cut."""
    ship(spark)
    rng = random.Random(most)
    data = [("big", i, 0, rng.choice([0, 0, 1, 2, 30, 400])) for i in range(3_000)] + [(k, i, i % 2, rng.randint(0, 60)) for k in ("a", None) for i in range(40)] + [("one", 0, 0, 5)]
    df = spark.createDataFrame(data, "g string, i long, j int, v long").withColumns({c: F.lit(1) for c in ("k", "r", "_r", "n")}).repartition(5)
    got = numbered(df, "g", ["i", "j"], "v", most, rows)
    assert got.columns == [*df.columns, "part"]
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.i, r.j)):
        by.setdefault(r.g, []).append(r.part)
    for g, parts in by.items():
        assert parts == plain([v for k, _, _, v in data if k == g], most, rows)
    assert numbered(df.limit(0), "g", ["i"], "v", most, rows).count() == 0


def test_commits_keep_their_bounds(spark):
    ship(spark)
    files = [("a", i, 40 << 20) for i in range(12)] + [("b", i, 50 << 20) for i in range(10)] + [("b", 10 + i, 10) for i in range(50_000)]
    df = spark.createDataFrame(files, "client string, file_id long, size long")
    got = chunks.commit_numbers(df).collect()
    assert [r.commit for r in sorted((r for r in got if r.client == "a"), key=lambda r: r.file_id)] == [i // 2 for i in range(12)]
    per = Counter((r.client, r.commit) for r in got)
    assert max(per.values()) == chunks.COMMIT_FILES and [per["b", k] for k in range(15)] == [1] * 10 + [10_000] * 5


def test_batches(spark):
    ship(spark)
    start = datetime(2024, 1, 1)
    heads = [("A", f"(A{i})", start + timedelta(hours=i), f"f{i // 2}") for i in range(7)]
    h = spark.createDataFrame(heads, "client string, vectorclock_serialized string, localtime timestamp_ntz, file string")
    fresh = spark.createDataFrame([("A", f"(A{i})", f"{i}-{k}") for i in range(7) for k in range(90)], "client string, vectorclock_serialized string, id string")
    of = lambda items, **more: [r.batch for r in deltalog.read_batches(h, items, 100, **more).orderBy("localtime").collect()]
    assert of(fresh) == [0, 0, 1, 1, 2, 2, 3]
    assert of(fresh, file="file") == [0, 0, 1, 1, 2, 2, 3]
    same = fresh.withColumn("id", F.substring_index("id", "-", -1))
    assert of(same) == [0] * 7  # the same ninety again and again
    mixed = spark.createDataFrame([("A", f"(A{i})", str(k)) for i in range(7) for k in range(60 * i, 60 * i + 90)], fresh.schema)
    assert of(mixed) == [0, 0, 1, 1, 2, 2, 3] and of(fresh.limit(0)) == [0] * 7


def test_containers_of_many_chunks(spark):
    ship(spark)
    rng = random.Random(4)
    rows = [("c", i // 9, i % 9, f"{i:06d}", rng.randint(1, 200)) for i in range(100_000)]
    df = spark.createDataFrame(rows, "commit string, file_id long, num int, checksum string, size long")
    got = {r.checksum: r.container for r in chunks.pack_containers(df, 4096).collect()}
    assert [got[r[3]] for r in rows] == plain([r[4] for r in rows], 4096)


def test_container_files_hold_their_chunks(spark):
    ship(spark)
    rows = [("c", i, 0, f"{i:04d}", i % 5 + 1, bytes([i % 256]) * (i % 5 + 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "commit string, file_id long, num int, checksum string, size long, data binary")
    files = chunks.container_files(df, 64)
    for f in files.collect():
        assert all(bytes(f.content)[e.offset : e.offset + e.size] == rows[int(e.checksum)][5] for e in f.entries)
        assert len(f.content) == sum(e.size for e in f.entries)
    back = chunks.stored_chunks(files, df.where("file_id < 20")).collect()
    assert {r.checksum: bytes(r.data) for r in back} == {r[3]: r[5] for r in rows[:20]}


def test_chunks_leave_their_container_before_they_move(spark):
    df = spark.createDataFrame([(1, i, 0, f"{i:02d}", 3, bytes([i] * 3)) for i in range(40)], "commit int, file_id int, num int, checksum string, size int, data binary")
    files = cut(chunks.container_files(df, 64), "containers")
    back = chunks.stored_chunks(files, df)
    plan = spark._jvm.PythonSQLUtils.explainString(back._jdf.queryExecution(), "formatted")
    moved = [part for part in plan.split("\n\n") if "Exchange\n" in part]
    assert moved and not [part for part in moved if "content" in part]  # a container would go along with each of its chunks
    assert sorted((r.checksum, bytes(r.data)) for r in back.collect()) == [(f"{i:02d}", bytes([i] * 3)) for i in range(40)]
