"""Moved files: each history goes on in one file."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from stratalog.operators import diff, indexing
from stratalog.operators.splits import placed
from stratalog.session import ship
from stratalog.sources.model import SCHEMAS

T = datetime(2024, 1, 1)


def tree(spark, paths):
    rows = [(i, 1, 1, p, "FILE", "NEW", 5, T, None, c, T, None, None) for i, p, c in paths]
    return spark.createDataFrame(rows, SCHEMAS["fileversion"])


def listing(spark, paths):
    rows = [(p, kind, 5, T, c, None, None, None) for p, kind, c in paths]
    return spark.createDataFrame(rows, "path string, type string, size long, lastmodified timestamp_ntz, checksum string, linktarget string, posixperms string, dosattrs string")


def guessed(spark, old, new):
    disk = listing(spark, [(p, "FILE", c) for p, c in new])
    return {r.path: r.filehistory_id for r in diff.guess_histories(disk.select("path", "checksum", "size", "lastmodified"), tree(spark, old), disk).collect()}


def test_common_suffix(spark):
    pairs = [("a/x.txt", "b/x.txt", 6), ("", "a", 0), ("abc", "abc", 3), ("c", "abc", 1), ("abc", "abd", 0), ("é漢x", "漢x", 2), ("aXa", "bXa", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    assert all(r.got == r.n for r in df.select("n", diff.common_suffix(F.col("a"), F.col("b")).alias("got")).collect())


def test_one_history_for_each_file(spark):
    ship(spark)
    two = guessed(spark, [("h1", "a/9.txt", "c"), ("h2", "a/8.txt", "c")], [("b/8.txt", "c"), ("b/9.txt", "c")])
    assert two == {"b/8.txt": "h2", "b/9.txt": "h1"}
    more = guessed(spark, [("h1", "a/1.txt", "c"), ("h2", "a/2.doc", "c")], [("b/x.doc", "c"), ("b/y.txt", "c"), ("b/z.txt", "c"), ("b/q.txt", "other")])
    assert more == {"b/x.doc": "h2", "b/y.txt": "h1", "b/z.txt": None, "b/q.txt": None}
    one = guessed(spark, [("h1", "a/report-old.pdf", "c"), ("h2", "a/x.pdf", "c"), ("h3", "kept.pdf", "c")], [("b/my-old.pdf", "c"), ("kept.pdf", "c")])
    assert one == {"b/my-old.pdf": "h1", "kept.pdf": "h3"}
    only = guessed(spark, [("h1", "a/x.pdf", "c")], [("b/y.pdf", "c"), ("b/x.pdf", "c"), ("c/x.pdf", "c")])
    assert only == {"b/y.pdf": None, "b/x.pdf": "h1", "c/x.pdf": None}
    assert guessed(spark, [("h1", "a", "c")], [("b", None)]) == {"b": None}


def test_a_path_that_is_there_as_a_folder_isnt_gone(spark):
    disk = listing(spark, [("b/8.txt", "FILE", "c"), ("a/8.txt", "FOLDER", None)])
    old = tree(spark, [("h1", "a/8.txt", "c"), ("h2", "z/7.txt", "c")])
    assert {r.path: r.filehistory_id for r in diff.guess_histories(disk.where("type = 'FILE'").select("path", "checksum", "size", "lastmodified"), old, disk).collect()} == {"b/8.txt": "h2"}


def test_many_equal_files_move(spark):
    ship(spark)
    old = tree(spark, [(f"h{i:03d}", f"a/d{i % 7}/f{i}.txt", "c") for i in range(200)])
    disk = listing(spark, [(f"b/d{i % 7}/f{i}.txt", "FILE", "c") for i in range(200)])
    out = indexing.indexed(disk, old, F.lit(T).cast("timestamp_ntz")).collect()
    assert len(out) == 200 and {r.kind for r in out} == {"changed"}
    assert all(r.path == f"b/d{int(r.filehistory_id[1:]) % 7}/f{int(r.filehistory_id[1:])}.txt" for r in out)


def test_a_hundred_thousand_equal_files(spark):
    ship(spark)
    ids = spark.range(100_000)
    old = ids.select(F.lit("c").alias("key"), F.concat(F.lit("a/"), "id").alias("path"), F.col("id").cast("string").alias("filehistory_id"))
    new = ids.select(F.lit("c").alias("key"), F.concat(F.lit("b/"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id"))).alias("path"))
    began = time.time()
    got = diff.moved_histories(new, old).collect()
    assert time.time() - began < 60 and len(got) == 100_000 == len({r.filehistory_id for r in got}) == len({r.path for r in got})
    assert all(r.path == f"b/{r.filehistory_id}" for r in got if int(r.filehistory_id) % 2 == 0)


def test_places(spark):
    rows = spark.range(4_000).select(F.when(F.col("id") < 3_500, "big").otherwise(F.concat(F.lit("g"), (F.col("id") % 9).cast("string"))).alias("g"), F.hash("id").alias("v"))
    by = {}
    for r in placed(rows, ["g"], ["v"]).collect():
        by.setdefault(r.g, []).append((r.place, r.v))
    for got in by.values():
        assert [p for p, _ in sorted(got)] == list(range(1, len(got) + 1)) and sorted(got) == sorted(got, key=lambda x: x[1])
