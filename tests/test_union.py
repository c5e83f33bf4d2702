"""The union of deltas, at once and batch by batch, in any order."""

import random


from stratalog.operators import mutations, union
from stratalog.session import ship
from stratalog.streaming import sync

VERSION = "filehistory_id string, version int, path string, status string, filecontent_checksum string, place long"


def said(rng, n=400):
    return [(f"h{rng.randrange(60)}", rng.randint(1, 4), f"p{rng.randrange(25)}", rng.choice(["NEW", "CHANGED", "DELETED"]), rng.choice(["c1", "c2", None]), k // 4) for k in range(n)]


def plain(rows):
    first, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[2], r[3], (r[4] is not None, r[4]))):
        first.setdefault(r[:2], r)
    for (h, v), r in sorted(first.items()):
        last[h] = r
    return first, last


def test_first_writer_wins_in_any_order(spark):
    rng = random.Random(6)
    rows = said(rng)
    first, last = plain(rows)
    for _ in range(2):
        rng.shuffle(rows)
        got = union.union_of({"fileversion": spark.createDataFrame(rows, VERSION).repartition(7)})["fileversion"]
        assert {tuple(r) for r in got.collect()} == set(first.values())
        ends = union.last_versions(got)
        assert {tuple(r) for r in ends.collect()} == set(last.values())
        paths = {}
        for r in last.values():
            if r[3] != "DELETED":
                paths[r[2]] = max(paths.get(r[2], ""), r[0])
        assert {r.path: r.filehistory_id for r in union.by_path(ends).collect()} == paths
        assert {r.filecontent_checksum: r.n for r in union.by_content(ends).collect()} == {c: sum(r[4] == c for r in last.values()) for c in ("c1", "c2")}


def test_batches_fold_into_the_same(spark, tmp_path):
    """In any order, one of them twice, as a stream runs them after a failure."""
    ship(spark)
    rng = random.Random(8)
    rows = said(rng, 120)
    first, last = plain(rows)
    parts = [rows[:50], rows[50:51], rows[51:]]
    rng.shuffle(parts)
    folder = str(tmp_path / "union")
    for part in [*parts, parts[0]]:
        union.fold(folder, {"fileversion": spark.createDataFrame(part, VERSION)}, buckets=4)
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/fileversion").drop("bucket").select("filehistory_id", "version", "path", "status", "filecontent_checksum", "place").collect()} == set(first.values())
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/last").select("filehistory_id", "version", "path", "status", "filecontent_checksum", "place").collect()} == set(last.values())


def test_a_stream_of_delta_files_keeps_the_union(spark, tmp_path):
    ship(spark)
    schema = "checksum string, size long, place long"
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "union")
    for rows in ([("a", 2, 5), ("b", 1, 1)], [("a", 1, 2), ("c", 3, 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        sync.ingest(spark, inbox, schema, str(tmp_path / "ledger"), lambda df, n: union.fold(folder, {"chunk": df}, buckets=2), once=True).awaitTermination()
    assert {(r.checksum, r.size, r.place) for r in spark.read.parquet(f"{folder}/chunk").collect()} == {("a", 1, 2), ("b", 1, 1), ("c", 3, 9)}


def test_placed_tables(spark):
    heads = "client string, vectorclock_serialized string"
    deltas = {"chunk": spark.createDataFrame([("A", "(A1)", "x", 1), ("A", "(A2)", "x", 2), ("B", "(B1)", "y", 3)], f"{heads}, checksum string, size long")}
    places = spark.createDataFrame([("A", "(A1)", 2), ("A", "(A2)", 1)], f"{heads}, place long")
    got = union.union_of(union.placed_tables(deltas, places))["chunk"].collect()
    assert [(r.checksum, r.size) for r in got] == [("x", 2)]  # B's commit is in no branch


def test_insert_absent_takes_the_first(spark):
    old = spark.createDataFrame([("k", 1)], "checksum string, size long")
    new = spark.createDataFrame([("k", 2, 1), ("n", 5, 7), ("n", 9, 3), ("n", 4, 8)], "checksum string, size long, place int").repartition(3)
    assert sorted(map(tuple, mutations.insert_absent(old, new, ["checksum"], "place").collect())) == [("k", 1), ("n", 9)]
    assert sorted(map(tuple, mutations.insert_absent(old, new.drop("place"), ["checksum"]).collect())) == [("k", 1), ("n", 4)]
    pair = spark.createDataFrame([("a", "b"), ("a", "b")], "x string, y string")
    assert mutations.insert_absent(pair.limit(0), pair, ["x", "y"]).count() == 1
