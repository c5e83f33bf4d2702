"""Operators on small hand-written rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalog.functions import clocks, text
from stratalog.operators import causality, chunks, diff, history, indexing, lookups, mutations
from stratalog.plans.store import VersionStore
from stratalog.session import ship
from stratalog.sources import deltalog
from stratalog.sources.model import SCHEMAS
from stratalog.streaming import sync


def test_clock_laws(spark):
    rng = random.Random(3)
    made = ["(" + ",".join(f"{c}{rng.randint(1, 3)}" for c in "ABC" if rng.random() < 0.7) + ")" for _ in range(20)]
    made += ["(UnitA4,UnitB5)", "(UnitA4,UnitB100000)", "(UnitC1,UnitD2)", "()"]
    df = spark.createDataFrame([(a, b) for a in made for b in made], "a string, b string")
    parse = lambda c: clocks.vc_parse(F.col(c))
    got = {(r.a, r.b): r.o for r in df.select("a", "b", clocks.vc_compare(parse("a"), parse("b")).alias("o")).collect()}
    flip = {"EQUAL": "EQUAL", "SMALLER": "GREATER", "GREATER": "SMALLER", "SIMULTANEOUS": "SIMULTANEOUS"}
    assert all(got[b, a] == flip[o] for (a, b), o in got.items())
    assert got["(UnitA4,UnitB5)", "(UnitA4,UnitB100000)"] == "SMALLER" and got["(UnitA4,UnitB5)", "(UnitC1,UnitD2)"] == "SIMULTANEOUS"
    for a, b, c in ((a, b, c) for a in made for b in made for c in made):
        if got[a, b] == got[b, c] == "SMALLER":
            assert got[a, c] == "SMALLER"
    with pytest.raises(Exception, match="no vector clock"):
        spark.createDataFrame([("A1",)], "a string").select(clocks.vc_parse(F.col("a"))).collect()


def headers(spark, branches: dict[str, str]):
    rows = []
    for branch, line in branches.items():
        for pos, h in enumerate(line.split()):
            client, clock, t = h.split("/")
            rows.append(("r", branch, pos, client, clock, int(t)))
    return spark.createDataFrame(rows, "repo string, branch string, pos int, client string, clock string, t long")


def test_branches(spark):
    ship(spark)
    h = headers(spark, {"A": "A/(A1)/1 A/(A2)/3 A/(A3)/4", "B": "A/(A1)/1 B/(A1,B1)/2", "C": "A/(A1)/1 A/(A2)/3 C/(A2,C1)/5"})
    won = causality.winners(h).first()
    assert (won.winner, won.clock) == ("B", "(A1,B1)")  # taken second, and none of the later ones is greater
    b, a = h.where("branch = 'B'"), h.where("branch = 'A'")
    assert [r.clock for r in causality.to_prune(b, a).orderBy("pos").collect()] == ["(A1,B1)"]
    assert [r.clock for r in causality.to_apply(b, a).orderBy("pos").collect()] == ["(A2)", "(A3)"]
    assert causality.to_prune(a, h.where("branch = 'A' and pos < 2")).count() == 0  # merely longer


def test_same_timestamp_and_skewed_clock(spark):
    ship(spark)
    same = headers(spark, {"A": "A/(A3)/1 A/(A4)/9", "B": "A/(A3)/1 B/(A3,B1)/9"})
    assert causality.winners(same).first().winner == "A"
    skewed = headers(spark, {"A": "A/(A1)/50", "B": "A/(A1)/50 B/(A1,B1)/10"})  # later by its clock, earlier by its time
    assert causality.winners(skewed).first().winner == "B"


def version(fh, v, path="p", status="NEW", updated=datetime(2024, 1, 1), content="c" * 40, kind="FILE", commit=1, size=1):
    return (fh, v, commit, path, kind, status, size, updated, None, content, updated, None, None)


def store(spark, versions, commits=((1, "MASTER"),)) -> VersionStore:
    s = VersionStore.empty(spark)
    head = [(i, st, datetime(2024, 1, 1), "A", f"(A{i})") for i, st in commits]
    return s.with_tables(fileversion=spark.createDataFrame(versions, SCHEMAS["fileversion"]), databaseversion=spark.createDataFrame(head, SCHEMAS["databaseversion"]))


def test_retention(spark):
    now = datetime(2024, 3, 1, 10, 0, 0)
    ages = [31 * 86400, 20 * 86400 + 1, 20 * 86400, 86401, 86400, 500, 499]
    s = store(spark, [version("h", i + 1, updated=now - timedelta(seconds=a)) for i, a in enumerate(ages)])
    gone = {r.version for r in history.thinned(s, F.lit(now).cast("timestamp_ntz")).collect()}
    assert set(range(1, 8)) - gone == {3, 5, 7}
    s = store(spark, [version("h", 1, updated=now - timedelta(days=9)), version("h", 2, updated=now - timedelta(days=8))])
    gone = history.thinned(s, F.lit(now).cast("timestamp_ntz"), intervals=((1, "MI"),), keep_seconds=0).collect()
    assert [r.version for r in gone] == [1]


def test_dirty_twin(spark):
    """A dirty commit's version has the same number as a master one."""
    s = store(spark, [version("h", 1), version("h", 2, status="DELETED", commit=3), version("h", 2, status="CHANGED", commit=2)], commits=((1, "MASTER"), (2, "DIRTY"), (3, "MASTER")))
    assert s.fileversion_master_last.count() == 0
    assert history.last_version(s, "h").count() == 1 and history.last_version(s, "h", strict_master=False).count() == 2
    out = mutations.remove_dirty(s, 9)
    assert out.fileversion.count() == 2 and out.databaseversion.count() == 2


def test_empty_store(spark):
    s = VersionStore.empty(spark)
    assert history.list_files(s).count() == 0 and lookups.local_branch(s).count() == 0
    assert mutations.collect_garbage(s).chunk.count() == 0 and causality.next_clock(s, "A").first().clock == {"A": 1}


def test_changes_and_actions(spark):
    t = datetime(2024, 1, 1)
    a = version("h", 1, updated=t)
    cases = [
        (version("h", 2, updated=t), []),
        (version("h", 2, updated=t + timedelta(milliseconds=900)), []),
        (version("h", 2, updated=t + timedelta(seconds=2)), [diff.MTIME]),
        (version("h", 2, size=2), [diff.SIZE, diff.CHECKSUM]),
        (version("h", 2, path="q"), [diff.PATH]),
        (version("h", 2, status="DELETED"), [diff.DELETED]),
        (version("h", 2, kind="FOLDER"), [diff.DELETED]),
    ]
    for b, want in cases:
        df = spark.createDataFrame([a, b], SCHEMAS["fileversion"])
        assert diff.version_changes(df).where("version = 2").first().changes == want
    df = spark.createDataFrame([([],), ([diff.DELETED],), ([diff.NEW],), ([diff.PATH],), ([diff.CHECKSUM],)], "c array<string>")
    known = df.select(diff.file_action(F.col("c"), F.lit(True), F.lit(True), F.lit(False)).alias("a")).collect()
    assert [r.a and r.a.action for r in known] == [None, "CHANGE", "DELETE", "RENAME", "CHANGE"]
    acts = [("NEW", "FILE", "b"), ("DELETE", "FOLDER", "x"), ("DELETE", "FILE", "a/1"), ("DELETE", "FILE", "a/2"), ("NEW", "FOLDER", "c"), ("CHANGE", "FILE", "z"), ("DELETE", "FOLDER", "x/y")]
    acts += [("NEW", "FILE", "x"), ("RENAME", "SYMLINK", "x"), ("NEW", "FILE", "x/z"), ("NEW", "FOLDER", "x/y")]  # a file and a link take the place of a folder
    df = spark.createDataFrame([(*a, f"{k:02d}") for k, a in enumerate(acts)], "action string, type string, path string, filehistory_id string")
    got = [(r.action, r.type, r.path) for r in sorted(diff.ordered_actions(df).collect(), key=lambda r: r.nth)]
    assert [p for _, _, p in got] == ["z", "a/2", "a/1", "c", "x/y", "b", "x/z", "x/y", "x", "x", "x"]
    assert got[-3:] == [("DELETE", "FOLDER", "x"), ("RENAME", "SYMLINK", "x"), ("NEW", "FILE", "x")]
    assert diff.ordered_actions(df.limit(0)).count() == 0


def plain_cuts(data: bytes, least: int, most: int, divisor: int) -> list[int]:
    """Content-defined cuts byte by byte: the window before the byte at ``least`` first, that byte never, then the others."""
    signed = [x - 256 if x > 127 else x for x in data]
    cuts, start = [], 0
    while start < len(data):
        end = min(start + most, len(data))
        cut = end
        window = signed[start + least - 48 : start + least]
        for at in range(start + least, end):
            if at > start + least:
                window = [*window[1:], signed[at]]
            a, b = sum(window), sum((48 - j) * x for j, x in enumerate(window))
            value = ((a & 0xFFFF) | (b << 16)) & 0xFFFFFFFF
            if value < 2**31 and value % divisor == divisor - 1:
                cut = at + 1
                break
        cuts.append(cut)
        start = cut
    return cuts


def test_chunks_round_trip(spark):
    ship(spark)
    rng = random.Random(5)
    files = [(1, bytes(rng.randbytes(100_000))), (2, b""), (3, b"x" * 5000), (4, b"x" * 5000)]
    df = spark.createDataFrame(files, "file_id long, content binary")
    for cut in (lambda: chunks.fixed_chunks(df, 1024), lambda: chunks.tttd_chunks(df, 1024)):
        c = cut()
        back = {r.file_id: bytes(r.content) for r in chunks.assemble(c.drop("data"), c.dropDuplicates(["checksum"])).collect()}
        assert back == {k: v for k, v in files if v}
    cuts = chunks.tttd_cuts(files[0][1], 1024)
    assert all(464 < b - a <= 2825 for a, b in zip([0, *cuts], cuts[:-1]))
    for data in (files[0][1], bytes(rng.choice(b"ab") for _ in range(30_000)), b"x" * 7000, bytes(465), bytes(464)):
        assert chunks.tttd_cuts(data, 1024) == plain_cuts(data, 464, 2825, 545)
    with pytest.raises(ValueError):
        chunks.tttd_cuts(b"x", 50)
    moved = chunks.tttd_cuts(b"abc" + files[0][1], 1024)
    assert len({x - 3 for x in moved} & set(cuts)) > len(cuts) // 2  # cuts follow the content
    sums = df.select("file_id", F.sha1("content").alias("checksum"))
    c = chunks.fixed_chunks(df, 1024)
    assert {r.file_id: bytes(r.content) for r in chunks.assemble(c.drop("data"), c.dropDuplicates(["checksum"]), sums).collect()} == dict(files)
    with pytest.raises(Exception, match="damaged chunk"):
        chunks.assemble(c.drop("data"), c.dropDuplicates(["checksum"]).withColumn("data", F.lit(b"other"))).collect()
    with pytest.raises(Exception, match="damaged content"):
        chunks.assemble(c.drop("data"), c.dropDuplicates(["checksum"]), sums.withColumn("checksum", F.lit("0"))).collect()
    with pytest.raises(Exception, match="missing chunk"):
        chunks.assemble(c.drop("data"), c.limit(1)).collect()


def test_delta_log(spark, tmp_path):
    s = store(spark, [version("h1", 1, path="a&<b>"), version("h2", 1, path="x\x01y", status="DELETED", content=None)])
    t = datetime(2024, 1, 1, 2, 3, 4, 567_000)
    link = ("h3", 1, 1, "l", "SYMLINK", "NEW", 0, t, "to/here", None, t, "rwxr--r--", "--a-")
    s = s.with_tables(
        fileversion=s.fileversion.union(spark.createDataFrame([link], SCHEMAS["fileversion"])), filehistory=spark.createDataFrame([("h1", 1), ("h2", 1), ("h3", 1)], SCHEMAS["filehistory"]),
        chunk=spark.createDataFrame([("k1", 1, 5), ("k2", 1, 6)], SCHEMAS["chunk"]), filecontent=spark.createDataFrame([("c" * 40, 1, 16), ("empty", 1, 0)], SCHEMAS["filecontent"]),
        filecontent_chunk=spark.createDataFrame([("c" * 40, "k2", 0), ("c" * 40, "k1", 1), ("c" * 40, "k1", 2)], SCHEMAS["filecontent_chunk"]),
        multichunk=spark.createDataFrame([("m", 1, 11)], SCHEMAS["multichunk"]), multichunk_chunk=spark.createDataFrame([("m", "k1"), ("m", "k2")], SCHEMAS["multichunk_chunk"]),
    )
    deltalog.write_deltas(s, f"{tmp_path}/log")
    tables = deltalog.read_deltas(spark, f"{tmp_path}/log")
    for name, df in tables.items():  # every table comes back with every column but the commit's id, which the clock stands for
        if name.startswith("databaseversion"):
            continue
        cols = [c for c in s.tables[name].columns if c != "databaseversion_id"]
        assert sorted(map(str, df.select(*cols).collect())) == sorted(map(str, s.tables[name].select(*cols).collect())), name
    assert [(r.of, r.logicaltime) for r in tables["databaseversion_vectorclock"].collect()] == [("A", 1)]
    assert deltalog.read_deltas(spark, f"{tmp_path}/log", "A", 2)["chunk"].count() == 0 and deltalog.read_deltas(spark, f"{tmp_path}/log", "A", 1, 1)["chunk"].count() == 2
    assert [tuple(r) for r in deltalog.read_headers(spark, f"{tmp_path}/log").select("client", "vectorclock_serialized").collect()] == [("A", "(A1)")]
    names = spark.createDataFrame([("database-A-0000000012",), ("multichunk-ab12",), ("action-up-B-17",), ("cleanup-3",), ("other",)], "name string")
    assert [(r.kind, r.client, r.number) for r in deltalog.parse_names(names).collect()] == [("database", "A", 12), ("multichunk", None, None), ("action", "B", None), ("cleanup", None, 3), (None, None, None)]


def test_ingest_once(spark, tmp_path):
    seen = []
    inbox, mark = f"{tmp_path}/in", f"{tmp_path}/mark"
    for k in range(2):
        spark.createDataFrame([(f"c{k}", k, 1)], SCHEMAS["chunk"]).write.mode("append").parquet(inbox)
        sync.ingest(spark, inbox, SCHEMAS["chunk"], mark, lambda df, _: seen.extend(r.checksum for r in df.collect()), once=True).awaitTermination()
    assert sorted(seen) == ["c0", "c1"]


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b.c/some-name_x.txt",)], "p string")
    r = df.select(text.depth(F.col("p")), text.file_name(F.col("p")), text.parent_path(F.col("p")), text.camel_case(F.lit("some-name_x y")), text.snake_case(F.lit("SomeName-x")), text.with_suffix(F.col("p"), F.lit("2")), text.human_size(F.lit(1536))).first()
    assert tuple(r) == (2, "some-name_x.txt", "a/b.c", "SomeNameXY", "some_name_x", "a/b.c/some-name_x (2).txt", "1.5 KB")
    assert text.parse_period("1d2h1.5m") == timedelta(days=1, hours=2, seconds=90)
    with pytest.raises(ValueError):
        text.parse_period("5 apples")


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab") if i % 50 else None, rng.choice([None, *range(20)]) if i % 3 else i, i, rng.randrange(100)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, tie int, v int")
    for descending in (False, True):
        got = {r.tie: (r._sum, r._n) for r in chunks.running(df, "g", "o", ["tie"], "v", descending, ranges=16).collect()}
        for g in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (1 if descending else -1, 0, r[2]) if r[1] is None else (0, -r[1] if descending else r[1], r[2]))
            total = 0
            for n, r in enumerate(own):
                assert got[r[2]] == (total, n)
                total += r[3]
    assert chunks.running(df.limit(0), "g", "o", ["tie"], "v").count() == 0


def plain_winner(rows) -> tuple:
    """client, clock, t of the last header taken: headers one by one, the earliest of those that no header left precedes."""
    clocks = {r[4]: {e[0]: int(e[1:]) for e in r[4][1:-1].split(",") if e} for r in rows}
    below = lambda a, b: clocks[a] != clocks[b] and all(n <= clocks[b].get(c, 0) for c, n in clocks[a].items())
    left, last = sorted({(r[5], r[3], r[4]) for r in rows}), None
    while left:
        one = next(h for h in left if not any(below(o[2], h[2]) for o in left))
        left.remove(one)
        if last is None or below(last[2], one[2]):
            last = one
    return last[1], last[2], last[0]


def test_winners_of_many_repositories(spark):
    ship(spark)
    rng, rows = random.Random(9), []
    for repo in range(12):
        for branch in "ABC":
            clock = dict.fromkeys("ABC", 0)
            for pos in range(rng.randrange(1, 9)):
                clock[branch] += 1
                for other in "ABC":
                    clock[other] += rng.random() < 0.2 and other != branch
                rows.append((f"r{repo}", branch, pos, branch, "(" + ",".join(f"{c}{n}" for c, n in clock.items() if n) + ")", rng.randrange(6)))
    got = {r.repo: r for r in causality.winners(spark.createDataFrame(rows, "repo string, branch string, pos int, client string, clock string, t long")).collect()}
    assert len(got) == 12
    for repo, r in got.items():
        assert (r.client, r.clock, r.t) == plain_winner([x for x in rows if x[0] == repo])


def test_indexing(spark):
    """A file that is as it was, one changed, one moved, one gone, one new, one that became a folder, and a path taken by another."""
    t = datetime(2024, 1, 1)
    tree = store(spark, [version("same", 1), version("mod", 3, path="m"), version("mov", 2, path="old/name.txt", content="d" * 40, size=7), version("gone", 1, path="g", content="e" * 40), version("type", 4, path="t", content="f" * 40)]).fileversion_master_last
    now = F.lit("2024-05-05 00:00:00").cast("timestamp_ntz")
    entry = lambda path, content="c" * 40, size=1, kind="FILE", at=t: (path, kind, size, at, content, None, None, None)
    schema = "path string, type string, size long, lastmodified timestamp_ntz, checksum string, linktarget string, posixperms string, dosattrs string"
    listing = [entry("p"), entry("m", "9" * 40, 2), entry("new/name.txt", "d" * 40, 7), entry("n", "8" * 40), entry("t", None, 0, "FOLDER")]
    rows = indexing.indexed(spark.createDataFrame(listing, schema), tree, now).collect()
    got = {(r.kind, r.path): (r.filehistory_id, r.version, r.status, r.type) for r in rows}
    assert got["changed", "m"] == ("mod", 4, "CHANGED", "FILE") and got["changed", "new/name.txt"] == ("mov", 3, "CHANGED", "FILE")
    assert got["new", "n"][1:] == (1, "NEW", "FILE") and got["new", "t"][1:] == (1, "NEW", "FOLDER") and got["new", "t"][0] != "type"
    assert got["replaced", "t"] == ("type", 5, "DELETED", "FILE") and got["deleted", "g"] == ("gone", 2, "DELETED", "FILE")
    assert len(rows) == 6 and all(str(r.updated) == "2024-05-05 00:00:00" for r in rows)
    none = spark.createDataFrame([], schema)
    assert {r.kind for r in indexing.indexed(none, tree, now).collect()} == {"deleted"} and indexing.indexed(none, tree.limit(0), now).count() == 0
    two = spark.createDataFrame([entry("x/name.txt", "d" * 40, 7), entry("y/name.txt", "d" * 40, 7)], schema)  # a moved file goes on once
    assert sorted((r.kind, r.path) for r in indexing.indexed(two, tree.where("filehistory_id = 'mov'"), now).collect()) == [("changed", "x/name.txt"), ("new", "y/name.txt")]


def test_disk_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"hello")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = {r.path: (r.type, r.size, r.checksum) for r in indexing.disk_listing(files, str(tmp_path)).collect()}
    assert got == {"d/a.txt": ("FILE", 5, "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d")}


def test_reconciled(spark):
    """Every state: nothing to do, new here, gone there, moved, changed here and there, and a history that a clean-up took."""
    won = [version("same", 1, path="s"), version("fresh", 1, path="f"), version("ends", 2, path="e", status="DELETED"), version("moves", 2, path="n"), version("edit", 2, path="x", content="d" * 40), version("clash", 2, path="c", content="d" * 40)]
    own = [version("same", 1, path="s"), version("ends", 1, path="e"), version("moves", 1, path="o"), version("edit", 1, path="x"), version("clash", 1, path="c"), version("purged", 1, path="q")]
    make = lambda rows: spark.createDataFrame(rows, SCHEMAS["fileversion"])
    disk = make([*own[:4], own[5], version("clash", 1, path="c", content="7" * 40)]).withColumnRenamed("filecontent_checksum", "checksum")
    disk = disk.union(make([own[3]]).limit(0)).dropDuplicates(["path"])
    got = {r.filehistory_id: (r.path, r.action, r.bucket) for r in diff.reconciled(make(won), make(own), disk).collect()}
    assert got == {"fresh": ("f", "NEW", "new"), "ends": ("e", "DELETE", "deleted"), "moves": ("n", "RENAME", "changed"), "edit": ("x", "CHANGE", "changed"), "clash": ("c", "CHANGE", "changed"), "purged": ("q", "DELETE", "deleted")}


def test_listing_takes_patterns_literally(spark):
    s = store(spark, [version("a", 1, path="x\\y"), version("b", 1, path="d/e")])
    assert [r.path for r in history.list_files(s, path="x\\").collect()] == ["x\\y"]
    assert [r.path for r in history.list_files(s, depths=(1, 9)).collect()] == ["d/e"]
    cleared = mutations.cleared(s.with_tables(general_settings=spark.createDataFrame([("k", "v")], SCHEMAS["general_settings"])))
    assert cleared.fileversion.count() == 0 and cleared.general_settings.count() == 1


def test_odd_text_functions(spark):
    df = spark.createDataFrame([("a:b*c?.txt", "--a-", bytes.fromhex("00ff")), (None, None, None)], "n string, d string, b binary")
    got = [tuple(r) for r in df.select(text.creatable_name(F.col("n")), text.has_dos_attribute(F.col("d"), "a"), text.to_hex(F.col("b")), text.from_hex(text.to_hex(F.col("b"))) == F.col("b")).collect()]
    assert got == [("abc.txt", True, "00ff", True), (None, False, None, None)]
    with pytest.raises(Exception, match="odd length"):
        df.select(text.from_hex(F.lit("abc"))).collect()


def test_download_plan(spark):
    """Contents known here come from here; of the winner's contents a chunk's container here counts first; a chunk without one is an error."""
    refs = lambda rows: spark.createDataFrame(rows, SCHEMAS["filecontent_chunk"])
    places = lambda rows: spark.createDataFrame(rows, SCHEMAS["multichunk_chunk"])
    local = VersionStore.empty(spark).with_tables(filecontent_chunk=refs([("c1", "a", 0)]), multichunk_chunk=places([("m1", "a"), ("m2", "b")]))
    winner = VersionStore.empty(spark).with_tables(filecontent_chunk=refs([("c1", "a", 0), ("c2", "b", 0), ("c2", "d", 1), ("c3", "x", 0)]), multichunk_chunk=places([("w1", "a"), ("w2", "b"), ("w3", "d")]))
    want = lambda *c: spark.createDataFrame([(x,) for x in c], "filecontent_checksum string")
    assert {r[0] for r in lookups.containers_to_download(want("c1", "c1", None, "empty"), local, winner).collect()} == {"m1"}
    assert {r[0] for r in lookups.containers_to_download(want("c1", "c2"), local, winner).collect()} == {"m1", "m2", "w3"}
    with pytest.raises(Exception, match="no container has chunk x"):
        lookups.containers_to_download(want("c3"), local, winner).collect()
