"""The data source of delta files: files chosen by name, streams behind a ledger."""

import tracemalloc

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalog.operators import union
from stratalog.plans.store import VersionStore
from stratalog.session import cut, ship
from stratalog.sources import deltalog, repository
from stratalog.sources.deltasource import Files, commits_in_file, delta_files, grouped
from stratalog.streaming import sync

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def commits(spark):
    ship(spark)
    return cut(deltalog.commits(VersionStore.derived(spark, SF)).where("_client in ('A', 'B')").orderBy("_date").limit(12), "commits")


@pytest.fixture
def folder(commits, tmp_path):
    at = str(tmp_path / "repo")
    repository.write_delta_files(commits, at)
    return at


def key(rows):
    return sorted((r._client, r._clock, r._date, str(r.fileHistories), str(r.chunks), str(r.multiChunks)) for r in rows)


def test_rows_are_those_of_the_xml_reader(spark, commits, folder, tmp_path):
    got = repository.read_delta_files(spark, folder).collect()
    assert key(got) == key(commits.collect())
    assert all(r.name == f"database-{r.client}-{r.number:010d}" and r.client == r._client for r in got)
    odd = """<?xml version="1.0"?><database><!-- <databaseVersion> --><databaseVersion client="A" date="7" clock="(A1)"/>
      <databaseVersion clock='a&lt;&quot;b"&gt;é' client="A>" date="8"><fileHistories><fileHistory id="x&amp;/&gt;"><fileVersions><fileVersion version="1" path="&lt;/databaseVersion&gt;"/></fileVersions></fileHistory></fileHistories></databaseVersion></database>"""
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "database-A-0000000001").write_text(odd, encoding="utf-8")
    rows = sorted(repository.read_delta_files(spark, str(tmp_path / "odd")).collect(), key=lambda r: r._date)
    assert [(r._client, r._clock, r._date) for r in rows] == [("A", "(A1)", 7), ("A>", 'a<"b">é', 8)]
    history = rows[1].fileHistories.fileHistory[0]
    assert history._id == "x&/>" and history.fileVersions.fileVersion[0]._path == "</databaseVersion>" and rows[0].fileHistories is None


def test_a_filter_leaves_other_files_closed(spark, folder):
    files = delta_files(folder)
    mine = [f for f in files if f[0] == "A"]
    for client, _, name, _ in files:
        if client == "B" or name == mine[0][2]:
            with open(f"{folder}/{name}", "w") as f:
                f.write("<database><databaseVersion")
    rows = repository.read_delta_files(spark, folder)
    some = rows.where((F.col("client") == "A") & (F.col("number") > mine[0][1]))
    assert sorted(r.name for r in some.collect()) == [f[2] for f in mine[1:]]
    assert rows.where(F.col("client").isin("A") & (F.col("number") >= mine[1][1]) & (F.col("number") < mine[2][1])).count() == 1
    assert rows.where(F.col("name") == mine[1][2]).select("client").collect() == [("A",)]
    assert rows.where("client = 'nobody'").count() == 0
    with pytest.raises(Exception, match="unclosed|no element|syntax|ParseError"):
        rows.where("client = 'B'").collect()


def test_empty_places(spark, tmp_path):
    assert repository.read_delta_files(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "multichunk-ab").write_text("no delta file")
    assert repository.read_delta_files(spark, str(tmp_path / "repo")).count() == 0


def test_tasks_take_neighbours():
    files = [("A", 1, "a", 5), ("A", 2, "b", 5), ("A", 3, "c", 50), ("B", 1, "d", 1)]
    assert [[f[2] for f in t.files] for t in grouped(files, 10)] == [["a", "b"], ["c"], ["d"]]
    assert grouped([], 10) == [] and grouped(files[:1], 1) == [Files([("A", 1, "a")])]


def test_stream_reads_each_file_once(spark, commits, tmp_path):
    folder, mark, seen = str(tmp_path / "repo"), str(tmp_path / "mark"), []
    run = lambda **more: sync.follow(spark, folder, mark, lambda df, _: seen.extend((r.client, r.number) for r in df.collect()), once=True, **more).awaitTermination()
    own = F.row_number().over(Window.partitionBy("_client").orderBy("_date"))
    early = cut(commits.withColumn("n", own), "numbered")
    repository.write_delta_files(early.where("n <= 2").drop("n"), folder)
    first = {(f[0], f[1]) for f in delta_files(folder)}
    known = spark.createDataFrame([("A", min(n for c, n in first if c == "A"))], "client string, filenumber int")
    run(known=known)
    assert sorted(seen) == sorted(first - {tuple(known.first())})
    run()
    assert len(seen) == len(first) - 1  # nothing is new
    repository.write_delta_files(early.where("n > 2").drop("n"), folder)
    run()
    every = {(f[0], f[1]) for f in delta_files(folder)}
    assert sorted(seen) == sorted(every - {tuple(known.first())})
    before = len(seen)
    ledger = repository.compact(spark, folder)  # merged files come under new numbers and hold what is known
    run()
    assert set(seen[before:]) == {tuple(r) for r in ledger.collect()} and len(seen) - before == commits.count()


def test_stream_feeds_the_union(spark, commits, folder, tmp_path):
    at = str(tmp_path / "union")
    fold = lambda df, _: union.fold(at, {"chunk": deltalog.tables(df)["chunk"].select("checksum", "size", F.lit(0).alias("place"))}, buckets=2)
    sync.follow(spark, folder, str(tmp_path / "mark"), fold, once=True).awaitTermination()
    want = {r.checksum for r in deltalog.tables(commits)["chunk"].collect()}
    assert want and sorted(r.checksum for r in spark.read.parquet(f"{at}/chunk").collect()) == sorted(want)


def test_a_commit_is_passed_by_without_a_tree(tmp_path):
    from pyarrow import fs as arrow_fs

    rows = "".join(f'<fileHistory id="{i:040x}"><fileVersions><fileVersion version="1" path="dir/{i}"/></fileVersions></fileHistory>' for i in range(100_000))
    data = f'<database><databaseVersion client="A"/>\n<databaseVersion client="B"><fileHistories>{rows}</fileHistories></databaseVersion ><databaseVersion client=\'C>\'></databaseVersion></database>'
    (tmp_path / "file").write_text(data)
    tracemalloc.start()
    got = [bytes(held[i:j]).decode() for held, i, j in commits_in_file(arrow_fs.LocalFileSystem(), str(tmp_path / "file")) if j - i < 1000]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == ['<databaseVersion client="A"/>', "<databaseVersion client='C>'></databaseVersion>"]
    assert peak < 1.5 * len(data) + (4 << 20)  # a tree takes some five times the text


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "latin-1"])
def test_encodings(spark, tmp_path, encoding):
    text = f'<?xml version="1.0" encoding="{encoding}"?><database><databaseVersion client="é" date="7" clock="(é1)"/></database>'
    (tmp_path / "database-A-0000000001").write_bytes(text.encode(encoding))
    assert [(r.client, r._client, r._clock) for r in repository.read_delta_files(spark, str(tmp_path)).collect()] == [("A", "é", "(é1)")]
