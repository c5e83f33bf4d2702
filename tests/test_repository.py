"""Delta files under their names: written, merged into one a client, and left alone where a write fails."""

import pytest
from pyspark.sql import functions as F

from stratalog.plans.store import VersionStore
from stratalog.session import cut, ship
from stratalog.sources import deltalog, repository
from stratalog.sources.deltasource import delta_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def commits(spark):
    ship(spark)
    return cut(deltalog.commits(VersionStore.derived(spark, SF)).where("_client in ('A', 'B')").orderBy("_date").limit(12), "commits")


def names(spark, folder):
    return [r.name for r in repository.listing(spark, folder).collect()]


def test_files_and_compaction(spark, commits, tmp_path):
    folder = str(tmp_path / "repo")
    repository.write_delta_files(commits, folder)
    before = commits.count()
    assert len(names(spark, folder)) == before and all(n.startswith("database-") for n in names(spark, folder))
    ledger = repository.compact(spark, folder)
    assert sorted(map(tuple, ledger.collect())) == sorted((n.split("-")[1], int(n.split("-")[2])) for n in names(spark, folder)) and ledger.count() == 2
    again = deltalog.read_rows(spark, folder, deltalog.BODY_SCHEMA)
    key = lambda df: sorted((r._client, r._clock, r._date, r.fileHistories) for r in df.collect())
    assert key(again) == key(commits)
    one = names(spark, folder)[0]
    clocks = [r._clock for r in deltalog.read_rows(spark, f"{folder}/{one}", deltalog.HEADER_SCHEMA).collect()]
    assert clocks == [r._clock for r in commits.where(F.col("_client") == one.split("-")[1]).orderBy("_date").collect()]  # in order of its own time
    assert deltalog.unknown_databases(repository.listing(spark, folder), ledger).count() == 0
    old = ledger.withColumn("filenumber", F.col("filenumber") - 1)  # who knows the last file of before sees the merged ones alone
    assert deltalog.unknown_databases(repository.listing(spark, folder), old).count() == 2


def test_purged_commits_go(spark, commits, tmp_path):
    folder = str(tmp_path / "repo")
    repository.write_delta_files(commits, folder)
    repository.compact(spark, folder, commits.where("_client = 'B'"))
    assert [n[:10] for n in names(spark, folder)] == ["database-B"]


def test_nothing_is_left_of_a_write_that_fails(spark, commits, tmp_path):
    folder = str(tmp_path / "repo")
    repository.write_delta_files(commits, folder)
    before = names(spark, folder)
    staged, new = repository.stage(commits.withColumn("file", F.concat(F.lit("database-"), "_client", F.lit("-0000000099"))))
    with pytest.raises(OSError, match="can't be put"):
        repository.publish(spark, staged, [*new, before[-1]], folder, before)  # the last name is taken
    assert names(spark, folder) == before
    assert repository.compact(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(OSError, match="can't be put"):
        repository.write_delta_files(commits, folder)
    assert names(spark, folder) == before


def test_files_in_parts(spark, commits, tmp_path):
    folder, key = str(tmp_path / "repo"), lambda df: sorted((r._client, r._clock, r._date, str(r.fileHistories)) for r in df.collect())
    repository.write_delta_files(commits, folder)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    try:
        ledger = {tuple(r) for r in repository.compact(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    files = delta_files(folder)
    assert {(f[0], f[1]) for f in files} == ledger and len(files) > len(ledger) and all("/part-" in f[2] for f in files)  # several tasks wrote a file
    assert {r.name for r in repository.listing(spark, folder).collect()} == {f[2].split("/")[0] for f in files}
    rows = repository.read_delta_files(spark, folder)
    assert key(rows) == key(commits) == key(deltalog.read_rows(spark, folder, deltalog.BODY_SCHEMA))
    one = files[0][2].split("/")[0]
    own = [int(r._clock.split(files[0][0])[1].split(",")[0].rstrip(")")) for r in rows.where(F.col("name") == one).collect()]
    assert own == sorted(own) and len(own) == sum(r._client == files[0][0] for r in commits.collect())
    again = repository.compact(spark, folder)  # parts are merged as files are
    assert {tuple(r) for r in again.collect()} == {(c, n + 1) for c, n in ledger} and {(f[0], f[1]) for f in delta_files(folder)} == {(c, n + 1) for c, n in ledger}
    assert key(repository.read_delta_files(spark, folder)) == key(commits)
