"""Content-defined chunks of stored files: the same cuts whatever the blocks."""

import hashlib
import random

import numpy as np
import pytest

from stratalog.operators import blocks, chunks
from stratalog.session import ship

MOST = chunks.tttd_sizes(1024)[1]
RNG = random.Random(3)
CONTENTS = {
    "random": RNG.randbytes(50_000), "two": bytes(RNG.choice(b"ab") for _ in range(40_000)), "same": b"x" * 30_000, "zero": bytes(MOST * 3), "one": b"1", "exact": RNG.randbytes(MOST),
    "mixed": RNG.randbytes(9_000) + bytes(20_000) + RNG.randbytes(300) + b"y" * 9_000,
}


@pytest.mark.parametrize("block", [MOST, 4096, 10_000])
@pytest.mark.parametrize("name", CONTENTS)
def test_blocks_give_the_cuts_of_the_whole(name, block):
    data, entry, before, got = CONTENTS[name], 0, 0, []
    for b in range((len(data) - 1) // block + 1):
        at = blocks.Block(data[b * block : (b + 1) * block + MOST], 1024)
        walk = at.walk(entry, block)
        assert before == len(got)
        got += [b * block + x for x in walk[1:]]
        if (b + 1) * block < len(data):
            starts, place, grows, count = at.transfer(block)
            i = np.searchsorted(starts, entry, side="right") - 1
            entry, before = int(place[i] + grows[i] * (entry - starts[i])), before + int(count[i])
    assert got == chunks.tttd_cuts(data, 1024)


def test_tables_tell_of_every_start():
    for data in CONTENTS.values():
        if len(data) < 4096 + MOST:
            continue
        at = blocks.Block(data[: 4096 + MOST], 1024)
        starts, place, grows, count = at.transfer(4096)
        for start in range(0, MOST, 7):
            i = np.searchsorted(starts, start, side="right") - 1
            walk = at.walk(start, 4096)
            assert (place[i] + grows[i] * (start - starts[i]), count[i]) == (walk[-1] - 4096, len(walk) - 1)
        assert len(starts) < MOST / 5  # chunks soon end together


def test_stored_files(spark, tmp_path):
    ship(spark)
    odd = {"a b%20ü.bin": CONTENTS["random"], "empty": b"", "d/deep": CONTENTS["mixed"], "one": b"1", "copy": CONTENTS["random"]}
    (tmp_path / "d").mkdir()
    for name, data in odd.items():
        (tmp_path / name).write_bytes(data)
    files = blocks.stored_files(spark, str(tmp_path)).withColumnRenamed("path", "file_id").selectExpr("file_id", "file_id as path", "length")
    want = {}
    for name, data in odd.items():
        cuts = chunks.tttd_cuts(data, 1024)
        want |= {(name, n): data[i:j] for n, (i, j) in enumerate(zip([0, *cuts], cuts, strict=False))}
    for block in (MOST, 16 << 10, 1 << 20):
        rows = blocks.tttd_file_chunks(files, 1024, block).collect()
        got = {(r.file_id.split(f"{tmp_path}/")[1], r.num): bytes(r.data) for r in rows}
        assert got == want and len(rows) == len(want)
        assert all(r.size == len(r.data) and r.checksum == hashlib.sha1(bytes(r.data)).hexdigest() for r in rows)
    sums = {r.path.split(f"{tmp_path}/")[1]: r.checksum for r in blocks.file_sums(files, part=1000).collect()}
    assert sums == {name: hashlib.sha1(data).hexdigest() for name, data in odd.items() if data}


def test_odd_files(spark, tmp_path):
    ship(spark)
    schema = "file_id string, path string, length long"
    (tmp_path / "short").write_bytes(b"short")
    none = spark.createDataFrame([("a", None, 5), ("b", f"{tmp_path}/short", None), ("c", f"{tmp_path}/short", 0)], schema)
    assert blocks.tttd_file_chunks(none, 1024).count() == 0 and blocks.tttd_file_chunks(none.limit(0), 1024).count() == 0
    assert [r.checksum for r in blocks.file_sums(none.where("path is null")).collect()] == [None]
    with pytest.raises(ValueError, match="shorter than a chunk"):
        blocks.tttd_file_chunks(none, 1024, 1000)
    with pytest.raises(Exception, match="has less than"):
        blocks.tttd_file_chunks(spark.createDataFrame([("a", f"{tmp_path}/short", 50)], schema), 1024).collect()


def test_windows_around_many_places():
    for data in CONTENTS.values():
        at = blocks.Block(data, 1024)
        for q in (np.arange(464, 464 + MOST), np.arange(464, len(data) + 2 * 464, 7)[:MOST], np.array([at.n - 3, at.n - 1, at.n, at.n + 1])):
            if q[0] >= 48 and q[-1] <= at.n + 464:
                assert (at._near_many(q) == at._near_few(q)).all()


def test_blocks_with_entries_are_spread(spark):
    """Blocks joined with where they begin have few bytes, which Spark merges into one task if the join's partitions are taken for the blocks' own."""
    rows = spark.range(64).selectExpr("id % 2 as file_id", "id as block")
    joined = blocks._spread(rows.join(rows.hint("merge"), ["file_id", "block"], "left"))
    assert "REPARTITION_BY_NUM" in joined._jdf.queryExecution().executedPlan().toString()
