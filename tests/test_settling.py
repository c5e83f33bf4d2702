"""Bursts that fire in quiet, and operations that are over when nobody renews them."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stratalog.operators import cleanup
from stratalog.sources import deltalog
from stratalog.streaming import sync

T = datetime(2024, 1, 1)


def wait(rows, n, seconds=40):
    until = time.monotonic() + seconds
    while len(rows) < n and time.monotonic() < until:
        time.sleep(0.2)
    return sorted(rows, key=str)


def test_bursts_fire_without_a_later_event(spark, tmp_path):
    inbox, schema = str(tmp_path / "in"), "user_id string, ts timestamp"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    put(("a", T), ("a", T + timedelta(seconds=5)), ("b", None), (None, T))
    seen = []

    def start():
        rows = sync.fired_bursts(spark.readStream.schema(schema).parquet(inbox), 2)
        keep = lambda df, _: seen.extend(map(tuple, df.collect()))
        return rows.writeStream.option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="500 milliseconds").foreachBatch(keep).start()

    q = start()
    try:
        first = [("a", T, T + timedelta(seconds=5), 2), ("b", None, None, 1), (None, T, T, 1)]
        assert wait(seen, 3) == sorted(first, key=str)  # nothing came after the burst
        put(("a", T + timedelta(seconds=9)))
        assert wait(seen, 4)[-4:].count(("a", T + timedelta(seconds=9), T + timedelta(seconds=9), 1)) == 1  # a burst of its own: the first is forgotten
        put(("c", T))
        until = time.monotonic() + 60  # a query with timers never runs out of batches, so its progress tells
        while sum(p["numInputRows"] for p in q.recentProgress) < 6 and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    before = len(seen)
    q = start()  # an open burst outlives a restart, and fires once
    try:
        got = wait(seen, 5)
        assert ("c", T, T, 1) in got and len(got) == 5 and before in (4, 5)
    finally:
        q.stop()


def test_running_operations(spark):
    at = lambda minutes: int((T.timestamp() - datetime(1970, 1, 1).timestamp() - 60 * minutes) * 1000)
    names = [("action-up-A-%d" % at(0),), ("action-up-B-%d" % at(8),), ("action-up-B-%d" % at(3),), ("action-down-C-%d" % at(7),), ("action-cleanup-D-%d" % (at(7) - 1),), ("database-E-0000000001",), ("odd",)]
    files = deltalog.parse_names(spark.createDataFrame(names, "name string"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    of = lambda *more: sorted((r.operation, r.client) for r in cleanup.running_operations(files, now, *more).collect())
    assert of() == [("down", "C"), ("up", "A"), ("up", "B")] and of("A", ["up", "cleanup"]) == [("up", "B")]
    assert cleanup.running_operations(files.limit(0), now).count() == 0
