"""What the derivation, the thinning and commits move between tasks."""

import pytest

from stratalog.operators import history
from stratalog.plans.catalog import QUERIES, _now
from stratalog.plans.store import VersionStore
from stratalog.session import ship
from stratalog.sources import deltalog

SF = "/root/testdata/sf0.001"


def moved(df):
    """What each exchange of a plan takes in."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [p for p in plan.split("\n\n") if "Exchange\n" in p.replace("BroadcastExchange\n", "")]


@pytest.fixture(scope="module")
def store(spark):
    return VersionStore.derived(ship(spark), SF)


def test_texts_and_paths_stay_where_they_are(store):
    for name in ("filecontent", "filecontent_chunk", "chunk", "multichunk"):
        assert moved(store.tables[name]) and not [p for p in moved(store.tables[name]) if "text#" in p]
    assert moved(store.fileversion) and not [p for p in moved(store.fileversion) if "path#" in p]
    assert not [p for p in moved(store.filehistory) if "event_id#" in p]  # the histories of a commit need no order of versions


def test_versions_move_to_their_commit_once(store):
    assert len([p for p in moved(deltalog.commits(store)) if "filehistory_id" in p.split("Arguments")[0]]) == 1


def test_thinning_derives_versions_once(spark, store):
    df = QUERIES["cleanup_versions"](spark, SF)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "documents.parquet" not in plan and "events.parquet" not in plan
    hour = history.purge_by_interval(store, "HH", _now(), _now())
    bounds = spark._jvm.PythonSQLUtils.explainString(hour._jdf.queryExecution(), "extended").split("== Optimized Logical Plan ==")[1].split("== Physical")[0]
    assert "2024-01-28 11:00:00" in bounds and "2024-01-28 13:00:00" in bounds  # nothing beyond a bucket's length is sorted
