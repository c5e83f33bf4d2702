"""Registered queries against their SQL, on the smallest tables."""

import pytest

import __spark_entry__
from oracle import compare
from stratalog.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SLOW = {"gc_commits", "gc_clocks", "gc_containers", "gc_chunks"}  # one of a kind is enough here
PICKED = [
    "table_fileversion", "table_multichunk", "view_databaseversion_master", "chunks_of_commit", "last_commits", "histories_by_ids", "expand_history", "ls_as_of", "ls_path", "max_dirty_time", "contents_with_chunks",
    "history_for_path", "purge_by_day", "cleanup_versions", "change_log", "restore_points", "insert_commits", "merge_chunk", "rehome_chunk", "remove_versions_upto", "gc_commits", "clock_order", "next_clock_time",
    "branch_prune", "branch_apply", "version_changes", "disk_status", "guess_histories", "fixed_chunks", "new_versions", "type_changes", "deletion_versions", "file_actions", "delta_round_trip", "delta_containers", "branch_winner", "histories_by_content", "cleanup_recent", "merge_needed", "restored", "commit_numbers", "cache_within_budget", "packed_containers", "assembled", "unknown_databases", "settled_bursts",
    "read_batches", "ordered_file_actions", "union_chunks", "union_paths", "union_contents", "cleanup_ok", "cleanup_busy", "compacted_deltas", "containers_to_download", "histories_of_clock_first", "branch_muddy", "delta_files_of", "followed_deltas", "tttd_chunks", "tttd_file_chunks", "running_operations", "running_up",
]


@pytest.mark.parametrize("name", PICKED)
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SF)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "path" in df.columns


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
