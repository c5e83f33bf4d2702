"""When to clean up, and what a clean-up does to the remote delta files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a check before a clean-up says, the first that holds; and the default limits.
PRECONDITIONS = ("NOK_DIRTY_LOCAL", "NOK_RECENTLY_CLEANED", "NOK_LOCAL_CHANGES", "NOK_REMOTE_CHANGES", "NOK_OTHER_OPERATIONS", "OK")
MIN_SECONDS, MAX_FILES = 3 * 3600, 15
# An operation renews its action file every two minutes, and one not renewed for five more is over.
RENEWED_SECONDS = 2 * 60 + 5 * 60


def _exists(df: DataFrame) -> Column:
    return df.limit(1).agg(F.count("*") > 0).scalar()


def precondition(store, status: DataFrame, remote: DataFrame, running: DataFrame, last: Column, now: Column, force: bool = False, min_seconds: int = MIN_SECONDS) -> DataFrame:
    """One row, ``code``: whether cleaning up may start.

    ``status``: what ``diff.status`` says of the disk; ``remote``: delta files not read yet; ``running``: operations of other clients;
    ``last``: time of the last clean-up, null if there was none. ``force`` skips the wait.
    """
    recent = F.lit(not force) & F.coalesce(last + F.make_dt_interval(secs=F.lit(min_seconds)) > now, F.lit(False))
    found = (_exists(store.dirty_commits), recent, _exists(status.where("status <> 'unchanged'")), _exists(remote), _exists(running))
    code = F.coalesce(*[F.when(c, F.lit(k)) for c, k in zip(found, PRECONDITIONS[:-1], strict=True)], F.lit(PRECONDITIONS[-1]))
    return store.databaseversion.sparkSession.range(1).select(code.alias("code"))


def merge_needed(names: DataFrame, removed: int = 0, force: bool = False, max_files: int = MAX_FILES) -> DataFrame:
    """One row, clients, files, needed: whether the delta files (kind, client of ``deltalog.parse_names``) are to be merged, since they are too many or versions were removed."""
    n = names.where("kind = 'database'").agg(F.countDistinct("client").alias("clients"), F.count("*").alias("files"))
    return n.withColumn("needed", (F.col("files") > max_files * F.col("clients")) | F.lit(removed > 0 or force))


def merged_files(names: DataFrame) -> DataFrame:
    """client, number of the one file that replaces a client's delta files (one over its newest), and how many go."""
    return names.where("kind = 'database'").groupBy("client").agg((F.max("number") + 1).alias("number"), F.count("*").alias("replaces"))


def cleanup_occurred(names: DataFrame, local: Column) -> DataFrame:
    """One row, ``occurred``: whether the newest clean-up file has a greater number than the last one seen here (null: none)."""
    newest = names.where("kind = 'cleanup'").agg(F.coalesce(F.max("number"), F.lit(0)).alias("newest"))
    return newest.select((F.col("newest") > F.coalesce(local, F.lit(0))).alias("occurred"))


def running_operations(names: DataFrame, now: Column, own: str | None = None, operations: list[str] | None = None, seconds: int = RENEWED_SECONDS) -> DataFrame:
    """operation, client, renewed of what runs at ``now`` (UTC) by the action files among ``names`` (kind, client, name of ``deltalog.parse_names``); of other clients than ``own``, and of ``operations`` if given.

    An action file's name has the time of its last renewal in milliseconds; of several files of one operation and client the newest counts.
    """
    rows = names.where("kind = 'action'").select(F.regexp_extract("name", r"^action-([a-z]+)-", 1).alias("operation"), "client", F.timestamp_millis(F.regexp_extract("name", r"(\d+)$", 1).cast("bigint")).cast("timestamp_ntz").alias("renewed"))
    rows = rows.where(F.col("client") != own) if own is not None else rows
    rows = rows.where(F.col("operation").isin(operations)) if operations is not None else rows
    rows = rows.groupBy("operation", "client").agg(F.max("renewed").alias("renewed"))
    return rows.where(F.col("renewed") >= now - F.make_dt_interval(secs=F.lit(seconds)))
