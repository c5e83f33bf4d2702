"""Greatest-per-group questions: latest versions, listings as of a time, change logs, restores, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import GREATER, vc_compare, vc_parse
from ..functions.text import depth
from ..plans.store import greatest_per
from ..session import cut

# The codes of time buckets and date_trunc's units.
UNITS = {"SS": "second", "MI": "minute", "HH": "hour", "DD": "day", "WW": "week", "MM": "month", "YYY": "year"}
_HALF = {"SS": "500 milliseconds", "MI": "30 seconds", "HH": "30 minutes", "DD": "12 hours"}
_LONGEST = {"SS": "1 second", "MI": "1 minute", "HH": "1 hour", "DD": "1 day", "WW": "7 days", "MM": "31 days", "YYY": "366 days"}
#: Default thinning: older than nothing (in seconds) by minute, and so on.
INTERVALS = ((3600, "MI"), (3 * 86400, "HH"), (30 * 86400, "DD"))


def newest_numbers(store, clients: DataFrame) -> DataFrame:
    """Largest file number of each of ``clients`` (client), 0 where none is known."""
    return clients.select("client").distinct().join(highest_known_numbers(store), "client", "left").select("client", F.coalesce("max_number", F.lit(0)).alias("max_number"))


def highest_known_numbers(store, compat: bool = False) -> DataFrame:
    """Largest file number of each client; ``compat`` groups by the number as well, which keeps every row."""
    if compat:
        return store.known_databases.groupBy("client", "filenumber").agg(F.max("filenumber").alias("max_number")).select("client", "max_number")
    return store.known_databases.groupBy("client").agg(F.max("filenumber").alias("max_number"))


def latest_for_path(store, path: str) -> DataFrame:
    """Per history the latest version that has this path, unless deleted, with its commit's clock."""
    rows = greatest_per(store.fileversion_full.where((F.col("commit_status") == "MASTER") & (F.col("path") == path)), "filehistory_id", "version")
    return rows.where("status <> 'DELETED'").select("filehistory_id", "version", "path", "vectorclock_serialized")


def history_for_path(store, path: str) -> DataFrame:
    """The history that has this path now: of those by ``latest_for_path``, the one that no other's clock is greater than and that is its history's last version.

    Candidates for one path are few; ties of clocks go to the smaller history id.
    """
    rows = latest_for_path(store, path).withColumn("clock", vc_parse(F.col("vectorclock_serialized")))
    a, b = rows.alias("a"), rows.select("clock").alias("b")
    best = a.join(b, vc_compare(F.col("b.clock"), F.col("a.clock")) == GREATER, "left_anti").orderBy("filehistory_id").limit(1)
    last = store.fileversion_last.select("filehistory_id", "version")
    return best.join(last, ["filehistory_id", "version"], "left_semi").select("filehistory_id", "version", "path")


def histories_by_content(store, wanted: DataFrame) -> DataFrame:
    """Last versions that have one of the wanted (checksum, size, lastmodified) and aren't deleted; an older version that has them doesn't count."""
    keys = wanted.select(F.col("checksum").alias("filecontent_checksum"), "size", "lastmodified").distinct()
    by = keys.columns
    found = store.fileversion_master.join(keys, by, "left_semi").groupBy("filehistory_id").agg(F.max("version").alias("version"))
    return store.fileversion_master_last.join(found, ["filehistory_id", "version"], "left_semi").select(*store.fileversion.columns)


def last_version(store, history: str, strict_master: bool = True) -> DataFrame:
    """The history's last version; not strict: any row of that number, dirty twins included."""
    last = store.fileversion_last.where(F.col("filehistory_id") == history)
    return last if strict_master else store.fileversion.join(last.select("filehistory_id", "version"), ["filehistory_id", "version"], "left_semi")


def _max_version(df: DataFrame, *by: Column | str) -> Column:
    return F.max("version").over(Window.partitionBy("filehistory_id", *by))


def purge_before(store, time: Column) -> DataFrame:
    """Versions older than ``time`` that aren't their history's last."""
    df = store.fileversion
    return df.withColumn("_max", _max_version(df)).where((F.col("version") != F.col("_max")) & (F.col("updated") < time)).select("filehistory_id", "version")


def deleted_before(store, time: Column) -> DataFrame:
    """The last deletion of each history, if older than ``time``."""
    return greatest_per(store.fileversion.where("status = 'DELETED'"), "filehistory_id", "version").where(F.col("updated") < time).select("filehistory_id", "version")


def time_bucket(ts: Column, unit: str, mode: str = "round") -> Column:
    """``ts`` rounded to the nearest second, minute, hour or day; longer units and ``truncate`` go down."""
    half = _HALF.get(unit) if mode == "round" else None
    return F.date_trunc(UNITS[unit], ts + F.expr(f"interval {half}") if half else ts).cast("timestamp_ntz")


def purge_by_interval(store, unit: str, start: Column, end: Column, mode: str = "round") -> DataFrame:
    """Versions strictly between two times that aren't the last of their bucket; buckets see all rows.

    Rows farther from the two times than a bucket is long can't share one with a row between them, so they are left out before rows are sorted.
    """
    beside = F.expr(f"interval {_LONGEST[unit]}")
    df = store.fileversion.select("filehistory_id", "version", "updated").where((F.col("updated") >= start - beside) & (F.col("updated") <= end + beside))
    df = df.withColumn("_bucket", time_bucket(F.col("updated"), unit, mode))
    rows = df.withColumn("_max", _max_version(df, "_bucket")).where((F.col("version") != F.col("_max")) & (F.col("updated") > start) & (F.col("updated") < end))
    return rows.select("filehistory_id", "version")


def thinned(store, now: Column, intervals: tuple[tuple[int, str], ...] = INTERVALS, keep_seconds: int = 30 * 86400) -> DataFrame:
    """filehistory_id, version of everything that cleaning up removes: interval thinning, old versions, old deletions with what precedes them."""
    ago = lambda s: now - F.make_dt_interval(secs=F.lit(s))
    rows = cut(store.fileversion.select("filehistory_id", "version", "updated", "status").distinct(), "versions")
    gone, newer = [], 0
    for seconds, unit in sorted(intervals):
        gone.append(purge_by_interval(store.with_tables(fileversion=rows), unit, ago(seconds), ago(newer)))
        newer = seconds
    # the last version and the last deletion of each history are found in one aggregation
    ends = rows.groupBy("filehistory_id").agg(F.max("version").alias("_max"), F.max(F.when(F.col("status") == "DELETED", F.struct("version", "updated"))).alias("_gone"))
    old, deleted = F.col("updated") < ago(keep_seconds), F.col("_gone.updated") < ago(keep_seconds)
    out = rows.join(ends, "filehistory_id").where(((F.col("version") != F.col("_max")) & old) | ((F.col("version") <= F.col("_gone.version")) & deleted)).select("filehistory_id", "version")
    for df in gone:
        out = out.unionByName(df)
    return out.distinct()


def list_files(store, path: str | None = None, history: str | None = None, as_of: Column | None = None, recursive: bool = True, deleted: bool = False, types: tuple[str, ...] = ("FILE", "FOLDER", "SYMLINK"), depths: tuple[int, int] | None = None, compat: bool = False) -> DataFrame:
    """The tree as of a time. ``path``: ``^`` and ``*`` stand for anything, else it is a prefix; ``history``: a prefix or whole id.

    Not recursive: as many slashes as the pattern; ``depths``: from so many to so many. One partial aggregation by history; the time filter reaches the scan.
    ``compat``: every row with the number of a last version, also one of a dirty commit.
    """
    rows = store.fileversion_master
    rows = rows.where(F.col("updated") <= as_of) if as_of is not None else rows
    rows = rows.where(F.col("filehistory_id").startswith(history)) if history else rows
    rows = greatest_per(rows, "filehistory_id", "version")
    if compat:
        rows = store.fileversion.join(rows.select("filehistory_id", "version"), ["filehistory_id", "version"], "left_semi").select(*store.fileversion.columns)
    rows = rows.where(F.col("type").isin(*types))
    rows = rows.where(depth(F.col("path")).between(*depths)) if depths else rows
    rows = rows if deleted else rows.where("status <> 'DELETED'")
    if path is not None:
        pattern = path.replace("^", "%").replace("*", "%") if "^" in path or "*" in path else path + "%"
        pattern = pattern.replace("\\", "\\\\")  # like takes a backslash for an escape
        rows = rows.where(F.col("path").like(pattern))
        if not recursive:
            rows = rows.where(depth(F.col("path")) == pattern.count("/"))
    return rows


def listing_columns(rows: DataFrame) -> DataFrame:
    """How a listing shows versions: one letter for status and type, short ids, targets of links."""
    return rows.select(
        F.element_at(F.create_map(*[F.lit(x) for x in ("NEW", "A", "CHANGED", "M", "RENAMED", "M", "DELETED", "D")]), F.col("status")).alias("status"),
        F.element_at(F.create_map(*[F.lit(x) for x in ("FILE", "-", "FOLDER", "d", "SYMLINK", "s")]), F.col("type")).alias("type"),
        F.substring("filehistory_id", 1, 10).alias("history"),
        F.coalesce(F.substring("filecontent_checksum", 1, 10), F.lit("")).alias("checksum"),
        "version",
        F.when(F.col("type") == "SYMLINK", F.concat("path", F.lit(" -> "), "linktarget")).otherwise(F.col("path")).alias("path"),
    )


def change_log(store, count: int = 10, start: int = 0, max_files: int = 100) -> DataFrame:
    """The last commits with the changes each made: client, path and 'new', 'changed' or 'deleted', ``max_files`` a commit, by path."""
    head = store.master_commits.orderBy(F.desc("id")).offset(start).limit(count).select(F.col("id").alias("databaseversion_id"), "client", "localtime")
    rows = greatest_per(store.fileversion.join(head.select("databaseversion_id"), "databaseversion_id", "left_semi"), ["databaseversion_id", "filehistory_id"], "version")
    kind = F.when(F.col("status") == "NEW", "new").when(F.col("status") == "DELETED", "deleted").otherwise("changed")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("databaseversion_id").orderBy("path", "filehistory_id"))).where(F.col("_n") <= max_files)
    return rows.join(head, "databaseversion_id").select("databaseversion_id", "client", "localtime", "path", "filehistory_id", kind.alias("change"))


def restore_points(store) -> DataFrame:
    """For each history the version that a restore without a number picks: the last but one, else the only one; folders have none."""
    by = Window.partitionBy("filehistory_id").orderBy(F.desc("version"))
    rows = store.fileversion_master.select("filehistory_id", "version", "type", "filecontent_checksum").withColumn("_back", F.row_number().over(by)).where("_back <= 2")
    return greatest_per(rows, "filehistory_id", "_back").where("type <> 'FOLDER'").select("filehistory_id", "version", "filecontent_checksum")
