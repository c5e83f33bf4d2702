"""From a listing of the disk to the next commit: new versions, changes of type, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.store import greatest_per
from .blocks import file_sums
from .diff import SIDE, changes, guess_histories, side

VERSION = ("filehistory_id", "version", "path", "type", "status", "size", "lastmodified", "linktarget", "filecontent_checksum", "updated", "posixperms", "dosattrs")


def _claimed(disk: DataFrame, tree: DataFrame) -> DataFrame:
    """``disk`` (path, type, size, lastmodified, checksum, linktarget, posixperms, dosattrs) with ``last``, the last version of the history it goes on, or null.

    Files go on the history of their path or of a moved file; folders and links that of their path only.
    """
    files = guess_histories(disk.where("type = 'FILE'").select("path", "checksum", "size", "lastmodified"), tree, disk)
    moved = files.where("filehistory_id is not null")
    others = disk.where("type <> 'FILE'").select("path").join(greatest_per(tree, "path", "filehistory_id").select("path", "filehistory_id"), "path")
    claims = moved.select("path", "filehistory_id").union(others.select("path", "filehistory_id"))
    last = tree.select("filehistory_id", F.struct(*tree.columns).alias("last"), side(tree, "was"))
    return disk.join(claims.join(last, "filehistory_id"), "path", "left")


def indexed(disk: DataFrame, tree: DataFrame, now: Column) -> DataFrame:
    """The versions that a commit at ``now`` adds: kind ('new', 'changed', 'replaced', 'deleted') and the columns of ``VERSION``.

    ``tree``: the last version of each history, deletions left out. A file that is as its last version says gives no row. Where the type of what
    lies at a path has changed, the old history ends ('replaced') and another begins. A new history's id is a digest of path and time.
    Contents equal to the last version's make it CHANGED even at another path; else another path makes it RENAMED.
    A history ends ('deleted') if its path is gone, or taken by another history of this commit.
    """
    rows = _claimed(disk, tree)
    here = F.struct(F.lit(True).alias("exists"), *SIDE[1:])
    retyped = F.col("last").isNotNull() & (F.col("last.type") != F.col("type"))
    rows = rows.withColumns({"differs": F.size(changes(here, F.col("was"))) > 0, "retyped": F.coalesce(retyped, F.lit(False))})
    rows = rows.withColumn("fresh", F.col("last").isNull() | F.col("retyped")).where("fresh or differs")
    same = (F.col("type") == "FILE") & F.col("checksum").eqNullSafe(F.col("last.filecontent_checksum"))
    status = F.when(F.col("fresh"), "NEW").when(same, "CHANGED").when(F.col("path") != F.col("last.path"), "RENAMED").otherwise("CHANGED")
    begun = F.sha1(F.concat(F.lit("history/"), "path", F.lit("/"), now.cast("string")).cast("binary"))
    added = rows.select(
        F.when(F.col("fresh"), "new").otherwise("changed").alias("kind"),
        F.when(F.col("fresh"), begun).otherwise(F.col("filehistory_id")).alias("filehistory_id"),
        F.when(F.col("fresh"), 1).otherwise(F.col("last.version") + 1).cast("int").alias("version"),
        "path", "type", status.alias("status"), "size", "lastmodified", "linktarget", F.col("checksum").alias("filecontent_checksum"), now.alias("updated"), "posixperms", "dosattrs",
    )
    ended = lambda df, kind: df.select(F.lit(kind).alias("kind"), *VERSION)
    as_deleted = {"status": F.lit("DELETED"), "version": (F.col("version") + 1).cast("int"), "updated": now}
    replaced = rows.where("retyped").select("last.*").withColumns(as_deleted)
    kept = added.where("kind = 'changed'").select("filehistory_id").union(replaced.select("filehistory_id"))
    taken = added.select("path", F.lit(True).alias("_taken"))
    rest = tree.join(kept, "filehistory_id", "left_anti").join(disk.select("path", F.lit(True).alias("_here")), "path", "left").join(taken, "path", "left")
    gone = rest.where("_here is null or _taken").select(*tree.columns).withColumns(as_deleted)
    return added.unionByName(ended(replaced, "replaced")).unionByName(ended(gone, "deleted"))


def new_contents(versions: DataFrame, known: DataFrame) -> DataFrame:
    """checksum, size of the contents of new versions that ``known`` (checksum) doesn't have."""
    rows = versions.where("status <> 'DELETED' and filecontent_checksum is not null").select(F.col("filecontent_checksum").alias("checksum"), "size")
    return rows.groupBy("checksum").agg(F.max("size").alias("size")).join(known.select("checksum"), "checksum", "left_anti")


def disk_listing(files: DataFrame, root: str) -> DataFrame:
    """Properties of the files of Spark's ``binaryFile`` source below ``root``: path below it, type, size, lastmodified, checksum, and nulls for what it can't tell.

    The source leaves out empty files, folders and links. Contents are hashed as streams, so a file may have any size; the source's own ``content`` isn't read.
    """
    start = F.length(F.lit(root.rstrip("/"))) + 2
    path = F.substring(F.regexp_replace("path", "^file:/*", "/"), start, F.length("path"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    return file_sums(files.select("path", "length", "modificationTime")).select(
        path.alias("path"), F.lit("FILE").alias("type"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("lastmodified"),
        "checksum", none("linktarget"), none("posixperms"), none("dosattrs"),
    )
