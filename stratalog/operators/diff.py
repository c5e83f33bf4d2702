"""Differences between versions, and between a disk listing and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import greatest_per
from ..session import cut
from .splits import in_order, placed

# Kinds of change.
NEW, DELETED = "NEW", "DELETED"
CHECKSUM, SIZE, ATTRIBUTES, MTIME, LINK, PATH = "CHANGED_CHECKSUM", "CHANGED_SIZE", "CHANGED_ATTRIBUTES", "CHANGED_LAST_MOD_DATE", "CHANGED_LINK_TARGET", "CHANGED_PATH"
SIDE = ("exists", "type", "path", "lastmodified", "size", "checksum", "linktarget", "posixperms", "dosattrs")


def side(rows: DataFrame, name: str) -> Column:
    """A version's properties as one struct; a deleted version doesn't exist."""
    return F.struct(
        (F.col("status") != "DELETED").alias("exists"), "type", "path", "lastmodified", "size", F.col("filecontent_checksum").alias("checksum"), "linktarget", "posixperms", "dosattrs"
    ).alias(name)


def changes(expected: Column, actual: Column, compare_checksums: bool = True) -> Column:
    """Kinds of change that lead from ``expected`` to ``actual`` (structs as ``side`` makes them), an array; empty if they are alike.

    Null sides don't exist. Times differ from a second on. Folders compare attributes alone, links their target alone.
    """
    e, a = lambda c: expected[c], lambda c: actual[c]
    here, there = F.coalesce(e("exists"), F.lit(False)), F.coalesce(a("exists"), F.lit(False))
    one = lambda kind: F.array(F.lit(kind))
    attributes = ~(e("posixperms").eqNullSafe(a("posixperms")) & e("dosattrs").eqNullSafe(a("dosattrs")))
    size = e("size") != a("size")
    ms = lambda c: F.unix_micros(c.cast("timestamp"))
    file = F.array_compact(
        F.array(
            F.when(e("path") != a("path"), PATH),
            F.when(F.abs(ms(e("lastmodified")) - ms(a("lastmodified"))) > 1_000_000, MTIME),
            F.when(size, SIZE),
            F.when(attributes, ATTRIBUTES),
            F.when(size | (F.lit(compare_checksums) & ~e("checksum").eqNullSafe(a("checksum"))), CHECKSUM),
        )
    )
    folder = F.array_compact(F.array(F.when(attributes, ATTRIBUTES)))
    link = F.array_compact(F.array(F.when(e("linktarget").isNull() | ~e("linktarget").eqNullSafe(a("linktarget")), LINK)))
    none = F.array().cast("array<string>")
    return (
        F.when(~here & ~there, none)
        .when(here & ~there, one(DELETED))
        .when(~here & there, one(NEW))
        .when(e("type") != a("type"), one(DELETED))
        .when(e("type") == "FOLDER", folder)
        .when(e("type") == "SYMLINK", link)
        .otherwise(file)
    )


def version_changes(versions: DataFrame) -> DataFrame:
    """What each version changed of the one before it in its history."""
    rows = versions.select("filehistory_id", "version", side(versions, "now"))
    rows = rows.withColumn("was", F.lag("now").over(Window.partitionBy("filehistory_id").orderBy("version")))
    return rows.select("filehistory_id", "version", changes(F.col("was"), F.col("now")).alias("changes"))


def status(tree: DataFrame, disk: DataFrame, delete: bool = True) -> DataFrame:
    """path and 'unchanged', 'changed', 'new' or 'deleted', from the catalog's tree and a listing (path, type, size, lastmodified, checksum, ...).

    Where several histories claim a path, the one with the largest id counts.
    """
    db = greatest_per(tree, "path", "filehistory_id").select("path", side(tree, "db"))
    here = disk.select("path", F.struct(F.lit(True).alias("exists"), *SIDE[1:]).alias("disk"))
    found = changes(F.col("db"), F.col("disk"))
    kind = F.when(F.col("disk").isNull(), "deleted").when(F.col("db").isNull(), "new").when(F.size(found) == 0, "unchanged").otherwise("changed")
    out = db.join(here, "path", "full_outer").select("path", kind.alias("status"))
    return out if delete else out.where("status <> 'deleted'")


def not_ignored(disk: DataFrame, rules: list[str]) -> DataFrame:
    """Without paths that a rule names: a whole path or file name, a wildcard of ``*`` and ``?``, or ``regex:`` and an expression."""
    keep = F.lit(True)
    plain = [r for r in rules if not r.startswith("regex:") and not set("*?") & set(r)]
    name = F.element_at(F.split("path", "/"), -1)
    if plain:
        keep &= ~F.col("path").isin(plain) & ~name.isin(plain)
    for r in rules:
        if r.startswith("regex:"):
            keep &= ~F.col("path").rlike(f"^(?:{r[6:]})$")
        elif r not in plain:
            pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in r) + "$"
            keep &= ~F.col("path").rlike(pattern) & ~name.rlike(pattern)
    return disk.where(keep)


def common_suffix(a: Column, b: Column) -> Column:
    """Length of the longest common end of two texts."""
    letters = lambda c: F.split(F.reverse(c), "")
    differs = F.array_position(F.zip_with(letters(a), letters(b), lambda x, y: x.eqNullSafe(y)), False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(differs > 0, differs - 1).otherwise(F.length(a))


def _end_of(level: int | str) -> Column:
    """What paths of this level have to share: so many last names, the extension, or nothing; null where a path hasn't got it."""
    if level == "extension":
        return F.nullif(F.regexp_extract("path", r"\.[^./]*$", 0), F.lit(""))
    names = F.size(F.split("path", "/"))
    return F.when(names >= level, F.substring_index("path", "/", -level)) if level else F.lit("")


def moved_histories(files: DataFrame, gone: DataFrame) -> DataFrame:
    """path, filehistory_id: which of the ``gone`` histories (key, path, filehistory_id) each of the ``files`` (key, path) goes on; each history once.

    Where a key has one file or one history, the longest common end of the paths decides, then the larger id or the smaller path. Elsewhere the
    pairs that share most of their last names come first, then those that share the extension, then the others; on each level
    files and histories that share the same end are paired in order of their paths (and ids), so that as many histories go on as there are files. A key may have
    any number of rows: no pairs of a key are made but the ones where it has a single file or history.
    """
    both = files.groupBy("key").agg(F.count("*").alias("_files")).join(gone.groupBy("key").agg(F.count("*").alias("_gone")), "key")
    both = both.select("key", (F.least("_files", "_gone") == 1).alias("one"))
    file = files.select("key", F.lit(0).alias("side"), "path", F.lit("").alias("id"))
    rows = cut(file.union(gone.select("key", F.lit(1), "path", F.col("filehistory_id"))).join(both, "key"), "moved")
    pairs = rows.where("one and side = 0").select("key", "path").join(rows.where("one and side = 1").select("key", F.col("path").alias("old"), "id"), "key")
    pairs = pairs.withColumn("same", common_suffix(F.col("path"), F.col("old")))
    out = pairs.groupBy("key").agg(F.min(F.struct(-F.col("same"), "path"))["path"].alias("path"), F.max(F.struct("same", "id"))["id"].alias("filehistory_id")).drop("key")

    rest = rows.where("not one").drop("one")
    deepest = rest.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    for level in [*range(deepest, 0, -1), "extension", 0] if deepest else []:
        able = rest.withColumn("end", _end_of(level)).where("end is not null")
        sides = able.groupBy("key", "end").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")).where("n0 > 0 and n1 > 0").select("key", "end")
        numbers = placed(able.join(sides, ["key", "end"], "left_semi"), ["key", "end", "side"], ["path", "id"])
        met = numbers.groupBy("key", "end", "place").agg(F.max(F.when(F.col("side") == 0, F.col("path"))).alias("path"), F.max(F.when(F.col("side") == 1, F.col("id"))).alias("id"))
        met = cut(met.where("path is not null and id is not null").select("path", "id"), "met")
        out = out.union(met.select("path", F.col("id").alias("filehistory_id")))
        if level != 0:
            files_left = rest.where("side = 0").join(met.select("path"), "path", "left_anti")
            rest = cut(files_left.unionByName(rest.where("side = 1").join(met.select("id"), "id", "left_anti")), "unmet")
    return out


def guess_histories(new: DataFrame, tree: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """For each new file (path, checksum, size, lastmodified) the history it goes on, or null: that with its path, else one with
    equal content, size and time whose old path is gone, each for one file: see ``moved_histories``.

    ``present``: the paths (path) that are on the disk, whatever lies there; those of ``new`` if left out.
    """
    by_path = greatest_per(tree, "path", "filehistory_id").select("path", F.col("filehistory_id").alias("_own"))
    rows = cut(new.join(by_path, "path", "left"), "new")
    key = lambda checksum: F.struct(F.col(checksum).alias("checksum"), "size", "lastmodified").alias("key")
    files = rows.where("_own is null and checksum is not null").select(key("checksum"), "path")
    gone = tree.where("type = 'FILE' and filecontent_checksum is not null").join((new if present is None else present).select("path"), "path", "left_anti")
    moved = moved_histories(files, gone.select(key("filecontent_checksum"), "path", "filehistory_id")).withColumnRenamed("filehistory_id", "_moved")
    return rows.join(moved, "path", "left").select("path", F.coalesce("_own", "_moved").alias("filehistory_id"))


def file_action(compared: Column, has_local: Column, local_as_expected: Column, winner_deleted: Column) -> Column:
    """struct<action, bucket>: what has to be done to a file so that it is as the winning version says.

    ``compared``: the changes of the comparison that the state asks for; ``has_local``: a local version is known;
    ``local_as_expected``: the file on disk is as that one says. Null if nothing has to be done.
    """
    has = lambda k: F.array_contains(compared, k)
    do = lambda action, bucket: F.struct(F.lit(action).alias("action"), F.lit(bucket).alias("bucket"))
    content_same = ~has(CHECKSUM) & ~has(SIZE)
    fresh = (
        F.when(has(DELETED), do("NEW", "new")).when(has(NEW), do("DELETE", "deleted")).when(has(LINK), do("NEW_SYMLINK", "new"))
        .when(content_same & (has(MTIME) | has(ATTRIBUTES)), do("SET_ATTRIBUTES", "new"))
        .when(has(PATH), F.raise_error(F.lit("a file that is new here can't have moved")).cast("struct<action:string,bucket:string>"))
        .otherwise(do("NEW", "new"))
    )
    known = (
        F.when(has(DELETED), do("CHANGE", "changed")).when(has(NEW), do("DELETE", "deleted")).when(has(LINK), do("NEW_SYMLINK", "new"))
        .when(content_same & (has(MTIME) | has(ATTRIBUTES) | has(PATH)), do("RENAME", "changed")).otherwise(do("CHANGE", "changed"))
    )
    alike = F.size(compared) == 0
    return F.when(has_local & ~local_as_expected, F.when(~(has(DELETED) & winner_deleted), do("CHANGE", "changed"))).when(~alike & ~has_local, fresh).when(~alike, known)


def reconciled(winner: DataFrame, local: DataFrame, disk: DataFrame) -> DataFrame:
    """filehistory_id, path, type, action, bucket: what makes the disk as the winning versions say; histories that need nothing give no row.

    ``winner`` and ``local``: the last version of each history, deletions included; ``disk``: a listing. A history that is here but not
    in ``winner`` any more, after a clean-up elsewhere, is deleted.
    """
    here = disk.select("path", F.struct(F.lit(True).alias("exists"), *SIDE[1:]).alias("disk"))
    won = winner.select("filehistory_id", F.col("path").alias("path"), F.col("type").alias("type"), side(winner, "won"), (F.col("status") == "DELETED").alias("ends"))
    own = local.select("filehistory_id", F.col("path").alias("own_path"), F.col("type").alias("own_type"), side(local, "own"))
    rows = won.join(own, "filehistory_id", "full_outer")
    rows = rows.join(here.select(F.col("path").alias("own_path"), F.col("disk").alias("at_own")), "own_path", "left")
    rows = rows.join(here.withColumnRenamed("disk", "at_won"), "path", "left")
    known, gone = F.col("own").isNotNull(), F.col("won").isNull()
    local_changes = changes(F.col("own"), F.col("at_own"))
    compared = F.when(~known, changes(F.col("won"), F.col("at_won"))).when(F.size(local_changes) == 0, changes(F.col("won"), F.col("own"))).otherwise(local_changes)
    act = file_action(compared, known, F.size(local_changes) == 0, F.coalesce("ends", F.lit(False)))
    act = F.when(gone, F.struct(F.lit("DELETE").alias("action"), F.lit("deleted").alias("bucket"))).otherwise(act)
    rows = rows.withColumn("act", act).where("act is not null")
    return rows.select("filehistory_id", F.coalesce("path", "own_path").alias("path"), F.coalesce("type", "own_type").alias("type"), "act.action", "act.bucket")


# The order in which kinds of action run.
ACTION_ORDER = ["DELETE FILE", "DELETE SYMLINK", "NEW FOLDER", "NEW FILE", "NEW SYMLINK", "RENAME FILE", "RENAME SYMLINK", "DELETE FOLDER"]


def ordered_actions(actions: DataFrame, id_col: str = "filehistory_id") -> DataFrame:
    """``actions`` (action, type, path, and an id that parts ties) with ``rank`` of their kind and ``nth``, the place (1, 2, ...) in which they run.

    Kinds that ``ACTION_ORDER`` doesn't name come first; deletions go from the leaves up, others down. What is made at or moved to the path of a folder
    that is deleted comes right behind that deletion, and of several the later kind first. All are sorted in ranges.
    """
    kinds = F.array(*map(F.lit, ACTION_ORDER))
    rank = (F.coalesce(F.array_position(kinds, F.concat_ws(" ", "action", "type")), F.lit(0)) - 1).cast("int")
    rows = actions.withColumn("rank", rank)
    folders = rows.where((F.col("action") == "DELETE") & (F.col("type") == "FOLDER")).select("path", F.lit(True).alias("_folder")).distinct()
    rows = rows.join(folders, "path", "left").select(*rows.columns, (F.col("_folder").isNotNull() & F.col("action").isin("NEW", "RENAME") & F.col("type").isin("FILE", "SYMLINK")).alias("_behind"))
    up = F.when(F.col("_behind") | (F.col("action") == "DELETE"), F.col("path"))
    order = (F.when(F.col("_behind"), len(ACTION_ORDER) - 1).otherwise(F.col("rank")), up.desc_nulls_last(), F.col("_behind"), F.when(F.col("_behind"), -F.col("rank")), F.col("path"), F.col(id_col))
    return in_order(rows, *order, name="nth").drop("_behind")


# Fixed value: the form of such a name.
def conflict_name(path: Column, user: Column, time: Column) -> Column:
    """``name (user's conflicted copy, 5 Jan 24, 3-07 PM).ext``."""
    note = F.concat(F.lit(" ("), user, F.lit("'s conflicted copy, "), F.date_format(time, "d MMM yy, h-mm a"), F.lit(")"))
    stem = F.regexp_replace(path, r"(?<=[^/.])\.[^./]+$", "")
    return F.concat(stem, note, F.substring(path, F.length(stem) + 1, F.length(path)))
