"""Changes to tables as functions from old frames to new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import vc_parse

#: Key columns of tables into which the first writer's row counts.
KEYS = {
    "chunk": ["checksum"],
    "filecontent": ["checksum"],
    "filecontent_chunk": ["filecontent_checksum", "chunk_checksum", "num"],
    "multichunk": ["id"],
    "multichunk_chunk": ["multichunk_id", "chunk_checksum"],
    "multichunk_muddy": ["id"],
}


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.select(*old.columns))


def append_numbered(old: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """Appends rows numbered on from the largest id, in ``order``. A batch of commits or delta files: few rows."""
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    return append(old, new.withColumn(id_col, (F.row_number().over(Window.orderBy(*order)) + top).cast("int")))


def clock_entries(commits: DataFrame) -> DataFrame:
    """databaseversion_id, client, logicaltime of every entry of the commits' clocks (id, vectorclock_serialized), to be appended."""
    rows = commits.select(F.col("id").alias("databaseversion_id"), F.explode(vc_parse(F.col("vectorclock_serialized"))).alias("client", "logicaltime"))
    return rows.withColumn("logicaltime", F.col("logicaltime").cast("int"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], place: str | None = None) -> DataFrame:
    """Appends rows whose key isn't there yet; of several with one key the first by ``place`` (a column of ``new``), else the smallest row."""
    rest = [c for c in new.columns if c not in keys]
    first = F.min(F.struct(*([place] if place else []), *[c for c in rest if c != place])).alias("_first")
    new = new.groupBy(*keys).agg(first).select(*keys, "_first.*") if rest else new.distinct()
    return append(old, new.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return append(old.join(new.select(*keys), keys, "left_anti"), new)


def mark_dirty(store, clock: str) -> DataFrame:
    return store.databaseversion.withColumn("status", F.when(F.col("vectorclock_serialized") == clock, "DIRTY").otherwise(F.col("status")))


def rehome_dirty(store, table: str, new_id: int) -> DataFrame:
    """Rows of dirty commits moved to commit ``new_id``."""
    df, ids = store.tables[table], store.dirty_commits.select(F.col("id").alias("databaseversion_id"), F.lit(True).alias("_dirty"))
    rows = df.join(ids, "databaseversion_id", "left").withColumn("databaseversion_id", F.when(F.col("_dirty"), F.lit(new_id)).otherwise(F.col("databaseversion_id")).cast("int"))
    return rows.select(*df.columns)


def without_dirty(store, table: str) -> DataFrame:
    """``table`` without rows of dirty commits."""
    df, key = store.tables[table], "id" if table == "databaseversion" else "databaseversion_id"
    return df.join(store.dirty_commits.select(F.col("id").alias(key)), key, "left_anti").select(*df.columns)


def remove_versions_upto(fileversion: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the versions of each history up to a number (``gone``: filehistory_id, version)."""
    upto = gone.groupBy("filehistory_id").agg(F.max("version").alias("_upto"))
    return fileversion.join(upto, "filehistory_id", "left").where("_upto is null or version > _upto").select(*fileversion.columns)


def remove_versions(fileversion: DataFrame, gone: DataFrame) -> DataFrame:
    return fileversion.join(gone.select("filehistory_id", "version"), ["filehistory_id", "version"], "left_anti").select(*fileversion.columns)


def referenced_histories(store) -> DataFrame:
    used = store.fileversion.select(F.col("filehistory_id").alias("id"), "databaseversion_id")
    return store.filehistory.join(used, ["id", "databaseversion_id"], "left_semi")


def referenced_contents(store) -> DataFrame:
    used = store.fileversion.where("filecontent_checksum is not null").select(F.col("filecontent_checksum").alias("checksum"))
    return store.filecontent.join(used, "checksum", "left_semi")


def referenced_content_chunks(store) -> DataFrame:
    used = store.fileversion.where("filecontent_checksum is not null").select("filecontent_checksum")
    return store.filecontent_chunk.join(used, "filecontent_checksum", "left_semi")


def used_chunks(store) -> DataFrame:
    """Chunks that a file version reaches through its content."""
    return referenced_content_chunks(store).select("chunk_checksum").distinct()


def referenced_container_chunks(store) -> DataFrame:
    return store.multichunk_chunk.join(used_chunks(store), "chunk_checksum", "left_semi").select(*store.multichunk_chunk.columns)


def filled_containers(store) -> DataFrame:
    return store.multichunk.join(store.multichunk_chunk.select(F.col("multichunk_id").alias("id")), "id", "left_semi")


def referenced_chunks(store) -> DataFrame:
    used = store.filecontent_chunk.select("chunk_checksum").union(store.multichunk_chunk.select("chunk_checksum"))
    return store.chunk.join(used.withColumnRenamed("chunk_checksum", "checksum"), "checksum", "left_semi")


def unused_containers(store) -> DataFrame:
    """id, size of containers none of whose chunks any file version reaches; ask before unreferenced rows go."""
    live = store.multichunk_chunk.join(used_chunks(store), "chunk_checksum", "left_semi").select(F.col("multichunk_id").alias("id"))
    return store.multichunk.join(live, "id", "left_anti").select("id", "size").distinct()


def non_empty_commits(store, table: str = "databaseversion") -> DataFrame:
    """Commits (or their clock entries) that a history, chunk, container or content still names."""
    key = "id" if table == "databaseversion" else "databaseversion_id"
    used = None
    for name in ("filehistory", "chunk", "multichunk", "filecontent"):
        ids = store.tables[name].select(F.col("databaseversion_id").alias(key)).distinct()
        used = ids if used is None else used.union(ids)
    df = store.tables[table]
    return df.join(used, key, "left_semi").select(*df.columns)


def without_settled_muddy(store) -> DataFrame:
    """Muddy containers that haven't become part of the store."""
    return store.multichunk_muddy.join(store.multichunk.select("id"), "id", "left_anti")


def remove_dirty(store, new_id: int):
    """The store after dirty commits are gone: their versions and histories deleted, their chunks, contents and containers kept for commit ``new_id``."""
    out = store.with_tables(fileversion=without_dirty(store, "fileversion"), filehistory=without_dirty(store, "filehistory"))
    out = out.with_tables(filecontent_chunk=referenced_content_chunks(out), filecontent=referenced_contents(out))
    out = out.with_tables(**{t: rehome_dirty(out, t, new_id) for t in ("chunk", "filecontent", "multichunk")}, databaseversion_vectorclock=without_dirty(out, "databaseversion_vectorclock"))
    return out.with_tables(databaseversion=without_dirty(out, "databaseversion"))


def collect_garbage(store, cut=lambda df, name: df):
    """The store without what no file version reaches any more.

    ``cut`` (``session.cut``) stores what several tables are held against: the references of the versions, and the rows that they leave of two tables.
    """
    refs = cut(store.fileversion.select("filehistory_id", "databaseversion_id", "filecontent_checksum").distinct(), "references")
    seen = store.with_tables(fileversion=refs)
    out = store.with_tables(filehistory=referenced_histories(seen), filecontent_chunk=cut(referenced_content_chunks(seen).select(*store.filecontent_chunk.columns), "content-chunks"), filecontent=referenced_contents(seen))
    live = out.filecontent_chunk.select("chunk_checksum").distinct()
    out = out.with_tables(multichunk_chunk=cut(out.multichunk_chunk.join(live, "chunk_checksum", "left_semi").select(*out.multichunk_chunk.columns), "container-chunks"))
    out = out.with_tables(multichunk=filled_containers(out))
    out = out.with_tables(chunk=referenced_chunks(out))
    return out.with_tables(databaseversion_vectorclock=non_empty_commits(out, "databaseversion_vectorclock"), databaseversion=non_empty_commits(out))


def without_known_databases(store):
    return store.with_tables(known_databases=store.known_databases.limit(0))


def cleared(store):
    """Every table empty but the settings."""
    return store.with_tables(**{t: df.limit(0) for t, df in store.tables.items() if t != "general_settings"})
