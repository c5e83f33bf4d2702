"""Lookups and joins over the store. Ordering is part of a result only where a limit depends on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_commit(store, table: str, clock: str) -> DataFrame:
    """Rows of ``table`` that came with the commit of this clock."""
    df = store.tables[table]
    return df.join(store.commit_ids(clock), "databaseversion_id", "left_semi").select(*df.columns)


def versions_to(store, client: str, upto: int) -> DataFrame:
    """Commits of a client up to its own time ``upto``."""
    return store.databaseversion_master.where((F.col("client") == client) & (F.col("client_version") <= upto)).orderBy("id")


def last_versions(store, limit: int, offset: int = 0) -> DataFrame:
    """Newest commits first; a limit of 0 or less means all, an offset of 0 or less none."""
    df = store.master_commits.orderBy(F.desc("id"))
    df = df.offset(offset) if offset > 0 else df
    return df.limit(limit) if limit > 0 else df


def histories_by_ids(store, ids: list[str]) -> DataFrame:
    """Every version of a short list of histories."""
    return store.fileversion_master.where(F.col("filehistory_id").isin(ids))


def expand_history_id(store, prefix: str) -> DataFrame:
    """The one history whose id begins so; no row where several or none do."""
    found = store.fileversion_master.where(F.col("filehistory_id").startswith(prefix)).select("filehistory_id").distinct().limit(2)
    return found.agg(F.count("*").alias("n"), F.min("filehistory_id").alias("filehistory_id")).where("n = 1").select("filehistory_id")


def non_empty_commits(store) -> DataFrame:
    ids = store.fileversion.select(F.col("databaseversion_id").alias("id"))
    return store.databaseversion.join(ids, "id", "left_semi")


def local_branch(store) -> DataFrame:
    """Headers of the commits that count, their clocks folded to text from the entries."""
    clock = store.databaseversion_vectorclock.groupBy(F.col("databaseversion_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("client", "logicaltime"))).alias("e"))
    text = F.concat(F.lit("("), F.array_join(F.transform("e", lambda x: F.concat(x["client"], x["logicaltime"].cast("string"))), ","), F.lit(")"))
    return store.master_commits.join(clock, "id").select("id", "client", "localtime", text.alias("clock"))


def max_dirty_time(store, client: str) -> DataFrame:
    """The client's time in the dirty commit with the largest id (not its largest time)."""
    own = store.databaseversion_vectorclock.where(F.col("client") == client).select(F.col("databaseversion_id").alias("id"), "logicaltime")
    return store.dirty_commits.select("id").join(own, "id").agg(F.max_by("logicaltime", "id").alias("logicaltime")).where("logicaltime is not null")


def contents_with_chunks(store, contents: DataFrame | None = None) -> DataFrame:
    """checksum, size and the ordered chunk list; contents without a chunk drop out."""
    contents = store.filecontent if contents is None else contents
    refs = store.filecontent_chunk.withColumnRenamed("filecontent_checksum", "checksum")
    lists = refs.join(contents.select("checksum"), "checksum", "left_semi").groupBy("checksum").agg(F.array_sort(F.collect_list(F.struct("num", "chunk_checksum"))).alias("c"))
    return contents.join(lists, "checksum").select("checksum", "size", F.array_join("c.chunk_checksum", ",").alias("chunks"))


def containers_of_chunks(store, chunks: DataFrame) -> DataFrame:
    """chunk_checksum and its container (the smallest id, where several hold it)."""
    held = store.multichunk_chunk.join(chunks.select("chunk_checksum"), "chunk_checksum", "left_semi")
    return held.groupBy("chunk_checksum").agg(F.min("multichunk_id").alias("multichunk_id"))


def containers_of_file(store, checksum: str) -> DataFrame:
    """What has to be fetched to restore a content."""
    chunks = store.filecontent_chunk.where(F.col("filecontent_checksum") == checksum).select("chunk_checksum")
    return store.multichunk_chunk.join(chunks, "chunk_checksum", "left_semi").select("multichunk_id").distinct()


def containers_with_chunks(store, clock: str) -> DataFrame:
    ids = of_commit(store, "multichunk", clock).select(F.col("id").alias("multichunk_id"))
    return store.multichunk_chunk.join(ids, "multichunk_id", "left_semi").groupBy("multichunk_id").agg(F.count("*").alias("n_chunks"), F.array_join(F.array_sort(F.collect_list("chunk_checksum")), ",").alias("chunks"))


def dirty_containers(store) -> DataFrame:
    return store.multichunk.join(store.dirty_commits.select(F.col("id").alias("databaseversion_id")), "databaseversion_id", "left_semi").select("id").distinct()


def versions_of_clock(store, clock: str, limit: int = 0) -> DataFrame:
    """Versions of the commit with this clock, dirty or not, with its header; with a ``limit`` above 0 the first so many by history and version."""
    rows = store.fileversion_full.where(F.col("vectorclock_serialized") == clock)
    return rows.orderBy("filehistory_id", "version").limit(limit) if limit > 0 else rows


def containers_to_download(wanted: DataFrame, local, winner) -> DataFrame:
    """multichunk_id of the containers that hold the contents (filecontent_checksum) of files to be made.

    A content that the ``local`` store knows, with containers, comes from these. For the chunks of the others, as the ``winner``'s store lists them, a
    container of the local store counts, else one of the winner's; a chunk that neither has is an error. A content without chunks needs none.
    """
    wanted = wanted.where("filecontent_checksum is not null").select("filecontent_checksum").distinct()
    place = lambda store, name: store.multichunk_chunk.groupBy("chunk_checksum").agg(F.min("multichunk_id").alias(name))
    known = wanted.join(local.filecontent_chunk, "filecontent_checksum").join(local.multichunk_chunk, "chunk_checksum").select("filecontent_checksum", "multichunk_id").distinct()
    chunks = wanted.join(known, "filecontent_checksum", "left_anti").join(winner.filecontent_chunk, "filecontent_checksum").select("chunk_checksum").distinct()
    found = chunks.join(place(local, "_here"), "chunk_checksum", "left").join(place(winner, "_there"), "chunk_checksum", "left")
    missing = F.raise_error(F.concat(F.lit("no container has chunk "), "chunk_checksum")).cast("string")
    return known.select("multichunk_id").union(found.select(F.coalesce("_here", "_there", missing).alias("multichunk_id"))).distinct()
