"""Delta files of commits as XML, and the names of files in a remote store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clocks import vc_get, vc_parse

# Typed file names.
FILE_NAMES = {
    "database": r"^database-([^-]+)-(\d{10})$",
    "multichunk": r"^multichunk-([a-f0-9]+)$",
    "action": r"^action-(?:up|down|cleanup|restore)-([^-]+)-(\d+)$",
    "cleanup": r"^cleanup-(\d+)$",
    "transaction": r"^transaction-([a-f0-9]+)$",
    "temp": r"^temp-([^-]+)-(.+)$",
    "repo": r"^(?:master|repo)$",
}
ATTRIBUTE_PREFIX = "_"
HEADER_SCHEMA = "_client string, _date bigint, _clock string"
# The elements and attributes of a commit.
_REFS = "chunkRefs:struct<chunkRef:array<struct<_ref:string>>>"
_VERSION = (
    "_version:int,_type:string,_status:string,_path:string,_pathEncoded:string,_size:bigint,_lastModified:bigint,_linkTarget:string,_updated:bigint,_checksum:string,_dosattrs:string,_posixperms:string"
)
BODY_SCHEMA = (
    f"{HEADER_SCHEMA}, chunks struct<chunk:array<struct<_checksum:string,_size:bigint>>>, fileContents struct<fileContent:array<struct<_checksum:string,_size:bigint,{_REFS}>>>, "
    f"multiChunks struct<multiChunk:array<struct<_id:string,_size:bigint,{_REFS}>>>, fileHistories struct<fileHistory:array<struct<_id:string,fileVersions:struct<fileVersion:array<struct<{_VERSION}>>>>>>"
)


def parse_names(listing: DataFrame, name: str = "name") -> DataFrame:
    """kind, client, number of remote file names; unknown names have a null kind."""
    col = F.col(name)
    kind = F.coalesce(*[F.when(col.rlike(p), F.lit(k)) for k, p in FILE_NAMES.items()])
    client = F.when(kind == "database", F.regexp_extract(col, FILE_NAMES["database"], 1)).when(kind == "action", F.regexp_extract(col, FILE_NAMES["action"], 1))
    number = F.when(kind == "database", F.regexp_extract(col, FILE_NAMES["database"], 2)).when(kind == "cleanup", F.regexp_extract(col, FILE_NAMES["cleanup"], 1))
    return listing.select("*", kind.alias("kind"), client.alias("client"), number.cast("bigint").alias("number"))


def database_name(client: Column, number: Column) -> Column:
    return F.concat(F.lit("database-"), client, F.lit("-"), F.lpad(number.cast("string"), 10, "0"))


def unknown_databases(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Remote delta files (name) that the ledger (client, filenumber) doesn't have."""
    found = parse_names(listing).where("kind = 'database'").select("name", "client", F.col("number").cast("int").alias("filenumber"))
    return found.join(known.select("client", "filenumber"), ["client", "filenumber"], "left_anti").select("name", "client", "filenumber")


def sharded_path(name: Column, levels: int = 2) -> Column:
    """The name below folders of its digest's first bytes, so that a folder stays small."""
    digest = F.sha1(name.cast("binary"))
    return F.concat(*[x for i in range(levels) for x in (F.substring(digest, 2 * i + 1, 2), F.lit("/"))], name)


def _millis(name: str) -> Column:
    return F.unix_millis(F.col(name).cast("timestamp"))


def _time(name: str) -> Column:
    return F.timestamp_millis(F.col(name)).cast("timestamp_ntz")


def _collected(rows: DataFrame, by: list[str], item: Column, outer: str, inner: str) -> DataFrame:
    """A row for each ``by`` with the items as ``<outer><inner/><inner/></outer>``."""
    return rows.groupBy(*by).agg(F.struct(F.array_sort(F.collect_list(item)).alias(inner)).alias(outer))


def commits(store) -> DataFrame:
    """Each commit in the form of ``BODY_SCHEMA``: header, chunks, contents and containers with their chunks in order, histories with versions.

    A commit is one row, as it is one file: ``chunks.commit_numbers`` bounds what goes into it.
    """
    dbv = "databaseversion_id"
    bad = F.col("path").rlike(r"[\x00-\x1f\ufffe\uffff]")  # characters that XML refuses
    version = F.struct(
        F.col("version").alias("_version"), F.col("type").alias("_type"), F.col("status").alias("_status"), F.when(~bad, F.col("path")).alias("_path"), F.when(bad, F.base64(F.encode("path", "UTF-8"))).alias("_pathEncoded"),
        F.col("size").alias("_size"), _millis("lastmodified").alias("_lastModified"), F.col("linktarget").alias("_linkTarget"), _millis("updated").alias("_updated"), F.col("filecontent_checksum").alias("_checksum"),
        F.col("dosattrs").alias("_dosattrs"), F.col("posixperms").alias("_posixperms"),
    )
    # a history without versions in a commit is there too; rows move to their commit once and are put together there
    histories = store.fileversion.select(dbv, "filehistory_id", version.alias("v"))
    histories = histories.unionByName(store.filehistory.select(dbv, F.col("id").alias("filehistory_id")), allowMissingColumns=True).repartition(dbv)
    histories = histories.groupBy(dbv, "filehistory_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    histories = histories.select(dbv, "filehistory_id", F.when(F.size("v") > 0, F.struct(F.col("v").alias("fileVersion"))).alias("fileVersions"))
    histories = _collected(histories, [dbv], F.struct(F.col("filehistory_id").alias("_id"), "fileVersions"), "fileHistories", "fileHistory")
    chunks = _collected(store.chunk, [dbv], F.struct(F.col("checksum").alias("_checksum"), F.col("size").alias("_size")), "chunks", "chunk")

    def with_refs(owner: DataFrame, refs: DataFrame, name: str, outer: str, inner: str) -> DataFrame:
        lists = refs.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("num", "chunk_checksum"))).alias("r"))
        lists = lists.select(name, F.struct(F.transform("r", lambda x: F.struct(x["chunk_checksum"].alias("_ref"))).alias("chunkRef")).alias("chunkRefs"))
        rows = owner.withColumnRenamed(owner.columns[0], name).join(lists, name, "left")
        return _collected(rows, [dbv], F.struct(F.col(name).alias(f"_{owner.columns[0]}"), F.col("size").alias("_size"), "chunkRefs"), outer, inner)

    contents = with_refs(store.filecontent, store.filecontent_chunk.withColumnRenamed("filecontent_checksum", "of"), "of", "fileContents", "fileContent")
    containers = with_refs(store.multichunk, store.multichunk_chunk.select(F.col("multichunk_id").alias("of"), "chunk_checksum", F.lit(0).alias("num")), "of", "multiChunks", "multiChunk")
    rows = store.databaseversion.select(F.col("id").alias(dbv), F.col("client").alias("_client"), _millis("localtime").alias("_date"), F.col("vectorclock_serialized").alias("_clock"))
    for part in (chunks, contents, containers, histories):
        rows = rows.join(part, dbv, "left")
    return rows.drop(dbv)


def write_deltas(store, path: str) -> None:
    """Commits as XML, a ``databaseVersion`` element each; times in milliseconds. Paths with characters that XML refuses are base64."""
    commits(store).write.format("xml").option("rootTag", "database").option("rowTag", "databaseVersion").option("attributePrefix", ATTRIBUTE_PREFIX).save(path)


def read_rows(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """The commits of delta files, also of those in parts, as rows of ``schema``, which may name a part of ``BODY_SCHEMA``."""
    return spark.read.format("xml").option("recursiveFileLookup", "true").option("rowTag", "databaseVersion").option("attributePrefix", ATTRIBUTE_PREFIX).schema(schema).load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """client, localtime, clock of the commits; what they hold isn't parsed into columns."""
    return read_rows(spark, path, HEADER_SCHEMA).select(F.col("_client").alias("client"), _time("_date").alias("localtime"), F.col("_clock").alias("vectorclock_serialized"))


def read_deltas(spark: SparkSession, path: str, client: str | None = None, first: int | None = None, last: int | None = None) -> dict[str, DataFrame]:
    """``tables`` of the commits of one ``client`` only, and only of its own times from ``first`` to ``last``."""
    rows = read_rows(spark, path, BODY_SCHEMA)
    own = vc_get(vc_parse(F.col("_clock")), F.col("_client"))
    rows = rows.where(F.col("_client") == client) if client is not None else rows
    rows = rows.where(own >= first) if first is not None else rows
    rows = rows.where(own <= last) if last is not None else rows
    return tables(rows)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Tables of commits in the form of ``BODY_SCHEMA``, by name, with client and clock in place of the commit's id."""
    head = [F.col("_client").alias("client"), F.col("_clock").alias("vectorclock_serialized")]
    each = lambda name, *cols: rows.select(*head, F.explode(name).alias("x")).select("client", "vectorclock_serialized", *cols)
    size = F.col("x._size").alias("size")
    chunks = each("chunks.chunk", F.col("x._checksum").alias("checksum"), size)
    contents = each("fileContents.fileContent", F.col("x._checksum").alias("checksum"), size, F.col("x.chunkRefs.chunkRef").alias("refs"))
    containers = each("multiChunks.multiChunk", F.col("x._id").alias("id"), size, F.col("x.chunkRefs.chunkRef").alias("refs"))
    histories = each("fileHistories.fileHistory", F.col("x._id").alias("id"), F.col("x.fileVersions.fileVersion").alias("versions"))
    v = histories.select("client", "vectorclock_serialized", F.col("id").alias("filehistory_id"), F.explode("versions").alias("v"))
    versions = v.select(
        "client", "vectorclock_serialized", "filehistory_id", F.col("v._version").alias("version"), F.coalesce("v._path", F.decode(F.unbase64("v._pathEncoded"), "UTF-8")).alias("path"),
        F.col("v._type").alias("type"), F.col("v._status").alias("status"), F.col("v._size").alias("size"), _time("v._lastModified").alias("lastmodified"), F.col("v._linkTarget").alias("linktarget"),
        F.col("v._checksum").alias("filecontent_checksum"), _time("v._updated").alias("updated"), F.col("v._posixperms").alias("posixperms"), F.col("v._dosattrs").alias("dosattrs"),
    )
    return {
        "databaseversion": rows.select(*head, _time("_date").alias("localtime")),
        "databaseversion_vectorclock": rows.select(*head, F.explode(vc_parse(F.col("_clock"))).alias("of", "logicaltime")),
        "chunk": chunks,
        "filecontent": contents.drop("refs"),
        "filecontent_chunk": contents.select(F.col("checksum").alias("filecontent_checksum"), F.posexplode("refs").alias("num", "r")).select("filecontent_checksum", F.col("r._ref").alias("chunk_checksum"), "num"),
        "multichunk": containers.drop("refs"),
        "multichunk_chunk": containers.select(F.col("id").alias("multichunk_id"), F.explode("refs").alias("r")).select("multichunk_id", F.col("r._ref").alias("chunk_checksum")),
        "filehistory": histories.drop("versions"),
        "fileversion": versions,
    }


def read_batches(headers: DataFrame, histories: DataFrame, most: int = 9_999, file: str | None = None) -> DataFrame:
    """``headers`` (client, vectorclock_serialized, localtime) with ``batch``: commits in order of time and client, a batch ends with the file that brings it to ``most`` histories.

    ``histories`` (client, vectorclock_serialized, id) that repeat in a batch count once. ``file``: a column of ``headers``, the file that a commit lies in;
    commits of a file that follow each other are read together. Without it each commit is a file. What a commit shares with each earlier one is counted by
    history; headers, few and one a commit, meet in one task with those counts.
    """
    by = ["client", "vectorclock_serialized"]
    order = Window.orderBy("localtime", *by)
    rows = headers.withColumn("_file", F.col(file) if file else F.struct(*by))
    begins = F.when(F.lag("_file").over(order).eqNullSafe(F.col("_file")), 0).otherwise(1)
    rows = rows.withColumn("_begins", begins).withColumn("unit", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    items = histories.select(*by, "id").join(rows.select(*by, "unit"), by).select("unit", "id").distinct()
    items = items.withColumn("was", F.coalesce(F.lag("unit").over(Window.partitionBy("id").orderBy("unit")), F.lit(0)))
    shared = items.groupBy("unit", "was").agg(F.count("*").alias("n")).groupBy("unit").agg(F.collect_list(F.struct("was", "n")).alias("shared"))
    units = rows.select("unit").distinct().join(shared, "unit", "left")

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        out, batch, first, held = [], 0, 1, 0
        for u in g.sort_values("unit").itertuples():
            if held >= most:
                batch, first, held = batch + 1, u.unit, 0
            held += sum(x["n"] for x in (u.shared if u.shared is not None else []) if x["was"] < first)
            out.append((u.unit, batch))
        return pd.DataFrame(out, columns=["unit", "batch"])

    batches = units.groupBy().applyInPandas(scan, "unit long, batch int")
    counts = histories.groupBy(*by).agg(F.count_distinct("id").alias("n"))
    out = rows.join(batches, "unit").join(counts, by, "left")
    return out.select(*by, "localtime", F.coalesce("n", F.lit(0)).alias("n"), "batch")
