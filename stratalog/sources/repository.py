"""A repository's delta files under their remote names: written commit by commit, listed, and merged into one file a client.

Spark writes the XML; the driver moves whole files from a staging folder to their names, so readers see a file either whole or not at all. A merged file that several
tasks wrote is a folder of that name with its parts in order, so no task takes all that a client has; readers take both.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clocks import vc_get, vc_parse
from ..operators.cleanup import merged_files
from ..session import fresh_path, ship
from .deltalog import ATTRIBUTE_PREFIX, BODY_SCHEMA, FILE_NAMES, database_name, parse_names, read_rows
from .deltasource import DeltaFiles


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name of each file in ``folder``, delta files in parts as one; none if there is no such folder. A repository keeps a few files a client, so their names fit the driver."""
    path, fs = _hadoop(spark, folder)
    found = fs.listStatus(path(folder)) if fs.exists(path(folder)) else []
    names = [n for x in found if x.isFile() | bool(re.match(FILE_NAMES["database"], n := x.getPath().getName()))]
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


def file_name(path: Column) -> Column:
    """The name of the delta file that a path, also of one of its parts, belongs to."""
    return F.regexp_extract(path, r"/(database-[^/]+-\d{10})(?:/[^/]*)?$", 1)


def stage(commits: DataFrame, parts: bool = False) -> tuple[str, list[str]]:
    """``commits`` (``BODY_SCHEMA`` and ``file``) written below a fresh folder, a file for each name; the folder and the names.

    A file's commits come in order of its client's own time. A name's rows meet in one task; with ``parts`` they are spread over ranges of that time, each a part.
    """
    spark = commits.sparkSession
    path_, fs = _hadoop(spark, folder := fresh_path(spark, "staged"))
    rows = commits.withColumn("_own", vc_get(vc_parse(F.col("_clock")), F.col("_client")))
    rows = rows.repartitionByRange("file", "_own") if parts else rows.repartition("file")
    rows = rows.sortWithinPartitions("file", "_own").drop("_own")
    rows.write.format("xml").option("rootTag", "database").option("rowTag", "databaseVersion").option("attributePrefix", ATTRIBUTE_PREFIX).partitionBy("file").save(folder)
    return folder, sorted(x.getPath().getName().removeprefix("file=") for x in fs.listStatus(path_(folder)) if x.isDirectory())


def publish(spark: SparkSession, staged: str, names: list[str], folder: str, replaced: list[str] = ()) -> None:
    """Moves staged files to their names in ``folder`` and then removes the ``replaced`` ones. One of several parts is moved as a folder.

    A name that exists already is an error. If a move fails, the files moved so far go again and nothing is removed.
    """
    path, fs = _hadoop(spark, folder)
    fs.mkdirs(path(folder))
    done = []
    try:
        for name in names:
            at = path(f"{staged}/file={name}")
            part = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-")] if fs.exists(at) else []
            if not part or fs.exists(path(f"{folder}/{name}")) or not fs.rename(part[0] if len(part) == 1 else at, path(f"{folder}/{name}")):
                raise OSError(f"{name} can't be put into {folder}")
            done.append(name)
    except Exception:
        for name in done:
            fs.delete(path(f"{folder}/{name}"), True)
        raise
    for name in replaced:
        fs.delete(path(f"{folder}/{name}"), True)


def write_delta_files(commits: DataFrame, folder: str) -> None:
    """Each of the ``commits`` (as ``deltalog.commits`` makes them) as a file ``database-<client>-<its own time>``."""
    own = vc_get(vc_parse(F.col("_clock")), F.col("_client"))
    staged, names = stage(commits.withColumn("file", database_name(F.col("_client"), own)))
    publish(commits.sparkSession, staged, names, folder)


def compact(spark: SparkSession, folder: str, commits: DataFrame | None = None) -> DataFrame:
    """Merges each client's delta files in ``folder`` into one, numbered one over its newest, and removes the others; the new ledger (client, filenumber).

    ``commits``: what the new files hold, by client, such as those of a store that old versions were purged from; what the present files hold if left out. Of a
    client that has no file nothing is written, and a client of whom ``commits`` has none loses its files.
    """
    names = parse_names(listing(spark, folder)).where("kind = 'database'")
    old = [r["name"] for r in names.select("name").collect()]
    if not old:
        return spark.createDataFrame([], "client string, filenumber int")
    rows = read_rows(spark, [f"{folder}/{n}" for n in old], BODY_SCHEMA) if commits is None else commits
    target = merged_files(names).select(F.col("client").alias("_client"), database_name(F.col("client"), F.col("number")).alias("file"))
    staged, new = stage(rows.join(F.broadcast(target), "_client").select(*rows.columns, "file"), parts=True)  # a row for each client
    publish(spark, staged, new, folder, old)
    return parse_names(spark.createDataFrame([(n,) for n in new], "name string")).select("client", F.col("number").cast("int").alias("filenumber"))


def _source(spark: SparkSession, streaming: bool):
    ship(spark).dataSource.register(DeltaFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return (spark.readStream if streaming else spark.read).format(DeltaFiles.name())


def _parsed(rows: DataFrame) -> DataFrame:
    body = F.from_xml("xml", BODY_SCHEMA, {"attributePrefix": ATTRIBUTE_PREFIX, "mode": "FAILFAST"})
    return rows.select("client", "number", "name", body.alias("c")).select("client", "number", "name", "c.*")


def read_delta_files(spark: SparkSession, folder: str) -> DataFrame:
    """client, number and name of the file, and ``BODY_SCHEMA`` of each commit in it.

    A filter on client, number or name keeps other files closed. Turns the session's push-down into Python sources on. An empty or missing folder has no rows; a damaged file
    that is opened is an error.
    """
    return _parsed(_source(spark, False).load(folder))


def follow_delta_files(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """The rows of ``read_delta_files`` as a stream: files beyond those of the ledger ``known`` (client, filenumber), then whatever comes.

    The query's checkpoint takes the ledger's place once it has one: each file counts once, also after a restart. A client's files count by their number, so one
    that comes under a lower number than its newest is never read, and a merged one is.
    """
    # a row for each client
    ledger = {} if known is None else {r["client"]: r["n"] for r in known.groupBy("client").agg(F.max("filenumber").alias("n")).collect()}
    return _parsed(_source(spark, True).option("known", json.dumps(ledger)).load(folder))
