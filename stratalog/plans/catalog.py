"""The registered queries on versioned metadata, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clocks, text
from ..session import cut, fresh_path, ship
from ..operators import blocks, causality, chunks, cleanup, diff, history, indexing, lookups, mutations, union
from ..sources import deltalog, repository
from ..sources.model import MODEL_SQL
from ..streaming import sync
from .store import VersionStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Parameters of the registered queries.
_CLOCK, _DIRTY_CLOCK = "(A5,B4,C4)", "(A2,B1)"
_HISTORY, _PATH, _PREFIX = "u7", "dir1/41.view", "a"
_NOW = "2024-01-28 12:00:00"
_now = lambda: F.lit(_NOW).cast("timestamp_ntz")
_one_history = lambda: F.sha1(F.lit(_HISTORY).cast("binary"))
_FV = "filehistory_id, version, databaseversion_id, path, type, status, size, lastmodified, linktarget, filecontent_checksum, updated, posixperms, dosattrs"


def _hash_prefix(n: int) -> str:
    return hashlib.sha1(_HISTORY.encode()).hexdigest()[:n]


def query(name: str, sql: str | None, model: bool = True) -> Callable[[Callable[[VersionStore], DataFrame]], Callable]:
    """Registers a function of a store; its SQL follows the model's unless ``model`` is false."""

    def add(f: Callable[[VersionStore], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(VersionStore.derived(ship(spark), sf_dir))
        if sql:
            SQL[name] = (MODEL_SQL if model else "") + sql
        return f

    return add


def _tables() -> None:
    for name in ("databaseversion", "databaseversion_vectorclock", "chunk", "filecontent", "filecontent_chunk", "filehistory", "fileversion", "multichunk", "multichunk_chunk", "multichunk_muddy", "known_databases", "general_settings"):
        query(f"table_{name}", f"SELECT * FROM {name}")(lambda s, name=name: s.tables[name])
    for name in ("databaseversion_master", "fileversion_master", "fileversion_master_last", "filehistory_full", "fileversion_full"):
        query(f"view_{name}", f"SELECT * FROM {name}")(lambda s, name=name: getattr(s, name))
    query("view_max_version", "SELECT filehistory_id, max(version) AS version FROM fileversion_master GROUP BY 1")(lambda s: s.fileversion_master.groupBy("filehistory_id").agg(F.max("version").alias("version")))


_tables()

# --- scans, lookups, filters ----------------------------------------------

query("known_databases_all", "SELECT client, filenumber FROM known_databases")(lambda s: s.known_databases.select("client", "filenumber"))
query("general_setting", "SELECT value FROM general_settings WHERE key = 'click'")(lambda s: s.general_settings.where("key = 'click'").select("value"))
query("chunk_cache", "SELECT checksum, size FROM chunk")(lambda s: s.chunk.select("checksum", "size"))
query("chunks_of_commit", f"SELECT * FROM chunk WHERE databaseversion_id IN (SELECT id FROM databaseversion WHERE vectorclock_serialized = '{_CLOCK}')")(lambda s: lookups.of_commit(s, "chunk", _CLOCK))
query("clock_of_commit", "SELECT client, logicaltime FROM databaseversion_vectorclock WHERE databaseversion_id = 12")(lambda s: s.databaseversion_vectorclock.where("databaseversion_id = 12").select("client", "logicaltime"))
query("dirty_commits", "SELECT * FROM databaseversion WHERE status = 'DIRTY'")(lambda s: s.dirty_commits)
query("versions_to", "SELECT * FROM databaseversion_master WHERE client = 'A' AND client_version <= 9")(lambda s: lookups.versions_to(s, "A", 9))
query("last_header", "SELECT * FROM master ORDER BY id DESC LIMIT 1")(lambda s: lookups.last_versions(s, 1))
query("last_commits", "SELECT * FROM master ORDER BY id DESC LIMIT 7 OFFSET 3")(lambda s: lookups.last_versions(s, 7, 3))
query("content_by_checksum", "SELECT * FROM filecontent WHERE checksum = (SELECT max(filecontent_checksum) FROM fileversion_last)")(
    lambda s: s.filecontent.join(s.fileversion_last.agg(F.max("filecontent_checksum").alias("checksum")), "checksum", "left_semi")
)
query("current_tree", f"SELECT {_FV} FROM fileversion_master_last")(lambda s: s.fileversion_master_last)
query("version_of_history", f"SELECT {_FV} FROM fileversion_master WHERE filehistory_id = sha1('{_HISTORY}') AND version = 3")(lambda s: s.fileversion_master.where((F.col("filehistory_id") == _one_history()) & (F.col("version") == 3)))
query("history_by_id", f"SELECT {_FV} FROM fileversion_master WHERE filehistory_id = sha1('{_HISTORY}')")(lambda s: s.fileversion_master.where(F.col("filehistory_id") == _one_history()))
_IDS = [hashlib.sha1(f"u{k}".encode()).hexdigest() for k in (1, 2, 3)]
query("histories_by_ids", f"SELECT {_FV} FROM fileversion_master WHERE filehistory_id IN ({', '.join(map(repr, _IDS))})")(lambda s: lookups.histories_by_ids(s, _IDS))
query("histories_with_versions", "SELECT filehistory_id, count(*) AS n, max(version) AS last FROM fileversion_master GROUP BY 1")(lambda s: s.fileversion_master.groupBy("filehistory_id").agg(F.count("*").alias("n"), F.max("version").alias("last")))
query("histories_with_last_version", "SELECT filehistory_id, version FROM fileversion_master_last")(lambda s: s.fileversion_master_last.select("filehistory_id", "version"))
query("last_version_of_path", f"SELECT {_FV} FROM fileversion_master_last WHERE path = '{_PATH}'")(lambda s: s.fileversion_master_last.where(F.col("path") == _PATH))
query("histories_of_clock", f"SELECT {_FV}, commit_status, localtime, client, vectorclock_serialized FROM fileversion_full WHERE vectorclock_serialized = '{_CLOCK}'")(lambda s: lookups.versions_of_clock(s, _CLOCK))
query("histories_of_clock_first", f"SELECT {_FV}, commit_status, localtime, client, vectorclock_serialized FROM fileversion_full WHERE vectorclock_serialized = '{_CLOCK}' ORDER BY filehistory_id, version LIMIT 5")(lambda s: lookups.versions_of_clock(s, _CLOCK, 5))
query("expand_history", f"SELECT min(filehistory_id) AS filehistory_id FROM fileversion_master WHERE filehistory_id LIKE substr(sha1('{_HISTORY}'), 1, 9) || '%' HAVING count(DISTINCT filehistory_id) = 1")(
    lambda s: lookups.expand_history_id(s, _hash_prefix(9))
)


_AS_OF = "SELECT * FROM (SELECT * FROM fileversion_master WHERE updated <= TIMESTAMP '2024-01-15 00:00:00' QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1)"
_as_of = lambda: F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
query("ls_as_of", f"{_AS_OF} WHERE status <> 'DELETED'")(lambda s: history.list_files(s, as_of=_as_of()))
query("ls_path", f"{_AS_OF} WHERE status <> 'DELETED' AND path LIKE 'dir3/%.view' AND type IN ('FILE', 'SYMLINK') AND length(path) - length(replace(path, '/', '')) = 1")(
    lambda s: history.list_files(s, path="dir3/*.view", as_of=_as_of(), recursive=False, types=("FILE", "SYMLINK"))
)
query("ls_deleted", f"{_AS_OF} WHERE filehistory_id LIKE '{_PREFIX}%'")(lambda s: history.list_files(s, history=_PREFIX, as_of=_as_of(), deleted=True))
query(
    "ls_columns",
    """SELECT CASE status WHEN 'NEW' THEN 'A' WHEN 'DELETED' THEN 'D' ELSE 'M' END AS status, CASE type WHEN 'FILE' THEN '-' WHEN 'FOLDER' THEN 'd' ELSE 's' END AS type, substr(filehistory_id, 1, 10) AS history,
    coalesce(substr(filecontent_checksum, 1, 10), '') AS checksum, version, CASE WHEN type = 'SYMLINK' THEN path || ' -> ' || linktarget ELSE path END AS path FROM fileversion_last""",
)(lambda s: history.listing_columns(history.list_files(s, deleted=True)))

# --- joins ----------------------------------------------------------------

query("non_empty_headers", "SELECT * FROM databaseversion WHERE id IN (SELECT databaseversion_id FROM fileversion)")(lambda s: lookups.non_empty_commits(s).select(*s.databaseversion.columns))
query("max_dirty_time", "SELECT v.logicaltime FROM databaseversion d JOIN databaseversion_vectorclock v ON v.databaseversion_id = d.id WHERE d.status = 'DIRTY' AND v.client = 'B' ORDER BY d.id DESC LIMIT 1")(lambda s: lookups.max_dirty_time(s, "B"))
query("local_branch", "SELECT id, client, localtime, vectorclock_serialized AS clock FROM master")(lookups.local_branch)
_LISTS = "SELECT c.checksum, c.size, string_agg(r.chunk_checksum, ',' ORDER BY r.num) AS chunks FROM filecontent c JOIN filecontent_chunk r ON r.filecontent_checksum = c.checksum"
query("contents_with_chunks", f"{_LISTS} GROUP BY 1, 2")(lookups.contents_with_chunks)
query("contents_of_commit", f"{_LISTS} WHERE c.databaseversion_id IN (SELECT id FROM databaseversion WHERE vectorclock_serialized = '{_CLOCK}') GROUP BY 1, 2")(lambda s: lookups.contents_with_chunks(s, lookups.of_commit(s, "filecontent", _CLOCK)))
query("containers_of_chunks", "SELECT chunk_checksum, min(multichunk_id) AS multichunk_id FROM multichunk_chunk WHERE chunk_checksum IN (SELECT checksum FROM chunk WHERE checksum LIKE 'a%') GROUP BY 1")(
    lambda s: lookups.containers_of_chunks(s, s.chunk.where("checksum like 'a%'").select(F.col("checksum").alias("chunk_checksum")))
)
query("containers_of_files", "SELECT DISTINCT r.filecontent_checksum, m.multichunk_id FROM filecontent_chunk r JOIN multichunk_chunk m USING (chunk_checksum)")(lambda s: s.filecontent_chunk.join(s.multichunk_chunk, "chunk_checksum").select("filecontent_checksum", "multichunk_id").distinct())
query("containers_of_file", "SELECT DISTINCT multichunk_id FROM filecontent_chunk r JOIN multichunk_chunk m USING (chunk_checksum) WHERE r.filecontent_checksum = (SELECT max(filecontent_checksum) FROM fileversion_last)")(
    lambda s: lookups.containers_of_file(s, s.fileversion_last.agg(F.max("filecontent_checksum")).first()[0])
)
query("containers_with_chunks", f"SELECT multichunk_id, count(*) AS n_chunks, string_agg(chunk_checksum, ',' ORDER BY chunk_checksum) AS chunks FROM multichunk_chunk WHERE multichunk_id IN (SELECT m.id FROM multichunk m JOIN databaseversion d ON d.id = m.databaseversion_id WHERE d.vectorclock_serialized = '{_CLOCK}') GROUP BY 1")(
    lambda s: lookups.containers_with_chunks(s, _CLOCK)
)
query(
    "containers_to_download",
    """, w AS (SELECT DISTINCT filecontent_checksum AS c FROM fileversion_last WHERE status <> 'DELETED' AND filecontent_checksum IS NOT NULL),
    known AS (SELECT DISTINCT c, multichunk_id FROM w JOIN filecontent_chunk r ON r.filecontent_checksum = c AND c < '8' JOIN multichunk_chunk m ON m.chunk_checksum = r.chunk_checksum AND m.multichunk_id < '8'),
    rest AS (SELECT DISTINCT chunk_checksum FROM w JOIN filecontent_chunk r ON r.filecontent_checksum = c WHERE c NOT IN (SELECT c FROM known))
    SELECT multichunk_id FROM known UNION SELECT coalesce(min(CASE WHEN multichunk_id < '8' THEN multichunk_id END), min(multichunk_id)) FROM rest JOIN multichunk_chunk USING (chunk_checksum) GROUP BY chunk_checksum""",
)(
    lambda s: lookups.containers_to_download(
        s.fileversion_master_last.select("filecontent_checksum"), s.with_tables(filecontent_chunk=s.filecontent_chunk.where("filecontent_checksum < '8'"), multichunk_chunk=s.multichunk_chunk.where("multichunk_id < '8'")), s
    )
)
query("dirty_containers", "SELECT DISTINCT id FROM multichunk WHERE databaseversion_id IN (SELECT id FROM databaseversion WHERE status = 'DIRTY')")(lookups.dirty_containers)

# --- greatest per group ---------------------------------------------------

query("highest_known_numbers", "SELECT client, max(filenumber) AS max_number FROM known_databases GROUP BY 1")(history.highest_known_numbers)
query("newest_numbers", "SELECT c AS client, coalesce(max(filenumber), 0)::INT AS max_number FROM (SELECT unnest(['A', 'B', 'C', 'Z']) AS c) LEFT JOIN known_databases ON client = c GROUP BY 1")(
    lambda s: history.newest_numbers(s, s.known_databases.sparkSession.createDataFrame([(c,) for c in "ABCZ"], "client string"))
)
query("highest_known_numbers_compat", "SELECT client, max(filenumber) AS max_number FROM known_databases GROUP BY client, filenumber")(lambda s: history.highest_known_numbers(s, True))
_LATEST = f"SELECT filehistory_id, version, path, vectorclock_serialized FROM (SELECT * FROM fileversion_full WHERE commit_status = 'MASTER' AND path = '{_PATH}' QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1) WHERE status <> 'DELETED'"
query("latest_for_path", _LATEST)(lambda s: history.latest_for_path(s, _PATH))
query("history_for_path", f"SELECT filehistory_id, version, path FROM ({_LATEST}) SEMI JOIN fileversion_last USING (filehistory_id, version)")(lambda s: history.history_for_path(s, _PATH))
query(
    "histories_by_content",
    """, w AS (SELECT DISTINCT filecontent_checksum, size, lastmodified FROM fileversion WHERE version % 3 <> 0 AND filecontent_checksum IS NOT NULL)
    SELECT l.* FROM fileversion_master_last l JOIN (SELECT filehistory_id, max(version) AS version FROM fileversion_master SEMI JOIN w USING (filecontent_checksum, size, lastmodified) GROUP BY 1) m USING (filehistory_id, version)""",
)(lambda s: history.histories_by_content(s, s.fileversion.where("version % 3 <> 0 and filecontent_checksum is not null").select(F.col("filecontent_checksum").alias("checksum"), "size", "lastmodified")))
query("ls_compat", "SELECT f.* FROM fileversion f JOIN fileversion_last l USING (filehistory_id, version) WHERE f.status <> 'DELETED' AND length(f.path) - length(replace(f.path, '/', '')) BETWEEN 1 AND 2")(lambda s: history.list_files(s, depths=(1, 2), compat=True))
query("last_version_of_history", f"SELECT * FROM fileversion_last WHERE filehistory_id = sha1('{_HISTORY}')")(lambda s: history.last_version(s, _hash_prefix(40)))
query("purge_before", f"SELECT filehistory_id, version FROM (SELECT *, max(version) OVER (PARTITION BY filehistory_id) AS m FROM fileversion) WHERE version <> m AND updated < TIMESTAMP '{_NOW}'")(lambda s: history.purge_before(s, _now()))
query("deleted_before", f"SELECT filehistory_id, version FROM (SELECT * FROM fileversion WHERE status = 'DELETED' QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1) WHERE updated < TIMESTAMP '{_NOW}'")(lambda s: history.deleted_before(s, _now()))
_INTERVAL = "SELECT filehistory_id, version FROM (SELECT *, max(version) OVER (PARTITION BY filehistory_id, date_trunc('{unit}', updated + INTERVAL {half})) AS m FROM fileversion) WHERE version <> m AND updated > TIMESTAMP '{now}' - INTERVAL {a} AND updated < TIMESTAMP '{now}' - INTERVAL {b}"
for _unit, _code, _half in (("day", "DD", "12 HOUR"), ("hour", "HH", "30 MINUTE"), ("minute", "MI", "30 SECOND")):
    query(f"purge_by_{_unit}", _INTERVAL.format(unit=_unit, half=_half, now=_NOW, a="20 DAY", b="1 DAY"))(lambda s, c=_code: history.purge_by_interval(s, c, _now() - F.expr("interval 20 days"), _now() - F.expr("interval 1 day")))
_THIN = " UNION ".join(_INTERVAL.format(unit=u, half=h, now=_NOW, a=f"{a} SECOND", b=f"{b} SECOND") for u, h, a, b in (("minute", "30 SECOND", 3600, 0), ("hour", "30 MINUTE", 259200, 3600), ("day", "12 HOUR", 2592000, 259200)))
_THIN += f""" UNION SELECT filehistory_id, version FROM (SELECT *, max(version) OVER (PARTITION BY filehistory_id) AS m FROM fileversion) WHERE version <> m AND updated < TIMESTAMP '{_NOW}' - INTERVAL 10 DAY
 UNION SELECT f.filehistory_id, f.version FROM fileversion f JOIN (SELECT * FROM fileversion WHERE status = 'DELETED' QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1) d
   ON d.filehistory_id = f.filehistory_id AND f.version <= d.version AND d.updated < TIMESTAMP '{_NOW}' - INTERVAL 10 DAY"""
query("cleanup_versions", _THIN)(lambda s: history.thinned(s, _now(), keep_seconds=10 * 86400))
query(
    "change_log",
    """SELECT databaseversion_id, c.client, c.localtime, path, filehistory_id, CASE status WHEN 'NEW' THEN 'new' WHEN 'DELETED' THEN 'deleted' ELSE 'changed' END AS change
    FROM (SELECT * FROM (SELECT * FROM fileversion WHERE databaseversion_id IN (SELECT id FROM master ORDER BY id DESC LIMIT 10) QUALIFY row_number() OVER (PARTITION BY databaseversion_id, filehistory_id ORDER BY version DESC) = 1)
      QUALIFY row_number() OVER (PARTITION BY databaseversion_id ORDER BY path, filehistory_id) <= 100) v JOIN (SELECT id, client, localtime FROM master) c ON c.id = v.databaseversion_id""",
)(history.change_log)
query(
    "restore_points",
    """SELECT filehistory_id, version, filecontent_checksum FROM (SELECT *, row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) AS back, count(*) OVER (PARTITION BY filehistory_id) AS n FROM fileversion_master)
    WHERE back = least(n, 2) AND type <> 'FOLDER'""",
)(history.restore_points)

# --- mutations ------------------------------------------------------------

query("insert_commits", "SELECT * FROM databaseversion UNION ALL SELECT ((SELECT max(id) FROM databaseversion) + row_number() OVER (ORDER BY localtime, client))::INT, 'MASTER', localtime, client, vectorclock_serialized FROM databaseversion WHERE status = 'DIRTY'")(
    lambda s: mutations.append_numbered(s.databaseversion, s.dirty_commits.withColumn("status", F.lit("MASTER")), ["localtime", "client"])
)
query("insert_clocks", "SELECT * FROM databaseversion_vectorclock UNION ALL SELECT v.databaseversion_id + 1000, v.client, v.logicaltime FROM databaseversion_vectorclock v JOIN databaseversion d ON d.id = v.databaseversion_id WHERE d.status = 'DIRTY'")(
    lambda s: mutations.append(s.databaseversion_vectorclock, mutations.clock_entries(s.dirty_commits.withColumn("id", (F.col("id") + 1000).cast("int"))))
)
query("insert_histories", "SELECT * FROM filehistory UNION ALL SELECT id, databaseversion_id + 1000 FROM filehistory WHERE databaseversion_id % 7 = 3")(
    lambda s: mutations.append(s.filehistory, s.filehistory.where("databaseversion_id % 7 = 3").withColumn("databaseversion_id", (F.col("databaseversion_id") + 1000).cast("int")))
)
query("insert_known_databases", "SELECT * FROM known_databases UNION ALL SELECT ((SELECT max(id) FROM known_databases) + row_number() OVER (ORDER BY client, own))::INT, client, own FROM commits WHERE own % 2 = 1")(
    lambda s: mutations.append_numbered(s.known_databases, deltalog.unknown_databases(_remote(s), s.known_databases), ["client", "filenumber"])
)


def _sizes(s: VersionStore) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t, df in s.tables.items() if t in ("chunk", "fileversion", "known_databases", "general_settings")]
    return reduce(DataFrame.union, counts)


query("cleared_tables", "SELECT 'general_settings' AS name, count(*) AS n FROM general_settings UNION ALL SELECT unnest(['chunk', 'fileversion', 'known_databases']), 0")(lambda s: _sizes(mutations.cleared(s)))
query("without_known_databases", "SELECT 'general_settings' AS name, count(*) AS n FROM general_settings UNION ALL SELECT 'chunk', count(*) FROM chunk UNION ALL SELECT 'fileversion', count(*) FROM fileversion UNION ALL SELECT 'known_databases', 0")(
    lambda s: _sizes(mutations.without_known_databases(s))
)
query("insert_versions", f"SELECT {_FV} FROM fileversion UNION ALL SELECT {_FV} FROM fileversion_last")(lambda s: mutations.append(s.fileversion, s.fileversion_last))
for _table, _keys in mutations.KEYS.items():
    _first = ", ".join(_keys)
    _cols = {"chunk": "databaseversion_id + 1000", "filecontent": "databaseversion_id + 1000", "multichunk": "databaseversion_id + 1000"}
    _changed = f"SELECT * REPLACE ((databaseversion_id + 1000)::INT AS databaseversion_id) FROM {_table}" if _table in _cols else f"SELECT * FROM {_table}"
    _half = f"{_keys[0]} < '8'"

    def _insert(s: VersionStore, table: str = _table, keys: list[str] = _keys, half: str = _half) -> DataFrame:
        df = s.tables[table]
        new = df.withColumn("databaseversion_id", (F.col("databaseversion_id") + 1000).cast("int")) if "databaseversion_id" in df.columns else df
        return mutations.insert_absent(df.where(half), new.unionByName(new), keys)

    query(f"merge_{_table}", f"SELECT * FROM {_table} WHERE {_half} UNION ALL SELECT * FROM ({_changed}) WHERE NOT ({_half})")(_insert)
query("upsert_settings", "SELECT * FROM general_settings WHERE key <> 'click' UNION ALL SELECT 'click', 'x' UNION ALL SELECT 'added', 'y'")(
    lambda s: mutations.upsert(s.general_settings, s.general_settings.sparkSession.createDataFrame([("click", "x"), ("added", "y")], "key string, value string"), ["key"])
)
query("mark_dirty", f"SELECT * REPLACE (CASE WHEN vectorclock_serialized = '{_CLOCK}' THEN 'DIRTY' ELSE status END AS status) FROM databaseversion")(lambda s: mutations.mark_dirty(s, _CLOCK))
_DIRTY_IDS = "(SELECT id FROM databaseversion WHERE status = 'DIRTY')"
for _table in ("chunk", "filecontent", "multichunk"):
    query(f"rehome_{_table}", f"SELECT * REPLACE ((CASE WHEN databaseversion_id IN {_DIRTY_IDS} THEN 999 ELSE databaseversion_id END)::INT AS databaseversion_id) FROM {_table}")(lambda s, t=_table: mutations.rehome_dirty(s, t, 999))
for _table in ("fileversion", "filehistory", "databaseversion_vectorclock"):
    query(f"remove_dirty_{_table}", f"SELECT * FROM {_table} WHERE databaseversion_id NOT IN {_DIRTY_IDS}")(lambda s, t=_table: mutations.without_dirty(s, t))
query("remove_dirty_databaseversion", "SELECT * FROM databaseversion WHERE status <> 'DIRTY'")(lambda s: mutations.without_dirty(s, "databaseversion"))
_DELETED = f"(SELECT * FROM fileversion WHERE status = 'DELETED' QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1)"
query("remove_versions_upto", f"SELECT {', '.join('f.' + c for c in _FV.split(', '))} FROM fileversion f LEFT JOIN {_DELETED} d USING (filehistory_id) WHERE d.version IS NULL OR f.version > d.version")(
    lambda s: mutations.remove_versions_upto(s.fileversion, history.deleted_before(s, F.lit("2100-01-01").cast("timestamp_ntz")))
)
query("remove_versions", f"SELECT * FROM fileversion f WHERE NOT EXISTS (SELECT 1 FROM {_DELETED} d WHERE d.filehistory_id = f.filehistory_id AND d.version = f.version)")(
    lambda s: mutations.remove_versions(s.fileversion, history.deleted_before(s, F.lit("2100-01-01").cast("timestamp_ntz")))
)


def _thin(s: VersionStore) -> VersionStore:
    """Only the last versions are left, as after a full purge."""
    return s.with_tables(fileversion=s.fileversion_master_last)


_LIVE = "(SELECT DISTINCT r.chunk_checksum FROM fileversion_master_last v JOIN filecontent_chunk r ON r.filecontent_checksum = v.filecontent_checksum)"
_CONTENTS = "(SELECT filecontent_checksum FROM fileversion_master_last WHERE filecontent_checksum IS NOT NULL)"
query("gc_histories", "SELECT * FROM filehistory h WHERE EXISTS (SELECT 1 FROM fileversion_master_last v WHERE v.filehistory_id = h.id AND v.databaseversion_id = h.databaseversion_id)")(lambda s: mutations.referenced_histories(_thin(s)))
query("gc_content_chunks", f"SELECT * FROM filecontent_chunk WHERE filecontent_checksum IN {_CONTENTS}")(lambda s: mutations.referenced_content_chunks(_thin(s)).select(*s.filecontent_chunk.columns))
query("gc_contents", f"SELECT * FROM filecontent WHERE checksum IN {_CONTENTS}")(lambda s: mutations.referenced_contents(_thin(s)))
query("gc_container_chunks", f"SELECT * FROM multichunk_chunk WHERE chunk_checksum IN {_LIVE}")(lambda s: mutations.referenced_container_chunks(_thin(s)))
_KEPT = f"(SELECT multichunk_id FROM multichunk_chunk WHERE chunk_checksum IN {_LIVE})"
query("gc_containers", f"SELECT * FROM multichunk WHERE id IN {_KEPT}")(lambda s: mutations.collect_garbage(_thin(s), cut).multichunk)
query("gc_chunks", f"SELECT * FROM chunk WHERE checksum IN {_LIVE}")(lambda s: mutations.collect_garbage(_thin(s), cut).chunk)
query("unused_containers", f"SELECT id, size FROM multichunk WHERE id NOT IN {_KEPT}")(lambda s: mutations.unused_containers(_thin(s)))
query("freed_bytes", f"SELECT count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM multichunk WHERE id NOT IN {_KEPT}")(lambda s: mutations.unused_containers(_thin(s)).agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")))
_USED = f"(SELECT h.databaseversion_id FROM filehistory h SEMI JOIN fileversion_master_last v ON v.filehistory_id = h.id AND v.databaseversion_id = h.databaseversion_id UNION SELECT databaseversion_id FROM chunk WHERE checksum IN {_LIVE} UNION SELECT databaseversion_id FROM multichunk WHERE id IN {_KEPT} UNION SELECT databaseversion_id FROM filecontent WHERE checksum IN {_CONTENTS})"
query("gc_commits", f"SELECT * FROM databaseversion WHERE id IN {_USED}")(lambda s: mutations.collect_garbage(_thin(s), cut).databaseversion)
query("gc_clocks", f"SELECT * FROM databaseversion_vectorclock WHERE databaseversion_id IN {_USED}")(lambda s: mutations.collect_garbage(_thin(s), cut).databaseversion_vectorclock)
query("settle_muddy", "SELECT * FROM multichunk_muddy WHERE id NOT IN (SELECT id FROM multichunk WHERE databaseversion_id < 40)")(lambda s: mutations.without_settled_muddy(s.with_tables(multichunk=s.multichunk.where("databaseversion_id < 40"))))
query("remove_dirty_contents", f"SELECT * REPLACE ((CASE WHEN databaseversion_id IN {_DIRTY_IDS} THEN 999 ELSE databaseversion_id END)::INT AS databaseversion_id) FROM filecontent WHERE checksum IN (SELECT filecontent_checksum FROM fileversion_master WHERE filecontent_checksum IS NOT NULL)")(
    lambda s: mutations.remove_dirty(s, 999).filecontent
)

# --- clocks and branches --------------------------------------------------

query(
    "clock_order",
    """, e AS (SELECT d.id, d.client, d.localtime::DATE AS day, v.client AS c, v.logicaltime AS t FROM databaseversion d JOIN databaseversion_vectorclock v ON v.databaseversion_id = d.id),
    p AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM e a JOIN e b ON a.day = b.day AND a.client < b.client),
    s AS (SELECT id_a, id_b, c, coalesce((SELECT t FROM e WHERE e.id = id_a AND e.c = k.c), 0) - coalesce((SELECT t FROM e WHERE e.id = id_b AND e.c = k.c), 0) AS d FROM p, (SELECT unnest(['A', 'B', 'C']) AS c) k)
    SELECT id_a, id_b, CASE WHEN max(d) > 0 AND min(d) < 0 THEN 'SIMULTANEOUS' WHEN max(d) > 0 THEN 'GREATER' WHEN min(d) < 0 THEN 'SMALLER' ELSE 'EQUAL' END AS "order" FROM s GROUP BY 1, 2""",
)(lambda s: causality.conflicting_pairs(s.databaseversion.withColumnRenamed("vectorclock_serialized", "clock")))
query("clock_round_trip", "SELECT id, vectorclock_serialized AS clock FROM databaseversion")(lambda s: s.databaseversion.select("id", clocks.vc_format(clocks.vc_parse(F.col("vectorclock_serialized"))).alias("clock")))
query("clock_increment", "SELECT d.id, v.logicaltime + 1 AS own FROM databaseversion d JOIN databaseversion_vectorclock v ON v.databaseversion_id = d.id AND v.client = d.client")(
    lambda s: s.databaseversion.select("id", clocks.vc_get(clocks.vc_increment(clocks.vc_parse(F.col("vectorclock_serialized")), F.col("client")), F.col("client")).alias("own"))
)
query("next_clock_time", "SELECT (coalesce((SELECT v.logicaltime FROM databaseversion d JOIN databaseversion_vectorclock v ON v.databaseversion_id = d.id WHERE d.status = 'DIRTY' AND v.client = 'B' ORDER BY d.id DESC LIMIT 1), 0) + 1)::BIGINT AS own")(
    lambda s: causality.next_clock(s, "B").select(clocks.vc_get(F.col("clock"), F.lit("B")).alias("own"))
)


def _branches(s: VersionStore, repo: F.Column | None = None) -> DataFrame:
    """A branch for each client: its own commits in order; of one repository, or of several."""
    return causality.branches(s).withColumn("repo", F.lit(1) if repo is None else repo).select("repo", "branch", "pos", "client", "clock", "t")


def _repos(s: VersionStore) -> DataFrame:
    """As many as the remainders of a commit's place by 4."""
    return _branches(s, (F.col("pos") % 4).cast("int"))


_B = ", b AS (SELECT c.client AS branch, c.own AS pos, c.client, d.vectorclock_serialized AS clock, epoch_us(d.localtime) // 1000 AS t, c.id FROM commits c JOIN databaseversion d USING (id))"
#: The order in which no header comes before one that its clock follows, the earliest first, and the last header taken in it.
_WON = (
    _B.replace("c.id FROM", "c.id, c.own % 4 AS repo FROM")
    + """, below AS (SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON y.repo = x.repo AND y.id <> x.id
      WHERE NOT EXISTS (SELECT 1 FROM databaseversion_vectorclock e LEFT JOIN databaseversion_vectorclock f ON f.databaseversion_id = y.id AND f.client = e.client WHERE e.databaseversion_id = x.id AND e.logicaltime > coalesce(f.logicaltime, 0))),
    after AS (SELECT h.*, coalesce((SELECT list(a) FROM below WHERE below.b = h.id), []) AS waits FROM b h),
    steps AS (
      SELECT DISTINCT repo, 0 AS n, []::INT[] AS done, -1 AS last FROM b
      UNION ALL
      SELECT repo, n + 1, list_append(done, x.id), CASE WHEN last < 0 OR list_contains(x.waits, last) THEN x.id ELSE last END
      FROM (SELECT k.repo, k.n, k.done, k.last, arg_min({'id': h.id, 'waits': h.waits}, {'t': h.t, 'client': h.client, 'clock': h.clock}) AS x
        FROM steps k JOIN after h ON h.repo = k.repo AND NOT list_contains(k.done, h.id) AND list_has_all(k.done, h.waits) GROUP BY k.repo, k.n, k.done, k.last)),
    won AS (SELECT repo, b.branch, b.client, b.clock, b.t, b.pos, b.id FROM (SELECT repo, arg_max(last, n) AS id FROM steps GROUP BY 1) JOIN b USING (repo, id)),
    winner AS (SELECT w.repo, CASE WHEN w.pos = (SELECT max(pos) FROM b WHERE b.repo = w.repo AND b.branch = w.branch) THEN w.branch END AS winner, w.client, w.clock, w.t FROM won w)
    """
)
_recursive = lambda sql: MODEL_SQL.replace("WITH", "WITH RECURSIVE", 1) + sql
query("branch_winner", _recursive(_WON + "SELECT * FROM winner"), model=False)(lambda s: causality.winners(_repos(s)))
query("branch_prune", f"{_B}, f AS (SELECT min(l.pos) AS p FROM b l JOIN b w ON w.pos = l.pos AND w.branch = 'B' WHERE l.branch = 'A' AND (l.clock, l.t) <> (w.clock, w.t)) SELECT 1 AS repo, branch, pos, client, clock, t FROM b, f WHERE branch = 'A' AND pos >= p")(
    lambda s: causality.to_prune(_branches(s).where("branch = 'A'"), _branches(s).where("branch = 'B'"))
)
# the loser has B's own commits up to its 5th, and then those of A
_LOSER = "SELECT * FROM b WHERE (branch = 'B' AND pos < 6) OR (branch = 'A' AND pos >= 6)"
query("branch_apply", f"{_B}, l AS ({_LOSER}), f AS (SELECT min(w.pos) AS p FROM b w LEFT JOIN l ON l.pos = w.pos WHERE w.branch = 'B' AND (l.pos IS NULL OR (l.client, l.clock, l.t) <> (w.client, w.clock, w.t))) SELECT 1 AS repo, branch, w.pos, client, clock, t FROM b w, f WHERE branch = 'B' AND w.pos >= p")(
    lambda s: causality.to_apply(_branches(s).where("(branch = 'B' and pos < 6) or (branch = 'A' and pos >= 6)"), _branches(s).where("branch = 'B'"))
)
query("branch_muddy", _recursive(_WON + "SELECT b.repo, b.client, b.clock, b.t FROM b JOIN winner USING (repo) WHERE branch IS DISTINCT FROM winner"), model=False)(
    lambda s: causality.muddy_headers(h := _repos(s), causality.winners(h))
)
query("muddy_containers", "SELECT m.id, c.client AS machine_name, c.own AS machine_version FROM multichunk m JOIN commits c ON c.id = m.databaseversion_id WHERE c.client <> 'C'")(lambda s: causality.muddy_containers(s, _branches(s).where("branch <> 'C'")))
query(
    "header_order",
    """, e AS (SELECT d.id, d.client, d.localtime::DATE AS day, epoch_ms(d.localtime) AS ms, v.client AS c, v.logicaltime AS t FROM databaseversion d JOIN databaseversion_vectorclock v ON v.databaseversion_id = d.id),
    p AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b, CASE WHEN (a.ms, a.client) < (b.ms, b.client) THEN -1 ELSE 1 END AS tie FROM e a JOIN e b ON a.day = b.day AND a.client <> b.client),
    s AS (SELECT id_a, id_b, tie, coalesce((SELECT t FROM e WHERE e.id = id_a AND e.c = k.c), 0) - coalesce((SELECT t FROM e WHERE e.id = id_b AND e.c = k.c), 0) AS d FROM p, (SELECT unnest(['A', 'B', 'C']) AS c) k)
    SELECT id_a, id_b, CASE WHEN max(d) > 0 AND min(d) >= 0 THEN 1 WHEN min(d) < 0 AND max(d) <= 0 THEN -1 ELSE any_value(tie) END AS "order" FROM s GROUP BY 1, 2""",
)(lambda s: _header_pairs(s))


def _header_pairs(s: VersionStore) -> DataFrame:
    h = s.databaseversion.select("id", "client", F.to_date("localtime").alias("day"), F.struct("client", F.col("vectorclock_serialized").alias("clock"), F.unix_millis(F.col("localtime").cast("timestamp")).alias("t")).alias("h"))
    a, b = (h.select(*[F.col(c).alias(f"{c}_{x}") for c in h.columns]) for x in "ab")
    pairs = a.join(b, (F.col("day_a") == F.col("day_b")) & (F.col("client_a") != F.col("client_b")))
    return pairs.select("id_a", "id_b", causality.header_order(F.col("h_a"), F.col("h_b")).alias("order"))


# --- differences ----------------------------------------------------------

query(
    "version_changes",
    """, l AS (SELECT *, status <> 'DELETED' AS ex FROM fileversion),
    p AS (SELECT a.filehistory_id, a.version, a.ex AS here, coalesce(b.ex, false) AS was, a.type AS t2, b.type AS t1, a.size <> b.size AS sz,
      NOT (a.posixperms IS NOT DISTINCT FROM b.posixperms AND a.dosattrs IS NOT DISTINCT FROM b.dosattrs) AS att, a.path <> b.path AS pa, abs(epoch_us(a.lastmodified) - epoch_us(b.lastmodified)) > 1000000 AS mt,
      a.filecontent_checksum IS DISTINCT FROM b.filecontent_checksum AS ck, b.linktarget IS NULL OR a.linktarget IS DISTINCT FROM b.linktarget AS li
      FROM l a LEFT JOIN l b ON b.filehistory_id = a.filehistory_id AND b.version = a.version - 1)
    SELECT filehistory_id, version, array_to_string(CASE WHEN NOT was AND NOT here THEN [] WHEN was AND NOT here THEN ['DELETED'] WHEN NOT was AND here THEN ['NEW'] WHEN t1 <> t2 THEN ['DELETED']
      WHEN t1 = 'FOLDER' THEN (CASE WHEN att THEN ['CHANGED_ATTRIBUTES'] ELSE [] END) WHEN t1 = 'SYMLINK' THEN (CASE WHEN li THEN ['CHANGED_LINK_TARGET'] ELSE [] END)
      ELSE list_filter([CASE WHEN pa THEN 'CHANGED_PATH' END, CASE WHEN mt THEN 'CHANGED_LAST_MOD_DATE' END, CASE WHEN sz THEN 'CHANGED_SIZE' END, CASE WHEN att THEN 'CHANGED_ATTRIBUTES' END, CASE WHEN sz OR ck THEN 'CHANGED_CHECKSUM' END], lambda x: x IS NOT NULL) END, ',') AS changes FROM p""",
)(lambda s: diff.version_changes(s.fileversion).select("filehistory_id", "version", F.array_join("changes", ",").alias("changes")))


def _disk(s: VersionStore) -> DataFrame:
    """A listing as the tree was on 2024-01-20, one entry for each path."""
    tree = history.list_files(s, as_of=F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return tree.withColumnRenamed("filecontent_checksum", "checksum")


query(
    "disk_status",
    """, was AS (SELECT * FROM (SELECT * FROM fileversion_master WHERE updated <= TIMESTAMP '2024-01-20 00:00:00' QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1) WHERE status <> 'DELETED')
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'deleted' WHEN a.path IS NULL THEN 'new' WHEN a.version = b.version THEN 'unchanged' WHEN a.type <> b.type THEN 'changed'
      WHEN a.type = 'FOLDER' THEN (CASE WHEN a.posixperms IS NOT DISTINCT FROM b.posixperms AND a.dosattrs IS NOT DISTINCT FROM b.dosattrs THEN 'unchanged' ELSE 'changed' END)
      WHEN a.type = 'SYMLINK' THEN (CASE WHEN a.linktarget = b.linktarget THEN 'unchanged' ELSE 'changed' END) ELSE 'changed' END AS status
    FROM fileversion_master_last a FULL JOIN was b ON b.path = a.path""",
)(lambda s: diff.status(s.fileversion_master_last, _disk(s)))
query("not_ignored", "SELECT path FROM fileversion_last WHERE path NOT LIKE '%.view' AND NOT regexp_matches(path, '^dir3/.*$') AND path <> 'dir7/7.click'")(lambda s: diff.not_ignored(s.fileversion_last, ["*.view", "regex:dir3/.*", "dir7/7.click"]).select("path"))
def _pairs_sql(levels: list[int | str]) -> str:
    """CTE ``moved`` (path, id) from ``fs`` (key, path) and ``hs`` (key, path, id): single ones by the longest common end, the others level by level and in order of their paths."""
    same = "coalesce(list_max(list_filter(range(1, least(length(f.path), length(h.path)) + 1), lambda k: right(f.path, k) = right(h.path, k))), 0)"
    out = f"""nf AS (SELECT key, count(*) AS n FROM fs GROUP BY 1), nh AS (SELECT key, count(*) AS n FROM hs GROUP BY 1), size_ AS (SELECT key, least(nf.n, nh.n) = 1 AS one FROM nf JOIN nh USING (key)),
    single AS (SELECT f.path, h.id FROM fs f JOIN hs h USING (key) JOIN size_ USING (key) WHERE one QUALIFY row_number() OVER (PARTITION BY key ORDER BY {same} DESC, h.id DESC, f.path) = 1),
    f0 AS (SELECT key, path, '' AS id FROM fs JOIN size_ USING (key) WHERE NOT one), h0 AS (SELECT key, path, id FROM hs JOIN size_ USING (key) WHERE NOT one)"""
    found = ["SELECT * FROM single"]
    for k, level in enumerate(levels):
        names = "length(path) - length(replace(path, '/', '')) + 1"
        end = "nullif(regexp_extract(path, '\\.[^./]*$'), '')" if level == "extension" else f"CASE WHEN {names} >= {level} THEN array_to_string(string_split(path, '/')[-{level}:], '/') END" if level else "''"
        for side in "fh":
            out += f", {side}n{k} AS (SELECT *, row_number() OVER (PARTITION BY key, e ORDER BY path, id) AS nth FROM (SELECT *, {end} AS e FROM {side}{k}) WHERE e IS NOT NULL)"
        out += f", m{k} AS (SELECT f.path, h.id FROM fn{k} f JOIN hn{k} h USING (key, e, nth)), f{k + 1} AS (SELECT * FROM f{k} WHERE path NOT IN (SELECT path FROM m{k})), h{k + 1} AS (SELECT * FROM h{k} WHERE id NOT IN (SELECT id FROM m{k}))"
        found.append(f"SELECT * FROM m{k}")
    return f"{out}, moved AS ({' UNION ALL '.join(found)})"


#: Files below another folder, those of every third history one folder deeper. Contents, sizes and times are made coarse, so that a few dozen files are alike.
_MOVED_TO = "CASE WHEN version % 3 = 0 THEN 'moved/deep/' || path ELSE 'moved/' || path END"
query(
    "guess_histories",
    f""", alike AS (SELECT substr(filecontent_checksum, 1, 2) AS key, path, version, filehistory_id AS id FROM fileversion_master_last WHERE type = 'FILE'),
    fs AS (SELECT key, {_MOVED_TO} AS path FROM alike WHERE substr(id, 40) <> '0'), hs AS (SELECT key, path, id FROM alike), {_pairs_sql([4, 3, 2, 1, "extension", 0])}
    SELECT path, moved.id AS filehistory_id FROM fs LEFT JOIN moved USING (path)""",
)(lambda s: _guessed(s))


def _guessed(s: VersionStore) -> DataFrame:
    alike = s.fileversion_master_last.where("type = 'FILE'").withColumns({"filecontent_checksum": F.substring("filecontent_checksum", 1, 2), "size": F.lit(1), "lastmodified": F.lit(_NOW).cast("timestamp_ntz")})
    new = alike.where("substring(filehistory_id, 40) <> '0'").select(F.expr(_MOVED_TO).alias("path"), F.col("filecontent_checksum").alias("checksum"), "size", "lastmodified")
    return diff.guess_histories(new, alike)


_SIDE_SQL = "{'ex': status <> 'DELETED', 'type': type, 'path': path, 'mt': lastmodified, 'size': size, 'ck': filecontent_checksum, 'li': linktarget, 'px': posixperms, 'da': dosattrs}"


def _changes_sql(e: str, a: str) -> str:
    """``diff.changes`` of two columns made by ``_SIDE_SQL``."""
    attributes = f"CASE WHEN NOT ({e}.px IS NOT DISTINCT FROM {a}.px AND {e}.da IS NOT DISTINCT FROM {a}.da) THEN 'CHANGED_ATTRIBUTES' END"
    return f"""CASE WHEN NOT coalesce({e}.ex, false) AND NOT coalesce({a}.ex, false) THEN [] WHEN NOT coalesce({a}.ex, false) THEN ['DELETED'] WHEN NOT coalesce({e}.ex, false) THEN ['NEW'] WHEN {e}.type <> {a}.type THEN ['DELETED'] ELSE list_filter(
      CASE {e}.type WHEN 'FOLDER' THEN [{attributes}] WHEN 'SYMLINK' THEN [CASE WHEN {e}.li IS NULL OR {e}.li IS DISTINCT FROM {a}.li THEN 'CHANGED_LINK_TARGET' END] ELSE [CASE WHEN {e}.path <> {a}.path THEN 'CHANGED_PATH' END,
      CASE WHEN abs(epoch_us({e}.mt) - epoch_us({a}.mt)) > 1000000 THEN 'CHANGED_LAST_MOD_DATE' END, CASE WHEN {e}.size <> {a}.size THEN 'CHANGED_SIZE' END, {attributes},
      CASE WHEN {e}.size <> {a}.size OR {e}.ck IS DISTINCT FROM {a}.ck THEN 'CHANGED_CHECKSUM' END] END, lambda x: x IS NOT NULL) END"""


_AT = "SELECT * FROM (SELECT * FROM fileversion_master WHERE updated <= TIMESTAMP '{} 00:00:00' QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1)"
_INDEX_NOW = "2024-02-01 00:00:00"
#: What ``indexing.indexed`` gives for the listing of 2024-01-20, with a quarter of the files moved.
_INDEXED = f""", disk AS (SELECT * REPLACE (CASE WHEN filehistory_id < '4' THEN 'moved/' || path ELSE path END AS path) FROM ({_AT.format("2024-01-20")}) WHERE status <> 'DELETED'),
    tree AS (SELECT * FROM fileversion_master_last),
    fs AS (SELECT {{'c': d.filecontent_checksum, 's': d.size, 'm': d.lastmodified}} AS key, d.path FROM disk d WHERE d.type = 'FILE' AND d.filecontent_checksum IS NOT NULL AND d.path NOT IN (SELECT path FROM tree)),
    hs AS (SELECT {{'c': filecontent_checksum, 's': size, 'm': lastmodified}} AS key, path, filehistory_id AS id FROM tree WHERE type = 'FILE' AND filecontent_checksum IS NOT NULL AND path NOT IN (SELECT path FROM disk)), {_pairs_sql([3, 2, 1, 'extension', 0])},
    claims AS (SELECT d.path, t.filehistory_id FROM disk d JOIN tree t ON t.path = d.path UNION ALL SELECT path, id FROM moved),
    j AS (SELECT d.* EXCLUDE (filehistory_id, version), {_SIDE_SQL.replace("status <> 'DELETED'", "true").replace(": ", ": d.").replace("d.true", "true")} AS e, t AS last, t.filehistory_id AS hid,
      CASE WHEN t.filehistory_id IS NOT NULL THEN {_SIDE_SQL.replace(": ", ": t.")} END AS a FROM disk d LEFT JOIN claims c ON c.path = d.path LEFT JOIN tree t ON t.filehistory_id = c.filehistory_id),
    k AS (SELECT *, hid IS NULL OR last.type <> type AS fresh, hid IS NOT NULL AND last.type <> type AS retyped, {_changes_sql("e", "a")} AS ch FROM j),
    added AS (SELECT CASE WHEN fresh THEN 'new' ELSE 'changed' END AS kind, CASE WHEN fresh THEN sha1('history/' || path || '/{_INDEX_NOW}') ELSE hid END AS filehistory_id, (CASE WHEN fresh THEN 1 ELSE last.version + 1 END)::INT AS version, path, type,
      CASE WHEN fresh THEN 'NEW' WHEN type = 'FILE' AND filecontent_checksum IS NOT DISTINCT FROM last.filecontent_checksum THEN 'CHANGED' WHEN path <> last.path THEN 'RENAMED' ELSE 'CHANGED' END AS status, size, lastmodified, linktarget,
      filecontent_checksum, TIMESTAMP '{_INDEX_NOW}' AS updated, posixperms, dosattrs FROM k WHERE fresh OR len(ch) > 0),
    ends AS (SELECT filehistory_id, (version + 1)::INT AS version, path, type, 'DELETED' AS status, size, lastmodified, linktarget, filecontent_checksum, TIMESTAMP '{_INDEX_NOW}' AS updated, posixperms, dosattrs FROM tree),
    every AS (SELECT * FROM added UNION ALL SELECT 'replaced', * FROM ends WHERE filehistory_id IN (SELECT hid FROM k WHERE retyped)
      UNION ALL SELECT 'deleted', * FROM ends WHERE filehistory_id NOT IN (SELECT filehistory_id FROM added WHERE kind = 'changed' UNION SELECT hid FROM k WHERE retyped) AND (path NOT IN (SELECT path FROM disk) OR path IN (SELECT path FROM added)))
    """


def _indexed(s: VersionStore) -> DataFrame:
    disk = _disk(s).withColumn("path", F.when(F.col("filehistory_id") < "4", F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")))
    disk = disk.select("path", *[c for c in diff.SIDE if c not in ("exists", "path")])
    return indexing.indexed(cut(disk, "disk"), cut(s.fileversion_master_last, "tree"), F.lit(_INDEX_NOW).cast("timestamp_ntz"))  # both are read several times


for _name, _kinds in (("new_versions", "'new', 'changed'"), ("type_changes", "'replaced'"), ("deletion_versions", "'deleted'")):
    query(_name, f"{_INDEXED} SELECT * FROM every WHERE kind IN ({_kinds})")(lambda s, k=_kinds: _indexed(s).where(f"kind in ({k})"))
query("new_contents", f"{_INDEXED} SELECT filecontent_checksum AS checksum, max(size) AS size FROM every WHERE status <> 'DELETED' AND filecontent_checksum NOT IN (SELECT checksum FROM filecontent WHERE checksum < '8') GROUP BY 1")(
    lambda s: indexing.new_contents(_indexed(s), s.filecontent.where("checksum < '8'"))
)
_HAS = "list_contains(c, '{}')"
_SAME = f"NOT {_HAS.format('CHANGED_CHECKSUM')} AND NOT {_HAS.format('CHANGED_SIZE')}"
_MOVED = f"({_HAS.format('CHANGED_LAST_MOD_DATE')} OR {_HAS.format('CHANGED_ATTRIBUTES')}"
_ACTIONS = f""", won AS (SELECT filehistory_id, path, type, status = 'DELETED' AS ends, {_SIDE_SQL} AS w FROM fileversion_last WHERE filehistory_id >= '2'),
    own AS (SELECT filehistory_id, path AS own_path, type AS own_type, {_SIDE_SQL} AS o FROM ({_AT.format("2024-01-20")})),
    disk AS (SELECT path, {_SIDE_SQL} AS d FROM ({_AT.format("2024-01-18")}) WHERE status <> 'DELETED'),
    r AS (SELECT *, coalesce(won.path, own_path) AS p, (SELECT d FROM disk WHERE disk.path = own_path) AS at_own, (SELECT d FROM disk WHERE disk.path = won.path) AS at_won FROM won FULL JOIN own USING (filehistory_id)),
    l AS (SELECT *, {_changes_sql("o", "at_own")} AS lc, {_changes_sql("w", "at_won")} AS fc, {_changes_sql("w", "o")} AS kc FROM r),
    c AS (SELECT *, CASE WHEN o IS NULL THEN fc WHEN len(lc) = 0 THEN kc ELSE lc END AS c FROM l),
    a AS (SELECT filehistory_id, p AS path, coalesce(type, own_type) AS type, CASE WHEN w IS NULL THEN 'DELETE/deleted'
      WHEN o IS NOT NULL AND len(lc) > 0 THEN CASE WHEN NOT ({_HAS.format("DELETED")} AND coalesce(ends, false)) THEN 'CHANGE/changed' END WHEN len(c) = 0 THEN NULL
      WHEN {_HAS.format("NEW")} THEN 'DELETE/deleted' WHEN {_HAS.format("DELETED")} THEN CASE WHEN o IS NULL THEN 'NEW/new' ELSE 'CHANGE/changed' END WHEN {_HAS.format("CHANGED_LINK_TARGET")} THEN 'NEW_SYMLINK/new'
      WHEN o IS NULL AND {_SAME} AND {_MOVED}) THEN 'SET_ATTRIBUTES/new' WHEN o IS NULL THEN 'NEW/new' WHEN {_SAME} AND {_MOVED} OR {_HAS.format("CHANGED_PATH")}) THEN 'RENAME/changed' ELSE 'CHANGE/changed' END AS act FROM c)
    """
_ACTED = "SELECT filehistory_id, path, type, split_part(act, '/', 1) AS action, split_part(act, '/', 2) AS bucket FROM a WHERE act IS NOT NULL"
query("file_actions", f"{_ACTIONS} {_ACTED}")(lambda s: _actions(s))


def _actions(s: VersionStore) -> DataFrame:
    return diff.reconciled(s.fileversion_last.where("filehistory_id >= '2'"), _disk_at(s, "2024-01-20", deleted=True), _disk_at(s, "2024-01-18").withColumnRenamed("filecontent_checksum", "checksum"))


#: Besides, half of the folders that go make room for a file of their path, and some of these for a renamed one as well.
query(
    "ordered_file_actions",
    f"""{_ACTIONS}, did AS ({_ACTED}), gone AS (SELECT * FROM did WHERE action = 'DELETE' AND type = 'FOLDER' AND filehistory_id >= '8'),
    every AS (SELECT filehistory_id, path, type, action FROM did UNION ALL SELECT 'n' || filehistory_id, path, 'FILE', 'NEW' FROM gone UNION ALL SELECT 'r' || filehistory_id, path, 'SYMLINK', 'RENAME' FROM gone WHERE filehistory_id >= 'c'),
    named AS (SELECT e.*, coalesce(list_position(['DELETE FILE', 'DELETE SYMLINK', 'NEW FOLDER', 'NEW FILE', 'NEW SYMLINK', 'RENAME FILE', 'RENAME SYMLINK', 'DELETE FOLDER'], action || ' ' || type), 0) - 1 AS rank FROM every e),
    sorted AS (SELECT *, row_number() OVER (ORDER BY rank, CASE WHEN action = 'DELETE' THEN path END DESC NULLS LAST, path, filehistory_id) AS first FROM named),
    -- a second pass, as one would do it by hand: each in its turn goes right behind the deletion, so the last one is nearest to it
    behind AS (SELECT s.filehistory_id, f.first AS spot FROM sorted s JOIN sorted f ON f.path = s.path AND f.action = 'DELETE' AND f.type = 'FOLDER' WHERE s.action IN ('NEW', 'RENAME') AND s.type IN ('FILE', 'SYMLINK'))
    SELECT s.filehistory_id, path, type, action, rank::INT AS rank, row_number() OVER (ORDER BY coalesce(spot, first), spot IS NOT NULL, -first) AS nth FROM sorted s LEFT JOIN behind USING (filehistory_id)""",
)(lambda s: diff.ordered_actions(_with_swaps(_actions(s).select("filehistory_id", "path", "type", "action"))))


def _with_swaps(actions: DataFrame) -> DataFrame:
    actions = cut(actions, "actions")
    gone = actions.where("action = 'DELETE' and type = 'FOLDER' and filehistory_id >= '8'")
    more = lambda rows, letter, kind, action: rows.select(F.concat(F.lit(letter), "filehistory_id").alias("filehistory_id"), "path", F.lit(kind).alias("type"), F.lit(action).alias("action"))
    return actions.union(more(gone, "n", "FILE", "NEW")).union(more(gone.where("filehistory_id >= 'c'"), "r", "SYMLINK", "RENAME"))


def _disk_at(s: VersionStore, day: str, deleted: bool = False) -> DataFrame:
    return history.list_files(s, as_of=F.lit(f"{day} 00:00:00").cast("timestamp_ntz"), deleted=deleted)


query("conflict_names", "SELECT DISTINCT path, regexp_replace(path, '\\.([a-z]+)$', ' (ann''s conflicted copy, 5 Jan 24, 3-07 PM).\\1') AS name FROM fileversion")(
    lambda s: s.fileversion.select("path").distinct().select("path", diff.conflict_name(F.col("path"), F.lit("ann"), F.lit("2024-01-05 15:07:00").cast("timestamp_ntz")).alias("name"))
)

# --- cleaning up ----------------------------------------------------------

_NAMES = "(SELECT client, count(*) AS files, max(own) AS top FROM commits GROUP BY 1)"
for _name, _last, _force, _code in (("dirty", "2024-01-01 00:00:00", False, "NOK_DIRTY_LOCAL"), ("recent", "2024-01-28 10:00:00", False, "NOK_RECENTLY_CLEANED"), ("forced", "2024-01-28 10:00:00", True, "NOK_LOCAL_CHANGES")):

    def _precondition(s: VersionStore, name: str = _name, last: str = _last, force: bool = _force) -> DataFrame:
        clean = s if name == "dirty" else s.with_tables(databaseversion=s.databaseversion.withColumn("status", F.lit("MASTER")))
        none = _remote(s).limit(0)
        return cleanup.precondition(clean, diff.status(s.fileversion_master_last, _disk(s)), none, none, F.lit(last).cast("timestamp_ntz"), _now(), force)

    _CASES = f"""SELECT CASE WHEN {_name == "dirty"} AND (SELECT count(*) FROM databaseversion WHERE status = 'DIRTY') > 0 THEN 'NOK_DIRTY_LOCAL' WHEN {not _force} AND TIMESTAMP '{_last}' + INTERVAL 3 HOUR > TIMESTAMP '{_NOW}' THEN 'NOK_RECENTLY_CLEANED'
      WHEN (SELECT count(*) FROM fileversion_master_last WHERE updated > TIMESTAMP '2024-01-20 00:00:00') > 0 THEN 'NOK_LOCAL_CHANGES' ELSE 'OK' END AS code"""
    query(f"cleanup_{_name}", _CASES)(_precondition)
for _name, _clean, _unread, _busy, _code in (("unread", True, True, True, "NOK_REMOTE_CHANGES"), ("busy", True, False, True, "NOK_OTHER_OPERATIONS"), ("ok", True, False, False, "OK")):

    def _settled(s: VersionStore, unread: bool = _unread, busy: bool = _busy) -> DataFrame:
        """Nothing is dirty, the disk is as the catalog says; files that the ledger doesn't have, and other clients' action files, if asked for."""
        clean = s.with_tables(databaseversion=s.databaseversion.withColumn("status", F.lit("MASTER")))
        same = clean.fileversion_master_last.groupBy("path").agg(F.max("filehistory_id").alias("filehistory_id")).select("path", F.lit("unchanged").alias("status"))
        remote = deltalog.unknown_databases(_remote(s), s.known_databases)
        running = deltalog.parse_names(s.databaseversion.select(F.concat(F.lit("action-up-"), "client", F.lit("-"), F.col("id").cast("string")).alias("name"))).where("kind = 'action' and client <> 'A'")
        return cleanup.precondition(clean, same, remote if unread else remote.limit(0), running if busy else running.limit(0), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), _now())

    query(
        f"cleanup_{_name}",
        f"""SELECT CASE WHEN {_unread} AND (SELECT count(*) FROM commits WHERE own % 2 = 1) > 0 THEN 'NOK_REMOTE_CHANGES' WHEN {_busy} AND (SELECT count(*) FROM databaseversion WHERE client <> 'A') > 0 THEN 'NOK_OTHER_OPERATIONS' ELSE 'OK' END AS code""",
    )(_settled)
#: Each commit's time stands for a renewal of its client's action file; two kinds of operations, seen by A some minutes after the newest of them.
_ACTIONS = "SELECT CASE WHEN id % 2 = 0 THEN 'up' ELSE 'down' END AS operation, client, date_trunc('millisecond', localtime) AS renewed FROM databaseversion"
query("running_operations", f", a AS ({_ACTIONS}) SELECT operation, client, max(renewed) AS renewed FROM a WHERE client <> 'A' GROUP BY 1, 2 HAVING max(renewed) >= (SELECT max(renewed) FROM a) - INTERVAL 7 MINUTE")(
    lambda s: cleanup.running_operations(_action_files(s), s.databaseversion.agg(F.timestamp_millis(F.max(F.unix_millis(F.col("localtime").cast("timestamp")))).cast("timestamp_ntz")).scalar(), "A")
)
query("running_up", f", a AS ({_ACTIONS}) SELECT operation, client, max(renewed) AS renewed FROM a WHERE operation = 'up' GROUP BY 1, 2 HAVING max(renewed) >= (SELECT max(renewed) FROM a) - INTERVAL 30 DAY")(
    lambda s: cleanup.running_operations(_action_files(s), s.databaseversion.agg(F.timestamp_millis(F.max(F.unix_millis(F.col("localtime").cast("timestamp")))).cast("timestamp_ntz")).scalar(), operations=["up"], seconds=30 * 86_400)
)


def _action_files(s: VersionStore) -> DataFrame:
    millis = F.unix_millis(F.col("localtime").cast("timestamp")).cast("string")
    return deltalog.parse_names(s.databaseversion.select(F.concat(F.when(F.expr("id % 2 = 0"), "action-up-").otherwise("action-down-"), "client", F.lit("-"), millis).alias("name")))


query("merge_needed", f"SELECT count(*) AS clients, sum(files)::BIGINT AS files, sum(files) > 15 * count(*) AS needed FROM {_NAMES}")(lambda s: cleanup.merge_needed(deltalog.parse_names(_remote(s))))
query("merged_files", f"SELECT client, top::BIGINT + 1 AS number, files AS replaces FROM {_NAMES}")(lambda s: cleanup.merged_files(deltalog.parse_names(_remote(s))))
query("cleanup_occurred", "SELECT max(CASE WHEN own % 5 = 0 THEN own ELSE 0 END) > 10 AS occurred FROM commits")(
    lambda s: cleanup.cleanup_occurred(
        deltalog.parse_names(s.databaseversion_vectorclock.join(s.databaseversion.select(F.col("id").alias("databaseversion_id"), "client"), ["databaseversion_id", "client"]).where("logicaltime % 5 = 0").select(F.concat(F.lit("cleanup-"), "logicaltime").alias("name"))), F.lit(10)
    )
)

# --- chunks ---------------------------------------------------------------


def _files(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def document_query(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(_files(ship(spark).read.parquet(f"{sf_dir}/documents.parquet")))
        if sql:
            SQL[name] = sql
        return f

    return add


_SLICES = """WITH h AS (SELECT doc_id AS file_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT file_id, i::INT AS num, substr(x, i * 2048 + 1, 2048) AS part FROM (SELECT *, unnest(range(0, (length(x) + 2047) // 2048)) AS i FROM h)),
k AS (SELECT file_id, num, sha1(unhex(part)) AS checksum, (length(part) // 2)::BIGINT AS size FROM c)
"""
document_query("fixed_chunks", _SLICES + "SELECT * FROM k")(lambda f: chunks.fixed_chunks(f, 1024).drop("data"))
document_query("new_chunks", _SLICES + "SELECT checksum, file_id, num, size FROM k WHERE checksum NOT IN (SELECT checksum FROM k WHERE file_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY checksum ORDER BY file_id, num) = 1")(
    lambda f: chunks.new_chunks(c := chunks.fixed_chunks(f, 1024).drop("data"), c.where("file_id % 2 = 0"))
)
#: Content-defined cuts of ``f`` (file_id, b), 1024 bytes on average, byte by byte: low and high halves of a window's sum are sum(v) and sum of v times 48, 47, ..., 1. Windows that end
#: 48 bytes or more behind the least size (464) don't depend on the chunk's start, the 48 before leave out the byte at the least size.
_CUT = """, x AS MATERIALIZED (SELECT file_id, hex(b) AS h, octet_length(b) AS n, list_transform(regexp_extract_all(hex(b), '..'), lambda c: (('0x' || c)::INT + 128) % 256 - 128) AS v FROM f WHERE octet_length(b) > 0),
p AS (SELECT file_id, generate_subscripts(v, 1) - 1 AS i, unnest(v)::BIGINT AS v FROM x),
w AS (SELECT file_id, i, sum(v) OVER s AS low, (i + 1) * sum(v) OVER s - sum(i * v) OVER s AS high FROM p WINDOW s AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) QUALIFY i >= 47),
e AS MATERIALIZED (SELECT file_id, list(i ORDER BY i) AS hits FROM w WHERE (high % 65536 + 65536) % 65536 < 32768 AND ((high % 65536 + 65536) % 65536 * 65536 + (low % 65536 + 65536) % 65536) % 545 = 544 GROUP BY 1),
r AS (SELECT file_id, -1 AS num, 0::BIGINT AS start, 0::BIGINT AS stop FROM x
  UNION ALL
  SELECT file_id, num + 1, s, least(n, s + 2825, coalesce(list_min(list_filter(list_transform(range(0, 48), lambda k: CASE WHEN s + 464 + k < n
      AND (list_sum(list_transform(list_concat(near[k + 1 : 48], near[50 : 49 + k]), lambda y, j: (49 - j) * y)) % 65536 + 65536) % 65536 < 32768
      AND ((list_sum(list_transform(list_concat(near[k + 1 : 48], near[50 : 49 + k]), lambda y, j: (49 - j) * y)) % 65536 + 65536) % 65536 * 65536 + (list_sum(list_concat(near[k + 1 : 48], near[50 : 49 + k])) % 65536 + 65536) % 65536) % 545 = 544
      THEN s + 465 + k END), lambda z: z IS NOT NULL)), far + 1, n))
  FROM (SELECT r.file_id, r.num, r.stop AS s, x.n, list_transform(x.v[r.stop + 417 : r.stop + 512], lambda y: y::BIGINT) AS near, list_filter(e.hits, lambda y: y >= r.stop + 512 AND y < r.stop + 2825)[1] AS far FROM r JOIN x USING (file_id) LEFT JOIN e USING (file_id) WHERE r.stop < x.n))
SELECT file_id, num::INT AS num, sha1(unhex(substr(h, start * 2 + 1, (stop - start) * 2))) AS checksum, stop - start AS size FROM r JOIN x USING (file_id) WHERE num >= 0"""
document_query("tttd_chunks", "WITH RECURSIVE f AS (SELECT doc_id AS file_id, encode(coalesce(text, '')) AS b FROM documents)" + _CUT)(lambda f: chunks.tttd_chunks(f, 1024).drop("data"))


@document_query("tttd_file_chunks", "WITH RECURSIVE f AS (SELECT doc_id % 8 AS file_id, encode(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, text) || chr(10)) AS b FROM documents GROUP BY 1)" + _CUT)
def _stored(f: DataFrame) -> DataFrame:
    """All texts in eight files on storage, which are cut in blocks."""
    spark = f.sparkSession
    folder = fresh_path(spark, "files")
    rows = f.select(F.expr("file_id % 8").alias("of"), "file_id", F.col("content").cast("string").alias("value"))
    rows.repartition("of").sortWithinPartitions("of", "file_id", "value").select("of", "value").write.partitionBy("of").text(folder)
    files = blocks.stored_files(spark, folder).withColumn("file_id", F.regexp_extract("path", r"of=(\d+)/", 1).cast("bigint"))
    return blocks.tttd_file_chunks(files, 1024, 64 << 10).drop("data")


_SUMS = lambda df: df.select("file_id", F.sha1("content").alias("checksum"), F.octet_length("content").cast("bigint").alias("size"))
_WHOLE = "SELECT doc_id AS file_id, sha1(coalesce(text, '')) AS checksum, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents"
document_query("assembled", _WHOLE)(lambda f: _SUMS(chunks.assemble((c := chunks.fixed_chunks(f, 4096)).drop("data"), c.dropDuplicates(["checksum"]), f.select("file_id", F.sha1("content").alias("checksum")))))


@document_query("restored", _WHOLE)
def _restored(f: DataFrame) -> DataFrame:
    """Files cut, their new chunks packed into containers by a hundred files, and everything fetched from the containers again."""
    c = chunks.fixed_chunks(f, 1024)
    first = chunks.new_chunks(c.drop("data"), c.select("checksum").limit(0)).withColumn("commit", F.expr("file_id div 100"))
    packed = chunks.container_files(first.join(c.select("file_id", "num", "data"), ["file_id", "num"]), 20_000)
    return _SUMS(chunks.assemble(c.drop("data"), chunks.stored_chunks(packed, c), f.select("file_id", F.sha1("content").alias("checksum"))))


#: File by file: a commit's bytes and files so far, and whether the file before has ended one.
_COMMITS = """WITH RECURSIVE f AS (SELECT doc_id AS file_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, doc_id % 3 AS client, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) AS nth FROM documents),
r AS (SELECT file_id, size, client, nth, size AS bytes, 1 AS files, 0::BIGINT AS commit FROM f WHERE nth = 1
  UNION ALL SELECT f.file_id, f.size, f.client, f.nth, CASE WHEN full_ THEN f.size ELSE bytes + f.size END, CASE WHEN full_ THEN 1 ELSE files + 1 END, commit + full_::INT
  FROM (SELECT *, bytes >= 40000 OR files >= 12 AS full_ FROM r) r JOIN f ON f.client = r.client AND f.nth = r.nth + 1)
SELECT file_id, size, commit FROM r"""
document_query("commit_numbers", _COMMITS)(
    lambda f: chunks.commit_numbers(f.select("file_id", F.octet_length("content").cast("bigint").alias("size"), (F.col("file_id") % 3).alias("client")), most_bytes=40_000, most_files=12).select("file_id", "size", "commit")
)
document_query(
    "packed_containers",
    _SLICES.replace("WITH", "WITH RECURSIVE", 1)
    + """, f AS (SELECT *, file_id // 100 AS commit, row_number() OVER (PARTITION BY file_id // 100 ORDER BY file_id, num, checksum) AS rn FROM k QUALIFY row_number() OVER (PARTITION BY checksum ORDER BY file_id, num) = 1),
    g AS (SELECT *, row_number() OVER (PARTITION BY commit ORDER BY file_id, num) AS nth FROM f),
    r AS (SELECT commit, nth, checksum, size AS fill, 0 AS container FROM g WHERE nth = 1
      UNION ALL SELECT g.commit, g.nth, g.checksum, CASE WHEN r.fill >= 20000 THEN g.size ELSE r.fill + g.size END, CASE WHEN r.fill >= 20000 THEN r.container + 1 ELSE r.container END FROM r JOIN g ON g.commit = r.commit AND g.nth = r.nth + 1)
    SELECT commit, checksum, container FROM r""",
)(lambda f: chunks.pack_containers(chunks.new_chunks(c := chunks.fixed_chunks(f, 1024).drop("data"), c.select("checksum").limit(0)).withColumn("commit", F.expr("file_id div 100")), 20_000))

# --- union of deltas ------------------------------------------------------

#: Commits in order of client and time; each row is said by its commit, and again, a little otherwise, by the commit five on.
_PLACES = ", places AS (SELECT *, row_number() OVER (ORDER BY client, localtime) AS place FROM databaseversion)"
_SAID = """, said AS (SELECT filehistory_id, version, path, status, filecontent_checksum, databaseversion_id AS id FROM fileversion UNION ALL SELECT filehistory_id, version, path || '~', status, filecontent_checksum, databaseversion_id + 5 FROM fileversion),
    united AS (SELECT s.*, place FROM said s JOIN places USING (id) QUALIFY row_number() OVER (PARTITION BY filehistory_id, version ORDER BY place) = 1),
    last AS (SELECT * FROM united QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1)"""


def _union(s: VersionStore) -> dict[str, DataFrame]:
    places = s.databaseversion.select(F.col("id").alias("databaseversion_id"), F.row_number().over(Window.orderBy("client", "localtime")).alias("place"))  # a row for each commit
    again = lambda df, **changed: df.unionByName(df.withColumns({"databaseversion_id": (F.col("databaseversion_id") + 5).cast("int"), **changed})).join(places, "databaseversion_id").drop("databaseversion_id")
    versions = s.fileversion.select("filehistory_id", "version", "path", "status", "filecontent_checksum", "databaseversion_id")
    return union.union_of({"chunk": again(s.chunk, size=F.col("size") + 1), "fileversion": again(versions, path=F.concat("path", F.lit("~")))})


query("union_chunks", f"{_PLACES} SELECT checksum, arg_min(size, place)::BIGINT AS size, min(place) AS place FROM (SELECT checksum, databaseversion_id AS id, size FROM chunk UNION ALL SELECT checksum, databaseversion_id + 5, size + 1 FROM chunk) JOIN places USING (id) GROUP BY 1")(lambda s: _union(s)["chunk"])
query("union_commits", f"{_PLACES} SELECT vectorclock_serialized, client, place FROM places")(
    lambda s: union.by_clock(s.databaseversion.select("vectorclock_serialized", "client", F.row_number().over(Window.orderBy("client", "localtime")).alias("place")))
)
query("union_paths", f"{_PLACES}{_SAID} SELECT path, max(filehistory_id) AS filehistory_id FROM last WHERE status <> 'DELETED' GROUP BY 1")(lambda s: union.by_path(union.last_versions(_union(s)["fileversion"])))
query("union_contents", f"{_PLACES}{_SAID} SELECT filecontent_checksum, count(*) AS n, min(filehistory_id) AS first FROM last WHERE filecontent_checksum IS NOT NULL GROUP BY 1")(lambda s: union.by_content(union.last_versions(_union(s)["fileversion"])))

# --- sources, functions, settling -----------------------------------------


def _remote(s: VersionStore) -> DataFrame:
    names = s.databaseversion_vectorclock.join(s.databaseversion.select(F.col("id").alias("databaseversion_id"), "client"), ["databaseversion_id", "client"])
    return names.select(deltalog.database_name(F.col("client"), F.col("logicaltime")).alias("name")).union(s.multichunk.select(F.concat(F.lit("multichunk-"), "id")))


def _deltas(s: VersionStore) -> dict[str, DataFrame]:
    """Written, and A's commits from its 3rd to its 20th read back."""
    path = fresh_path(s.databaseversion.sparkSession, "deltas")
    deltalog.write_deltas(s, path)
    return deltalog.read_deltas(s.databaseversion.sparkSession, path, "A", 3, 20)


_DELTA = ", c AS (SELECT id AS databaseversion_id, client, d.vectorclock_serialized FROM commits JOIN (SELECT id, vectorclock_serialized FROM databaseversion) d USING (id) WHERE client = 'A' AND own BETWEEN 3 AND 20)"
query("delta_round_trip", f"{_DELTA} SELECT c.client, c.vectorclock_serialized, f.* EXCLUDE (databaseversion_id) REPLACE (date_trunc('millisecond', f.lastmodified) AS lastmodified, date_trunc('millisecond', f.updated) AS updated) FROM fileversion f JOIN c USING (databaseversion_id)")(
    lambda s: _deltas(s)["fileversion"]
)
query("delta_contents", f"{_DELTA} SELECT filecontent_checksum, chunk_checksum, num FROM filecontent_chunk WHERE filecontent_checksum IN (SELECT checksum FROM filecontent JOIN c USING (databaseversion_id))")(lambda s: _deltas(s)["filecontent_chunk"])
query("delta_containers", f"{_DELTA} SELECT multichunk_id, chunk_checksum FROM multichunk_chunk WHERE multichunk_id IN (SELECT id FROM multichunk JOIN c USING (databaseversion_id))")(lambda s: _deltas(s)["multichunk_chunk"])
query("delta_chunks", f"{_DELTA} SELECT c.client, c.vectorclock_serialized, checksum, size FROM chunk JOIN c USING (databaseversion_id)")(lambda s: _deltas(s)["chunk"])
#: Commit by commit, ten of a client's a file: the histories of the batch so far, and whether the file before has filled it.
_BATCHES = """, h AS (SELECT databaseversion_id AS id, list(id) AS hs FROM filehistory GROUP BY 1),
    u AS (SELECT d.id, d.client, d.vectorclock_serialized, d.localtime, coalesce(h.hs, []) AS hs, d.client || ((c.own - 1) // 10) AS file, row_number() OVER (ORDER BY d.localtime, d.client, d.vectorclock_serialized) AS nth FROM databaseversion d JOIN commits c ON c.id = d.id LEFT JOIN h ON h.id = d.id),
    r AS (SELECT nth, file, hs, 0 AS batch FROM u WHERE nth = 1
      UNION ALL SELECT u.nth, u.file, CASE WHEN len(r.hs) >= 100 AND u.file <> r.file THEN u.hs ELSE list_distinct(list_concat(r.hs, u.hs)) END, (r.batch + (len(r.hs) >= 100 AND u.file <> r.file)::INT)::INT FROM r JOIN u ON u.nth = r.nth + 1)
    SELECT client, vectorclock_serialized, localtime, len(u.hs)::BIGINT AS n, batch FROM r JOIN u USING (nth)"""
query("read_batches", MODEL_SQL.replace("WITH", "WITH RECURSIVE", 1) + _BATCHES, model=False)(
    lambda s: deltalog.read_batches(_in_files(s), s.filehistory_full.select("client", "vectorclock_serialized", "id"), 100, "file")
)


def _in_files(s: VersionStore) -> DataFrame:
    """Commits and the file that each lies in: ten of a client's own."""
    own = s.databaseversion_vectorclock.select(F.col("databaseversion_id").alias("id"), "client", "logicaltime")
    file = F.concat("client", F.expr("(logicaltime - 1) div 10").cast("string"))
    return s.databaseversion.join(own, ["id", "client"]).select("client", "vectorclock_serialized", "localtime", file.alias("file"))


#: Every commit a file of its own, then one file a client; read back by file.
@query(
    "compacted_deltas",
    """, c AS (SELECT client, max(own) + 1 AS number, count(*) AS commits FROM commits GROUP BY 1), v AS (SELECT client, count(*) AS versions FROM fileversion f JOIN commits c ON c.id = f.databaseversion_id GROUP BY 1)
    SELECT 'database-' || client || '-' || lpad(number::VARCHAR, 10, '0') AS name, client, number::INT AS filenumber, commits, versions FROM c JOIN v USING (client)""",
)
def _compacted(s: VersionStore) -> DataFrame:
    spark = s.databaseversion.sparkSession
    folder = fresh_path(spark, "repository")
    repository.write_delta_files(cut(deltalog.commits(s), "commits"), folder)
    ledger = repository.compact(spark, folder)
    left = deltalog.parse_names(repository.listing(spark, folder)).join(ledger, "client")
    rows = deltalog.read_rows(spark, folder, deltalog.BODY_SCHEMA).groupBy(F.col("_client").alias("client"), repository.file_name(F.input_file_name()).alias("name"))
    rows = rows.agg(F.count("*").alias("commits"), F.sum(F.aggregate(F.coalesce("fileHistories.fileHistory", F.array()), F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["fileVersions"]["fileVersion"]))).alias("versions"))
    return left.join(rows, ["client", "name"], "left").select("name", "client", F.col("number").cast("int").alias("filenumber"), "commits", "versions")


#: Two clients' files by name, and what lies in them.
_IN_FILES = ", v AS (SELECT databaseversion_id, count(*) AS versions FROM fileversion GROUP BY 1) SELECT client, own::BIGINT AS number, 'database-' || client || '-' || lpad(own::VARCHAR, 10, '0') AS name, d.vectorclock_serialized AS clock, coalesce(versions, 0)::BIGINT AS versions FROM commits c JOIN (SELECT id, vectorclock_serialized FROM databaseversion) d USING (id) LEFT JOIN v ON v.databaseversion_id = c.id"


def _repository(s: VersionStore) -> str:
    folder = fresh_path(s.databaseversion.sparkSession, "repository")
    repository.write_delta_files(cut(deltalog.commits(s), "commits"), folder)
    return folder


def _in_names(rows: DataFrame) -> DataFrame:
    versions = F.aggregate(F.coalesce("fileHistories.fileHistory", F.array()), F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["fileVersions"]["fileVersion"]))
    return rows.select("client", "number", "name", F.col("_clock").alias("clock"), versions.alias("versions"))


@query("delta_files_of", f"{_IN_FILES} WHERE client IN ('A', 'B') AND own BETWEEN 3 AND 20")
def _files_of(s: VersionStore) -> DataFrame:
    rows = repository.read_delta_files(s.databaseversion.sparkSession, _repository(s))
    return _in_names(rows.where(F.col("client").isin("A", "B") & F.col("number").between(3, 20)))


@query("followed_deltas", f"{_IN_FILES} WHERE own > 5")
def _followed(s: VersionStore) -> DataFrame:
    """A stream that begins behind a ledger with five files of each client, and stores what it reads."""
    spark = s.databaseversion.sparkSession
    known = s.databaseversion.select("client").distinct().withColumn("filenumber", F.lit(5))
    into = fresh_path(spark, "followed")
    keep = lambda df, n: _in_names(df).write.mode("overwrite").parquet(f"{into}/batch={n}")
    sync.follow(spark, _repository(s), fresh_path(spark, "ledger"), keep, known, once=True).awaitTermination()
    return spark.read.schema("client string, number bigint, name string, clock string, versions bigint").parquet(into).drop("batch")


query("remote_names", "SELECT 'database-' || client || '-' || lpad(own::VARCHAR, 10, '0') AS name, 'database' AS kind, client, own::BIGINT AS number FROM commits UNION ALL SELECT 'multichunk-' || id, 'multichunk', NULL, NULL FROM multichunk")(lambda s: deltalog.parse_names(_remote(s)))
query("unknown_databases", "SELECT 'database-' || client || '-' || lpad(own::VARCHAR, 10, '0') AS name, client, own AS filenumber FROM commits WHERE own % 2 = 1")(lambda s: deltalog.unknown_databases(_remote(s), s.known_databases))
query("cache_within_budget", "SELECT path, size FROM (SELECT *, sum(size) OVER (PARTITION BY type ORDER BY lastmodified DESC, path ROWS UNBOUNDED PRECEDING) AS s FROM fileversion_last) WHERE s <= 200000")(
    lambda s: chunks.within_budget(s.fileversion_last.withColumn("cache", F.col("type")), 200_000).select("path", "size")
)
query("path_functions", "SELECT DISTINCT path, length(path) - length(replace(path, '/', '')) AS depth, regexp_extract(path, '[^/]*$') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_extract(path, '[^.]*$') AS extension, regexp_replace(path, '\\.([a-z]+)$', ' (x).\\1') AS suffixed FROM fileversion")(
    lambda s: s.fileversion.select("path").distinct().select("path", text.depth(F.col("path")).alias("depth"), text.file_name(F.col("path")).alias("name"), text.parent_path(F.col("path")).alias("parent"), text.extension(F.col("path")).alias("extension"), text.with_suffix(F.col("path"), F.lit("x")).alias("suffixed"))
)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.settled_bursts(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts"), 3600)


QUERIES["settled_bursts"] = _events
SQL["settled_bursts"] = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS fire, count(*) AS n FROM g GROUP BY user_id, g"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file tree as it was at a time."""
    return QUERIES["ls_as_of"](spark, sf_dir)
