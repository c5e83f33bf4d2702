"""The twelve tables of versioned metadata: their schemas, and a derivation from the star-schema test tables.

``derive`` builds the tables with DataFrame operations; ``MODEL_SQL`` says the same in DuckDB SQL, so
that every query on them can be checked there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The tables' columns.
SCHEMAS = {
    "databaseversion": "id int, status string, localtime timestamp_ntz, client string, vectorclock_serialized string",
    "databaseversion_vectorclock": "databaseversion_id int, client string, logicaltime int",
    "chunk": "checksum string, databaseversion_id int, size bigint",
    "filecontent": "checksum string, databaseversion_id int, size bigint",
    "filecontent_chunk": "filecontent_checksum string, chunk_checksum string, num int",
    "filehistory": "id string, databaseversion_id int",
    "fileversion": (
        "filehistory_id string, version int, databaseversion_id int, path string, type string, status string, size bigint, lastmodified timestamp_ntz, "
        "linktarget string, filecontent_checksum string, updated timestamp_ntz, posixperms string, dosattrs string"
    ),
    "multichunk": "id string, databaseversion_id int, size bigint",
    "multichunk_chunk": "multichunk_id string, chunk_checksum string",
    "multichunk_muddy": "id string, machine_name string, machine_version int",
    "known_databases": "id int, client string, filenumber int",
    "general_settings": "key string, value string",
}

SLICE, CONTAINER = 512, 65536


def derive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every table, lazily: events become file versions, days of a client commits, documents contents.

    Only the few commits meet in windows over all rows; the others run by history, commit or text.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    client = F.substring(F.lit("ABC"), (F.col("user_id") % 3 + 1).cast("int"), 1)
    events = events.withColumn("client", client).withColumn("day", F.to_date("ts"))
    content = docs.select(F.col("doc_id").alias("doc"), F.unhex(F.sha1("text")).alias("content"))

    days = events.groupBy("client", "day").agg(F.max("ts").alias("localtime"))
    commits = days.withColumn("id", F.dense_rank().over(Window.orderBy("day", "client")).cast("int"))
    commits = commits.withColumn("own", F.row_number().over(Window.partitionBy("client").orderBy("day")).cast("int"))
    status = F.when(F.col("id") % 7 == 3, "DIRTY").otherwise("MASTER")
    a, b = commits.alias("a"), commits.alias("b")
    others = a.join(b, (F.col("b.client") != F.col("a.client")) & (F.col("b.day") < F.col("a.day")))
    others = others.groupBy(F.col("a.id").alias("databaseversion_id"), F.col("b.client").alias("client")).agg(F.count("*").cast("int").alias("logicaltime"))
    clock = others.unionByName(commits.select(F.col("id").alias("databaseversion_id"), "client", F.col("own").alias("logicaltime")))
    text = clock.groupBy(F.col("databaseversion_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("client", "logicaltime"))).alias("e"))
    text = text.select("id", F.concat(F.lit("("), F.array_join(F.transform("e", lambda x: F.concat(x["client"], x["logicaltime"].cast("string"))), ","), F.lit(")")).alias("vectorclock_serialized"))
    databaseversion = commits.join(text, "id").select("id", status.alias("status"), "localtime", "client", "vectorclock_serialized")

    n_docs = docs.agg(F.count("*")).scalar()
    user = F.col("user_id").cast("string")
    of_user = F.sha1(F.concat(F.lit("u"), user).cast("binary"))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    path = F.concat(F.lit("dir"), (F.col("user_id") % 10).cast("string"), F.lit("/"), user, F.lit("."), F.col("event_type"))
    kind = F.when(F.col("event_id") % 10 == 8, "FOLDER").when(F.col("event_id") % 10 == 9, "SYMLINK").otherwise("FILE")
    head = F.broadcast(commits.select("client", "day", F.col("id").alias("databaseversion_id")))  # a row for each day of a client
    # events move by history as they are, once for whatever follows; what is made of them comes after
    v = events.select("event_id", "ts", "user_id", "event_type", "value").repartition("user_id")
    v = v.withColumn("version", F.row_number().over(by)).withColumn("before_type", F.lag("event_type").over(by))
    v = v.withColumns({"client": client, "day": F.to_date("ts")}).join(head, ["client", "day"]).drop("client", "day")
    v = v.withColumn("doc", F.col("event_id") % n_docs).join(content, "doc", "left").withColumns({"path": path, "type": kind})
    change = F.when(F.col("version") == 1, "NEW").when(F.col("event_type") == "error", "DELETED").when(F.col("event_type") != F.col("before_type"), "RENAMED").otherwise("CHANGED")
    fileversion = v.select(
        of_user.alias("filehistory_id"),
        F.col("version").cast("int").alias("version"),
        "databaseversion_id",
        "path",
        "type",
        change.alias("status"),
        F.round(F.col("value") * 100).cast("bigint").alias("size"),
        F.col("ts").alias("lastmodified"),
        F.when(F.col("type") == "SYMLINK", F.concat(F.lit("target/"), user)).alias("linktarget"),
        F.when(F.col("type") == "FILE", F.lower(F.hex("content"))).alias("filecontent_checksum"),
        F.col("ts").alias("updated"),
        F.when(F.col("event_id") % 3 == 0, "rwxr--r--").alias("posixperms"),
        F.when(F.col("event_id") % 4 == 0, "--a-").alias("dosattrs"),
    )
    filehistory = events.select("user_id", "client", "day").distinct().join(head, ["client", "day"]).select(of_user.alias("id"), "databaseversion_id").distinct()

    n_commits = commits.agg(F.count("*")).scalar()
    # a text's slices are named where it lies: their digests and sizes move, texts don't
    part = lambda i: F.substring(F.col("text"), i * SLICE + 1, F.lit(SLICE))
    numbers = F.sequence(F.lit(0), F.expr(f"(length(text) - 1) div {SLICE}"))
    parts = F.when(F.length("text") > 0, F.transform(numbers, lambda i: F.struct(F.unhex(F.sha1(part(i))).alias("sum"), F.octet_length(part(i)).cast("bigint").alias("size"))))
    named = docs.select("doc_id", F.sha1("text").alias("checksum"), F.octet_length("text").cast("bigint").alias("size"), parts.alias("parts"))
    contents = named.groupBy("checksum").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("parts").alias("parts"))
    contents = contents.withColumn("databaseversion_id", (F.col("doc_id") % n_commits + 1).cast("int"))
    filecontent = contents.select("checksum", "databaseversion_id", "size")
    slices = contents.select("checksum", "databaseversion_id", "doc_id", F.posexplode("parts").alias("num", "part"))
    slices = slices.select("checksum", "databaseversion_id", "doc_id", "num", F.lower(F.hex("part.sum")).alias("chunk_checksum"), F.col("part.size").alias("size"))
    filecontent_chunk = slices.select(F.col("checksum").alias("filecontent_checksum"), "chunk_checksum", "num")
    first = slices.groupBy("chunk_checksum").agg(F.min(F.struct("doc_id", "num", "databaseversion_id", "size")).alias("f")).select(F.col("chunk_checksum").alias("checksum"), "f.*")
    chunk = first.select("checksum", "databaseversion_id", "size")
    before = Window.partitionBy("databaseversion_id").orderBy("doc_id", "num").rowsBetween(Window.unboundedPreceding, -1)
    packed = first.withColumn("bin", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / CONTAINER))
    packed = packed.withColumn("multichunk_id", F.sha1(F.concat(F.lit("m"), F.col("databaseversion_id").cast("string"), F.lit("/"), F.col("bin").cast("string")).cast("binary")))
    multichunk = packed.groupBy(F.col("multichunk_id").alias("id"), "databaseversion_id").agg(F.sum("size").alias("size"))
    own = clock.join(commits.select(F.col("id").alias("databaseversion_id"), "client"), ["databaseversion_id", "client"])
    dirty = own.where("databaseversion_id % 7 = 3")
    muddy = multichunk.join(dirty, "databaseversion_id").select("id", F.col("client").alias("machine_name"), F.col("logicaltime").alias("machine_version"))
    known = commits.where("own % 2 = 0").select(F.row_number().over(Window.orderBy("client", "own")).cast("int").alias("id"), "client", F.col("own").alias("filenumber"))
    settings = events.groupBy(F.col("event_type").alias("key")).agg(F.max("event_id").cast("string").alias("value"))
    return {
        "databaseversion": databaseversion,
        "databaseversion_vectorclock": clock,
        "chunk": chunk,
        "filecontent": filecontent,
        "filecontent_chunk": filecontent_chunk,
        "filehistory": filehistory,
        "fileversion": fileversion,
        "multichunk": multichunk,
        "multichunk_chunk": packed.select("multichunk_id", F.col("checksum").alias("chunk_checksum")),
        "multichunk_muddy": muddy,
        "known_databases": known,
        "general_settings": settings,
    }


#: The same tables, and the views of the store, for DuckDB; goes before a SELECT.
MODEL_SQL = f"""
WITH ev AS (SELECT event_id, ts, user_id, event_type, value, substr('ABC', (user_id % 3 + 1)::INT, 1) AS client, ts::DATE AS day FROM events),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
commits AS (SELECT *, dense_rank() OVER (ORDER BY day, client)::INT AS id, row_number() OVER (PARTITION BY client ORDER BY day)::INT AS own
  FROM (SELECT client, day, max(ts) AS localtime FROM ev GROUP BY 1, 2)),
databaseversion_vectorclock AS (
  SELECT a.id AS databaseversion_id, b.client, count(*)::INT AS logicaltime FROM commits a JOIN commits b ON b.client <> a.client AND b.day < a.day GROUP BY 1, 2
  UNION ALL SELECT id, client, own FROM commits),
databaseversion AS (
  SELECT id, CASE WHEN id % 7 = 3 THEN 'DIRTY' ELSE 'MASTER' END AS status, localtime, client,
    (SELECT '(' || string_agg(v.client || v.logicaltime, ',' ORDER BY v.client) || ')' FROM databaseversion_vectorclock v WHERE v.databaseversion_id = c.id) AS vectorclock_serialized
  FROM commits c),
fv0 AS (
  SELECT *, 'dir' || (user_id % 10) || '/' || user_id || '.' || event_type AS path,
    CASE event_id % 10 WHEN 8 THEN 'FOLDER' WHEN 9 THEN 'SYMLINK' ELSE 'FILE' END AS type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS version
  FROM ev),
fv1 AS (SELECT *, lag(path) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM fv0),
fileversion AS (
  SELECT sha1('u' || user_id) AS filehistory_id, version, c.id AS databaseversion_id, path, type,
    CASE WHEN version = 1 THEN 'NEW' WHEN event_type = 'error' THEN 'DELETED' WHEN path <> before THEN 'RENAMED' ELSE 'CHANGED' END AS status,
    round(value * 100)::BIGINT AS size, ts AS lastmodified, CASE WHEN type = 'SYMLINK' THEN 'target/' || user_id END AS linktarget,
    CASE WHEN type = 'FILE' THEN sha1(d.text) END AS filecontent_checksum, ts AS updated,
    CASE WHEN event_id % 3 = 0 THEN 'rwxr--r--' END AS posixperms, CASE WHEN event_id % 4 = 0 THEN '--a-' END AS dosattrs
  FROM fv1 JOIN commits c ON c.client = fv1.client AND c.day = fv1.day LEFT JOIN docs d ON d.doc_id = event_id % (SELECT count(*) FROM docs)),
filehistory AS (SELECT DISTINCT filehistory_id AS id, databaseversion_id FROM fileversion),
contents AS (
  SELECT sha1(text) AS checksum, min(doc_id) AS doc_id, any_value(text) AS text, (min(doc_id) % (SELECT count(*) FROM commits) + 1)::INT AS databaseversion_id FROM docs GROUP BY 1),
filecontent AS (SELECT checksum, databaseversion_id, strlen(text)::BIGINT AS size FROM contents),
slices AS (
  SELECT checksum, databaseversion_id, doc_id, num::INT AS num, substr(text, num::INT * {SLICE} + 1, {SLICE}) AS part
  FROM (SELECT *, unnest(range(0, (length(text) + {SLICE - 1}) // {SLICE})) AS num FROM contents)),
filecontent_chunk AS (SELECT checksum AS filecontent_checksum, sha1(part) AS chunk_checksum, num FROM slices),
first_chunk AS (
  SELECT sha1(part) AS checksum, doc_id, num, databaseversion_id, strlen(part)::BIGINT AS size FROM slices
  QUALIFY row_number() OVER (PARTITION BY sha1(part) ORDER BY doc_id, num) = 1),
chunk AS (SELECT checksum, databaseversion_id, size FROM first_chunk),
packed AS (
  SELECT *, sha1('m' || databaseversion_id || '/' || (coalesce(sum(size) OVER (PARTITION BY databaseversion_id ORDER BY doc_id, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {CONTAINER})::BIGINT) AS multichunk_id
  FROM first_chunk),
multichunk AS (SELECT multichunk_id AS id, databaseversion_id, sum(size)::BIGINT AS size FROM packed GROUP BY 1, 2),
multichunk_chunk AS (SELECT multichunk_id, checksum AS chunk_checksum FROM packed),
multichunk_muddy AS (SELECT m.id, c.client AS machine_name, c.own AS machine_version FROM multichunk m JOIN commits c ON c.id = m.databaseversion_id WHERE c.id % 7 = 3),
known_databases AS (SELECT row_number() OVER (ORDER BY client, own)::INT AS id, client, own AS filenumber FROM commits WHERE own % 2 = 0),
general_settings AS (SELECT event_type AS key, max(event_id)::VARCHAR AS value FROM events GROUP BY 1),
master AS (SELECT * FROM databaseversion WHERE status = 'MASTER'),
databaseversion_master AS (SELECT d.*, v.logicaltime AS client_version FROM master d JOIN databaseversion_vectorclock v ON v.databaseversion_id = d.id AND v.client = d.client),
fileversion_master AS (SELECT f.* FROM fileversion f WHERE databaseversion_id IN (SELECT id FROM master)),
fileversion_last AS (SELECT * FROM fileversion_master QUALIFY row_number() OVER (PARTITION BY filehistory_id ORDER BY version DESC) = 1),
fileversion_master_last AS (SELECT * FROM fileversion_last WHERE status <> 'DELETED'),
filehistory_full AS (SELECT h.*, d.status, d.localtime, d.client, d.vectorclock_serialized FROM filehistory h JOIN databaseversion d ON d.id = h.databaseversion_id),
fileversion_full AS (SELECT f.*, d.status AS commit_status, d.localtime, d.client, d.vectorclock_serialized FROM fileversion f JOIN databaseversion d ON d.id = f.databaseversion_id)
"""
