"""The union of delta commits: what several commits say of one thing counts as the first of them says it.

Rows carry ``place``, where their commit stands in the winning branch. Taking the smallest place of each key doesn't depend on the order in which
files are read, nor on how often a row is merged, so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..plans.store import greatest_per
from ..session import cut

#: What a row of each table is about.
KEYS = {"chunk": ["checksum"], "multichunk": ["id"], "filecontent": ["checksum"], "fileversion": ["filehistory_id", "version"]}
BUCKETS = 64


def first_written(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key with the smallest ``place``, of several in one commit the smallest; partial sums before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "place")]
    return rows.groupBy(*keys).agg(F.min(F.struct("place", *rest)).alias("_first")).select(*keys, "_first.*").select(*rows.columns)


def placed_tables(deltas: dict[str, DataFrame], places: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``KEYS`` out of ``deltas`` (as ``deltalog.read_deltas`` gives them) with ``place``; ``places``: client, vectorclock_serialized, place. What lies in no listed commit is left out."""
    by = ["client", "vectorclock_serialized"]
    return {t: deltas[t].join(places, by).drop(*by) for t in KEYS if t in deltas}


def union_of(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {t: first_written(df, KEYS[t]) for t, df in tables.items()}


def last_versions(versions: DataFrame) -> DataFrame:
    """The last version of each history, deletions too."""
    return greatest_per(versions, "filehistory_id", "version")


def by_clock(commits: DataFrame) -> DataFrame:
    """The commit of each clock; of several with one clock the last."""
    return greatest_per(commits, "vectorclock_serialized", "place")


def by_path(last: DataFrame) -> DataFrame:
    """path, filehistory_id of what isn't deleted; of several histories with one path the largest id."""
    return last.where("status <> 'DELETED'").groupBy("path").agg(F.max("filehistory_id").alias("filehistory_id"))


def by_content(last: DataFrame) -> DataFrame:
    """filecontent_checksum, n, first of the histories that end in each content, deleted ones too."""
    rows = last.where("filecontent_checksum is not null")
    return rows.groupBy("filecontent_checksum").agg(F.count("*").alias("n"), F.min("filehistory_id").alias("first"))


def _stored(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _fold(path: str, rows: DataFrame, key: str, merge, buckets: int) -> None:
    """Merges ``rows`` into the table at ``path``; only the buckets (by hash of ``key``) that rows fall into are read and written."""
    rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
    old = _stored(rows.sparkSession, path)
    if old is not None:
        rows = rows.unionByName(old.where(F.col("bucket").isin(touched)).select(*rows.columns))
    merged = cut(merge(rows), "merged")  # a table can't be read and replaced at once
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def fold(folder: str, tables: dict[str, DataFrame], buckets: int = BUCKETS) -> None:
    """Merges placed tables into those under ``folder``, and keeps ``last`` (the last version of each history) beside them: for ``foreachBatch``.

    Batches may come in any order and more than once, with the same result. An index by path or content is a view of ``last``.
    """
    for t, df in tables.items():
        _fold(f"{folder}/{t}", df, KEYS[t][0], lambda rows, t=t: first_written(rows, [*KEYS[t], "bucket"]), buckets)
    if "fileversion" in tables:
        touched = tables["fileversion"].select("filehistory_id").distinct()
        versions = _stored(touched.sparkSession, f"{folder}/fileversion").drop("bucket")
        last = last_versions(versions.join(touched, "filehistory_id", "left_semi"))
        _fold(f"{folder}/last", last, "filehistory_id", lambda rows: _latest(rows), buckets)


def _latest(rows: DataFrame) -> DataFrame:
    """Of a history's rows the one with the greatest version; of two with that the one from the earlier commit."""
    rest = [c for c in rows.columns if c not in ("filehistory_id", "bucket", "version", "place")]
    best = F.max_by(F.struct("version", "place", *rest), F.struct("version", -F.col("place")))
    return rows.groupBy("filehistory_id", "bucket").agg(best.alias("_row")).select("filehistory_id", "bucket", "_row.*").select(*rows.columns)
