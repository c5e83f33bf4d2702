"""Makes this package importable on executors that don't share the driver's folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once per application; returns ``spark``."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        fd, path = tempfile.mkstemp(prefix="stratalog-", suffix=".zip")
        with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one in the working folder on a local master; elsewhere that is an error,
    since executors and driver need not share any folder but the one the cluster names.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = os.path.abspath(f"spark-shared/{uuid.uuid4().hex}")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    _at_exit(spark, sc.getCheckpointDir())  # the application's own part of the folder
    return named


def _at_exit(spark: SparkSession, path: str) -> None:
    """Has the file system remove ``path`` when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/stratalog-{name}-{uuid.uuid4().hex}"
    _at_exit(spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the shared folder and read back, so that what uses it several times computes it once and after a lost executor doesn't again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
