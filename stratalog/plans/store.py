"""``VersionStore``: the tables, and the views that queries read."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.model import SCHEMAS, derive

HEADER = ("status", "localtime", "client", "vectorclock_serialized")


def greatest_per(df: DataFrame, by: str | list[str], order: Column | str) -> DataFrame:
    """The row of each group that is last by ``order``, in one aggregation (no sort, partial sums before the shuffle)."""
    by = [by] if isinstance(by, str) else by
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*by, "_row.*").select(*df.columns)


@dataclass
class VersionStore:
    """Tables by name; every view is a lazy DataFrame."""

    tables: dict[str, DataFrame]
    _views: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def derived(cls, spark: SparkSession, sf_dir: str) -> VersionStore:
        return cls(derive(spark, sf_dir))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VersionStore:
        """Tables as Parquet folders under ``path``."""
        return cls({name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in SCHEMAS.items()})

    @classmethod
    def empty(cls, spark: SparkSession) -> VersionStore:
        return cls({name: spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items()})

    def write(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    def with_tables(self, **changed: DataFrame) -> VersionStore:
        return VersionStore(self.tables | changed)

    def register(self) -> None:
        """Temporary views for SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        for name in ("databaseversion_master", "fileversion_master", "fileversion_master_last", "filehistory_full", "fileversion_full"):
            getattr(self, name).createOrReplaceTempView(name)

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    @property
    def master_commits(self) -> DataFrame:
        return self.databaseversion.where("status = 'MASTER'")

    @property
    def dirty_commits(self) -> DataFrame:
        return self.databaseversion.where("status = 'DIRTY'")

    @property
    def databaseversion_master(self) -> DataFrame:
        """Commits that count, with the time of their own client as client_version."""
        own = self.databaseversion_vectorclock.select(F.col("databaseversion_id").alias("id"), "client", F.col("logicaltime").alias("client_version"))
        return self.master_commits.join(own, ["id", "client"]).select("id", *HEADER, "client_version")

    @property
    def fileversion_master(self) -> DataFrame:
        ids = self.master_commits.select(F.col("id").alias("databaseversion_id"))
        return self.fileversion.join(ids, "databaseversion_id", "left_semi").select(*self.fileversion.columns)

    @property
    def fileversion_last(self) -> DataFrame:
        """Latest version of each history, deleted ones included."""
        return greatest_per(self.fileversion_master, "filehistory_id", "version")

    @property
    def fileversion_master_last(self) -> DataFrame:
        """Latest version of each history unless it is a deletion: a deleted file doesn't show its predecessor."""
        return self.fileversion_last.where("status <> 'DELETED'")

    @property
    def filehistory_full(self) -> DataFrame:
        head = self.databaseversion.select(F.col("id").alias("databaseversion_id"), *HEADER)
        return self.filehistory.join(head, "databaseversion_id").select("id", "databaseversion_id", *HEADER)

    @property
    def fileversion_full(self) -> DataFrame:
        head = self.databaseversion.select(F.col("id").alias("databaseversion_id"), F.col("status").alias("commit_status"), "localtime", "client", "vectorclock_serialized")
        return self.fileversion.join(head, "databaseversion_id").select(*self.fileversion.columns, "commit_status", "localtime", "client", "vectorclock_serialized")

    def commit_ids(self, clock: str) -> DataFrame:
        """databaseversion_id of the commit with this clock text; no row if none has it."""
        return self.databaseversion.where(F.col("vectorclock_serialized") == clock).select(F.col("id").alias("databaseversion_id"))
