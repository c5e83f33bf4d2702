"""Toxicity, quality rules, near-duplicates and packing over ``documents``, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog import ship
from stratalog.llm.catalog import TOKENIZERS
from stratalog.llm.common import saved
from stratalog.llm.near_dedup import drop_near_duplicates
from stratalog.llm.packing import pack_pieces
from stratalog.llm.quality_rules import keep_by_rules
from stratalog.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores 0.7 or higher go.

    A null text scores as an empty one; repeated rows score alike; without labels the score is the same for all. An empty table stays empty.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit(docs.select("doc_id", "text"), labels))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are too short (a null or empty text is) or repeat themselves go, row by row. An empty table stays empty."""
    ship(spark)
    return keep_by_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its shingles or more stays, the one with the smallest doc_id.

    Rows that repeat an id with another text are documents of their own; of rows that repeat both, one stays. A row without an id gives way to
    one with an id. Texts without a word are linked with nothing and stay. An empty table stays empty.
    """
    ship(spark)
    return drop_near_duplicates(docs, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens that hold every remaining document; a null text is one token, repeated rows are packed each."""
    ship(spark)
    return pack_pieces(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("packing", packing)]
#: SQL can't express a fitted classifier or a tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again, so no later stage or lost executor repeats an earlier one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
