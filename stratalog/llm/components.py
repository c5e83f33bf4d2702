"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _through(df: DataFrame, col: str, up: DataFrame) -> DataFrame:
    """``col`` replaced by what ``up`` (node, up) says of it, where it says something."""
    up = up.select(F.col("node").alias(col), F.col("up").alias("_up"))
    return df.join(up.hint("merge"), col, "left").withColumn(col, F.coalesce("_up", col)).drop("_up")


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of ``edges`` (columns ``a``, ``b``).

    A round hooks every node to its smallest smaller neighbour, follows that to the fourth place in two joins, and
    contracts the edges by it; where the fourth place isn't the end, an edge leads on from there. So the edges shrink
    from round to round, and only "is anything left" reaches the driver. The labels are one chain of joins, a join
    for each round, at the end. Self-loops, repeated edges and an empty table are fine; null ends are ignored.
    """
    edges = checkpointed(_ordered(edges.where("a is not null and b is not null")))
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        up = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = _through(up, "up", up)
        up = checkpointed(_through(up, "up", up).select("node", "up"))
        labels = _through(labels, "component", up)
        on = _through(up.select(F.col("up").alias("a"), F.col("up").alias("b")).distinct(), "b", up)
        edges = checkpointed(_ordered(_through(_through(edges, "a", up), "b", up).select("a", "b").union(on.select("a", "b"))))
    return checkpointed(labels.select("node", "component"))
