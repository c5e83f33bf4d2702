"""Cutting ordered rows into parts whose sums start anew at each cut.

Where a part begins decides where it ends, and so where the next one begins; a running sum can't say that. Rows are sorted into
ranges, and each range says in a small table what it does to a part that is open when it begins: for every row that may start
a part, how many parts end in the range from there, and what the last one holds. A scan over those tables gives what
is open at the start of each range, and then every range numbers its rows by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def next_starts(sums: np.ndarray, most: int, rows: int | None) -> np.ndarray:
    """For a part that starts at each row (and the end): where the next one starts, beyond the end if it isn't full there.

    ``sums`` has the sums before each row, and of all. A part ends with the row that brings it to ``most`` or to ``rows`` rows.
    """
    at = np.searchsorted(sums, sums + most, side="left")
    at = np.maximum(at, np.arange(len(sums)) + 1)
    return at if rows is None else np.minimum(at, np.arange(len(sums)) + rows)


def starts_of(sizes: np.ndarray, most: int, rows: int | None = None, filled: int = 0, held: int = 0) -> list[int]:
    """Rows that start a part, where one of ``filled`` and ``held`` rows is open before the first."""
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n, out = len(sizes), []
    at = max(int(np.searchsorted(sums, most - filled, side="left")), 1)
    at = at if rows is None else min(at, rows - held)
    following = next_starts(sums, most, rows)
    while at <= n:
        out.append(at)
        at = int(following[at])
    return out


def part_numbers(sizes: np.ndarray, most: int, rows: int | None = None, filled: int = 0, held: int = 0) -> np.ndarray:
    """Number of the part of each row, 0 for the open one."""
    change = np.zeros(len(sizes) + 1, np.int64)
    change[starts_of(sizes, most, rows, filled, held)] = 1
    return np.cumsum(change)[: len(sizes)]


def _transfer(sizes: np.ndarray, most: int, rows: int | None) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Sums before the rows that may start a part here first; from each of them the parts that end here, and what is open at the end: sum and rows."""
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    n = len(sizes)
    following = next_starts(sums, most, rows).tolist()
    ended, last = [0] * (n + 1), list(range(n + 1))
    for s in range(n - 1, -1, -1):
        if following[s] <= n:
            ended[s], last[s] = ended[following[s]] + 1, last[following[s]]
    head = min(n, int(np.searchsorted(sums, most, side="left")), n if rows is None else rows) + 1
    open_ = last[:head]
    return sums[:head], ended[:head], (sums[n] - sums[open_]).tolist(), [n - x for x in open_]


def numbered(df: DataFrame, by: str, order: list[str], size: str, most: int, rows: int | None = None, name: str = "part") -> DataFrame:
    """``df`` with ``name``: the part of its ``by`` that each row falls into, 0, 1, ... in ``order``.

    A part ends with the row that brings the sum of ``size`` (no less than 0; null counts 0) to ``most``, or its rows to ``rows``. Rows equal in ``order`` may come
    either way. A group of any size is spread over ranges; what a range tells the scan is bounded by the rows of a part. Rows without
    a ``by`` form a group of their own.
    """
    if most < 1 or (rows is not None and rows < 1):
        raise ValueError("a part holds something")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, by, *order).sortWithinPartitions(by, *order)
    placed = cut(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    keys = placed.select(F.col(by).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("v"), "_at", F.shiftright("_at", 33).alias("r"))
    kind = keys.schema["k"].dataType.simpleString()

    def tell(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("_at")["v"].to_numpy()
        sums, ended, filled, held = _transfer(v, most, rows)
        return pd.DataFrame({"k": [g["k"].iloc[0]], "r": [g["r"].iloc[0]], "n": [len(v)], "total": [int(v.sum())], "sums": [sums], "ended": [ended], "filled": [filled], "held": [held]})

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        out, filled, held, number = [], 0, 0, 0
        for t in g.sort_values("r").itertuples():
            out.append((t.k, t.r, filled, held, number))
            at = max(int(np.searchsorted(t.sums, most - filled, side="left")), 1)
            at = at if rows is None else min(at, rows - held)
            if at >= len(t.sums):  # nothing is full before the range's end
                filled, held = filled + t.total, held + t.n
            else:
                number += 1 + t.ended[at]
                filled, held = t.filled[at], t.held[at]
        return pd.DataFrame(out, columns=["k", "r", "filled", "held", "number"])

    def number_rows(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_at")
        start = g.iloc[0]
        return pd.DataFrame({"_at": g["_at"], "_part": int(start["number"]) + part_numbers(g["v"].to_numpy(), most, rows, int(start["filled"]), int(start["held"]))})

    maps = keys.groupBy("k", "r").applyInPandas(tell, f"k {kind}, r long, n long, total long, sums array<long>, ended array<long>, filled array<long>, held array<long>")
    entries = maps.groupBy("k").applyInPandas(scan, f"k {kind}, r long, filled long, held long, number long")
    entries = entries.select(F.col("k").alias("_k"), F.col("r").alias("_r"), "filled", "held", "number")
    rows_ = keys.join(entries, keys["k"].eqNullSafe(F.col("_k")) & (F.col("r") == F.col("_r"))).groupBy("_k", "r").applyInPandas(number_rows, "_at long, _part long")
    return placed.join(rows_, "_at").select(*df.columns, F.col("_part").alias(name))


def placed(df: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the number of each row in its group (``by``, never null), 1, 2, ... in ``order``; a group of any size is spread over ranges."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "places")
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    runs = rows.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a group's ranges
    runs = runs.select(*by, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(runs, [*by, "_range"]).select(*df.columns, (F.col("_at") + F.col("_shift") + 1).alias(name))


def in_order(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row (1, 2, ...) by ``order``: sorted in ranges, which are stored, and counted on from range to range.

    No task holds more than a range, and equal rows alone can't be divided.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumns({"_range": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    return rows.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_nth") + 1).alias(name))
