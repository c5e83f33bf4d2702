"""Shards of near-equal size by sampled splitters, in DataFrame functions only.

Rows are keyed by (hash of the text, doc_id), so equal texts are neighbours and a group of any
size can be cut. A size-weighted sample of keys gives quantile boundaries of many small ranges; a
range that turns out overfull is subdivided by a sample of its own. The exact bytes of the ranges
and a running sum inside each of them then place every row on the line of all bytes, which is
cut into shards. The few rows larger than a 32nd of a shard are dealt first, largest to the
emptiest shard, and the cuts leave room for them.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, texts

RANGES_PER_SHARD, SAMPLES_PER_RANGE, HEAVY_PARTS, ROUNDS = 16, 16, 32, 3
_KEY = ("h", "doc_id")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus ``overhead``), text_crc32 and h, the hash that orders rows."""
    raw = F.col("text").cast("binary")
    return texts(docs, id_col, text_col).select("doc_id", (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("h"))


def _sample(rows: DataFrame, rate: Column, seed: int) -> DataFrame:
    """Keys drawn with a probability of size times ``rate``, by a hash, so that a draw can be repeated."""
    u = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(u < F.col("size") * rate)


def _quantiles(sample: DataFrame, every: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Each ``every``-th key of the sample in order."""
    order = Window.partitionBy(*by).orderBy(*_KEY)
    return sample.withColumn("rn", F.row_number().over(order)).where(F.col("rn") % every == 0).select(F.struct(*_KEY).alias("cut"))


def _ranged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``range``: how many cuts are at or below the row's key, by binary search in one array, however many ``shards`` asks for."""
    n = cuts.count()
    rows = rows.withColumn("cuts", cuts.agg(F.sort_array(F.collect_list("cut"))).scalar())
    key = F.struct(*_KEY)
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)]) if n else F.array().cast("array<int>")

    def advance(at: Column, step: Column) -> Column:
        ok = (at + step <= F.size("cuts")) & (F.get("cuts", at + step - 1) <= key)
        return F.when(ok, at + step).otherwise(at)

    return rows.withColumn("range", F.aggregate(steps, F.lit(0), advance)).drop("cuts")


def _deal(sizes: list[int], shards: int, total: int) -> tuple[list[int], list[int]]:
    """Shard of each heavy row, largest first to the emptiest, and the end of each shard's room on the line of the other rows."""
    load = [(0, s) for s in range(shards)]
    of = []
    for size in sizes:
        bytes_, s = heapq.heappop(load)
        of.append(s)
        heapq.heappush(load, (bytes_ + size, s))
    heavy = sorted(load, key=lambda x: x[1])
    rest = total - sum(sizes)
    level, filled = 0.0, 0
    for k, (low, _) in enumerate(sorted(heavy), 1):  # fill up to one level
        filled += low
        high = (rest + filled) / k
        if k == shards or high <= sorted(heavy)[k][0]:
            level = high
            break
    ends, at = [], 0.0
    for low, _ in heavy:
        at += max(0.0, level - low)
        ends.append(int(at))
    ends[-1] = rest
    return of, ends


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (0, 1, ... in each shard), grown_shard (null).

    Shards differ in bytes by less than the largest row, mostly by far less. A null text has no
    bytes and counts 16; repeated rows are rows of their own and may lie in different shards when
    the cut falls between them. Other columns are ignored; an empty table gives an empty result.
    """
    rows = checkpointed(sized(docs, id_col, text_col))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("size") * HEAVY_PARTS * shards > total
    big = rows.where(heavy).withColumn("rank", F.row_number().over(Window.orderBy(F.col("size").desc(), *_KEY)))
    big_sizes = [r["size"] for r in big.orderBy("rank").select("size").collect()]  # HEAVY_PARTS * shards at most
    shard_of, ends = _deal(big_sizes, shards, total)
    light, rest = rows.where(~heavy), total - sum(big_sizes)

    ranges = RANGES_PER_SHARD * shards
    goal = max(rest / ranges, 1.0)
    cuts = checkpointed(_quantiles(_sample(light, F.lit(SAMPLES_PER_RANGE / goal), 0), SAMPLES_PER_RANGE))
    for seed in range(1, ROUNDS + 1):
        ranged = _ranged(light, cuts)
        full = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > 3 * goal) & (F.col("n") > 1))
        full = checkpointed(full.select("range"))  # at most a third of the ranges
        if full.isEmpty():
            break
        more = _sample(ranged.join(F.broadcast(full), "range"), F.lit(SAMPLES_PER_RANGE / goal), seed)
        cuts = checkpointed(cuts.union(_quantiles(more, SAMPLES_PER_RANGE, ("range",))).distinct())

    before = Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, 0)
    placed = _ranged(light, cuts).select("*", F.sum("size").over(before).alias("to"), F.row_number().over(Window.partitionBy("range").orderBy(*_KEY)).alias("nth"))
    sums = _ranged(light, cuts).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    sums = sums.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    middle = F.col("bytes0") + F.col("to") - F.expr("size div 2")
    shard = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < middle)), F.lit(shards - 1))
    placed = placed.join(F.broadcast(sums), "range").select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("n0") + F.col("nth")).alias("nth"))
    placed = checkpointed(placed)
    begun = [shard_of.count(s) for s in range(shards)]
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # a row for each shard
    placed = placed.join(F.broadcast(first), "shard")
    slot = F.col("nth") - F.col("first") + F.get(F.array(*[F.lit(b) for b in begun]), F.col("shard"))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
    if big_sizes:
        nth = [shard_of[:i].count(s) for i, s in enumerate(shard_of)]
        pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("rank") - 1)
        placed = placed.union(big.select("doc_id", "size", "text_crc32", pick(shard_of).alias("shard"), pick(nth).cast("long").alias("slot")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
