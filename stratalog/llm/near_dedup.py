"""Near-duplicate groups by b-bit MinHash.

1. Every document becomes its set of hashed 5-word shingles; equal sets form a class, one node, so
   copies are never expanded into pairs.
2. A node keeps the low ``BITS`` bits of ``PERMUTATIONS`` minima, packed, and band keys over whole
   minima; how many, and of how many minima each, follows from the threshold.
3. The smallest node of a band bucket leads it. Nodes with a bucket of one leader in common form a group, so each pair that
   shares a bucket shares a group, and a group reaches no further than one bucket from its leader.
4. A group is cut into chunks of bounded count and shingles, the leader in each. In a chunk the collision-corrected
   similarity from the packed bits drops hopeless pairs and the rest is confirmed on full sets, except where two nodes
   are connected already: a chunk returns a spanning forest of its links.
5. What is left are pairs across chunks of a group that the links found so far don't connect. Blocks of the nodes outside the
   group's largest component are held against all its blocks, by packed bits first, and only nodes with a promising partner bring
   their sets for the confirmation. A group of near copies that its chunks have connected is done without this step.

A pair at the threshold shares no bucket with probability ``BAND_MISS`` at most, and its estimate lies
below the bound of step 4 with ``PRUNE_MISS`` at most (the binomial tail of its unequal lanes): see ``bounds``.
"""

from __future__ import annotations

import math
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, checkpointed, map_text, mix, salted_lookup, saved, texts, words
from .components import components

SHINGLE, BITS, PERMUTATIONS = 5, 4, 128
#: Nodes and shingles of a chunk; one node may have more shingles by itself.
BLOCK, ITEMS = 256, 4 << 20
BAND_MISS, PRUNE_MISS = 4e-7, 3e-6
_ROWS = 4
_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**63, (PERMUTATIONS, _ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def bounds(percent: int) -> tuple[int, int, float]:
    """Bands, minima in each, and the least estimate of a pair to confirm, for links from ``percent`` on.

    The signature's lanes are too few for less than 11 percent; that is an error, not a loss of links.
    """
    s = percent / 100
    if not 0 < s <= 1:
        raise ValueError(f"percent has to lie above 0 and up to 100, not {percent}")
    for rows in range(_ROWS, 0, -1):
        bands = 1 if s == 1 else math.ceil(math.log(BAND_MISS) / math.log1p(-(s**rows)))
        if bands * rows <= PERMUTATIONS:
            break
    else:
        raise ValueError(f"{PERMUTATIONS} minima don't find pairs at {percent} percent reliably")
    chance = 2.0**-BITS
    p, unequal = (1 - chance) * (1 - s), PERMUTATIONS  # of a lane to differ; most lanes that may
    tail = 0.0
    while unequal > 0:
        tail += math.comb(PERMUTATIONS, unequal) * p**unequal * (1 - p) ** (PERMUTATIONS - unequal)
        if tail > PRUNE_MISS:
            break
        unequal -= 1
    return bands, rows, (1 - (unequal + 0.5) / PERMUTATIONS - chance) / (1 - chance)


def shingle_sets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingle sets of the rows, each ascending, in one flat array, and the offset of each row."""
    _, _, _, word, first = words(arr, lower=True)
    sets, sizes = [], np.zeros(len(arr), np.int64)
    grams = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        grams += word[k : k + len(grams)] * _PLACE[k]
    grams = mix(grams)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if b - a >= SHINGLE:
            sets.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:  # the whole sequence; its length keeps it apart from longer ones
            sets.append(mix((word[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            continue
        sizes[i] = len(sets[-1])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def minima(flat: np.ndarray, off: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """(rows, PERMUTATIONS) uint32 minima; rows without a shingle stay at the largest value."""
    out = np.full((len(off) - 1, PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    rows = np.flatnonzero(np.diff(off))
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(off[rows], off[rows[i]] + block)))
        part = flat[off[rows[i]] : off[rows[j - 1] + 1]]
        starts = off[rows[i:j]] - off[rows[i]]
        tmp = np.empty_like(part)
        for k in range(PERMUTATIONS):
            np.multiply(part, _MUL[k], out=tmp)
            tmp += _ADD[k]
            out[rows[i:j], k] = np.minimum.reduceat(tmp, starts) >> np.uint64(32)
        i = j
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Low ``BITS`` = 4 bits of the minima, two to a byte."""
    low = (low & 0xF).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis: uint64 words): equal lanes by bit counts, less chance hits."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    unequal = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (1 - unequal / PERMUTATIONS - chance) / (1 - chance)


def _lanes(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint64).reshape(-1, PERMUTATIONS * BITS // 64)


def signatures(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, k, h, n (set size), set_hi, set_lo (fingerprint of the set), sig (packed low bits), bands."""
    n_bands, n_rows, _ = bounds(percent)

    def make():
        def of(arr: pa.Array) -> list[pa.Array]:
            flat, off = shingle_sets(arr)
            full = np.flatnonzero(np.diff(off))
            hi, lo = np.zeros(len(arr), np.uint64), np.zeros(len(arr), np.uint64)
            if len(full):
                hi[full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), off[full])
                lo[full] = np.add.reduceat(mix(flat + np.uint64(0x14057B7EF767814F)), off[full])
            low = minima(flat, off)
            keys = np.empty((len(arr), n_bands), np.uint64)
            for b in range(n_bands):
                keys[:, b] = mix((low[:, b * n_rows : (b + 1) * n_rows].astype(np.uint64) * _BAND[b, :n_rows]).sum(1, dtype=np.uint64) + np.uint64(b))
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PERMUTATIONS * BITS // 8), len(arr), [None, pa.py_buffer(pack(low).tobytes())])
            bands = pa.ListArray.from_arrays(np.arange(len(arr) + 1, dtype=np.int32) * n_bands, keys.view(np.int64).ravel())
            return [pa.array(np.diff(off)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), sig.cast(pa.binary()), bands]

        return of

    return map_text(docs, make, "n long, set_hi long, set_lo long, sig binary, bands array<long>", keep=("doc_id", "k", "h"))


def _forest(n: int, a: np.ndarray, b: np.ndarray, linked, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the candidate pairs (a, b) of ``n`` nodes connect; ``linked(k)`` confirms the k-th, asked only across trees.

    Nodes with equal ``known`` are connected from the start.
    """
    parent = list(range(n))
    if known is not None:
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        parent = first[of].tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(i), root(j)
        if x != y and linked(k):
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _shared(sets: list[np.ndarray], left: int, start: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with those from ``start`` on, over the items that two of them have."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, item, n = np.unique(flat, return_inverse=True, return_counts=True)
    common = n[item] > 1
    row, item = row[common], (np.cumsum(n > 1) - 1)[item[common]]
    out = np.zeros((left, len(sets) - start), np.float32)
    order = np.argsort(item, kind="stable")
    row, item = row[order], item[order]
    step = 4096
    for lo in range(0, int(item[-1]) + 1 if len(item) else 0, step):
        i, j = np.searchsorted(item, (lo, lo + step))
        has = np.zeros((len(sets), step), np.float32)
        has[row[i:j], item[i:j] - lo] = 1
        out += has[:left] @ has[start:].T
    return out


def _promising(sigs: np.ndarray, left: int, same: bool, percent: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of the first ``left`` nodes with the others (``same``: among all) whose estimate reaches the bound, and the estimates.

    Pairs with equal ``known`` are left out.
    """
    least = bounds(percent)[2]
    a, b, est = [], [], []
    for i in range(left):
        start = i + 1 if same else left
        e = estimate(sigs[start:], sigs[i])
        ok = e >= least
        j = np.flatnonzero(ok if known is None else ok & (known[start:] != known[i]))
        a.append(np.full(len(j), i))
        b.append(j + start)
        est.append(e[j])
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((a, np.int64), (b, np.int64), (est, float)))


def block_links(sets: list[np.ndarray], sigs: np.ndarray, left: int, same: bool, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the first ``left`` documents and the others (``same``: among all), beyond what ``known`` connects."""
    a, b, est = _promising(sigs, left, same, percent, known)
    if not len(a):
        return []
    order = np.argsort(-est, kind="stable")  # likely links first: they connect the most
    a, b = a[order], b[order]
    sizes = np.array([len(x) for x in sets])
    if len(a) > 2 * len(sets) and len(sets) <= 2 * BLOCK:
        start = 0 if same else left
        both = _shared(sets, left, start)[a, b - start]
        ok = 100 * both >= percent * (sizes[a] + sizes[b] - both)
        return _forest(len(sets), a[ok], b[ok], lambda k: True, known)

    def linked(k: int) -> bool:
        x = np.sort(np.concatenate([sets[a[k]], sets[b[k]]]), kind="stable")
        n = int((x[1:] == x[:-1]).sum())
        return 100 * n >= percent * (len(x) - n)

    return _forest(len(sets), a, b, linked, known)


# --- groups ------------------------------------------------------------------


def _with_sets(docs: DataFrame, reps: DataFrame, at: DataFrame) -> DataFrame:
    """node, sig, at and items (the whole set) of the nodes of ``at`` (node, at: array of structs)."""

    def make():
        def of(arr: pa.Array) -> list[pa.Array]:
            flat, off = shingle_sets(arr)
            return [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(arr), [None, pa.py_buffer(off * 8), pa.py_buffer(flat.tobytes())]).cast(pa.binary())]

        return of

    want = reps.select("k", "h", "node", "sig").join(at, "node")
    texts_of = docs.select("k", "h", "text").join(want, ["k", "h"]).dropDuplicates(["k", "h"])
    return map_text(texts_of, make, "items binary", keep=("node", "sig", "at"))


def _spread(rows: DataFrame) -> DataFrame:
    """A row for each entry of ``at``."""
    return rows.select("node", "sig", "items", F.explode("at").alias("at")).select("at.*", "node", "sig", "items")


def _placed(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy("node").agg(F.collect_list(F.struct(*cols)).alias("at"))


def _links_of(rows: DataFrame, by: list[str], percent: int) -> DataFrame:
    """Links (a, b) in each group of ``rows``: node, sig, items, side (0 is held against 1, or among itself if there is no 1), known."""

    def compare(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        t, left = t.take(order), int((side == 0).sum())
        ids, known = t["node"].to_numpy(), t["known"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["items"]]
        found = block_links(sets, _lanes(t["sig"].to_pylist()), left, left == len(ids), percent, known) if left else []
        a, b = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": ids[a], "b": ids[b]})

    return rows.groupBy(*by).applyInArrow(compare, "a long, b long")


def _parts(n: str, items: str, block: int) -> F.Column:
    """How many blocks hold ``n`` nodes with ``items`` shingles in all."""
    return F.greatest(F.ceil(F.col(n) / block), F.ceil(F.col(items) / ITEMS), F.lit(1)).cast("int")


def _across(pairs: DataFrame, sets: DataFrame, reps: DataFrame, heavy: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links across the chunks of the groups of ``heavy`` (leader, chunks) that ``labels`` don't connect, or None; pairs: leader, node, n; sets: node, sig, items."""
    named = heavy.select("leader", F.col("leader").alias("node")).join(reps.select("node", "n"), "node").select("leader", "node", "n")
    named = named.union(salted_lookup(pairs, heavy, "leader", F.col("node")).where("chunks is not null").select("leader", "node", "n"))
    named = checkpointed(named.join(labels, "node", "left").select("leader", "node", "n", F.coalesce("component", "node").alias("known")))
    sums = named.groupBy("leader", "known").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    split = sums.groupBy("leader").agg(F.max_by(F.struct("known", "c", "items"), F.struct("c", "known")).alias("most"), F.sum("c").alias("c"), F.sum("items").alias("items")).where("c > most.c")
    split = split.select("leader", F.col("most.known").alias("main"), F.col("most.c").alias("mc"), F.col("most.items").alias("mi"), (F.col("c") - F.col("most.c")).alias("rc"), (F.col("items") - F.col("most.items")).alias("ri"))
    split = checkpointed(split.select("leader", "main", _parts("rc", "ri", 2 * block).alias("rest"), _parts("mc", "mi", 2 * block).alias("mains")))
    if split.isEmpty():
        return None
    rows = salted_lookup(named, split, "leader", F.col("node")).where("main is not null")
    dealt = F.xxhash64("node", F.lit(3))
    of = F.when(F.col("known") == F.col("main"), F.col("rest") + F.pmod(dealt, F.col("mains"))).otherwise(F.pmod(dealt, F.col("rest"))).cast("int")
    rows = rows.withColumn("block", of)
    last = F.when(F.col("block") < F.col("rest"), F.col("rest") + F.col("mains")).otherwise(F.col("rest")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("leader", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "known")

    def hopeful(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        t = t.take(np.argsort(side, kind="stable"))
        left = int((side == 0).sum())
        a, b, _ = _promising(_lanes(t["sig"].to_pylist()), left, left == len(side), percent, t["known"].to_numpy()) if left else (np.zeros(0, np.int64),) * 3
        return t.take(np.union1d(a, b)).select(["leader", "lo", "hi", "side", "node", "known"])

    near = rows.join(reps.select("node", "sig"), "node").groupBy("leader", "lo", "hi").applyInArrow(hopeful, "leader long, lo int, hi int, side int, node long, known long")
    near = checkpointed(near)
    if near.isEmpty():
        return None
    return _links_of(_spread(sets.drop("at").join(_placed(near, "leader", "lo", "hi", "side", "known"), "node")), ["leader", "lo", "hi"], percent)


def _labels(docs: DataFrame, reps: DataFrame, percent: int, block: int) -> DataFrame:
    """node, component of the nodes of ``reps`` (node, k, h, n, sig, bands) that are linked with another."""
    rows = reps.select("node", "n", F.explode("bands").alias("key")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    part = rows.groupBy("key", "salt").agg(F.min("node").alias("first"), F.count("*").alias("c"))
    bucket = part.groupBy("key").agg(F.min("first").alias("leader"), F.sum("c").alias("c")).where("c > 1").select("key", "leader")
    led = part.select("key", "salt").join(bucket, "key")
    pairs = checkpointed(rows.join(led, ["key", "salt"]).where("node <> leader").select("leader", "node", "n").distinct())

    sums = pairs.groupBy("leader").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    heavy = checkpointed(sums.select("leader", _parts("c", "items", block).alias("chunks")).where("chunks > 1"))
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
    member = salted_lookup(pairs, heavy, "leader", F.col("node")).select("node", "leader", chunk.alias("chunk"))
    lead = sums.select("leader").join(heavy, "leader", "left").select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("chunk"))
    sets, chunked = _with_sets(docs, reps, _placed(member.union(lead), "leader", "chunk")), not heavy.isEmpty()
    sets = saved(sets, "sets") if chunked else sets  # pairs across chunks need them again
    links = checkpointed(_links_of(_spread(sets).withColumns({"side": F.lit(0), "known": F.col("node")}), ["leader", "chunk"], percent))
    labels = components(links)
    if not chunked:
        return labels
    more = _across(pairs, sets, reps, heavy, labels, percent, block)
    return labels if more is None else components(links.union(more))


def labelled(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each row of ``docs``: doc_id, k and h (keys of id and text, never null), n_shingles, cluster (null: linked with nothing), component_id."""
    docs = texts(docs, id_col, text_col).withColumns({"k": F.xxhash64("doc_id", "text"), "h": F.xxhash64("text", F.lit(1))})
    all_sigs = checkpointed(signatures(docs, percent))
    classes = all_sigs.where("n > 0").groupBy("set_hi", "set_lo", "n").agg(
        F.min(F.struct("k", "h")).alias("key"), F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count("*").alias("copies")
    )
    # the ids are drawn once: the checkpoint holds them
    reps = checkpointed(classes.select(F.monotonically_increasing_id().alias("node"), "key.*", "set_hi", "set_lo", "n", "doc_id", "sig", "bands", "copies"))
    labels = _labels(docs, reps, percent, block)

    found = reps.select("node", "set_hi", "set_lo", F.col("n").alias("n_shingles"), "doc_id", "copies").join(labels, "node", "left").where("copies > 1 or component is not null")
    found = found.withColumn("cluster", F.coalesce("component", "node"))
    least = found.groupBy("cluster").agg(F.min("doc_id").alias("component_id"))
    found = found.join(least, "cluster").select(F.struct("set_hi", "set_lo", "n_shingles").alias("set"), "cluster", "component_id")
    out = all_sigs.select("doc_id", "k", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.struct("set_hi", "set_lo", F.col("n").alias("n_shingles"))).alias("set"))
    out = salted_lookup(out, found, "set", F.col("k"))
    own = F.when(F.col("cluster").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "k", "h", "n_shingles", "cluster", own.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), kept (is that one itself) for every row.

    Links documents with 100 * intersection >= ``percent`` * union of their sets of distinct
    5-word shingles (A-Z lower-cased; fewer words: the whole sequence as one). Null, empty and
    blank texts have no shingle and stay alone. Rows are documents of their own: rows that repeat an id with another text are
    linked each by its own text, and each row with the smallest id of its component is kept. A row without an id takes part in links; its component_id is the
    smallest id it reaches, null if that is none, and only then it is kept. An empty table gives an empty result; other columns are ignored.
    """
    out = labelled(docs, percent, id_col, text_col, block)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, every column as it was, one of each group of linked rows: that with the smallest id, nulls last, then by a hash of the text.

    Rows that repeat both id and text are linked if the text has a word, so one of them stays. Rows without a word all stay.
    """
    rows = checkpointed(labelled(docs, percent, id_col, text_col, block).where("cluster is not null").select("cluster", "doc_id", "k", "h"))
    first = rows.groupBy("cluster").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "h")).alias("f")).select("f.k", "f.h")
    same = rows.groupBy("k", "h").agg(F.count("*").alias("n"))
    k, h = (f"{c}_{uuid.uuid4().hex}" for c in "kh")  # no column of docs has such a name
    named = lambda df: df.select(F.col("k").alias(k), F.col("h").alias(h))
    gone = named(same.select("k", "h").join(first, ["k", "h"], "left_anti"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({k: F.xxhash64(F.col(id_col), text), h: F.xxhash64(text, F.lit(1))})
    out = keyed.join(gone, [k, h], "left_anti")
    repeats = checkpointed(named(same.where("n > 1").join(first, ["k", "h"], "left_semi")))
    if not repeats.isEmpty():
        out = out.join(repeats, [k, h], "left_anti").unionByName(out.join(repeats, [k, h], "left_semi").dropDuplicates([k, h]))
    return out.select(*docs.columns)
