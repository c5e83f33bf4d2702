"""Reconciling the branches of several writers.

Headers are rows: repo, branch, pos (place in the branch), client, clock (text), t (milliseconds).
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import ENTRY_PATTERN, GREATER, SMALLER, vc_compare, vc_parse

HEADER = ["client", "clock", "t"]


def conflicting_pairs(headers: DataFrame) -> DataFrame:
    """Pairs of headers of one repository and day, from different clients, with how their clocks compare.

    ``headers``: id, client, localtime, clock. The day bounds the pairs: it names as many commits as there are clients.
    """
    h = headers.select("id", "client", F.to_date("localtime").alias("day"), "clock")
    a, b = h.select([F.col(c).alias(f"{c}_a") for c in h.columns]), h.select([F.col(c).alias(f"{c}_b") for c in h.columns])
    pairs = a.join(b, (F.col("day_a") == F.col("day_b")) & (F.col("client_a") < F.col("client_b")))
    return pairs.select("id_a", "id_b", vc_compare(vc_parse(F.col("clock_a")), vc_parse(F.col("clock_b"))).alias("order"))


def header_order(a: Column, b: Column, with_time: bool = True) -> Column:
    """-1, 0 or 1 for two headers (structs of client, clock, t): by their clocks; those that say nothing by time and then client, or 0."""
    clocks = vc_compare(vc_parse(a["clock"]), vc_parse(b["clock"]))
    less, more = F.struct(a["t"], a["client"]) < F.struct(b["t"], b["client"]), F.struct(a["t"], a["client"]) > F.struct(b["t"], b["client"])
    tie = F.when(less, -1).when(more, 1).otherwise(0) if with_time else F.lit(0)
    return F.when(clocks == SMALLER, -1).when(clocks == GREATER, 1).otherwise(tie)


def branches(store) -> DataFrame:
    """branch (a client), pos, client, clock, t of every commit: a branch holds its client's own commits, by its own time."""
    head = store.databaseversion.select("id", "client", F.col("vectorclock_serialized").alias("clock"), F.unix_millis(F.col("localtime").cast("timestamp")).alias("t"))
    own = store.databaseversion_vectorclock.select(F.col("databaseversion_id").alias("id"), "client", F.col("logicaltime").alias("pos"))
    return head.join(own, ["id", "client"]).select(F.col("client").alias("branch"), "pos", *HEADER)


def _chains(times: np.ndarray, clients: np.ndarray) -> list[np.ndarray]:
    """Places of ``times`` (a clock a row) in chains of growing clocks: one a client, more where a client's clocks don't grow."""
    out: list[np.ndarray] = []
    for client in np.unique(clients):
        rest = np.flatnonzero(clients == client)
        rest = rest[np.argsort(times[rest].sum(1), kind="stable")]  # a greater clock has a greater sum
        while len(rest):
            grows = (np.diff(times[rest], axis=0) >= 0).all(1) & (np.diff(times[rest], axis=0) > 0).any(1)
            if grows.all():
                out.append(rest)
                break
            chain, left = [rest[0]], []
            for x in rest[1:]:
                ok = (times[x] >= times[chain[-1]]).all() and (times[x] > times[chain[-1]]).any()
                (chain if ok else left).append(x)
            out.append(np.array(chain))
            rest = np.array(left, np.int64)
    return out


def _smaller_in(chain: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many of a chain's clocks are smaller than each of ``times``: those up to a place, found in each of a clock's entries."""
    own = times[chain]
    upto = np.full(len(times), len(chain))
    for entry in range(times.shape[1]):
        np.minimum(upto, np.searchsorted(own[:, entry], times[:, entry], side="right"), out=upto)
    equal = (upto > 0) & (own[np.maximum(upto - 1, 0)] == times).all(1)
    return upto - equal


def _winner(headers: pd.DataFrame) -> pd.DataFrame:
    """Winning branch of one repository: for n headers in k chains n * k numbers, a heap of the chains' fronts and one pass."""
    ends = headers.sort_values("pos").groupby("branch").tail(1).sort_values("branch")
    left = headers[["t", "client", "clock"]].drop_duplicates().sort_values(["t", "client", "clock"]).reset_index(drop=True)
    entries = [re.findall(ENTRY_PATTERN, text) for text in left["clock"]]
    place = {c: i for i, c in enumerate(sorted({c for e in entries for c, _ in e}))}
    times = np.zeros((len(left), max(len(place), 1)), np.int64)
    for i, e in enumerate(entries):
        times[i, [place[c] for c, _ in e]] = [int(n) for _, n in e]
    chains = _chains(times, left["client"].to_numpy())
    waits = np.stack([_smaller_in(c, times) for c in chains], 1)
    taken = np.zeros(len(chains), np.int64)
    front = np.array([waits[c[0]] for c in chains])  # what the first header of each chain that isn't taken waits for
    pending, ready, last = np.ones(len(chains), bool), [], None
    chain_of = np.empty(len(left), np.int64)
    for k, c in enumerate(chains):
        chain_of[c] = k
    while True:
        for k in np.flatnonzero(pending & (front <= taken).all(1)):
            heapq.heappush(ready, int(chains[k][taken[k]]))  # places are in the order of time and client
            pending[k] = False
        if not ready:
            break
        one = heapq.heappop(ready)
        if last is None or ((times[one] >= times[last]).all() and (times[one] > times[last]).any()):
            last = one
        k = chain_of[one]
        taken[k] += 1
        if taken[k] < len(chains[k]):
            front[k], pending[k] = waits[chains[k][taken[k]]], True
    end = left.iloc[last]
    won = [r.branch for r in ends.itertuples() if (r.t, r.client, r.clock) == (end["t"], end["client"], end["clock"])]
    return pd.DataFrame({"repo": [headers["repo"].iloc[0]], "winner": [won[0] if won else None], "client": [end["client"]], "clock": [end["clock"]], "t": [end["t"]]})


def winners(headers: DataFrame) -> DataFrame:
    """repo, winner (branch, null if none ends in the winning header), client, clock, t.

    All headers are put in an order that agrees with their clocks, ties by time and client; each that is greater
    than the last one taken is taken; the first branch that ends in the last one wins. A repository's headers (commits of its
    writers since they last agreed) meet in one task, whose work is headers times writers; repositories are independent.
    """
    headers = headers.select("repo", "branch", "pos", *HEADER)
    kinds = {c: headers.schema[c].dataType.simpleString() for c in ("repo", "branch")}
    return headers.groupBy("repo").applyInPandas(_winner, f"repo {kinds['repo']}, winner {kinds['branch']}, client string, clock string, t long")


def _first_difference(loser: DataFrame, winner: DataFrame) -> DataFrame:
    other = winner.select("repo", "pos", F.struct(*HEADER).alias("_other"))
    both = loser.join(other, ["repo", "pos"]).where(F.struct(*HEADER) != F.col("_other"))
    return both.groupBy("repo").agg(F.min("pos").alias("_from"))


def to_prune(loser: DataFrame, winner: DataFrame) -> DataFrame:
    """Headers of the losing branch from the first place where both have one and they differ; a branch that is just longer keeps all."""
    return loser.join(_first_difference(loser, winner), "repo").where("pos >= _from").select(*loser.columns)


def to_apply(loser: DataFrame, winner: DataFrame) -> DataFrame:
    """Headers of the winning branch from the first place where the loser has none or another."""
    own = loser.select("repo", "pos", F.struct(*HEADER).alias("_own"))
    differs = winner.join(own, ["repo", "pos"], "left").where(F.col("_own").isNull() | (F.col("_own") != F.struct(*HEADER)))
    first = differs.groupBy("repo").agg(F.min("pos").alias("_from"))
    return winner.join(first, "repo").where("pos >= _from").select(*winner.columns)


def muddy_headers(headers: DataFrame, won: DataFrame) -> DataFrame:
    """Headers of other branches that the winning branch doesn't have."""
    winning = headers.join(won.select("repo", F.col("winner").alias("branch")), ["repo", "branch"], "left_semi").select("repo", *HEADER)
    return headers.select("repo", *HEADER).distinct().join(winning, ["repo", *HEADER], "left_anti")


def muddy_containers(store, headers: DataFrame) -> DataFrame:
    """id, machine_name, machine_version of the containers of muddy ``headers`` (client, clock): theirs, not part of the winning branch."""
    muddy = store.databaseversion.join(headers.select("client", F.col("clock").alias("vectorclock_serialized")).distinct(), ["client", "vectorclock_serialized"], "left_semi").select(F.col("id").alias("databaseversion_id"), "client")
    own = muddy.join(store.databaseversion_vectorclock, ["databaseversion_id", "client"])
    return store.multichunk.join(own, "databaseversion_id").select("id", F.col("client").alias("machine_name"), F.col("logicaltime").alias("machine_version"))


def next_clock(store, client: str) -> DataFrame:
    """Clock of the client's next commit: the newest master clock, the client's own time one over its dirty one if there is any, else over its last."""
    last = store.master_commits.agg(F.max_by("vectorclock_serialized", "id").alias("last"))
    own = store.databaseversion_vectorclock.where(F.col("client") == client).select(F.col("databaseversion_id").alias("id"), "logicaltime")
    dirty = store.dirty_commits.select("id").join(own, "id").agg(F.max_by("logicaltime", "id").alias("dirty"))
    clock = vc_parse(F.coalesce("last", F.lit("()")))
    mine = F.coalesce(F.col("dirty").cast("bigint"), F.try_element_at(clock, F.lit(client)), F.lit(0).cast("bigint")) + 1
    return last.join(dirty, how="cross").select(F.map_concat(F.map_filter(clock, lambda k, _: k != client), F.create_map(F.lit(client), mine)).alias("clock"))  # one row each
