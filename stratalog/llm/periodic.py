"""Periodic runs of words, by a suffix automaton with sets of end positions.

The automaton of a stretch of words has a state for each class of factors with the same ends. Ends are kept ordered and merged from
the longest states to the shorter, the smaller set into the larger. Two ends that become neighbours in a state, at a distance no
longer than its factors, are a square: the factor ends at both places, so the words between repeat with that distance as
smallest period. The seeds of one run share its start and its period, and the furthest of their ends is its end.

Before that, stretches that can't hold a wanted run are left out. A run of ``exponent`` periods and ``shortest`` words has
every window of ``WINDOW`` words again inside it, at its period's distance. So in a stretch of n words a run's windows have their
nearest equal within n / exponent words, and a window that hasn't divides the stretch; that is repeated until nothing divides.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import large, mix, raw_bytes, texts

#: Least number of periods and of words in a run. The filter's window may be longer than no run less one period.
EXPONENT, SHORTEST, WINDOW = 4, 6, 5
#: An ordered set is kept in blocks of so many positions at most.
BLOCK = 1024
FIELDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]  # start, length, period


class Ends:
    """Ordered positions in blocks, so that one more costs little however many there are."""

    __slots__ = ("blocks", "lasts", "size")

    def __init__(self, position: int) -> None:
        self.blocks, self.lasts, self.size = [[position]], [position], 1

    def add(self, x: int) -> None:
        k = min(bisect_left(self.lasts, x), len(self.lasts) - 1)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > BLOCK:
            self.blocks.insert(k + 1, block[BLOCK // 2 :])
            del block[BLOCK // 2 :]
            self.lasts.insert(k, block[-1])
            k += 1
        self.lasts[k] = self.blocks[k][-1]
        self.size += 1

    def around(self, x: int) -> tuple[int, int]:
        """The positions before and after ``x``, which is in the set; -1 where there is none."""
        k = bisect_left(self.lasts, x)
        block = self.blocks[k]
        at = bisect_left(block, x)
        before = block[at - 1] if at else self.lasts[k - 1] if k else -1
        after = block[at + 1] if at + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return before, after

    def __iter__(self):
        for block in self.blocks:
            yield from block


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Longest factor, suffix link and own end (-1 for clones) of each state of the suffix automaton of ``ids``; state 0 is the root.

    A state's only transition is kept in two lists, further ones in a dictionary.
    """
    length, link, end, symbol, target = [0], [-1], [-1], [-1], [0]
    more: dict[int, dict[int, int]] = {}
    last = 0

    def step(p: int, c: int) -> int:
        return target[p] if symbol[p] == c else more[p].get(c, -1) if p in more else -1

    def put(p: int, c: int, q: int) -> None:
        if symbol[p] == c or symbol[p] < 0:
            symbol[p], target[p] = c, q
        else:
            more.setdefault(p, {})[c] = q

    for i, c in enumerate(ids):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        symbol.append(-1)
        target.append(0)
        p = last
        while p >= 0 and (q := step(p, c)) < 0:
            put(p, c, new)
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                symbol.append(symbol[q])
                target.append(target[q])
                if q in more:
                    more[clone] = dict(more[q])
                while p >= 0 and step(p, c) == q:
                    put(p, c, clone)
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def squares(ids: list[int], least: int) -> dict[tuple[int, int], int]:
    """(start, period) of the runs of ``ids`` that have a square whose repeated factor has ``least`` words or more, with the run's end.

    States with shorter factors are left out: they have no such square.
    """
    length, link, end = automaton(ids)
    found: dict[tuple[int, int], int] = {}
    below: list[list[Ends] | None] = [None] * len(length)  # sets of the states that link here

    for state in np.argsort(-np.array(length), kind="stable").tolist():
        size = length[state]
        if size < least:
            break
        sets = below[state] or []
        below[state] = None
        if end[state] >= 0:
            sets.append(Ends(end[state]))
        whole = max(sets, key=lambda s: s.size)
        came = {x: k for k, part in enumerate(sets) if part is not whole for x in part}
        for x in came:
            whole.add(x)
        for x, k in came.items():
            before, after = whole.around(x)
            for left, right in ((before, x), (x, after)):
                # neighbours of one set are no news: they were so with a longer factor
                if 0 <= left < right <= left + size and came.get(left, -1) != came.get(right, -1):
                    key = (left - size + 1, right - left)
                    found[key] = max(found.get(key, -1), right)
        up = link[state]
        if length[up] >= least:
            if below[up] is None:
                below[up] = []
            below[up].append(whole)
    return found


def stretches(ids: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """First word and end of the stretches that may hold runs; every run lies in one of them, and what extends it too."""
    n = len(ids) - WINDOW + 1
    if len(ids) < shortest or n < 2:
        return []
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = mix(key + ids[k : k + n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    gap = np.where(key[order[1:]] == key[order[:-1]], np.diff(order), n)
    near = np.full(n, n)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    out, todo = [], [(0, n)]
    while todo:
        i, j = todo.pop()
        words = j - i + WINDOW - 1
        ok = near[i:j] <= words // exponent
        if words < shortest:
            continue
        if ok.all():
            out.append((i, j + WINDOW - 1))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]).astype(np.int8)))
        todo += [(i + int(a), i + int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return sorted(out)


def runs_of(ids: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST, narrow: bool = True) -> list[Run]:
    """Runs (start, length, smallest period) of at least ``exponent`` periods and ``shortest`` words, by start and period.

    ``narrow=False`` builds one automaton of all words; the runs are the same.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    if narrow and (shortest < WINDOW + 1 or exponent < 4):
        raise ValueError("the filter needs runs of four periods and six words")
    out = []
    least = min(max(shortest, exponent * q) - q for q in range(1, shortest + 1))  # shortest factor that recurs one period on
    for i, j in stretches(ids, exponent, shortest) if narrow else [(0, len(ids))]:
        _, local = np.unique(ids[i:j], return_inverse=True)
        for (start, period), end in squares(local.tolist(), least).items():
            length = end - start + 1
            if length >= max(shortest, exponent * period):
                out.append((i + start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that a run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]), strict=True) if not d]


def repeated_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """For a tenth of the ids, by their checksum, ``words`` with a tail that repeats its own beginning. A null id is written as nothing."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _described(words: list[bytes], exponent: int, shortest: int) -> tuple:
    place: dict[bytes, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for w in words], np.int64)
    runs = runs_of(ids, exponent, shortest)
    start, length, period = min(runs, key=lambda r: (_Greatest(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    text = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(runs), start, length, period, 1000 * length // period if runs else None, sha(text.encode()), sha(b" ".join(collapsed(words, runs)))


class _Greatest:
    """length / period, compared exactly, the greatest first."""

    __slots__ = ("length", "period")

    def __init__(self, length: int, period: int) -> None:
        self.length, self.period = length, period

    def __lt__(self, other: _Greatest) -> bool:
        return self.length * other.period > other.length * self.period

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Greatest) and self.length * other.period == other.length * self.period


def periodic_runs(docs: DataFrame, change: Callable[[object, list[bytes]], list[bytes]] | None = None, exponent: int = EXPONENT, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with ``FIELDS``: the number of runs, that with the most periods, digests of all runs and of the words that stay.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as bytes; ``change(doc_id, words)`` may replace a document's words first. A null, empty
    or blank text has no word and no run: nulls, and the digests of nothing. Of runs with equally many periods the first counts, then
    that of the smaller period. Rows are judged one by one, nothing is shuffled, and repeated rows get equal results; other columns are
    ignored and an empty table gives an empty result. A document lies in one task, whose memory follows its periodic stretches.
    """
    rows = texts(docs, id_col, text_col)
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(FIELDS).fields])
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw_bytes(large(b.column(1)))
            out = []
            for k, key in enumerate(b.column(0).to_pylist()):
                words = data[off[k] : off[k + 1]].tobytes().split()
                out.append(_described(change(key, words) if change else words, exponent, shortest))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], names=schema.names)

    return rows.mapInArrow(run, schema)
