"""Quality rules on repetition, from a suffix array over the words of each document.

Documents of a slice share one flat word array with a unique separator after each, so one
suffix sort serves all of them and no match crosses documents. Prefix doubling sorts only
suffixes that are still tied. The class of every word window of length 1, 2, 4, ... is kept,
and the longest common prefix of neighbours in the suffix array is read off those classes from
the longest window down. Each suffix's longest repeat is the larger prefix it shares with its
two neighbours (the depth of its innermost LCP interval); the union of these spans is the part
of a document that maximal repeated substrings cover.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import filter_text, map_text, mix, texts, words

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_long_words long, covered_fraction double, longest_repeat long, too_long boolean, kept boolean"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """What a document may hold. Repeats count from ``window`` words on, long ones from ``long_window``.

    ``max_repeat_percent`` bounds the words that repeats cover (the base rule). The method's own, stricter limits: ``max_long_percent``
    bounds the words that long repeats cover, ``max_longest_repeat`` the words of the longest passage that occurs twice.
    """

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    long_window: int = 10
    max_long_percent: int = 10
    max_longest_repeat: int = 100


def suffix_array(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``keys`` and, for 1, 2, 4, ... words, the class of the window at each place.

    Every suffix must differ from the others before the end, as a unique last key of each document gives.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    levels = [rank.astype(np.int32)]
    tied = order[~(new & np.append(new[1:], True))]
    step = 1
    while len(tied):
        key = rank[tied] * n + rank[tied + step]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = key // n
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.ones(len(tied), bool)
        begin[1:] = old[1:] != old[:-1]
        at = np.arange(len(tied))
        base = np.maximum.accumulate(np.where(begin, at, 0))
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - base
        levels.append(rank.astype(np.int32))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    return array, levels


def common_prefixes(array: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the prefix that each suffix of the array shares with the one before it."""
    lcp = np.zeros(len(array), np.int64)
    pair = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    a, b, length = array[pair - 1], array[pair], np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a + length] == levels[k][b + length]
        length += same * np.int64(1 << k)
    lcp[pair] = length
    return lcp


def longest_repeats(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest passage that begins there and occurs elsewhere in its document."""
    docs = len(first) - 1
    counts = np.diff(first)
    place = np.arange(len(word)) + np.repeat(np.arange(docs), counts)
    ends = first[1:] + np.arange(docs)
    keys = np.empty(len(word) + docs, np.uint64)
    salt = mix(np.arange(1, docs + 1, dtype=np.uint64))
    keys[place] = mix(word + np.repeat(salt, counts))
    keys[ends] = mix(salt ^ np.uint64(0xD1B54A32D192ED03))
    array, levels = suffix_array(keys)
    lcp = common_prefixes(array, levels)
    depth = np.zeros(len(keys), np.int64)
    depth[array] = np.maximum(lcp, np.append(lcp[1:], 0))
    return depth[place]


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def measures(arr: pa.Array, limits: Limits) -> list[np.ndarray]:
    """The columns of ``FIELDS`` for a large_string array."""
    data, starts, ends, word, first = words(arr, lower=False)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    off = off - off[0]
    n_words = np.diff(first)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    word_chars = _sums(in_word & ((data & 0xC0) != 0x80), off)
    n_symbols = _sums(_SYMBOL[data], off)

    n_dup = np.zeros(len(arr), np.int64)
    for i, text in enumerate(arr.to_pylist()):
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
        n_dup[i] = len(lines) - len(set(lines))

    depth = longest_repeats(word, first)

    def covered(window: int) -> np.ndarray:
        hit = np.flatnonzero(depth >= window)
        change = np.zeros(len(word) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.subtract.at(change, hit + depth[hit], 1)
        return _sums(np.cumsum(change[:-1]) > 0, first)

    repeat, long = covered(limits.window), covered(limits.long_window)
    longest = np.zeros(len(arr), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(arr)), n_words), depth)
    failed = (n_words < limits.min_words) | (100 * repeat > limits.max_repeat_percent * n_words)
    too_long = longest > limits.max_longest_repeat
    kept = ~failed & ~too_long & (100 * long <= limits.max_long_percent * n_words)
    return [n_words, word_chars, n_symbols, n_dup, repeat, failed, long, repeat / np.maximum(n_words, 1), longest, too_long, kept]


def quality_rules(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with ``FIELDS``: the base counts, what maximal repeats cover, the longest one and the verdict.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are. ``covered_fraction`` is the share of
    words in repeats of ``window`` words or more (overlaps count once, the first occurrence too), ``n_long_words`` the words in repeats of
    ``long_window`` or more; ``longest_repeat`` may overlap itself. A null text counts as empty and fails for its length.
    Rows are judged one by one, so repeated rows and ids get equal results; other columns are
    ignored and an empty table gives an empty result.
    """

    def make():
        return lambda arr: [pa.array(x) for x in measures(arr, limits)]

    return map_text(texts(docs, id_col, text_col), make, FIELDS)


def keep_by_rules(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    return filter_text(docs, lambda: lambda arr: measures(arr, limits)[-1], text_col)
