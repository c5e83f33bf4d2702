"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks up every neighbouring
pair by binary search over the sorted pair keys, finds each word's lowest rank and merges all
its occurrences there from the left; words without a known pair drop out. A task remembers the
words it has encoded, so each costs merges once.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_text, texts

FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A vocabulary file of word-end BPE: NFC, lower case, pieces by the file's pattern, no decoder."""

    def __init__(self, path: str, remember: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        chars = byte_chars()
        self.inner = np.array([vocab.get(c, -1) for c in chars], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.piece = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[int, str, str]] = {}
        self.remember = remember

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, none of them empty, and where each piece's begin."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), sizes)
        word, sym = word[sym >= 0], sym[sym >= 0]
        done_word, done_sym = [], []
        none = len(self.keys)
        while len(sym):
            key = np.full(len(sym), -1, np.int64)
            key[:-1] = np.where(word[1:] == word[:-1], sym[:-1] * self.base + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            length = np.diff(np.append(starts, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, starts), length)
            over = best == none
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
            hit = (rank == best) & ~over
            # in a run of one symbol the pairs overlap: every other one counts, from the left
            run = hit & ~np.append(False, hit[:-1])
            place = np.arange(len(hit))
            hit &= (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
            sym[hit] = self.made[rank[hit]]
            keep = ~over & ~np.append(False, hit[:-1])
            sym, word = sym[keep], word[keep]
        word, sym = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_word, done_sym))
        order = np.argsort(word, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(pieces)))])

    def learn(self, pieces: list[str]) -> None:
        """Remembers number of tokens, ids and tokens (joined by a space) of new pieces."""
        ids, off = self.merge([p.encode() for p in pieces])
        ids, off = ids.tolist(), off.tolist()
        names, numbers = [self.tokens[i] for i in ids], list(map(str, ids))
        for piece, i, j in zip(pieces, off, off[1:]):
            self.known[piece] = (j - i, " ".join(numbers[i:j]), " ".join(names[i:j]))

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.piece.findall(text.lower())

    def split(self, text: str) -> list[str]:
        """Pieces of a text in order; special tokens stand alone, as upper case so that no piece equals one."""
        if self.marks is None or "<|" not in text:
            return self._pieces(text)
        out = []
        for i, part in enumerate(self.marks.split(text)):
            out += [part.upper()] if i % 2 else self._pieces(part)
        return out

    def encode(self, batch: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of tokens, ids joined by a space, decoded text."""
        cut = [self.split(t) for t in batch]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            new = set().union(*cut)
        for s, i in self.special.items():
            self.known[s.upper()] = (1, str(i), s)
            new.discard(s.upper())
        if new:
            self.learn(list(new))
        out = []
        for parts in cut:
            n, ids, names = zip(*map(self.known.__getitem__, parts)) if parts else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(names)))
        return out


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with ``FIELDS``: token count, SHA-256 of the decimal ids and of the decoded text.

    ``path`` is a vocabulary file that every executor can read. Ids are those of the tokenizers
    library without added special tokens, so special strings in a text are matched as one
    token; without a decoder the decoded text is the tokens joined by spaces. A null text
    counts as empty: no token, hashes of the empty string. Repeated rows give equal results,
    other columns are ignored and an empty table gives an empty result.
    """

    def make():
        bpe = WordBpe(path)

        def of(arr: pa.Array) -> list[pa.Array]:
            n, ids, text = zip(*bpe.encode(arr.to_pylist()), strict=True)
            digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
            return [pa.array(n, pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array(map(digest, text), pa.string())]

        return of

    return map_text(texts(docs, id_col, text_col), make, FIELDS)
