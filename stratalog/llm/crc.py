"""CRC-32 of many byte runs at once: of words, and of words put together, without building the joined text.

CRC-32 is linear over bits, so the checksum of A followed by B is that of A moved on by B's length, with that of B added.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Words up to this length go byte by byte, all at once; moves by so many bytes are one lookup in tables.
STEPS = 64


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_BYTE = _byte_table()


def _move_tables() -> np.ndarray:
    """[n, k, v]: where byte ``k`` with value ``v`` of a checksum goes when ``n`` zero bytes follow."""
    out = np.empty((STEPS + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(STEPS):
        out[n + 1] = _BYTE[out[n] & 255] ^ (out[n] >> 8)
    return out.reshape(-1)


_MOVE = _move_tables()


def bounds(data: np.ndarray, off: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each longest run of bytes that ``solid`` (256 flags) marks, inside the rows that ``off`` bounds; the first run of each row and their number."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    on = solid[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = on.copy()
    starts[1:] &= ~on[:-1] | edge[1:n]
    ends = on.copy()
    ends[:-1] &= ~on[1:] | edge[1:n]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each of the byte ranges."""
    lengths = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-np.minimum(lengths, STEPS + 1), kind="stable")
    n_long = int((lengths > STEPS).sum())
    for i in order[:n_long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = order[n_long:]
    at, left = starts[order], lengths[order]
    value = np.full(len(order), 0xFFFFFFFF, np.uint32)
    fewer = np.searchsorted(-left, -np.arange(STEPS + 1), side="left")  # how many ranges are longer than 0, 1, ...
    for step in range(int(left[0]) if len(left) else 0):
        m = int(fewer[step])
        value[:m] = _BYTE[(value[:m] ^ data[at[:m] + step]) & 255] ^ (value[:m] >> 8)
    out[order] = ~value
    return out


def appended(crc: np.ndarray, byte: int) -> np.ndarray:
    """The checksums with one more byte."""
    raw = ~crc
    return ~(_BYTE[(raw ^ np.uint32(byte)) & 255] ^ (raw >> 8))


def joined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The checksums of ``first``'s bytes followed by those of ``second``, which have ``lengths`` bytes."""
    value, left = first.copy(), lengths.astype(np.int64)
    todo = np.arange(len(value))
    while len(todo):
        n = np.minimum(left[todo], STEPS)
        base, v = n * 1024, value[todo]
        value[todo] = _MOVE[base + (v & 255)] ^ _MOVE[base + 256 + ((v >> 8) & 255)] ^ _MOVE[base + 512 + ((v >> 16) & 255)] ^ _MOVE[base + 768 + (v >> 24)]
        left[todo] -= n
        todo = todo[left[todo] > 0]
    return value ^ second
