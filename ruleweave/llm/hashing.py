"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and ``\\t``-``\\r``; they are
hashed by a polynomial over random 64-bit byte values, modulo 2^64, followed by
a bit mixer.  Whole batches are handled by numpy: no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
BASE = int(_RNG.integers(0, 2**64, dtype=np.uint64)) | 1
CHAIN = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | U(1)
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes handled at once; a longer text is still handled whole, alone.
SLICE_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _powers[name] = np.multiply.accumulate(full)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a well-known 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h = h * U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if big else np.int32
    raw = column.buffers()
    if raw[1] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about SLICE_BYTES each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, split: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = split[data]
    before = np.ones(n, bool)
    before[1:] = white[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = True
    after = np.ones(n, bool)
    after[:-1] = white[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = True
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((BYTE_LOWER if lower else BYTE)[data] * _power("up", BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", pow(BASE, -1, 2**64), n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * CHAIN[63])


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of each document's first word (n + 1)."""
    starts, ends, first = word_spans(data, offsets)
    return hash_spans(data, starts, ends, lower), first


def chains(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of ``h``, whichever documents they are in."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1] * CHAIN[0]
    for j in range(1, k):
        out += h[j : len(h) - k + 1 + j] * CHAIN[j]
    return mix(out)


def shingle_sets(column: pa.Array, k: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles.

    Fewer than k words: the whole sequence is the one shingle (its length is
    hashed in, so it equals no full shingle).  No words: the empty set.
    """
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        h, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        s = chains(h, k)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= k:
                yield np.unique(s[lo : hi - k + 1])
            elif hi > lo:
                tail = np.uint64(hi - lo)
                for x in h[lo:hi]:
                    tail = mix(np.array([tail], np.uint64) * CHAIN[62] + x)[0]
                yield np.array([tail], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
