"""Vectorised byte, word and shingle kernels over blocks of UTF-8 text.

Every kernel takes the concatenated bytes of many texts and their offsets, so that
NumPy works on megabytes at a time and no per-word Python code runs.  Texts never
run into each other: words, lines and windows end at the offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd 64-bit value for each byte; FOLDED gives A-Z the values of a-z.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)

#: Bytes of words: all but space and \x09-\x0D.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words: 0-9, a-z, A-Z and all of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, r in enumerate((_R, _RINV)):
            a = np.full(size, r, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes in place."""
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(off: np.ndarray, most: int = 1 << 20):
    """Ranges of texts of about `most` bytes together; one long text makes a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the offsets of each text's words."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    m = table[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    st = np.flatnonzero(m & (edge[:-1] | ~np.concatenate(([False], m[:-1]))))
    en = np.flatnonzero(m & (edge[1:] | ~np.concatenate((m[1:], [False])))) + 1
    return st, en, np.searchsorted(st, off)


def prefix(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash and window hashes come."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [st, en)."""
    return mix((pre[en] - pre[st]) * powers(len(pre))[1][st] + (en - st).astype(np.uint64) * COEF[63])


def window_starts(wo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices at which k words of one text follow each other, and each text's offsets in them."""
    count = np.maximum(0, np.diff(wo) - (k - 1))
    o = np.concatenate(([0], np.cumsum(count)))
    return np.arange(o[-1]) + np.repeat(wo[:-1] - o[:-1], count), o


def gram_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k word hashes from each index on; k is part of the hash."""
    out = np.full(len(at), k, np.uint64) * COEF[62]
    for j in range(k):
        out += h[at + j] * COEF[j]
    return mix(out)


def shingles(buf: np.ndarray, off: np.ndarray, k: int, table: np.ndarray = SPACED) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles, A-Z lower-cased; fewer words make one shingle, none an empty set."""
    out = []
    for a, b in pieces(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        st, en, wo = words(part, o, table)
        h = span_hash(prefix(part, FOLDED), st, en)
        at, so = window_starts(wo, k)
        s = gram_hash(h, at, k)
        for d in range(b - a):
            n = int(wo[d + 1] - wo[d])
            if 0 < n < k:
                out.append(gram_hash(h, wo[d : d + 1], n))
            else:
                out.append(np.unique(s[so[d] : so[d + 1]]))
    return out
