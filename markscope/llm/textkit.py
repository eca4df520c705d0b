"""Vectorised text helpers for tasks: Arrow string columns to word boundaries and word hashes.

Everything here works on one bounded slice of an Arrow batch at a time (``slices``), so memory
stays proportional to ``max_bytes`` (or to the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

#: ASCII white space of ``[\x20\x09-\x0D]``; every other byte belongs to a word.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x41:0x5B] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True

#: 0: white space and control bytes, 1: letters, digits and all of a non-ASCII character, 2: other visible bytes.
TOKEN_KIND = np.full(256, 2, dtype=np.uint8)
TOKEN_KIND[:0x21] = 0
TOKEN_KIND[0x7F] = 0
TOKEN_KIND[ALNUM_WORD] = 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _mix_int(x: int) -> int:
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


#: A random 64-bit value for each byte, A-Z as a-z (from a rule, so that all workers agree).
BYTE_VALUE = np.array([_mix_int(int(LOWER[i]) + 1) for i in range(256)], dtype=U64)
#: The same without folding case.
CASE_VALUE = np.array([_mix_int(i + 1001) for i in range(256)], dtype=U64)
BASE = _mix_int(977) | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE_BYTES + 1), U64(base), dtype=U64)
        p[0] = 1
        have = np.cumprod(p)
        if n <= 4 * SLICE_BYTES:
            _POWERS[name] = have
    return have


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    kind = np.int64 if wide else np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], dtype=kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def slices(off: np.ndarray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` (one row at least)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + max_bytes, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_bounds(data: np.ndarray, off: np.ndarray, kinds: np.ndarray):
    """Starts and ends of the words, and each row's first word (``len(off)`` entries).

    ``kinds`` maps a byte to its kind, 0 (or False) outside words; a word is a run of one kind.
    ``off`` starts at 0.  A word never crosses rows.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    k = kinds[data]
    inside = k != 0
    change = k[1:] != k[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= change
    last[:-1] &= change
    full = off[1:] > off[:-1]
    head, tail = off[:-1][full], off[1:][full] - 1
    first[head] = inside[head]
    last[tail] = inside[tail]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over random byte values, then mixed."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    n = len(data)
    c = np.empty(n + 1, dtype=U64)
    c[0] = 0
    np.cumsum(value[data] * _powers("up", BASE, n)[:n], out=c[1:])
    h = (c[ends] - c[starts]) * _powers("down", BASE_INV, n)[starts]
    return mix(h + (ends - starts).astype(U64))


def take_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lengths)


def lower_text(text: str | None) -> str:
    """A-Z to a-z, nothing else."""
    return (text or "").translate(_LOWER_TABLE)


_LOWER_TABLE = {i: i + 32 for i in range(0x41, 0x5B)}
