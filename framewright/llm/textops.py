"""Numpy helpers on Arrow text columns: word spans and Rabin-Karp hashes of words and windows.

Texts are handled as UTF-8 bytes. The white space that separates words is ASCII, so splitting bytes
equals splitting code points. All hashes are 64-bit polynomials, the same in every task and run.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, CHUNK + 1), base, np.uint64)
        row[0] = 1
        have = _powers[base] = np.cumprod(row, dtype=np.uint64)
        if n > 8 * CHUNK:
            del _powers[base]
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def rolling(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers; hash of [s, e) is (sums[e] - sums[s]) * inverse[s]."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASE, n), out=sums[1:])
    return sums, powers(_INVERSE, n + 1)


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums, inverse = rolling(values)
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def pieces(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows holding about limit bytes; a null counts as empty.

    A row longer than limit comes alone and whole.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: a Python worker lives as long as its executor, and takes tasks of many kinds."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and row of every maximal run of bytes other than the six ASCII spaces."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~IS_SPACE[data]
    edge = np.ones(n + 1, bool)
    edge[1:n] = ~solid[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(solid & edge[:-1])
    edge[:n] = ~solid
    edge[offsets] = True
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return span_hash(_BYTE[_LOWER[data] if lower else data], starts, ends)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def windows(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of first word, hash) of every k consecutive words of one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return at, span_hash(hashes, at, at + k)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return starts, np.append(starts[1:], len(values))
