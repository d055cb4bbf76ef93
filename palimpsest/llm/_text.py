"""Array kernels over UTF-8 text: words, rolling hashes, shingles.

A batch of texts is one byte array with offsets; all steps work on whole arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded to arrays at a time (a longer text is taken alone).
CHUNK = 1 << 20

_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection of 64-bit words."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words."""
    return mix(np.arange(n, dtype=np.uint64) * _GOLD + np.uint64(seed))


def _byte_words() -> np.ndarray:
    t = stream(256, 11)
    t[65:91] = t[97:123]  # A-Z count as a-z
    return t


_BYTE = _byte_words()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Cache(dict):
    """Kept in each process; a function that goes to another process takes none of it along."""

    def __reduce__(self):
        return Cache, ()


_powers: dict[str, np.ndarray] = Cache()


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if _powers.get("n", np.zeros(1))[0] < n:
        size = max(n, CHUNK)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
        _powers["n"] = np.array([size])
    return _powers["up"], _powers["down"]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about limit bytes; null is empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    if column.null_count:  # bytes under a null don't count
        lens = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offs), 0)
        if (np.diff(offs) != lens).any():
            yield from chunks(column.fill_null(b""), limit)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def trim() -> None:
    """Give freed memory back to the system, so that a reused worker doesn't hold what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def words(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that aren't white space."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~space[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum of a polynomial in random byte words."""
    n = len(buf)
    up, down = _power(max(n, 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[buf] * up[:n], dtype=np.uint64, out=total[1:])
    h = total[end] - total[start]
    h *= down[np.minimum(start, max(n - 1, 0))]
    return mix(h + (end - start).astype(np.uint64))


def shingles(buf: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of lower-cased words by row: (hashes sorted within each row, offsets).

    A row of fewer words has its whole sequence as one shingle, a row without words none.
    """
    start, end, row = words(buf, offs)
    rows = len(offs) - 1
    h = span_hash(buf, start, end)
    per = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(per)))
    with np.errstate(over="ignore"):
        roll = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for k in range(width if len(roll) else 0):
            roll = roll * np.uint64(_BASE) + h[k : k + len(roll)]
        roll = mix(roll)
        out = []
        for r in range(rows):
            a, b = first[r], first[r + 1]
            if b - a >= width:
                out.append(np.unique(roll[a : b - width + 1]))
            elif b > a:
                x = np.uint64(b - a)
                for v in h[a:b]:
                    x = x * np.uint64(_BASE) + v
                out.append(mix(np.array([x])))
            else:
                out.append(h[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else h[:0]), np.concatenate(([0], np.cumsum(sizes)))
