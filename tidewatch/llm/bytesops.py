"""Vectorised work on the UTF-8 bytes of Arrow text columns; everything here runs inside tasks, on one batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A 64-bit odd base for rolling hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 21:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit value for each byte, from a rule.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_lower = np.arange(256)
_lower[65:91] += 32
LOWER_VALUES = BYTE_VALUES[_lower]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    n, low = len(offsets) - 1, 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each byte (or item) the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums_to(values: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero."""
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes; a run ends with its row."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge) & (np.arange(len(data) + 1) < len(data)))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial."""
    sums = sums_to(values[data] * _power(BASE, len(data), "up"))
    return mix((sums[ends] - sums[starts]) * _power(INVERSE, len(data) + 1, "down")[starts] + (ends - starts).astype(U64))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``size``-word shingles of each row, sorted by row and hash.

    A-Z count as a-z. A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    starts, ends = words(data, offsets)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, U64)
    each = span_hashes(data, starts, ends, LOWER_VALUES)
    row = np.searchsorted(offsets, starts, "right") - 1
    padded = np.concatenate([each, np.zeros(size, U64)])
    same = np.concatenate([row, np.full(size, -1)])
    total, length = np.zeros(len(each), U64), np.zeros(len(each), np.int64)
    for j in range(size):
        own = same[j : j + len(each)] == row
        total = total * U64(BASE) + np.where(own, padded[j : j + len(each)], U64(0))
        length += own
    first = np.r_[True, row[1:] != row[:-1]]
    keep = (length == size) | first
    total, row = mix(total + length.astype(U64))[keep], row[keep]
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    fresh = np.r_[True, (total[1:] != total[:-1]) | (row[1:] != row[:-1])]
    return row[fresh], total[fresh]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
