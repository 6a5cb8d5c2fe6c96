"""Byte-level tokenising and hashing of whole Arrow string columns with numpy.

Words are runs of non-separator bytes of UTF-8. A separator class made of ASCII
bytes only gives the same words on bytes as on code points, because every byte
of a multi-byte character is 0x80 or more.

Everything works on the raw buffers of an Arrow column, so that no Python string
is made. Buffers are handled in segments of about ``SEGMENT`` bytes, cut between
words, so memory stays bounded whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random odd 64-bit value for each byte.
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)

_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32

#: Words of contract 3: runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of contract 5: ASCII letters and digits, and everything beyond ASCII.
WORDISH = np.zeros(256, bool)
WORDISH[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            out = []
            for base in (BASE, INVERSE):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
        _powers[size] = tuple(out)
    a, b = _powers[size]
    return a[:n], b[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is_null) of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    null = np.zeros(n, bool) if column.null_count == 0 else np.asarray(column.is_null())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if off is not None and n else np.zeros(n + 1, np.int64)
    start, end = int(offsets[0]), int(offsets[-1])
    flat = np.frombuffer(data, np.uint8, end - start, start) if data is not None and end > start else np.zeros(0, np.uint8)
    return flat, offsets - start, null


def words(flat: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: (start, end) byte positions, a 64-bit hash of each
    (ASCII letters folded to lower case), and the texts' bounds in these arrays."""
    n, parts = len(flat), []
    is_start = np.zeros(n + 1, bool)
    is_start[offsets] = True
    at = 0
    while at < n:
        stop = min(n, at + SEGMENT)
        while stop < n and not (is_start[stop] or not table[flat[stop]]):
            # the word across the cut belongs to this segment
            ahead = flat[stop : stop + 4096]
            free = np.flatnonzero(~table[ahead] | is_start[stop : stop + len(ahead)])
            stop += int(free[0]) if len(free) else len(ahead)
        seg = flat[at:stop]
        inside = table[seg]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        first = is_start[at:stop]
        begins = np.flatnonzero(inside & (~before | first))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:] & ~first[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        if len(begins):
            with np.errstate(over="ignore"):
                power, inverse = powers(len(seg) + 1)
                total = np.empty(len(seg) + 1, np.uint64)
                total[0] = 0
                np.cumsum(BYTE_VALUE[_ASCII_LOWER[seg]] * power[: len(seg)], out=total[1:])
                value = (total[ends] - total[begins]) * inverse[begins]
            parts.append((begins + at, ends + at, mix(value)))
        at = stop
    if parts:
        begins, ends, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        begins = ends = np.zeros(0, np.int64)
        value = np.zeros(0, np.uint64)
    return begins, ends, value, np.searchsorted(begins, offsets)


def ngrams(value: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive word hashes."""
    m = len(value) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + value[i : i + m]
    return mix(out)


def whole(value: np.ndarray) -> int:
    """A hash of a whole sequence of word hashes, unlike that of any run of n."""
    return int(mix(np.array([len(value) + 0x5851F42D], np.uint64))[0]) ^ (int(ngrams(value, len(value))[0]) if len(value) else 0)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 21):
    """Slices of a batch with about ``limit`` bytes of text each, at least a row."""
    flat, offsets, _ = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit)))
        yield batch.slice(at, min(stop, batch.num_rows) - at)
        at = stop
