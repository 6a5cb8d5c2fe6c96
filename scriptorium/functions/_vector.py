"""Code points of whole Arrow batches as numpy arrays, for scalar functions that
would need many regular expressions each."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Code points handled at once.
SEGMENT = 1 << 20


def segments(texts: pd.Series):
    """(first, after, code points, bounds) of runs of rows, each of about SEGMENT
    code points and one row at least; a null is an empty text."""
    values = ["" if t is None or t != t else t for t in texts]
    at = 0
    while at < len(values):
        stop, size = at, 0
        while stop < len(values) and (stop == at or size + len(values[stop]) <= SEGMENT):
            size += len(values[stop])
            stop += 1
        own = values[at:stop]
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield at, stop, codes, np.concatenate([[0], np.cumsum([len(t) for t in own])]).astype(np.int64)
        at = stop


def sums(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of set marks of each row."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def lookup(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which code points below 65536 are in one of the closed ranges; all others are like the last, which is in none."""
    table = np.zeros(1 << 16, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    table[-1] = False
    return table


def member(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, 0xFFFF)]
