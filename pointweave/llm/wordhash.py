"""Words of Arrow text columns as 64-bit hashes, by whole arrays instead of by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time (a longer text is still handled whole).
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def white_space() -> np.ndarray:
    """Bytes that part words: space and the five ASCII controls."""
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    return gap


def non_letters() -> np.ndarray:
    """Every ASCII byte that is no letter or digit parts words."""
    gap = np.zeros(256, bool)
    gap[:128] = [not chr(c).isalnum() for c in range(128)]
    return gap


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds) of consecutive parts of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z folded, and the bounds of each row's words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    first = first[:-1]
    begins = inside & first
    begins[1:] |= inside[1:] & ~inside[:-1]
    starts = np.flatnonzero(begins)
    ends_here = np.ones(len(data), bool)
    ends_here[:-1] = ~inside[1:] | first[1:]
    ends = np.flatnonzero(inside & ends_here) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * powers("up", len(data) + 1)[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * powers("down", len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, bounds)
