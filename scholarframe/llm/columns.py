"""Arrow string columns as flat byte arrays, and word arithmetic on them.

The helpers work on one Arrow batch inside a task: the texts lie end to end in
one ``uint8`` array, so that whole batches are handled by array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values, and ``n + 1`` offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


#: Bytes of texts that a task turns into arrays at a time.
SLICE = 256 << 10


def slices(column: pa.Array, limit: int = SLICE):
    """``(first, stop)`` row ranges of at most ``limit`` bytes each, or of one row."""
    n = len(column)
    if not n:
        return
    sizes = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    total, first = np.r_[0, np.cumsum(sizes)], 0
    while first < n:
        stop = max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1)
        yield first, min(stop, n)
        first = min(stop, n)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i < n``; kept for the next batch unless longer than a slice."""
    if base not in _POWERS or n > len(_POWERS[base]):
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > SLICE + 1:
            return out[:n]
        _POWERS[base] = out
    return _POWERS[base][:n]


#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A random odd number for each byte.
BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the high bits of a polynomial hash over the low ones."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes.

    Unlike ranges may have equal ones too, and some texts make that certain, so
    whoever needs equality compares the bytes as well: see :func:`same_bytes`.
    """
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * powers(BASE, len(buf)), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(INVERSE, len(buf) + 1)[starts] + (ends - starts).astype(np.uint64))


def gathered(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many ranges end to end."""
    total = np.cumsum(size)
    return buf[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)]


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Whether each range of ``a`` holds the bytes of the range of ``b`` beside it; about ``at_once`` bytes are compared at a time."""
    same = a_size == b_size
    own = np.flatnonzero(same & (a_size > 0))
    total, first = np.cumsum(a_size[own]), 0
    while first < len(own):
        stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + at_once, "right")))
        k = own[first:stop]
        unlike = gathered(a, a_start[k], a_size[k]) != gathered(b, b_start[k], b_size[k])
        if unlike.any():
            same[k[np.searchsorted(np.cumsum(a_size[k]), np.flatnonzero(unlike), "right")]] = False
        first = stop
    return same


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true, which never cross a row's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.r_[inside[1:], False]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends
