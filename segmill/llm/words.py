"""Words of a byte buffer as arrays: spans and hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0xD6E8FEB86659FD93)
_STEP = 12
_POWERS = np.cumprod(np.full(1 << _STEP, 0x100000001B3, dtype=np.uint64))
#: What a place of two and of three levels of ``_STEP`` bits adds.
_FAR = [np.cumprod(np.r_[np.uint64(1), np.full((1 << _STEP) - 1, p, dtype=np.uint64)], dtype=np.uint64) for p in (_POWERS[-1], pow(int(_POWERS[-1]), 1 << _STEP, 1 << 64))]


def lower_table(inside) -> np.ndarray:
    """Codes of bytes: A-Z as a-z, and 0 for those outside words."""
    table = np.zeros(256, dtype=np.uint8)
    for b in inside:
        table[b] = b + 32 if 65 <= b <= 90 else b
    return table


def word_spans(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of codes other than 0."""
    inside = np.concatenate([[False], code > 0, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def word_hashes(code: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes; the same bytes give the same hash anywhere."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sizes = stops - starts
    first = np.cumsum(sizes) - sizes
    inside = np.flatnonzero(code)
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    weight = _POWERS[place & (1 << _STEP) - 1]
    for level, powers in enumerate(_FAR, 1):
        if int(sizes.max()) > 1 << _STEP * level:
            weight = weight * powers[place >> _STEP * level & (1 << _STEP) - 1]
    return np.add.reduceat(code[inside].astype(np.uint64) * weight, first) * _ODD
