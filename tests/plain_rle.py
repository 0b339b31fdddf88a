"""Run lengths mask by mask, as the tests' plain versions."""

from __future__ import annotations

import numpy as np


def pack(counts: list[int]) -> str:
    """Five bits to a character from '0' on, lowest first; from the third run on, the change against the run two before."""
    out = []
    for i, c in enumerate(counts):
        x = int(c) - (int(counts[i - 2]) if i > 2 else 0)
        while True:
            bits, x = x & 31, x >> 5
            done = x == -1 if bits & 16 else x == 0
            out.append(chr(48 + (bits if done else bits | 32)))
            if done:
                break
    return "".join(out)


def unpack(text: str) -> list[int]:
    counts: list[int] = []
    at = 0
    while at < len(text):
        x = shift = 0
        while True:
            bits = ord(text[at]) - 48
            at += 1
            x |= (bits & 31) << shift
            shift += 5
            if not bits & 32:
                if bits & 16:
                    x -= 1 << shift
                break
        counts.append(x + (counts[-2] if len(counts) > 2 else 0))
    return counts


def runs(mask: np.ndarray) -> list[int]:
    """Run lengths down the columns, zeros first."""
    flat = mask.astype(np.int8).ravel(order="F")
    edges = np.flatnonzero(np.diff(flat)) + 1
    lengths = np.diff(np.r_[0, edges, len(flat)]).tolist() if len(flat) else []
    return ([0] if len(flat) and flat[0] else []) + lengths


def mask_of(counts: list[int], height: int, width: int) -> np.ndarray:
    values = np.arange(len(counts)) % 2
    return np.repeat(values, counts).astype(bool).reshape((height, width), order="F")


def polygon_mask(points: list[float], height: int, width: int) -> np.ndarray:
    """Pixels whose centre is inside a polygon x0, y0, x1, y1, ..., by the even-odd rule."""
    xs, ys = np.array(points[0::2], dtype=float), np.array(points[1::2], dtype=float)
    px, py = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), dtype=bool)
    for x0, y0, x1, y1 in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1)):
        if y0 != y1:
            crosses = (y0 > py) != (y1 > py)
            inside ^= crosses & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0)
    return inside


def decode_any(segmentation, height: int, width: int) -> np.ndarray:
    """A packed or plain run-length dict, a list of polygons, or nothing; turned where it is width by height."""
    if isinstance(segmentation, dict):
        counts = segmentation["counts"]
        h, w = segmentation["size"]
        m = mask_of(unpack(counts) if isinstance(counts, str) else counts, h, w)
        return m.T if m.shape != (height, width) and m.shape == (width, height) else m
    m = np.zeros((height, width), dtype=bool)
    for polygon in segmentation or ():
        m |= polygon_mask(polygon, height, width)
    return m
