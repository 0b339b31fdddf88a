"""Areas of unions of boxes and mean gradients in boxes, by summed-area tables.

A table over the boxes' own edges (not over pixels) holds the union's area below and left of every corner; a window reads it at its four corners.
The tables of all images of a slice of a batch are made together, without a Python loop over images.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column

from .runs import arrow_udf

#: Cells of tables held at a time; images with larger tables are cut into strips.
CELLS = 4_000_000


def _flat(lists: pa.Array, names: str) -> tuple[np.ndarray, np.ndarray]:
    """Each element's row, and its fields as columns of whole numbers."""
    sizes, items = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()
    return np.repeat(np.arange(len(lists)), sizes), np.stack([items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1).reshape(-1, len(names))


def _ragged_sum(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums before each element, from 0 in every run."""
    before = np.cumsum(values) - values
    return before - np.repeat(before[starts], sizes)


class _Axis:
    """The distinct places of each image along one axis, sorted; all images one after the other."""

    def __init__(self, image: np.ndarray, places: np.ndarray, images: int):
        self.low = int(places.min())
        self.span = int(places.max()) - self.low + 2
        keys = np.unique(image * self.span + places - self.low)
        self.keys, self.value = keys, keys % self.span + self.low
        self.n = np.bincount(keys // self.span, minlength=images)
        self.first = np.cumsum(self.n) - self.n
        self.step = np.diff(self.value, append=0)
        self.step[(self.first + self.n - 1)[self.n > 0]] = 0

    def find(self, image: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number, within the image, of the last place not beyond each given one, and how far beyond it is; before the first: the first."""
        inside = np.clip(places, self.value[self.first[image]], self.value[self.first[image] + self.n[image] - 1])
        at = np.searchsorted(self.keys, image * self.span + inside - self.low, side="right") - 1
        return at - self.first[image], inside - self.value[at]


def union_pixels(image: np.ndarray, boxes: np.ndarray, wimage: np.ndarray, windows: np.ndarray, images: int) -> np.ndarray:
    """How much of each window (l, t, r, b) its image's boxes cover together."""
    out = np.zeros(len(windows), dtype=np.int64)
    good = (boxes[:, 0] < boxes[:, 2]) & (boxes[:, 1] < boxes[:, 3])
    image, boxes = image[good], boxes[good]
    asked = np.flatnonzero((windows[:, 0] < windows[:, 2]) & (windows[:, 1] < windows[:, 3]) & (np.bincount(image, minlength=images)[wimage] > 0))
    if not len(asked):
        return out
    # Images are taken together up to CELLS; one with more is halved by its boxes' middle.
    n = np.bincount(image, minlength=images)
    cells = 4 * n**2
    part = (np.cumsum(cells) - cells) // CELLS
    if len(np.unique(part[n > 0])) > 1 or (cells.max() > CELLS and len(np.unique(boxes[:, [0, 2]])) > 3):
        for p in np.unique(part[n > 0]):
            b, w = part[image] == p, asked[part[wimage[asked]] == p]
            mine, theirs = image[b], boxes[b]
            if not len(w):
                continue
            if cells[mine].max() <= CELLS or len(np.unique(theirs[:, [0, 2]])) <= 3:
                out[w] = _summed(mine, theirs, wimage[w], windows[w], images)
                continue
            middle = int(np.median(np.unique(theirs[:, [0, 2]])))
            for side, cut in ((2, np.minimum), (0, np.maximum)):
                b2, w2 = theirs.copy(), windows[w].copy()
                b2[:, side], w2[:, side] = cut(b2[:, side], middle), cut(w2[:, side], middle)
                out[w] += union_pixels(mine, b2, wimage[w], w2, images)
        return out
    out[asked] = _summed(image, boxes, wimage[asked], windows[asked], images)
    return out


def _summed(image: np.ndarray, boxes: np.ndarray, wimage: np.ndarray, windows: np.ndarray, images: int) -> np.ndarray:
    two = np.concatenate([image, image])
    x, y = _Axis(two, np.concatenate([boxes[:, 0], boxes[:, 2]]), images), _Axis(two, np.concatenate([boxes[:, 1], boxes[:, 3]]), images)
    size = x.n * y.n
    first = np.cumsum(size) - size
    # Corners in two orders: column by column (a) and row by row (b).
    of = np.repeat(np.arange(images), size)
    inner = np.arange(int(size.sum())) - first[of]
    ax, ay = inner // y.n[of], inner % y.n[of]
    to_b = first[of] + ay * x.n[of] + ax
    to_a = np.empty_like(to_b)
    to_a[to_b] = np.arange(len(to_b))
    edges = [x.find(image, boxes[:, 0])[0], y.find(image, boxes[:, 1])[0], x.find(image, boxes[:, 2])[0], y.find(image, boxes[:, 3])[0]]
    mark = np.zeros(len(of), dtype=np.int64)
    for i, j, sign in ((0, 1, 1), (2, 1, -1), (0, 3, -1), (2, 3, 1)):
        mark += sign * np.bincount(first[image] + edges[i] * y.n[image] + edges[j], minlength=len(mark))
    # Every column's and row's marks add up to 0, so running sums need no new start.
    held = np.cumsum(np.cumsum(mark)[to_a])[to_b] > 0
    area = held * x.step[x.first[of] + ax] * y.step[y.first[of] + ay]
    column = np.flatnonzero(ay == 0)
    below = _ragged_sum(area, column, np.diff(np.append(column, len(area))))
    by_row = below[to_a]
    row = np.flatnonzero(ax[to_a] == 0)
    table = _ragged_sum(by_row, row, np.diff(np.append(row, len(area))))[to_b]

    def under(px: np.ndarray, py: np.ndarray) -> np.ndarray:
        (i, dx), (j, dy) = x.find(wimage, px), y.find(wimage, py)
        at = first[wimage] + i * y.n[wimage] + j
        right, up = np.where(dx > 0, at + y.n[wimage], at), np.where(dy > 0, at + 1, at)
        sx, sy = np.maximum(x.step[x.first[wimage] + i], 1), np.maximum(y.step[y.first[wimage] + j], 1)
        return table[at] + (table[right] - table[at]) // sx * dx + (table[up] - table[at]) // sy * dy + held[at] * dx * dy

    l, t, r, b = windows.T
    return under(r, b) - under(l, b) - under(r, t) + under(l, t)


def _list_like(values: np.ndarray, rows: np.ndarray, n: int, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def covered_pixels(boxes: Column | str, windows: Column | str) -> Column:
    """For arrays of boxes (l, t, r, b; null for none) and of windows: an array of what of each window the boxes cover together."""

    @arrow_udf("array<bigint>")
    def run(b: pa.Array, w: pa.Array) -> pa.Array:
        (image, found), (wimage, asked) = _flat(b, "ltrb"), _flat(w, "ltrb")
        return _list_like(union_pixels(image, found, wimage, asked, len(w)), wimage, len(w), pa.int64())

    return run(boxes, windows)


def mean_gradients(values: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The mean gradient of the picture cut to each box (clipped to it): central differences inside, one-sided at the cut's own edges; 0 if a side is below 2.

    Sums come from tables: one of the inside, and running sums of what pixels have where they lie on a cut's left, right, upper or lower edge.
    """
    h, w = values.shape
    l, t, r, b = np.clip(boxes[:, 0], 0, w), np.clip(boxes[:, 1], 0, h), np.clip(boxes[:, 2], 0, w), np.clip(boxes[:, 3], 0, h)
    fx, fy = np.zeros((h, w)), np.zeros((h, w))
    fx[:, :-1], fy[:-1] = np.diff(values, axis=1), np.diff(values, axis=0)
    bx, by = np.roll(fx, 1, axis=1), np.roll(fy, 1, axis=0)
    cx, cy = (fx + bx) / 2, (fy + by) / 2
    inside = np.pad(np.hypot(cx, cy), ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    # By where a pixel lies: at the left or right edge, summed down; at the upper or lower, summed across.
    left, right = (np.pad(np.hypot(g, cy), ((1, 0), (0, 0))).cumsum(axis=0) for g in (fx, bx))
    upper, lower = (np.pad(np.hypot(cx, g), ((0, 0), (1, 0))).cumsum(axis=1) for g in (fy, by))
    fine = (r - l >= 2) & (b - t >= 2)
    l, t, r, b = l[fine], t[fine], r[fine], b[fine]
    total = inside[b - 1, r - 1] - inside[t + 1, r - 1] - inside[b - 1, l + 1] + inside[t + 1, l + 1]
    total += left[b - 1, l] - left[t + 1, l] + right[b - 1, r - 1] - right[t + 1, r - 1]
    total += upper[t, r - 1] - upper[t, l + 1] + lower[b - 1, r - 1] - lower[b - 1, l + 1]
    total += np.hypot(fx[t, l], fy[t, l]) + np.hypot(bx[t, r - 1], fy[t, r - 1]) + np.hypot(fx[b - 1, l], by[b - 1, l]) + np.hypot(bx[b - 1, r - 1], by[b - 1, r - 1])
    out = np.zeros(len(boxes))
    out[fine] = total / ((r - l) * (b - t))
    return out


def _partial_gradients(values: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """As :func:`mean_gradients`, of a picture whose missing pixels are NaN: a pixel beside one is at an edge, and one between two of them counts not at all."""
    out = np.zeros(len(boxes))
    for i, (l, t, r, b) in enumerate(np.maximum(boxes, 0)):
        v = values[t:b, l:r]
        if v.size:
            sides = []
            for axis in (0, 1):
                wide = np.pad(v, 1, constant_values=np.nan)
                before, after = (np.roll(wide, s, axis)[1:-1, 1:-1] for s in (1, -1))
                sides.append(np.where(np.isnan(before), after - v, np.where(np.isnan(after), v - before, (after - before) / 2)))
            size = np.hypot(*sides)
            there = ~np.isnan(size)
            out[i] = size[there].mean() if there.any() else 0.0
    return out


def box_gradients(pixels: Column | str, boxes: Column | str) -> Column:
    """For arrays of pixels (y, x, v; in any order; null for none) and of boxes: an array of each box's mean gradient."""

    @arrow_udf("array<double>")
    def run(p: pa.Array, q: pa.Array) -> pa.Array:
        (image, place), (bimage, boxes) = _flat(p, "yx"), _flat(q, "ltrb")
        v = p.flatten().field("v").to_numpy(zero_copy_only=False).astype(np.float64) if len(place) else np.zeros(0)
        out = np.zeros(len(boxes))
        first, ends = np.searchsorted(image, np.arange(len(q) + 1)), np.searchsorted(bimage, np.arange(len(q) + 1))
        for i in np.unique(bimage):
            mine = slice(first[i], first[i + 1])
            if first[i] < first[i + 1]:
                y, x = place[mine].T
                grid = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
                grid[y, x] = v[mine]
                mean = _partial_gradients if np.isnan(grid).any() else mean_gradients
                out[ends[i] : ends[i + 1]] = mean(grid, boxes[ends[i] : ends[i + 1]])
        return _list_like(out, bimage, len(q), pa.float64())

    return run(pixels, boxes)
