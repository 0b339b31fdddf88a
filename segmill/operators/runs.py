"""Masks as run lengths, without pixel arrays: areas, overlaps, unions, differences, codecs, polygons, holes and connected parts.

Run lengths are COCO's: down the columns, zeros first. Here they become spans [start, stop) of set places, sorted; set algebra is one sweep over the
spans' ends of many rows, so it costs runs, not pixels. All functions of columns work on Arrow batches, a slice of bounded size at a time.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a batch's columns that a function takes at a time, so that its arrays don't grow with a batch's rows.
SLICE = 1 << 19


def arrow_udf(kind: str, rows: int | None = None, cells=None):
    """Spark's arrow_udf of a function that gets a slice of at most SLICE bytes, and ``rows`` rows, (or a row) of its columns at a time.

    ``cells``, where a result is larger than what it is made of, tells the result's bytes; they are at most SLICE too.
    """

    def add(f):
        @functools.wraps(f)
        def run(*columns):
            def work(first: int, n: int) -> list[pa.Array]:
                mine = [c.slice(first, n) for c in columns]
                if n < 2 or (n <= (rows or n) and sum(c.nbytes for c in mine) <= SLICE and (cells is None or cells(*mine) <= SLICE)):
                    return [f(*mine)]
                return work(first, n // 2) + work(first + n // 2, n - n // 2)

            parts = work(0, len(columns[0]))
            return pa.concat_arrays(parts) if len(parts) > 1 else parts[0]

        return F.arrow_udf(run, kind)

    return add


def _lists(column: pa.Array, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Each element's row, and the elements."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(kind)


def _to_lists(row: np.ndarray, values: np.ndarray, n: int, kind=pa.int32(), null=None) -> pa.Array:
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind), mask=None if null is None else pa.array(null))


def _restart(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Running sums, from each row's own 0."""
    total = np.cumsum(values)
    first = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, dtype=np.int64)
    before = total[first] - values[first] if len(first) else np.zeros(0, dtype=np.int64)
    return total - np.repeat(before, np.diff(np.append(first, len(row))))


def _number(row: np.ndarray) -> np.ndarray:
    """Places of elements within their rows."""
    return _restart(np.ones(len(row), dtype=np.int64), row) - 1


def spans(row: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the set spans, without empty ones."""
    ends = _restart(counts, row)
    on = (_number(row) % 2 == 1) & (counts > 0)
    return row[on], (ends - counts)[on], ends[on]


def from_spans(row: np.ndarray, start: np.ndarray, stop: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, counts) of sorted, separate spans; those that touch become one. ``size``: places of each row's mask."""
    if len(row):
        same = (row[1:] == row[:-1]) & (start[1:] == stop[:-1])
        row, start, stop = row[np.r_[True, ~same]], start[np.r_[True, ~same]], stop[np.r_[~same, True]]
    last = np.zeros(len(size), dtype=np.int64)
    # Spans are sorted, so a row's last one stays.
    last[row] = stop
    before = np.where(np.diff(row, prepend=-1) != 0, 0, np.roll(stop, 1)) if len(row) else start
    rows = np.concatenate([np.repeat(row, 2), np.flatnonzero((last < size) | (size == 0))])
    values = np.concatenate([np.stack([start - before, stop - start], axis=1).ravel(), (size - last)[(last < size) | (size == 0)]])
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]


def sweep(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(row, start, stop, depths): pieces between neighbouring ends, and how many spans of each group cover a piece."""
    most = max((int(g[2].max()) for g in groups if len(g[2])), default=0) + 1
    keys = np.concatenate([np.concatenate([r * most + a, r * most + b]) for r, a, b in groups])
    if not len(keys):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, [none for _ in groups]
    # Each group's ends are sorted already, so this is a merge.
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    depths, at = [], 0
    for r, _, _ in groups:
        step = np.zeros(len(keys), dtype=np.int64)
        step[at : at + len(r)], step[at + len(r) : at + 2 * len(r)] = 1, -1
        depths.append(np.cumsum(step[order])[:-1])
        at += 2 * len(r)
    long = np.diff(keys) > 0
    row, start = np.divmod(keys[:-1][long], most)
    # A row's last end leaves nothing set, so no piece reaches into the next row but empty ones.
    return row, start, start + np.diff(keys)[long], [d[long] for d in depths]


def _totals(row: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, counts, n).astype(np.int64)


def overlap(a: Column | str, b: Column | str) -> Column:
    """struct(a, b, both): set places of two masks' run lengths, and of both at once."""

    @arrow_udf("struct<a:bigint,b:bigint,both:bigint>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        n, mine, other = len(x), spans(*_lists(x)), spans(*_lists(y))
        row, start, stop, (p, q) = sweep([mine, other], n)
        both = (p > 0) & (q > 0)
        sums = [_totals(g[0], g[2] - g[1], n) for g in (mine, other)] + [_totals(row[both], (stop - start)[both], n)]
        return pa.StructArray.from_arrays([pa.array(s) for s in sums], ["a", "b", "both"])

    return run(a, b)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(o: Column) -> Column:
    """Of an :func:`overlap`."""
    return _share(o["both"], o["a"] + o["b"] - o["both"])


def ios(o: Column) -> Column:
    return _share(o["both"], F.least(o["a"], o["b"]))


def inside(o: Column) -> Column:
    """The share of the first mask inside the second."""
    return _share(o["both"], o["a"])


def area(counts: Column | str) -> Column:
    @arrow_udf("bigint")
    def run(c: pa.Array) -> pa.Array:
        row, counts = _lists(c)
        return pa.array(_totals(row, counts * (_number(row) % 2), len(c)), mask=c.is_null().to_numpy(zero_copy_only=False))

    return run(counts)


def without(a: Column | str, painted: Column | str) -> Column:
    """Run lengths of a mask minus what is painted already."""

    @arrow_udf("array<int>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        rx, cx = _lists(x)
        row, start, stop, (p, q) = sweep([spans(rx, cx), spans(*_lists(y))], len(x))
        left = (p > 0) & (q == 0)
        return _to_lists(*from_spans(row[left], start[left], stop[left], _totals(rx, cx, len(x))), len(x))

    return run(a, painted)


def union(masks: Column | str) -> Column:
    """Run lengths of the union of an array of masks of one size."""

    return arrow_udf("array<int>")(_union)(masks)


def _union(m: pa.Array) -> pa.Array:
    n = len(m)
    outer = np.repeat(np.arange(n), pc.list_value_length(m).fill_null(0).to_numpy(zero_copy_only=False))
    inner, counts = _lists(m.flatten())
    row, start, stop = spans(inner, counts)
    row = outer[row] if len(row) else row
    order = np.lexsort((start, row))
    row, start, stop, (depth,) = sweep([(row[order], start[order], stop[order])], n)
    size = np.zeros(n, dtype=np.int64)
    np.maximum.at(size, outer, _totals(inner, counts, len(outer)))
    return _to_lists(*from_spans(row[depth > 0], start[depth > 0], stop[depth > 0], size), n)


# Codecs


def packed_bytes(row: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, characters): five bits to a character from '0' on, lowest first; from the third run on, the change against the run two before."""
    x = counts.copy()
    late = np.flatnonzero(_number(row) > 2)
    x[late] -= counts[late - 2]
    n = np.ones(len(x), dtype=np.int64)
    size = np.where(x < 0, ~x, x)
    for k in range(1, max(1, (int(size.max(initial=0)).bit_length() + 5) // 5)):
        n += size >= 1 << (5 * k - 1)
    owner = np.repeat(np.arange(len(x)), n)
    k = _number(owner)
    return row[owner], (48 + (x[owner] >> 5 * k & 31) + np.where(k < n[owner] - 1, 32, 0)).astype(np.uint8)


def unpacked(row: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, counts) of characters."""
    bits = codes.astype(np.int64) - 48
    last = np.flatnonzero(bits & 32 == 0)
    size = np.diff(last, prepend=-1)
    owner = np.repeat(np.arange(len(last)), size)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    used = bits[: len(owner)]
    x = np.bincount(owner, (used & 31) << 5 * k, len(last)).astype(np.int64)
    x -= np.where(used[last] & 16, 1 << 5 * size, 0)
    rows = row[last]
    # The runs of a row from the second on are sums of changes, odd ones and even ones apart.
    place, out = _number(rows), x.copy()
    for chain in (place % 2 == 1, (place % 2 == 0) & (place > 0)):
        out[chain] = _restart(x[chain], rows[chain])
    return rows, out


def _characters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = text.cast(pa.large_binary())
    sizes = pc.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(raw)), sizes), np.frombuffer(b"".join(x or b"" for x in raw.to_pylist()), dtype=np.uint8)


def pack(counts: Column | str) -> Column:
    """COCO's string of run lengths."""

    @arrow_udf("string")
    def run(c: pa.Array) -> pa.Array:
        row, codes = packed_bytes(*_lists(c))
        ends = np.searchsorted(row, np.arange(len(c) + 1)).astype(np.int32)
        null = c.is_null().to_numpy(zero_copy_only=False)
        text = pa.StringArray.from_buffers(len(c), pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes()))
        return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), text)

    return run(counts)


def unpack(text: Column | str) -> Column:
    """Run lengths of COCO's string."""

    @arrow_udf("array<int>")
    def run(t: pa.Array) -> pa.Array:
        row, counts = unpacked(*_characters(t))
        return _to_lists(row, counts, len(t), null=t.is_null().to_numpy(zero_copy_only=False))

    return run(text)


def of_bits(bits: Column | str, width: int) -> Column:
    """Run lengths of row-major pixels."""

    @arrow_udf("array<int>")
    def run(b: pa.Array) -> pa.Array:
        row, value = _lists(b)
        n = np.bincount(row, minlength=len(b))
        height, first, k = n // width, np.cumsum(n) - n, _number(row)
        down = np.maximum(height[row], 1)
        value = value[first[row] + k % down * width + k // down] > 0
        # A run begins where the value changes, and with every row; a row that begins with a 1 has an empty run of zeros first.
        begin = np.flatnonzero((k == 0) | np.r_[True, value[1:] != value[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(begin, len(row)))
        zero = begin[(k[begin] == 0) & value[begin]]
        rows, sizes = np.concatenate([row[zero], row[begin]]), np.concatenate([np.zeros(len(zero), dtype=np.int64), size])
        order = np.argsort(rows, kind="stable")
        return _to_lists(rows[order], sizes[order], len(b), null=b.is_null().to_numpy(zero_copy_only=False))

    return run(bits)


def to_bits(counts: Column | str, width: int) -> Column:
    """Row-major pixels of run lengths."""

    @arrow_udf("array<tinyint>", cells=lambda c: pc.sum(c.flatten()).as_py() or 0)
    def run(c: pa.Array) -> pa.Array:
        row, counts = _lists(c)
        value = np.repeat((_number(row) % 2).astype(np.int8), counts)
        pixel = np.repeat(row, counts)
        n = np.bincount(pixel, minlength=len(c))
        height, first, k = n // width, np.cumsum(n) - n, _number(pixel)
        return _to_lists(pixel, value[first[pixel] + k % width * height[pixel] + k // width], len(c), pa.int8(), c.is_null().to_numpy(zero_copy_only=False))

    return run(counts)


# Polygons


def polygon_spans(points: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Set spans, down the columns, of one polygon x0, y0, x1, y1, ... by COCO's rule.

    Its outline is drawn on a grid five times as fine; where it goes from one column of that grid to the next at a pixel column's middle,
    it crosses that column, and everything between two crossings (rows rounded up) is inside.
    """
    # Fixed value of the format: how much finer the outline's grid is.
    fine = 5.0
    xy = np.trunc(fine * points.reshape(-1, 2) + 0.5).astype(np.int64)
    u, v = [], []
    for (x0, y0), (x1, y1) in zip(xy, np.roll(xy, -1, axis=0)):
        dx, dy = abs(x1 - x0), abs(y1 - y0)
        steps = max(dx, dy)
        # Always drawn from the lower end of the longer side, so that an edge is the same in either direction.
        turned = (dx >= dy and x0 > x1) or (dx < dy and y0 > y1)
        (ax, ay), (bx, by) = ((x1, y1), (x0, y0)) if turned else ((x0, y0), (x1, y1))
        t = np.arange(steps + 1)
        if dx >= dy:
            line = (t + ax, np.trunc(ay + (by - ay) / max(dx, 1) * t + 0.5).astype(np.int64))
        else:
            line = (np.trunc(ax + (bx - ax) / dy * t + 0.5).astype(np.int64), t + ay)
        u.append(line[0][::-1] if turned else line[0])
        v.append(line[1][::-1] if turned else line[1])
    u, v = np.concatenate(u), np.concatenate(v)
    moved = np.flatnonzero(u[1:] != u[:-1])
    x = (np.where(u[moved + 1] < u[moved], u[moved + 1], u[moved + 1] - 1) + 0.5) / fine - 0.5
    y = (np.minimum(v[moved + 1], v[moved]) + 0.5) / fine - 0.5
    hit = (x == np.floor(x)) & (x >= 0) & (x <= width - 1)
    places = np.sort((x[hit] * height + np.ceil(np.clip(y[hit], 0, height))).astype(np.int64))
    if len(places) % 2:
        places = np.append(places, height * width)
    start, stop = places[::2], places[1::2]
    full = stop > start
    return start[full], stop[full]


def of_polygons(polygons: Column | str, height: Column | str, width: Column | str) -> Column:
    """Run lengths of the union of polygons (array<array<double>>) on a canvas; no polygons, an empty mask."""

    @arrow_udf("array<int>")
    def run(p: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        rows, starts, stops = [], [], []
        size = [(int(a), int(b)) for a, b in zip(h.to_pylist(), w.to_pylist())]
        for i, shapes in enumerate(p.to_pylist()):
            for points in shapes or ():
                if points and len(points) >= 6:
                    start, stop = polygon_spans(np.array(points[: len(points) // 2 * 2], dtype=np.float64), *size[i])
                    rows.append(np.full(len(start), i))
                    starts.append(start)
                    stops.append(stop)
        row, start, stop = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (rows, starts, stops))
        order = np.lexsort((start, row))
        row, start, stop, (depth,) = sweep([(row[order], start[order], stop[order])], len(p))
        return _to_lists(*from_spans(row[depth > 0], start[depth > 0], stop[depth > 0], np.array([a * b for a, b in size], dtype=np.int64)), len(p))

    return run(polygons, height, width)


def turned(counts: Column | str, height: Column | str) -> Column:
    """Run lengths of the transposed mask; ``height`` is the given one's."""

    @arrow_udf("array<int>")
    def run(c: pa.Array, h: pa.Array) -> pa.Array:
        row, counts = _lists(c)
        height, size = h.to_numpy(zero_copy_only=False).astype(np.int64), _totals(row, counts, len(c))
        row, start, stop = spans(row, counts)
        # A run along a row starts where a place is set and that of the column before isn't, and ends likewise.
        start, stop, by = start + height[row], stop + height[row], height[row]
        edges = []
        for shift in (by, -by):
            r, a, b, (here, beside) = sweep([(row, start, stop), (row, start + shift, stop + shift)], len(c))
            keep = (here > 0) & (beside == 0)
            r, a, n = r[keep], a[keep], (b - a)[keep]
            owner = np.repeat(np.arange(len(r)), n)
            x, y = np.divmod(a[owner] + _number(owner) - height[r[owner]], height[r[owner]])
            place = y * (size[r[owner]] // height[r[owner]]) + x
            order = np.lexsort((place, r[owner]))
            edges.append((r[owner][order], place[order]))
        (rows, first), (_, last) = edges
        return _to_lists(*from_spans(rows, first, last + 1, size), len(c), null=c.is_null().to_numpy(zero_copy_only=False))

    return run(counts, height)


def decode(packed: Column | str, counts: Column | str, polygons: Column | str, coded_height: Column | str, coded_width: Column | str, height: Column | str, width: Column | str) -> Column:
    """Run lengths on a height x width canvas of whichever form a label has: packed, plain run lengths (of coded_height x coded_width) or polygons.

    Run lengths of a width x height mask are turned; without any form the mask is empty.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    coded = F.coalesce(unpack(packed), c(counts).cast("array<int>"))
    swapped = (c(coded_height) == c(width)) & (c(coded_width) == c(height)) & (c(height) != c(width))
    # Python functions run for every row, so rows that don't need one give it a null.
    back = turned(F.when(swapped, coded), F.coalesce(c(coded_height), F.lit(1)))
    return F.coalesce(back, coded, of_polygons(polygons, height, width))


# Windows


def in_boxes(counts: Column | str, boxes: Column | str, height: int) -> Column:
    """How many set places lie in each box (l, t, r, b) of an array; 0 for a null mask."""

    @arrow_udf("array<bigint>")
    def run(c: pa.Array, q: pa.Array) -> pa.Array:
        return _in_boxes(c, q, height)

    return run(counts, boxes)


def union_in_boxes(masks: Column | str, boxes: Column | str, height: int) -> Column:
    """As :func:`in_boxes`, of the union of an array of masks. One function, as each one of a task has a Python process of its own."""

    @arrow_udf("array<bigint>")
    def run(m: pa.Array, q: pa.Array) -> pa.Array:
        return _in_boxes(_union(m), q, height)

    return run(masks, boxes)


def _in_boxes(c: pa.Array, q: pa.Array, height: int) -> pa.Array:
    row, x, y0, y1 = column_runs(*spans(*_lists(c)), np.full(len(c), height))
    sizes = pc.list_value_length(q).fill_null(0).to_numpy(zero_copy_only=False)
    items = q.flatten()
    asked = np.stack([items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in "ltrb"], axis=1).reshape(-1, 4)
    first, ends, out = np.searchsorted(row, np.arange(len(c) + 1)), np.r_[0, np.cumsum(sizes)], np.zeros(len(asked), dtype=np.int64)
    for i in np.flatnonzero((sizes > 0) & (np.diff(first) > 0)):
        mine = slice(first[i], first[i + 1])
        for k in range(ends[i], ends[i + 1]):
            l, t, r, b = asked[k]
            shared = np.minimum(y1[mine], b) - np.maximum(y0[mine], t)
            out[k] = shared[(shared > 0) & (x[mine] >= l) & (x[mine] < r)].sum()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def _resized(m: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest pixel by centres."""
    y, x = (((np.arange(n) + 0.5) * k / n).astype(np.int64) for n, k in ((height, m.shape[0]), (width, m.shape[1])))
    return m[y[:, None], x]


def placed(raw: Column | str, refined: Column | str, window: Column | str, width: int, canvas_width: int, canvas_height: int) -> Column:
    """What a refined mask of a window is on the image's canvas.

    struct(crf_iou: IoU of raw and refined; pixels and edges (top, bottom, left, right): set places of the window-sized mask, and on its edges; counts, area and
    inclusive box on the canvas). ``raw`` and ``refined`` are row-major, of ``width``; ``window`` is a struct l, t, r, b.
    """
    sides = "top", "bottom", "left", "right"
    corners = "rmin", "cmin", "rmax", "cmax"
    ints = lambda names: ",".join(f"{n}:int" for n in names)

    @arrow_udf(f"struct<crf_iou:double,pixels:bigint,edges:struct<{ints(sides)}>,counts:array<int>,area:bigint,box:struct<{ints(corners)}>>")
    def run(a: pa.Array, b: pa.Array, q: pa.Array) -> pa.Array:
        n = len(b)
        (arow, av), (brow, bv) = _lists(a), _lists(b)
        afirst, bfirst = np.searchsorted(arow, np.arange(n + 1)), np.searchsorted(brow, np.arange(n + 1))
        both = np.bincount(brow, (av > 0) & (bv > 0), n) if len(av) == len(bv) else np.array([((av[i:j] > 0) & (bv[k : k + j - i] > 0)).sum() for i, j, k in zip(afirst, afirst[1:], bfirst)])
        either = np.bincount(arow, av > 0, n) + np.bincount(brow, bv > 0, n) - both
        windows = np.stack([q.field(c).to_numpy(zero_copy_only=False) for c in "ltrb"], axis=1).astype(np.int64)
        pixels, edges, box = np.zeros(n, dtype=np.int64), np.zeros((n, 4), dtype=np.int32), np.zeros((n, 4), dtype=np.int32)
        rows, starts, stops = [], [], []
        for i, (l, t, r, e) in enumerate(windows.tolist()):
            m = bv[bfirst[i] : bfirst[i + 1]].reshape(-1, width) > 0
            if not m.size or r <= l or e <= t:
                continue
            m = _resized(m, e - t, r - l)
            pixels[i], edges[i] = m.sum(), (m[0].sum(), m[-1].sum(), m[:, 0].sum(), m[:, -1].sum())
            x0, y0 = max(l, 0), max(t, 0)
            seen = m[y0 - t : max(0, canvas_height - t), x0 - l : max(0, canvas_width - l)]
            if not seen.any():
                continue
            # Column by column, a row of zeros behind each, so that no run goes on in the next.
            flat = np.concatenate([[0], np.pad(seen, ((0, 1), (0, 0))).ravel(order="F").astype(np.int8)])
            on, off = np.flatnonzero(np.diff(flat) > 0), np.flatnonzero(np.diff(flat) < 0)
            x, y = np.divmod(on, len(seen) + 1)
            top = (x + x0) * canvas_height + y + y0
            rows.append(np.full(len(on), i))
            starts.append(top)
            stops.append(top + off - on)
            ys, xs = np.flatnonzero(seen.any(axis=1)), np.flatnonzero(seen.any(axis=0))
            box[i] = ys[0] + y0, xs[0] + x0, ys[-1] + y0, xs[-1] + x0
        row, start, stop = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (rows, starts, stops))
        area = np.bincount(row, stop - start, n).astype(np.int64)
        counts = _to_lists(*from_spans(row, start, stop, np.full(n, canvas_width * canvas_height)), n)
        pack_ints = lambda values, names: pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in values.T], list(names))
        iou_ = np.divide(both, either, out=np.zeros(n), where=either > 0)
        return pa.StructArray.from_arrays([pa.array(iou_), pa.array(pixels), pack_ints(edges, sides), counts, pa.array(area), pack_ints(box, corners)], ["crf_iou", "pixels", "edges", "counts", "area", "box"])

    return run(raw, refined, window)


# Connected parts


def column_runs(row: np.ndarray, start: np.ndarray, stop: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y0, y1): spans cut at the columns' ends."""
    if not len(row):
        return row, row, row, row
    h = height[row]
    many = (stop - 1) // h - start // h + 1
    owner = np.repeat(np.arange(len(row)), many)
    x = start[owner] // h[owner] + _number(owner)
    top = x * h[owner]
    return row[owner], x, np.maximum(start[owner], top) - top, np.minimum(stop[owner], top + h[owner]) - top


def labels(row: np.ndarray, x: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """The 4-connected part of every column run: the number of its first run. Runs are sorted by (row, x, y0).

    Runs of neighbouring columns that share a height are linked; labels go over links and over labels' labels until none changes, in rounds that
    grow with the logarithm of a part's runs.
    """
    n = len(row)
    label = np.arange(n)
    if not n:
        return label
    high = int(y1.max()) + 1
    column = row * (int(x.max()) + 3) + x + 1
    key0, key1 = column * high + y0, column * high + y1
    # Of the next column, the runs that end after this one's start and start before its end.
    first = np.searchsorted(key1, key0 + high, side="right")
    last = np.searchsorted(key0, key1 + high, side="left")
    many = np.maximum(last - first, 0)
    u = np.repeat(label, many)
    v = first[u] + _number(u) if len(u) else u
    while len(u):
        a, b = label[u], label[v]
        low, top = np.minimum(a, b), np.maximum(a, b)
        apart = low != top
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(label, top[apart], low[apart])
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def _filled(counts: pa.Array, heights: pa.Array) -> pa.Array:
    n = len(counts)
    row, c = _lists(counts)
    height = heights.to_numpy(zero_copy_only=False).astype(np.int64)
    size = _totals(row, c, n)
    ends = _restart(c, row)
    off = (_number(row) % 2 == 0) & (c > 0)
    prow, x, y0, y1 = column_runs(row[off], (ends - c)[off], ends[off], height)
    part = labels(prow, x, y0, y1)
    wide = size[prow] // np.maximum(height[prow], 1) if len(prow) else prow
    edge = (x == 0) | (x == wide - 1) | (y0 == 0) | (y1 == height[prow]) if len(prow) else np.zeros(0, dtype=bool)
    open_ = np.zeros(len(part), dtype=bool)
    open_[part[edge]] = True
    hole = ~open_[part] if len(part) else edge
    start, stop = x * height[prow] + y0 if len(prow) else x, x * height[prow] + y1 if len(prow) else x
    mine = spans(row, c)
    grow, gstart, gstop = np.concatenate([mine[0], prow[hole]]), np.concatenate([mine[1], start[hole]]), np.concatenate([mine[2], stop[hole]])
    order = np.lexsort((gstart, grow))
    return _to_lists(*from_spans(grow[order], gstart[order], gstop[order], size), n, null=counts.is_null().to_numpy(zero_copy_only=False))


def fill_holes(counts: Column | str, height: Column | str) -> Column:
    """Run lengths of a mask with the background that can't reach the border."""

    @arrow_udf("array<int>")
    def run(c: pa.Array, h: pa.Array) -> pa.Array:
        return _filled(c, h)

    return run(counts, height)


def component_at(counts: Column | str, height: Column | str, y: Column | str, x: Column | str) -> Column:
    """Run lengths of the 4-connected part that holds a pixel; empty where the pixel isn't set."""

    @arrow_udf("array<int>")
    def run(c: pa.Array, h: pa.Array, ys: pa.Array, xs: pa.Array) -> pa.Array:
        n = len(c)
        row, counts = _lists(c)
        height = h.to_numpy(zero_copy_only=False).astype(np.int64)
        prow, px, y0, y1 = column_runs(*spans(row, counts), height)
        part = labels(prow, px, y0, y1)
        sy, sx = (s.to_numpy(zero_copy_only=False).astype(np.int64) for s in (ys, xs))
        seed = (px == sx[prow]) & (y0 <= sy[prow]) & (y1 > sy[prow]) if len(prow) else np.zeros(0, dtype=bool)
        wanted = np.full(n, -1)
        wanted[prow[seed]] = part[seed]
        keep = part == wanted[prow] if len(prow) else seed
        top = px * height[prow] if len(prow) else px
        return _to_lists(*from_spans(prow[keep], (top + y0)[keep], (top + y1)[keep], _totals(row, counts, n)), n, null=c.is_null().to_numpy(zero_copy_only=False))

    return run(counts, height, y, x)
