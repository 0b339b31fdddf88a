"""Run lengths against pixel arrays, and tables over edges against counting pixels."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators import areas as ar
from segmill.operators import graph as gr
from segmill.operators import runs as rn

from . import plain_rle as rle


def plain_flood(mask, y, x):
    out, todo = np.zeros_like(mask), [(y, x)]
    while todo:
        y, x = todo.pop()
        if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
            out[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def plain_holes(mask):
    wide = np.pad(~mask, 1, constant_values=True)
    return ~plain_flood(wide, 0, 0)[1:-1, 1:-1]


def pairs(n, seed):
    rng = np.random.default_rng(seed)
    for i in range(n):
        h, w = int(rng.integers(1, 10)), int(rng.integers(1, 10))
        yield i, rng.random((h, w)) < rng.choice([0, 0.2, 0.5, 0.8, 1]), rng.random((h, w)) < rng.choice([0, 0.3, 0.6, 1]), int(rng.integers(h)), int(rng.integers(w))


@pytest.mark.parametrize("seed", [1, 2])
def test_set_algebra_parts_and_codecs(spark, seed):
    made = list(pairs(120, seed))
    rows = [(i, rle.runs(a), rle.runs(b), a.shape[0], y, x) for i, a, b, y, x in made] + [(999, None, [3], 1, 0, 0)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>, h int, y int, x int").repartition(3)
    df = df.select(
        "i", rn.overlap("a", "b").alias("o"), rn.area("a").alias("area"), rn.without("a", "b").alias("left"), rn.union(F.array("a", "b", "a")).alias("both"), rn.pack("a").alias("packed"),
        rn.unpack(rn.pack("a")).alias("again"), rn.turned("a", "h").alias("turned"), rn.fill_holes("a", "h").alias("filled"), rn.component_at("a", "h", "y", "x").alias("part"),
    )
    found = {r.i: r for r in df.collect()}
    assert (found[999].area, found[999].packed, found[999].again, found[999].filled) == (None, None, None, None) and found[999].o.both == 0
    for i, a, b, y, x in made:
        r = found[i]
        assert (r.o.a, r.o.b, r.o.both, r.area) == (a.sum(), b.sum(), (a & b).sum(), a.sum())
        assert r.left == rle.runs(a & ~b) and r.both == rle.runs(a | b) and r.packed == rle.pack(rle.runs(a)) and r.again == rle.runs(a)
        assert r.turned == rle.runs(a.T) and r.filled == rle.runs(plain_holes(a)) and r.part == rle.runs(plain_flood(a, y, x))
        assert (gr.flood(a, y * a.shape[1] + x) == plain_flood(a, y, x)).all()


def test_shares(spark):
    df = spark.createDataFrame([([2, 4], [4, 2]), ([6], [6])], "a array<int>, b array<int>").withColumn("o", rn.overlap("a", "b"))
    o = F.col("o")
    assert [tuple(r) for r in df.select(rn.iou(o), rn.ios(o), rn.inside(o)).collect()] == [(0.5, 1.0, 0.5), (0.0, 0.0, 0.0)]


def test_bits_and_large_numbers(spark):
    rng = np.random.default_rng(4)
    masks = [rng.random((int(rng.integers(1, 7)), 5)) < 0.5 for _ in range(30)]
    df = spark.createDataFrame([(i, m.astype(int).ravel().tolist()) for i, m in enumerate(masks)] + [(99, None)], "i int, m array<tinyint>")
    for r in df.select("i", "m", rn.of_bits("m", 5).alias("c"), rn.to_bits(rn.of_bits("m", 5), 5).alias("back")).collect():
        assert r.back == r.m and r.c == (rle.runs(masks[r.i]) if r.i < 99 else None)
    counts = [[int(v) for v in rng.integers(0, 2**30, int(rng.integers(0, 9)))] for _ in range(30)]
    df = spark.createDataFrame([(c,) for c in counts], "c array<int>").select("c", rn.pack("c").alias("p"), rn.unpack(rn.pack("c")).alias("b"))
    for r in df.collect():
        assert r.p == rle.pack(r.c) and r.b == r.c


def test_spiral_costs_its_runs():
    m = np.zeros((480, 480), dtype=bool)
    t, l, b, r = 0, 0, 479, 479
    m[0, :] = True
    while t < b - 4:
        m[t, l : r + 1] = m[t : b + 1, r] = m[b, l : r + 1] = m[t + 4 : b + 1, l] = True
        t, b, r = t + 4, b - 4, r - 4
        m[t, l : l + 5] = True
        l += 4
    begun = time.time()
    assert (gr.flood(m, 0) == m).all() and time.time() - begun < 2


def test_every_form_of_a_label(spark):
    m = np.zeros((9, 7), dtype=bool)
    m[2:5, 1:6] = True
    square = [1.0, 2.0, 6.0, 2.0, 6.0, 5.0, 1.0, 5.0]
    rows = [
        (0, rle.pack(rle.runs(m)), None, None, 9, 7), (1, None, rle.runs(m), None, 9, 7), (2, None, rle.runs(m.T), None, 7, 9), (3, None, None, [square], 9, 7),
        (4, None, None, [square[:4] + [6.0, 3.5, 1.0, 3.5], [1.0, 3.0, 6.0, 3.0, 6.0, 5.0, 1.0, 5.0]], 9, 7), (5, None, None, None, 9, 7), (6, None, None, [], 9, 7), (7, None, None, [[1.0, 2.0]], 9, 7),
    ]
    df = spark.createDataFrame(rows, "i int, p string, c array<int>, s array<array<double>>, ch int, cw int").select("i", rn.decode("p", "c", "s", "ch", "cw", F.lit(9), F.lit(7)).alias("m"))
    found = {r.i: rle.mask_of(r.m, 9, 7) for r in df.collect()}
    assert all((found[i] == (m if i < 5 else False)).all() for i in range(8))


def test_polygons_are_near_their_pixels_centres(spark):
    rng = np.random.default_rng(6)
    shapes = [(rng.random(2 * int(rng.integers(3, 8))) * 60 - 10).tolist() for _ in range(40)]
    df = spark.createDataFrame([(i, [s]) for i, s in enumerate(shapes)], "i int, s array<array<double>>").select("i", rn.of_polygons("s", F.lit(40), F.lit(40)).alias("m"))
    for r in df.collect():
        p = shapes[r.i]
        edge = np.hypot(*np.diff(np.array(p + p[:2]).reshape(-1, 2), axis=0).T).sum()
        assert (rle.mask_of(r.m, 40, 40) != rle.polygon_mask(p, 40, 40)).sum() <= edge


@pytest.mark.parametrize("cells", [60, 400, 4_000_000])
def test_union_areas_equal_counting(monkeypatch, cells):
    monkeypatch.setattr(ar, "CELLS", cells)
    rng = np.random.default_rng(cells)
    for _ in range(25):
        n = int(rng.integers(1, 8))
        of, asked = np.sort(rng.integers(0, n, int(rng.integers(0, 40)))), np.sort(rng.integers(0, n, int(rng.integers(1, 50))))
        boxes, windows = ([np.stack([(a := rng.integers(-3, 28, k)), (b := rng.integers(-3, 28, k)), a + rng.integers(-1, 12, k), b + rng.integers(-1, 12, k)], axis=1).reshape(-1, 4) for k in (len(of), len(asked))])
        got = ar.union_pixels(of, boxes, asked, windows, n)
        for k, (i, (l, t, r, b)) in enumerate(zip(asked, windows + 10)):
            grid = np.zeros((60, 60), dtype=bool)
            for x0, y0, x1, y1 in boxes[of == i] + 10:
                grid[y0 : max(y0, y1), x0 : max(x0, x1)] = True
            assert got[k] == grid[t : max(t, b), l : max(l, r)].sum()


def test_box_gradients_equal_cutting_out():
    v = np.random.default_rng(8).standard_normal((12, 15))
    boxes = np.array([(l, t, r, b) for l in range(-1, 15, 2) for r in range(max(l, 0), 17, 3) for t in range(0, 12, 3) for b in range(t, 14, 2)])
    for (l, t, r, b), got in zip(boxes, ar.mean_gradients(v, boxes)):
        cut = v[t:b, max(l, 0) : r]
        want = np.hypot(*np.gradient(cut)).mean() if min(cut.shape) > 1 else 0.0
        assert abs(got - want) < 1e-9
