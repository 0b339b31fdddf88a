import json
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from segmill.functions import geometry as g
from segmill.functions import masks as mk
from segmill.functions import scoring as sc
from segmill.operators import evaluate as ev
from segmill.operators import graph as gr
from segmill.operators import greedy as gd
from segmill.operators import merge as mg
from segmill.operators import stats as st
from segmill.operators import windows as wn
from segmill.plans import fixtures as fx
from segmill.plans import presets as ps
from segmill.sources import readers as rd
from segmill.sources import sinks

from . import plain_rle as rle

D = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit_box(l, t, r, b):  # noqa: E741
    return g.box(F.lit(l), F.lit(t), F.lit(r), F.lit(b))


def test_box_iou_cases(spark):
    a = lit_box(0, 0, 10, 10)
    r = one(spark, g.box_iou(a, lit_box(10, 0, 20, 10)), g.box_iou(a, a), g.box_iou(a, lit_box(0, 0, 5, 10)), g.box_iou(lit_box(3, 3, 3, 3), lit_box(3, 3, 3, 3)), g.box_ios(a, lit_box(2, 2, 4, 4)))
    assert tuple(r) == (0.0, 1.0, 0.5, 0.0, 1.0)


def test_half_even(spark):
    assert tuple(one(spark, *[g.half_even(F.lit(v)) for v in (0.5, 1.5, 2.5, -0.5)])) == (0, 2, 2, 0)


def test_expanded_overlap_is_strict_and_short_by_one(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("rmin", "cmin", "rmax", "cmax"))])
    # Extents of 10 grow by 1 a side: 0..10 and 12..22 meet at 11 but don't overlap.
    r = one(spark, g.overlap_expanded(box(0, 0, 10, 10), box(12, 0, 22, 10), 0.1), g.overlap_expanded(box(0, 0, 10, 10), box(11, 0, 21, 10), 0.1))
    assert tuple(r) == (False, True)


def test_sizes(spark):
    r = one(spark, g.size_bin(F.lit(1023)), g.size_bin(F.lit(1024)), g.size_bin(F.lit(9216)), g.crop_sizes_px([0.5, 0.25, 64.0, 0.25], F.lit(100), F.lit(200)), g.pick_crop_size(F.array(F.lit(24), F.lit(48)), F.lit(15.0)), g.pick_crop_size(F.array(F.lit(24), F.lit(48)), F.lit(90.0)))
    assert tuple(r) == ("small", "medium", "large", [25, 50, 64], 48, 48)


def test_component_and_patch_bounds(spark):
    r = one(spark, g.component_box(F.lit(1), F.lit(0), F.lit(3), F.lit(2), F.lit(4), F.lit(3), F.lit(100), F.lit(50)), g.patch_bounds(lit_box(10, 10, 30, 12), F.lit(100), F.lit(100), F.lit(5), F.lit(5)))
    assert tuple(r[0]) == (0, 12, 67, 38) and tuple(r[1]) == (0, 0, 2, 1)


def bits(*rows):
    return [int(c) for row in rows for c in row]


def test_empty_and_small_masks(spark):
    df = spark.createDataFrame([(bits("000", "000", "000"),), (bits("010", "010", "000"),)], "m array<tinyint>")
    df = df.withColumn("b", mk.bbox(F.col("m"), 3))
    rows = df.select("b", mk.aspect_ratio(F.col("b")), mk.compactness(F.col("m"), F.col("b")), mk.centroid(F.col("m"), 3), mk.bbox_xywh(F.col("b"))).collect()
    assert tuple(rows[0]) == (None, 1.0, 0.0, None, None)
    assert tuple(rows[1][0]) == (0, 1, 1, 1) and rows[1][1] == 2.0 and rows[1][2] == 1.0 and tuple(rows[1][3]) == (1.0, 0.5) and rows[1][4] == [1, 0, 1, 2]


def test_mask_algebra(spark):
    a, b = bits("110", "000"), bits("011", "000")
    df = spark.createDataFrame([(a, b)], "a array<tinyint>, b array<tinyint>")
    r = df.select(mk.iou_and_inside(F.col("a"), F.col("b")), mk.either(F.col("a"), F.col("b")), mk.without(F.col("a"), F.col("b")), mk.paste(F.col("a"), 3, 4, 3, F.lit(2), F.lit(1)), mk.resize_nearest(F.col("a"), 3, 2, 6, 4), mk.threshold(F.transform("a", lambda x: x * 10))).first()
    assert tuple(round(x, 6) for x in r[0]) == (0.333333, 0.5, 0.5) and r[1] == bits("111", "000") and r[2] == bits("100", "000")
    assert r[3] == bits("0000", "0011", "0000") and r[4] == bits("111100", "111100", "000000", "000000") and r[5] == a


def test_rle():
    m = np.random.default_rng(0).random((9, 7)) > 0.6
    counts = rle.runs(m)
    assert (rle.mask_of(counts, 9, 7) == m).all() and rle.unpack(rle.pack(counts)) == counts
    assert rle.pack([0, 5, 1000, 3, 2]) and rle.unpack(rle.pack([0, 5, 1000, 3, 2])) == [0, 5, 1000, 3, 2]
    # The public format's known example: a 1 x 6 mask of zeros is "6".
    assert rle.pack([6]) == "6"


def test_flood_and_holes():
    m = np.array([[1, 1, 1, 0, 1], [1, 0, 1, 0, 1], [1, 1, 1, 0, 1]], dtype=bool)
    assert gr.flood(m, 0).sum() == 8 and gr.flood(m, 3).sum() == 0 


def test_components_both_ways(spark):
    r = np.random.default_rng(3)
    vs = [(i, v) for i in range(5) for v in range(12)]
    es = [(i, *sorted(r.choice(12, 2, replace=False).tolist())) for i in range(5) for _ in range(2 * i)] + [(7, 0, 1)]
    vs += [(7, 0), (7, 1)]
    v, e = spark.createDataFrame(vs, "image_id int, v long"), spark.createDataFrame(es, "image_id int, u long, v long")
    label = {x: x[1] for x in vs}
    for i, a, b in es * 12:
        lo = min(label[i, a], label[i, b])
        label[i, a] = label[i, b] = lo
    for f in (gr.components, gr.image_components):
        assert {(q.image_id, q.v): q.component for q in f(v, e).collect()} == label


def test_scores(spark):
    r = one(spark, sc.area_prior(F.lit(0.004)), sc.area_prior(F.lit(0.0)), sc.shape_penalty(F.lit(0.875), F.lit(2)), sc.shape_penalty(F.lit(0.9), F.lit(1)), sc.merged_score(F.lit(2.0), F.lit(3)), sc.nice_max(F.lit(0.0)), sc.nice_max(F.lit(21.0)), sc.nice_max(F.lit(1000.0), whole=True), sc.proposal_alignment(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(10.0)))
    assert [round(x, 6) for x in r] == [1.0, 0.0, 0.5, 0.0, 1.94, 1.0, 50.0, 1000, 1.0]


def test_greedy_ties_and_budget(spark):
    rows = [(1, k, 0, 0, 10, 10, 5.0) for k in (1, 2)] + [(1, 3, 50, 50, 60, 60, 5.0), (1, 4, 80, 80, 90, 90, 1.0)]
    df = spark.createDataFrame(rows, "image_id int, ord int, l int, t int, r int, b int, score double")
    hit = lambda a, b: g.box_iou(a, b) > 0.4
    kept = lambda budget: [r.ord for r in gd.suppress(df, ["image_id"], [F.desc("score"), F.col("ord")], ["ord", "l", "t", "r", "b"], hit, budget).orderBy("rank").collect()]
    assert kept(None) == [1, 3, 4] and kept(2) == [1, 3]


def test_combined_labels_are_apart(spark):
    a = fx.annotations(spark, D)
    base, crop = a.filter("source = 'baseline'"), a.filter("source = 'crop'")
    out = mg.combine_labels(base, crop)
    n_base, n_crop = base.count(), crop.count()
    added = out.filter("split = 'crop'").count()
    assert out.filter("split = 'baseline'").count() == n_base and 0 < added < n_crop
    kept = {(r.image_id, r.ann_id): r for r in out.collect()}
    by = {}
    for r in kept.values():
        by.setdefault(r.image_id, []).append(r)

    def dup(x, y):
        w, h = min(x.r, y.r) - max(x.l, y.l), min(x.b, y.b) - max(x.t, y.t)
        both = max(0, w) * max(0, h)
        return both / (x.area + y.area - both) >= 0.5 or both / x.area >= 0.7 or both / y.area >= 0.7

    for rows in by.values():
        for i, x in enumerate(rows):
            for y in rows[:i]:
                assert x.split == y.split == "baseline" or not dup(x, y)
    for r in crop.collect():
        if (r.image_id, r.ann_id) not in kept:
            assert any(dup(r, k) for k in by.get(r.image_id, []) if k.split == "baseline" or k.ord < r.ord)


def _masks(n, seed, size=8):
    r = np.random.default_rng(seed)
    out = np.zeros((n, size, size), dtype=bool)
    for m in out:
        y, x, h, w = r.integers(0, size - 2), r.integers(0, size - 2), r.integers(1, 5), r.integers(1, 5)
        m[y : y + h, x : x + w] = r.random((min(h, size - y), min(w, size - x))) > 0.2
    return out, np.round(r.random(n) * 2 + 0.5, 3)


def _pair(a, b):
    both, na, nb = (a & b).sum(), a.sum(), b.sum()
    return (both / (na + nb - both) if na + nb - both else 0.0, both / min(na, nb) if min(na, nb) else 0.0, both / na if na else 0.0)


def _facts(m):
    ys, xs = np.where(m)
    if not len(ys):
        return None, 0.0, 1.0
    b = ys.min(), xs.min(), ys.max(), xs.max()
    h, w = b[2] - b[0] + 1, b[3] - b[1] + 1
    return b, m.sum() / (h * w), max(h, w) / min(h, w)


def _loop_components(ms, iou, ios, ratio):
    def near(a, b):
        if a is None or b is None:
            return False
        grow = lambda v: (v[0] - (v[2] - v[0]) * ratio, v[1] - (v[3] - v[1]) * ratio, v[2] + (v[2] - v[0]) * ratio, v[3] + (v[3] - v[1]) * ratio)
        x, y = grow(a), grow(b)
        return x[0] < y[2] and y[0] < x[2] and x[1] < y[3] and y[1] < x[3]

    label = list(range(len(ms)))
    for i in range(len(ms)):
        for j in range(i):
            p = _pair(ms[i], ms[j])
            if p[0] > iou or p[1] > ios or near(_facts(ms[i])[0], _facts(ms[j])[0]):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(6))
def test_merge_candidates_loop(seed):
    ms, score = _masks(14, seed)
    protected = list(_masks(2, seed + 50)[0])
    top, low, high, iou, ios, ratio, aspect = 4, 0.03, 0.3, 0.4, 0.7, 0.1, 2.5
    _, got = mg.merge_candidates_image(ms, score, protected, iou=iou, top_k=top, min_ratio=low, max_ratio=high, ios=ios, expand=ratio, max_aspect=aspect)
    index = [i for i in range(14) if low <= ms[i].mean() <= high]
    label = _loop_components([ms[i] for i in index], iou, ios, ratio)
    pool = []
    for k in sorted(set(label)):
        members = [i for i, x in zip(index, label) if x == k]
        union = np.logical_or.reduce(ms[members])
        if len(members) > 1 and union.mean() <= high and _facts(union)[2] <= aspect:
            pool.append((union, max(score[members]) - 0.03 * (len(members) - 1)))
        else:
            pool += [(ms[i], score[i]) for i in members]
    pool.sort(key=lambda c: (-c[1], -c[0].mean()))
    own = [p for p in protected if low <= p.mean()]
    kept = []
    for m, s in pool:
        if any(_pair(m, p)[0] > iou for p in own) or any(_pair(m, k)[0] > iou or _pair(m, k)[1] > ios for k, _ in kept):
            continue
        kept.append((m, s))
        if len(kept) == top:
            break
    assert [(m.tolist(), round(float(s), 9)) for m, s, _ in got] == [(m.tolist(), round(float(s), 9)) for m, s in kept]


def test_protected_mask_that_contains_a_crop():
    """Kept by the general merge, dropped as a fragment by the conservative one."""
    import pandas as pd

    big, small = np.zeros((10, 10), dtype=bool), np.zeros((10, 10), dtype=bool)
    big[:8, :8], small[1:3, 1:3] = True, True
    _, kept = mg.merge_candidates_image(small[None], np.array([2.0]), [big], max_ratio=1.0)
    assert len(kept) == 1
    out = mg.conservative_merge_image(small[None], pd.DataFrame({"score": [2.0]}), big[None], max_ratio=1.0)
    assert out == [([0], 2.0, "fragment")]


@pytest.mark.parametrize("seed", range(6))
def test_conservative_merge_accounts_for_all(seed):
    import pandas as pd

    ms, score = _masks(14, seed)
    protected = _masks(2, seed + 70)[0]
    out = mg.conservative_merge_image(ms, pd.DataFrame({"score": score}), protected, max_ratio=0.3, min_score=0.9, expand=0.0)
    assert sorted(i for members, _, _ in out for i in members) == list(range(14))
    added = [np.logical_or.reduce(ms[m]) for m, _, reason in out if reason is None]
    assert len(added) <= 2
    for i, a in enumerate(added):
        assert all(_pair(a, p)[0] < 0.35 and _pair(a, p)[2] < 0.7 for p in protected)
        assert all(_pair(a, b)[0] < 0.35 for b in added[:i])


def test_general_merge_over_frames(spark):
    df = spark.createDataFrame([(1, i, m.ravel().astype(int).tolist(), float(s), i < 2) for i, (m, s) in enumerate(zip(*_masks(8, 3)))], "image_id long, mask_id long, bits array<int>, score double, protected boolean")
    rows = mg.merge_candidates(df, 8, max_ratio=0.5, min_ratio=0.01).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert mg.conservative_merge(df, 8, max_ratio=0.5).count() > 0


def test_ncut_solves_its_equation():
    r = np.random.default_rng(0)
    x = np.vstack([r.standard_normal((6, 4)) * 0.1 + [3, 0, 0, 0], r.standard_normal((3, 4)) * 0.1 + [0, 3, 0, 0]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = np.where(u @ u.T > 0.2, 1.0, 1e-5)
    v, d = gr.second_vector(gr.Affinity(u)), a.sum(axis=1)
    lap = np.diag(d) - a
    s = v @ lap @ v / (v @ (d * v))
    assert np.abs(lap @ v - s * d * v).max() < 1e-9 and len({bool(b) for b in (v[:6] > v.mean())}) == 1
    masks = gr.iterative_cut(x, (3, 3), rounds=2)
    assert masks[0].sum() == 3 and len(masks) == 2


def test_grid_windows(spark):
    rows = wn.grid_windows(spark, 480, [1.0, 0.75, 0.5]).orderBy("ord").collect()
    assert tuple(rows[0]) == (1, 0, 0, 480, 480) and all(r.x + r.w <= 480 for r in rows)
    assert len(wn.grid_windows(spark, 480, [0.5], max_per_scale=5).collect()) == 5
    assert [(r.x, r.y) for r in wn.grid_windows(spark, 100, [0.5, 0.5], max_per_scale=3).orderBy("ord").collect()] == [(0, 0), (35, 0), (50, 0)]


def test_coverage_counts_pixels(spark):
    r = np.random.default_rng(1)
    boxes = [(k % 3, *sorted(r.integers(0, 40, 2).tolist()), *sorted(r.integers(0, 40, 2).tolist())) for k in range(20)]
    boxes = [(i, l, t, rr + 1, b + 1) for i, l, rr, t, b in boxes]
    frame = spark.createDataFrame(boxes, "image_id int, l int, t int, r int, b int")
    win = spark.createDataFrame([(i, k, 5 * k, 3 * k, 5 * k + 12, 3 * k + 20) for i in range(4) for k in range(4)], "image_id int, ord int, l int, t int, r int, b int")
    for w in wn.coverage(win, frame).collect():
        canvas = np.zeros((80, 80), dtype=bool)
        for i, l, t, rr, b in boxes:  # noqa: E741
            if i == w.image_id:
                canvas[t:b, l:rr] = True
        assert w.covered_pixels == canvas[w.t : w.b, w.l : w.r].sum()


def _loop_windows(heat, sizes, w, h, top_k, nms, pct, rescue, covered=None, pixels=None):
    """The windows of one image, step by step."""
    clip = lambda v, lo, hi: max(lo, min(v, hi))
    gh, gw = heat.shape
    px = sorted({max(2, min(int(round(v * min(w, h) if v <= 1 else v)), max(w, h))) for v in sizes})

    def square(cx, cy, s):
        x, y = max(0, int(round(cx - s / 2))), max(0, int(round(cy - s / 2)))
        x, y = max(0, min(x, w - s)), max(0, min(y, h - s))
        return x, y, max(x + 1, min(x + s, w)), max(y + 1, min(y + s, h))

    def cells(b):
        x1, y1 = clip(math.floor(b[0] / w * gw), 0, gw - 1), clip(math.floor(b[1] / h * gh), 0, gh - 1)
        return heat[y1 : max(y1 + 1, min(gh, math.ceil(b[3] / h * gh))), x1 : max(x1 + 1, min(gw, math.ceil(b[2] / w * gw)))], x1, y1

    def cover(b):
        return 0.0 if covered is None else covered[b[1] : b[3], b[0] : b[2]].mean()

    def edge(b):
        return 0.0 if pixels is None else np.hypot(*np.gradient(pixels[b[1] : b[3], b[0] : b[2]])).mean()

    def score(b):
        p = cells(b)[0]
        return 1.5 * p.mean() + p.max() + 2 * p.mean() * (1 - cover(b)) + 0.5 * edge(b) / 128 - 0.1 * sum((b[0] == 0, b[1] == 0, b[2] == w, b[3] == h))

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    raw, peaks = [], max(10 * top_k, 50)
    for k in sorted(range(heat.size), key=lambda k: (-heat.flat[k], -k)):
        if heat.flat[k] < np.percentile(heat, pct) and len(raw) >= peaks or len(raw) >= peaks * len(px):
            break
        for s in px:
            b = square((k % gw + 0.5) / gw * w, (k // gw + 0.5) / gh * h, s)
            raw.append((score(b), b))
    raw.sort(key=lambda r: -round(r[0], 9))
    out = []

    def fill(items, reason, until):
        for s, b in items:
            if len(out) >= until:
                return
            if all(iou(b, o[1]) <= nms for o in out):
                out.append((s, b, reason))

    fill(raw, "heatmap", top_k - rescue)
    centres = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for _, b, _ in out]
    spots = []
    for row in range(3):
        for col in range(3):
            t, b = int(round(row * h / 3)), int(round((row + 1) * h / 3))
            left, r = int(round(col * w / 3)), int(round((col + 1) * w / 3))
            if any(left <= x < r and t <= y < b for x, y in centres):
                continue
            near = min((math.hypot((left + r) / 2 - x, (t + b) / 2 - y) for x, y in centres), default=None)
            bonus = 0.4 if near is None else min(0.4, near / math.hypot(w, h) * 0.8)
            p, x1, y1 = cells((left, t, r, b))
            y, x = np.unravel_index(p.argmax(), p.shape)
            for s in px[:2]:
                q = square((x1 + x + 0.5) / gw * w, (y1 + y + 0.5) / gh * h, s)
                spots.append((score(q) + 0.5 * p.max() + 0.4 * (1 - cover(q)) + 0.3 * edge(q) / 128 + (0.15 if row != 1 or col != 1 else 0) + bonus, q))
    spots.sort(key=lambda r: -round(r[0], 9))
    fill(spots, "spatial_rescue", len(out) + rescue)
    fill(raw, "heatmap_fill", top_k)
    return [(b, reason) for _, b, reason in out]


@pytest.mark.parametrize("top_k,rescue", [(6, 2), (4, 0), (12, 4)])
def test_heatmap_windows_loop(spark, top_k, rescue):
    r = np.random.default_rng(top_k)
    heat = {i: r.permutation(64).reshape(8, 8) / 63 for i in range(3)}
    cells = spark.createDataFrame([(i, y, x, float(h[y, x])) for i, h in heat.items() for y in range(8) for x in range(8)], "image_id int, y int, x int, heat double")
    images = spark.createDataFrame([(i, 200, 150) for i in heat], "image_id int, width int, height int")
    rows = wn.heatmap_windows(cells, images, [0.25, 0.35, 0.5], top_k, 0.4, 85.0, rescue).orderBy("image_id", "ord").collect()
    for i, h in heat.items():
        got = [((q.l, q.t, q.r, q.b), q.reason) for q in rows if q.image_id == i]
        assert got == _loop_windows(h, [0.25, 0.35, 0.5], 200, 150, top_k, 0.4, 85.0, rescue)


def test_heatmap_windows_with_coverage_and_edges(spark):
    r = np.random.default_rng(77)
    heat, w, h = r.permutation(36).reshape(6, 6) / 35, 40, 30
    pixels = np.zeros((h, w)) + r.integers(0, 256, (h, 1))
    pixels[:, : w // 3] = r.integers(0, 256, (h, w // 3))
    boxes = [(2, 3, 18, 20), (10, 1, 25, 9), (30, 20, 40, 30)]
    covered = np.zeros((h, w), dtype=bool)
    for left, top, right, bottom in boxes:
        covered[top:bottom, left:right] = True
    cells = spark.createDataFrame([(1, y, x, float(heat[y, x])) for y in range(6) for x in range(6)], "image_id int, y int, x int, heat double")
    images = spark.createDataFrame([(1, w, h)], "image_id int, width int, height int")
    painted = spark.createDataFrame([(1, *b) for b in boxes], "image_id int, l int, t int, r int, b int")
    grey = spark.createDataFrame([(1, y, x, float(pixels[y, x])) for y in range(h) for x in range(w)], "image_id int, y int, x int, v double")
    rows = wn.heatmap_windows(cells, images, [0.3, 0.5], 8, 0.4, 85.0, 3, covered=painted, pixels=grey).orderBy("ord").collect()
    plain = _loop_windows(heat, [0.3, 0.5], w, h, 8, 0.4, 85.0, 3, covered, pixels)
    assert [((q.l, q.t, q.r, q.b), q.reason) for q in rows] == plain
    assert plain != _loop_windows(heat, [0.3, 0.5], w, h, 8, 0.4, 85.0, 3)


def test_median_by_counts(spark):
    r = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in ((1, 1), (2, 2), (3, 501), (4, 1000)) for v in r.choice([r.integers(0, 50, n), r.integers(0, 10**6, n)])]
    rows += [(5, 1e9), (5, 1.0), (5, 2.0), (6, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {q.k: q.median for q in st.median(df, "v", ["k"]).collect()}
    assert got == {k: float(np.median([v for i, v in rows if i == k])) for k in range(1, 6)}
    assert st.median(df, "v").first().median == float(np.median([v for _, v in rows if v is not None]))
    assert st.median(df.filter("k = 6"), "v").first().median is None and st.median(df.filter("k = 6"), "v", ["k"]).collect() == []


def test_bundle_parts_are_one_document(spark, tmp_path):
    images = spark.createDataFrame([(i, f"{i}.jpg") for i in range(40)], "id long, file_name string")
    anns = spark.createDataFrame([(i, i % 7, float(i)) for i in range(200)], "id long, image_id long, area double")
    cats = spark.createDataFrame([(1, "object", "object")], "id int, name string, supercategory string")
    for name, a in (("all", anns), ("none", anns.limit(0))):
        sinks.write_bundle(str(tmp_path / name), images, a, cats, 'with "quotes"', parts=5)
        parts = sorted((tmp_path / name).glob("part-*"))
        doc = json.loads("".join(p.read_text() for p in parts))
        assert [x["id"] for x in doc["images"]] == list(range(40)) and doc["info"]["description"] == 'with "quotes"' and len(doc["annotations"]) == a.count()
        back = rd.bundle(spark, str(tmp_path / name))
        assert back["images"].count() == 40 and back["annotations"].count() == a.count() and back["categories"].count() == 1


def test_rescue_that_takes_all_slots(spark):
    """Bounded by default; in compatibility mode the first pass has no end."""
    r = np.random.default_rng(9)
    cells = spark.createDataFrame([(1, y, x, float(r.random())) for y in range(8) for x in range(8)], "image_id int, y int, x int, heat double").cache()
    images = spark.createDataFrame([(1, 200, 200)], "image_id int, width int, height int")
    n = lambda compat: wn.heatmap_windows(cells, images, [0.25], 4, 0.4, 85.0, 4, compat).count()
    assert n(False) <= 4 < n(True)


def test_objectness_is_the_blend(spark):
    r = np.random.default_rng(2)
    feat = r.standard_normal((4, 5, 6))
    feat /= np.linalg.norm(feat, axis=2, keepdims=True)
    df = spark.createDataFrame([(1, y, x, feat[y, x].tolist()) for y in range(4) for x in range(5)], "image_id int, y int, x int, feat array<double>")
    got = {(q.y, q.x): q.objectness for q in wn.objectness(df).collect()}
    scale = lambda v: (v - v.min()) / (v.max() - v.min())
    raw = np.array([[np.mean([1 - feat[y, x] @ feat[b, a] for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= b < 4 and 0 <= a < 5]) for x in range(5)] for y in range(4)])
    edge = np.ones((4, 5), dtype=bool)
    edge[1:-1, 1:-1] = False
    proto = feat[edge].mean(axis=0)
    far = 1 - feat @ (proto / np.linalg.norm(proto))
    want = scale(0.55 * scale(raw) + 0.45 * scale(far))
    assert all(abs(got[y, x] - want[y, x]) < 1e-9 for y in range(4) for x in range(5))


def test_stats_with_missing_parts(spark):
    images = spark.createDataFrame([(1,), (2,)], "id int")
    anns = spark.createDataFrame([(1, 1024.0), (1, None), (9, 9216.0)], "image_id int, area double")
    r = st.label_stats(images, anns).first()
    assert (r.total_images, r.total_anns, r.small_count, r.medium_count, r.large_count, r.avg_masks, r.med_masks) == (2, 3, 1, 1, 1, 1.0, 1.0)
    assert {q.n_masks: q.images for q in st.mask_histogram(images, anns).collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    none = st.label_stats(images, anns.limit(0)).first()
    assert (none.total_anns, none.small_pct, none.mean_area) == (0, 0.0, 0.0)


def test_published_invariants():
    small, medium, large, n = 1570, 1311, 918, 3799
    for a, b, c, want in ((0.0006, 0.0420, 0.3758, 0.1056), (0.0006, 0.0496, 0.4346, 0.1224)):
        assert abs((a * small + b * medium + c * large) / n - want) < 1e-4
    assert 4872 + 3465 == 8337 and 3315 + 4872 == 8187 and round(3315 / 2500, 3) == 1.326
    assert 1 + 282 + 185 + 32 == 500 and 282 + 2 * 185 + 3 * 32 == 748


def test_fragment_rate_and_ap(spark):
    schema = "image_id int, ann_id long, ord int, l int, t int, r int, b int, area int, score double"
    gt = spark.createDataFrame([(1, 1, 1, 0, 0, 10, 10, 100, 0.0), (1, 2, 2, 50, 50, 60, 60, 100, 0.0)], schema)
    pred = spark.createDataFrame([(1, 11, 1, 0, 0, 10, 4, 40, 0.9), (1, 12, 2, 0, 4, 10, 8, 40, 0.8), (1, 13, 3, 50, 50, 60, 60, 100, 0.7)], schema)
    r = ev.fragment_rate(gt, pred).first()
    assert (r.fragmented, r.n_gt, r.fragment_rate) == (1, 2, 0.5)
    # One of two found, behind two misses: precision 1/3 up to recall 0.5.
    assert abs(ev.average_precision(gt, pred).first().ap - 51 / 101 / 3) < 1e-9
    assert ev.overmerge_rate(gt, pred).first().overmerged == 0
    row = lambda a, b, c: spark.createDataFrame([(a, b, c)], "recall double, duplicate_rate double, fragment_rate double")
    assert ev.decision(row(0.10, 0.1, 0.1), row(0.12, 0.15, 0.1)).first().adopt and not ev.decision(row(0.10, 0.1, 0.1), row(0.12, 0.25, 0.1)).first().adopt


P = "[x] INFO: copypaste: "


def _log(spark, *lines):
    return spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run string, line_no long, line string")


def test_log_blocks(spark):
    head = P + "AP,AP50,AP75,APs,APm,APl"
    good = _log(spark, P + "Task: bbox", head, P + "1,2,3,4,5,6", head, P + "9,9,9,9,9,9", P + "Task: segm", head, P + "1,2,3", head, "1,2,3,4,5,6", head, P + "a,2,3,4,5,6", P + "Task: keypoints", head)
    rows = rd.eval_metrics(good).collect()
    assert [(r.task, r.AP, r.APl) for r in rows] == [("bbox", 1.0, 6.0)]
    later = _log(spark, P + "Task: bbox", head, P + "1,2,3,4,5,6", P + "Task: bbox", head, P + "7,2,3,4,5,6")
    assert rd.eval_metrics(later).first().AP == 7.0
    assert rd.eval_metrics_regex(_log(spark, "AP,AP50,AP75,APs,APm,APl")).first().AP == 50.0
    assert rd.eval_metrics_regex(_log(spark, "copypaste:", "AP,APs", "3.5,1.5")).first().APs == 1.5


def test_files(spark, tmp_path):
    lines = ['{"iteration": 1, "total_loss": 2.5}', "", "oops{", '{"total_loss": 3}', '{"iteration": 3, "total_loss": "x"}', '{"iteration": 4, "total_loss": 7}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    assert [tuple(r) for r in rd.jsonl(spark, str(tmp_path / "m.jsonl")).orderBy("iteration").collect()] == [(1, 2.5), (4, 7.0)]
    for run in ("b", "a"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "eval.log").write_text(f"start\n{P}Task: bbox\n{P}AP,AP50,AP75,APs,APm,APl\n{P}1,2,3,{4 if run == 'a' else 5},5,6\n")
    ranked = rd.rank_runs(rd.eval_metrics(rd.log_lines(spark, str(tmp_path / "runs")))).orderBy("rank").collect()
    assert [r.run for r in ranked] == ["b", "a"]
    sinks.ranked_csv(str(tmp_path / "rank"), rd.rank_runs(rd.eval_metrics(rd.log_lines(spark, str(tmp_path / "runs")))))
    assert spark.read.csv(str(tmp_path / "rank"), header=True).count() == 2
    (tmp_path / "ids.txt").write_text("3\n\n 5 \n")
    assert [r.id for r in rd.id_list(spark, str(tmp_path / "ids.txt")).collect()] == [3, 5]
    tree = tmp_path / "t"
    for p in ("n1/images/a.png", "n2/b.png"):
        (tree / p).parent.mkdir(parents=True)
        (tree / p).write_bytes(b"abc")
    assert sorted((r["class"], r.name) for r in rd.image_tree(spark, str(tree)).collect()) == [("n1", "a.png"), ("n2", "b.png")]
    assert {r.sha256 for r in rd.hashes(spark, str(tree)).collect()} == {"ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}
    assert {r["class"]: r.files for r in sinks.class_manifest(rd.image_tree(spark, str(tree))).collect()} == {"n1": 1, "n2": 1}
    (tmp_path / "abl.csv").write_text("variant,images,full_masks,windows,rescue,generated,crop_candidates,scored,crop_merged,merged,final_annotations\nbaseline,100,98,1200,386,1189,1189,1189,398,496,496\n")
    assert rd.csv_table(spark, str(tmp_path / "abl.csv"), rd.ABLATION).first().merged == 496


def test_bundle_round_trip(spark, tmp_path):
    images = spark.createDataFrame([(1, "a.jpg", 20, 10, "d", 1, "", "")], rd.IMAGES)
    anns = spark.createDataFrame([(1, 1, 1, 0, 4.0, [0.0, 0.0, 2.0, 2.0], Row(size=[10, 20], counts="6"), 20, 10)], rd.ANNOTATIONS)
    cats = spark.createDataFrame([(1, "fg", "fg")], rd.CATEGORIES)
    sinks.write_coco(str(tmp_path / "c"), images, anns, cats, "test")
    back = rd.coco(spark, str(tmp_path / "c"))
    assert back["images"].collect() == images.collect() and back["annotations"].first().segmentation.counts == "6" and back["categories"].count() == 1
    assert rd.coco(spark, str(tmp_path / "c"), swap_wh=True)["images"].first().width == 10
    (tmp_path / "partial.json").write_text(json.dumps({"images": [{"id": 1}], "annotations": [{"image_id": 1}]}))
    part = rd.coco(spark, str(tmp_path / "partial.json"))
    assert part["annotations"].first().area is None and part["categories"].count() == 0
    sinks.write_split(str(tmp_path / "s"), mg.split_fanout({"normal": anns, "combined": anns}))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("split").count().count() == 2
    for _ in range(2):
        sinks.append_checkpoint(str(tmp_path / "k"), anns.withColumn("class", F.lit("n1")))
    # Writing a finished class again replaces it.
    assert spark.read.parquet(str(tmp_path / "k")).count() == 1
    debug = sinks.debug_records(anns.select("image_id", F.lit("normal").alias("split"), F.lit(1).alias("rank"), "area")).first().value
    assert json.loads(debug)["splits"]["normal"][0]["area"] == 4.0


def test_summaries(spark):
    stats = st.label_stats(spark.range(1500).select("id"), spark.createDataFrame([(1, 5.0)], "image_id long, area double"))
    lines = [r.line for r in sinks.stats_table(stats, stats).orderBy("n").collect()]
    assert "| Total images | 1,500 | 1,500 |" in lines and any("1 (100.0%)" in x for x in lines)
    p = spark.createDataFrame([("a", 1), ("b", 2)], "variant string, images int")
    e = spark.createDataFrame([("b", 0.5), ("c", 0.1)], "variant string, ap double")
    out = sinks.summary(p, e)
    assert [tuple(r) for r in out["csv"].collect()] == [("a", "1", ""), ("b", "2", "0.5"), ("c", "", "0.1")]
    assert out["md"].first().value == "| a | 1 |  |" and sinks.output_name("x", {"k": 2}, (0, 5)) == "x_k2_0_5"


def test_paths_lists_presets(spark):
    images = spark.createDataFrame([("n1/a.jpg",), ("n1\\b.jpg",), ("c.jpg",), ("none.jpg",)], "file_name string")
    files = spark.createDataFrame([("n1/a.jpg",), ("n1/images/b.jpg",), ("z/c.jpg",), ("y/c.jpg",)], "rel string")
    assert {r.file_name: r.path for r in rd.resolve_paths(images, files).collect()} == {"n1/a.jpg": "n1/a.jpg", "n1\\b.jpg": "n1/images/b.jpg", "c.jpg": "y/c.jpg", "none.jpg": None}
    paths = spark.createDataFrame([("x_multiscale.json",), ("x_raw_multiscale.json",)], "path string")
    assert rd.pick_file(paths, "_multiscale.json", ("_raw_multiscale.json",)) == "x_multiscale.json"
    assert tuple(one(spark, rd.number_list(F.lit(" 1, ,2.5"), [1.0]), rd.number_list(F.lit(""), [0.35, 0.5]))) == ([1.0, 2.5], [0.35, 0.5])
    with pytest.raises(ValueError):
        rd.enum_list("a,b", ["a"])
    assert ps.select_steps("merge,baseline") == ["baseline", "merge"]
    assert ps.resolve("final")["keep_topk"] == 2 and ps.resolve("final", keep_topk=5)["keep_topk"] == 5 and ps.resolve()["heatmap_spatial_rescue"] == -1
    kv = lambda *r: spark.createDataFrame(list(r), "name string, value string")
    assert {r.name: r.value for r in ps.resolve_table(kv(("a", "3")), kv(("a", "2"), ("b", "2")), kv(("a", "1"), ("b", "1"), ("c", "1"))).collect()} == {"a": "3", "b": "2", "c": "1"}
    with pytest.raises(ValueError):
        ps.equal_split(99, 20, 5)
    ps.register(spark, "base", spark.range(1), spark.range(2))
    assert spark.sql("SELECT count(*) AS n FROM base_annotations").first().n == 2
    assert ps.file_uri("/tmp/x").startswith("file:///") and ps.file_uri("s3a://b/x") == "s3a://b/x"
    assert [r.id for r in st.sample(spark.range(100), "id", 5).collect()] == [r.id for r in st.sample(spark.range(100).repartition(7), "id", 5).collect()]


def test_metrics_stream(spark, tmp_path):
    from segmill.streaming.metrics import running_summary, stream_points

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.jsonl").write_text('{"iteration": 1, "total_loss": 2.5}\nbad\n{"iteration": 5, "total_loss": 1.5}\n')
    q = running_summary(stream_points(spark, str(src))).writeStream.format("memory").queryName("points").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert tuple(spark.table("points").first()) == (5, 1.5, 2)


def test_range_join_reaches_every_image(spark):
    from segmill.plans import queries as qs

    boxes = {}
    for r in fx.annotations(spark, D).filter("source = 'baseline'").collect():
        boxes.setdefault(r.image_id, []).append(r)
    lattice = [(x, y) for x in range(0, 160, 20) for y in range(0, 160, 20)]
    under = {i: {(x, y) for x, y in lattice if any(f.l <= x < f.r and f.t <= y < f.b for f in b)} for i, b in boxes.items()}
    windows = wn.grid_windows(spark, fx.SIZE, [1.0, 0.75, 0.5]).collect()
    want = {(i, w.ord): sum(w.x <= x < w.x + w.w and w.y <= y < w.y + w.h for x, y in p) for i, p in under.items() for w in windows}
    got = {(r.image_id, r.ord): r.covered_points for r in qs.q_range_join_points(spark, D).collect()}
    assert got == want and len(boxes) > 100


def test_union_takes_every_mask_of_an_image(spark, monkeypatch):
    from segmill.plans import queries as qs

    rows = fx.masks(spark, D).collect()
    want = {}
    for r in rows:
        want[r.image_id] = [a | b for a, b in zip(want.get(r.image_id, [0] * 64), r.bits)]
    assert {r.image_id: r.area for r in qs.q_union_masks(spark, D).collect()} == {i: sum(v) for i, v in want.items()}
    # One pixel a mask, so that each mask left out is missed.
    sparse = spark.createDataFrame([(i, i // 25, [int(k == i % 25) for k in range(64)]) for i in range(75)], "mask_id long, image_id long, bits array<tinyint>")
    monkeypatch.setattr(fx, "masks", lambda spark, d: sparse)
    assert {r.image_id: r.area for r in qs.q_union_masks(spark, D).collect()} == {0: 25, 1: 25, 2: 25}


def _plain_coco(gt, pred):
    """COCO's matching and envelope, image by image."""
    def iou(a, c):
        i = max(0, min(a[4], c[4]) - max(a[2], c[2])) * max(0, min(a[5], c[5]) - max(a[3], c[3]))
        return i / ((a[4] - a[2]) * (a[5] - a[3]) + (c[4] - c[2]) * (c[5] - c[3]) - i)

    def one(lo, hi, at):
        marks, n = [], sum(lo <= a[6] <= hi for a in gt)
        for image in {p[0] for p in pred}:
            own, used = [a for a in gt if a[0] == image], set()
            for p in sorted((p for p in pred if p[0] == image), key=lambda p: (-p[7], p[8])):
                free = sorted((not lo <= a[6] <= hi, -iou(a, p), a[1]) for a in own if a[1] not in used and iou(a, p) >= at)
                if free:
                    used.add(free[0][2])
                if not (free[0][0] if free else not lo <= p[6] <= hi):
                    marks.append((p[7], bool(free)))
        curve = []
        for s in sorted({m[0] for m in marks}, reverse=True):
            upto = [m[1] for m in marks if m[0] >= s]
            curve.append((sum(upto) / n if n else 0, sum(upto) / len(upto)))
        return sum(max((p for r, p in curve if r >= k / 100 - 1e-9), default=0) for k in range(101)) / 101 if n else None

    levels = [round(0.5 + 0.05 * k, 2) for k in range(10)]
    mean = lambda lo, hi: None if one(lo, hi, 0.5) is None else sum(one(lo, hi, t) for t in levels) / 10
    return [mean(0, 1e10), one(0, 1e10, 0.5), one(0, 1e10, 0.75), mean(0, 1024), mean(1024, 9216), mean(9216, 1e10)]


def test_coco_ap_equals_plain(spark):
    rng = np.random.default_rng(11)
    gt, pred = [], []
    for i in range(160):
        side = int(rng.choice([12, 31, 32, 33, 60, 96, 97, 120]))
        gt.append((i // 8, i, x := int(rng.integers(0, 30)), y := int(rng.integers(0, 30)), x + side, y + side, side * side))
        for k in range(2):
            d = [int(v) for v in rng.integers(0, 1 + side // 6, 4)]
            b = (x + d[0], y + d[1], x + side + d[2], y + side + d[3])
            pred.append((i // 8, 1000 + 2 * i + k, *b, (b[2] - b[0]) * (b[3] - b[1]), float(rng.integers(0, 40)), 2 * i + k))
    kind = "image_id long, ann_id long, l int, t int, r int, b int, area int"
    for own in (gt, [a for a in gt if a[6] > 1024]):
        got = ev.coco_ap(spark.createDataFrame(own, kind), spark.createDataFrame(pred, kind + ", score double, ord int")).first()
        want = _plain_coco(own, pred)
        assert list(got.asDict()) == ["AP", "AP50", "AP75", "APs", "APm", "APl"]
        assert all(a is b is None or abs(a - b) < 1e-9 for a, b in zip(got, want)), (got, want)
        assert (got.APs is None) == (own is not gt) and 0 < got.AP < got.AP50


def test_average_precision_query_gives_six_figures(spark):
    from segmill.plans import queries as qs

    got = qs.q_average_precision(spark, D).first()
    assert list(got.asDict()) == ["AP", "AP50", "AP75", "APs", "APm", "APl"]
    assert abs(got.AP50 - ev.average_precision(*qs._gt_pred(spark, D)).first().ap) < 1e-6
