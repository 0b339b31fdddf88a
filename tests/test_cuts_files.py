"""Normalised cuts against dense ones, one JSON file in splits against the whole reader, copies of files, and the generator's edge cases."""

import hashlib
import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.operators import graph as gr
from segmill.operators import runs as rn
from segmill.operators import windows as wn
from segmill.plans import generator as gn
from segmill.sources import readers as rd
from segmill.sources import sinks as sk

from . import plain_rle as rle
from .test_runs import plain_flood


def dense_vector(a):
    root = 1 / np.sqrt(a.sum(axis=1))
    _, v = np.linalg.eigh(root[:, None] * (np.diag(a.sum(axis=1)) - a) * root[None])
    v = v[:, 1] * root
    return v * np.sign(v[np.abs(v).argmax()])


def unit_rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    f = rng.standard_normal((5, dims))[rng.integers(0, 5, n)] + 0.9 * rng.standard_normal((n, dims))
    return f / np.linalg.norm(f, axis=1, keepdims=True)


@pytest.mark.parametrize("n,dims", [(2, 3), (25, 64), (400, 32), (400, 8)])
def test_lanczos_equals_dense(n, dims):
    f = unit_rows(n, dims, n + dims)
    a = np.where(f @ f.T > 0.2, 1.0, 1e-5)
    v, want = gr.second_vector(gr.Affinity(f, block=64)), dense_vector(a)
    assert np.abs(v - want).max() < 1e-6 * np.abs(want).max()


def test_affinity_applies_the_matrix():
    f = unit_rows(70, 6, 1)
    a, x = np.where(f @ f.T > 0.2, 1.0, 1e-5), np.random.default_rng(0).standard_normal(70)
    block = gr.Affinity(f, block=16)
    assert np.allclose(block @ x, a @ x) and np.allclose(block.degree, a.sum(axis=1))


def test_cut_at_full_size_in_little_memory():
    f = unit_rows(3600, 32, 3)
    tracemalloc.start()
    a = gr.Affinity(f)
    v = gr.second_vector(a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lap = a.degree * v - a @ v
    s = (v @ lap) / (v @ (a.degree * v))
    # The dense matrix alone would be 104 MB.
    assert np.abs(lap - s * a.degree * v).max() < 1e-8 * a.degree.max() and peak < 40e6


def plain_cuts(feat, shape, rounds, tau=0.2):
    """The iterative cut with dense matrices and a pixel-by-pixel flood."""
    feat, painted, before, masks = feat.copy(), np.zeros(shape, dtype=bool), None, []
    for _ in range(rounds):
        if before is not None:
            painted |= before
            feat[painted.ravel()] = 0
        u = feat / np.maximum(np.linalg.norm(feat, axis=1, keepdims=True), 1e-12)
        v = dense_vector(np.where(u @ u.T > tau, 1.0, 1e-5))
        v = np.round(v / np.abs(v).max(), 9)
        fg = (v > v.mean()).reshape(shape)
        seed = int(v.argmax())
        if fg[[0, 0, -1, -1], [0, -1, 0, -1]].sum() >= 3 or not fg.flat[np.abs(v).argmax()]:
            fg, seed = ~fg, int(v.argmin())
        m = plain_flood(fg, *divmod(seed, shape[1]))
        if before is not None and ((m & before).sum() / max(1, (m | before).sum()) > 0.5 or m.mean() <= 0.01):
            m = np.zeros(shape, dtype=bool)
        seen = np.logical_or.reduce(masks) if masks else np.zeros(shape, dtype=bool)
        masks.append(m & ~seen)
        before = m
    return masks


def test_cut_masks_equal_plain(spark):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for image in range(6):
        h, w = int(rng.integers(5, 9)), int(rng.integers(5, 9))
        f = rng.standard_normal((3, 8))[rng.integers(0, 3, h * w)] + 1.5 * rng.standard_normal((h * w, 8))
        rows += [(image, y, x, f[y * w + x].tolist()) for y in range(h) for x in range(w)]
        want |= {(image, k): m.ravel().astype(int).tolist() for k, m in enumerate(plain_cuts(f, (h, w), 3))}
    df = spark.createDataFrame(rows, "image_id long, y int, x int, feat array<double>").repartition(3)
    assert {(r.image_id, r.round): list(r.bits) for r in gr.cut_masks(df, rounds=3).collect()} == want


def bundle(spark, n):
    images = spark.createDataFrame([(i, f'{{"{i}\\" }}.jpg', 4, 5, None, None, None, None) for i in range(n)], rd.IMAGES)
    anns = spark.createDataFrame([(i, i % n, 1, 0, float(i), [0.0, 1.0, 2.0, 3.0], ([4, 5], 'a}{"\\' + str(i)), 4, 5) for i in range(3 * n)] + [(None, None, None, None, None, None, None, None, None)], rd.ANNOTATIONS)
    return images, anns, spark.createDataFrame([(1, "object", "object")], rd.CATEGORIES)


@pytest.mark.parametrize("size", ["97", "1000", "128m"])
def test_one_file_in_splits_equals_whole(spark, tmp_path, size):
    """Splits may fall anywhere: inside names, escapes and braces in strings."""
    path = str(tmp_path / "one")
    sk.write_coco(path, *bundle(spark, 30), 'of "{tests}"')
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert size == "128m" or spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
        found = rd.coco_split(spark, path)
        want = rd.coco(spark, path)
        for k in ("images", "annotations", "categories"):
            rows = [sorted(map(str, d.select(*want[k].columns).collect())) for d in (found[k], want[k])]
            # A record without any value has no keys that tell its kind.
            assert rows[0] == [r for r in rows[1] if r.count("None") < len(want[k].columns) - 1] or rows[0] == rows[1]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_swapped_sides_and_spaces_in_one_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"info": {"description": "x"}, "licenses": [{"id": 1, "name": "n", "url": "u"}], "categories": [], "images": [{"id": 1, "file_name": "f", "width": 2, "height": 3}], "annotations": [{"image_id": 1, "id": 4}]}, indent=2))
    found = rd.coco_split(spark, str(tmp_path / "a.json"), swap_wh=True)
    assert [(r.width, r.height) for r in found["images"].collect()] == [(3, 2)] and found["annotations"].first().id == 4 and found["categories"].count() == 0


def test_snapshot_copies_and_checks(spark, tmp_path):
    source, target = tmp_path / "from", tmp_path / "to"
    for i, content in enumerate((b"", b"\x00\xff" * 1000, b"text")):
        (source / f"d{i}").mkdir(parents=True)
        (source / f"d{i}" / "f.bin").write_bytes(content)
    for _ in range(2):
        rows = {r.name: r for r in sk.snapshot_copy(spark, str(source), str(target)).collect()}
        assert sorted(rows) == ["d0/f.bin", "d1/f.bin", "d2/f.bin"] and all(r.intact for r in rows.values())
    assert rows["d1/f.bin"].sha256 == hashlib.sha256(b"\x00\xff" * 1000).hexdigest() and (target / "d1" / "f.bin").read_bytes() == b"\x00\xff" * 1000
    assert rows["d0/f.bin"].size_bytes == 0


def test_masks_in_windows(spark):
    rng = np.random.default_rng(5)
    masks = [rng.random((9, 7)) < 0.4 for _ in range(4)]
    rows = [(i % 2, rle.runs(m)) for i, m in enumerate(masks)]
    win = [(i, k, *map(int, (l, t, r, b))) for i in range(3) for k, (l, t, r, b) in enumerate([(0, 0, 7, 9), (2, 3, 5, 8), (4, 4, 4, 6), (6, 0, 7, 1)])]
    found = wn.mask_coverage(spark.createDataFrame(win, "image_id int, ord int, l int, t int, r int, b int"), spark.createDataFrame(rows, "image_id int, counts array<int>"), 9).collect()
    for r in found:
        union = masks[r.image_id] | masks[r.image_id + 2] if r.image_id < 2 else np.zeros((9, 7), dtype=bool)
        assert r.covered_pixels == union[r.t : r.b, r.l : r.r].sum()
    assert len(found) == 12


def test_masks_are_placed_as_pixels_are(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for i in range(40):
        gh = int(rng.integers(1, 6))
        raw, ref = rng.random((gh, 4)) < 0.6, rng.random((gh, 4)) < 0.5
        l, t = int(rng.integers(-3, 12)), int(rng.integers(-3, 10))
        r, b = l + int(rng.integers(1, 12)), t + int(rng.integers(1, 12))
        rows.append((i, raw.ravel().astype(int).tolist(), ref.ravel().astype(int).tolist(), l, t, r, b))
        big = np.array([[ref[int((y + 0.5) * gh / (b - t)), int((x + 0.5) * 4 / (r - l))] for x in range(r - l)] for y in range(b - t)])
        canvas = np.zeros((11, 13), dtype=bool)
        for y in range(b - t):
            for x in range(r - l):
                if 0 <= y + t < 11 and 0 <= x + l < 13:
                    canvas[y + t, x + l] = big[y, x]
        want[i] = canvas, (raw & ref).sum() / max(1, (raw | ref).sum()), big
    df = spark.createDataFrame(rows, "i int, raw array<tinyint>, ref array<tinyint>, l int, t int, r int, b int")
    for r in df.select("i", rn.placed("raw", "ref", F.struct("l", "t", "r", "b"), 4, 13, 11).alias("m")).collect():
        canvas, iou, big = want[r.i]
        assert r.m.counts == rle.runs(canvas) and r.m.area == canvas.sum() and abs(r.m.crf_iou - iou) < 1e-12 and r.m.pixels == big.sum()
        assert tuple(r.m.edges) == (big[0].sum(), big[-1].sum(), big[:, 0].sum(), big[:, -1].sum())
        if canvas.any():
            ys, xs = np.nonzero(canvas)
            assert tuple(r.m.box) == (ys.min(), xs.min(), ys.max(), xs.max())


def test_generator_without_any_cut(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    none = lambda w: w.limit(0).select(*gn.WINDOW, F.lit(0).cast("long").alias("mask_id"), F.array(F.lit(0).cast("tinyint")).alias("raw"), F.array(F.lit(0).cast("tinyint")).alias("refined"))
    splits, counters = gn.generate(images, none, gn.Settings(48, 48, 8, 48))
    assert splits.count() == 0
    for r in counters.collect():
        # No window has a candidate, so every one is tried again, at both scales.
        assert (r.full_masks, r.total_windows, r.skipped_covered, r.eligible_windows, r.generated_crop_candidates, r.merged_masks) == (0, 14, 0, 13, 0, 0)
        assert r.border_retry_windows == 26


def test_generator_on_proposed_windows(spark):
    images = spark.createDataFrame([(1,)], "image_id long")
    proposed = spark.createDataFrame([(1, 1, 0, 0, 24, 24, 2.0, "heatmap"), (1, 2, 24, 24, 48, 48, 1.0, "spatial_rescue")], "image_id long, ord int, l int, t int, r int, b int, score double, reason string")
    dot = [1 if i in (27, 28, 35, 36) else 0 for i in range(64)]

    def cut(w):
        bits = F.array(*[F.lit(v).cast("tinyint") for v in dot])
        return w.select(*gn.WINDOW, (F.col("window_id") + 10).cast("long").alias("mask_id"), bits.alias("raw"), bits.alias("refined"))

    splits, counters = gn.generate(images, cut, gn.Settings(48, 48, 8, 48, merge={"max_ratio": 0.5}), heatmap=proposed)
    r = counters.first()
    assert (r.full_masks, r.total_windows, r.ranked_windows, r.rescue_windows, r.crop_candidates, r.crop_merged_masks, r.merged_masks, r.border_retry_windows) == (1, 2, 2, 1, 2, 2, 3, 0)
    assert {(s.split, s.area) for s in splits.collect()} == {("normal", 144), ("raw_multiscale", 36), ("multiscale", 36), ("combined", 144), ("combined", 36)}
